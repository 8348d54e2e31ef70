"""SQL statements over frames.

Statements with many expressions are handed to Spark as one text; building them column by
column costs a round trip to the JVM for each expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def literal(value) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def over(frames: dict[str, DataFrame], text: str) -> DataFrame:
    """A SQL statement over frames that it names as ``{name}``; other braces stay."""
    for name in frames:
        text = text.replace("{" + name + "}", f"\0{name}\1")
    text = text.replace("{", "{{").replace("}", "}}").replace("\0", "{").replace("\1", "}")
    return next(iter(frames.values())).sparkSession.sql(text, **frames)
