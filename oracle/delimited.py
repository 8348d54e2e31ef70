"""A CSV copy of the orders read by a declaration, in SQL over the orders themselves."""

_SOUND = "o_orderkey % 101 <> 7"


def _row(name: str, kind: str, presence: str = "PRESENT", bad: str = "FALSE", long: str = "FALSE") -> str:
    filled = "0" if presence == "MISSING" else f"count({name}) FILTER (WHERE {_SOUND})"
    return (f"SELECT '{name}' AS column_name, {kind} AS declared_type, '{presence}' AS presence, CAST({filled} AS BIGINT) AS filled, "
            f"count(*) FILTER (WHERE {_SOUND} AND {bad}) AS bad, count(*) FILTER (WHERE {_SOUND} AND {long}) AS too_long FROM orders")


_FAULTS = " UNION ALL ".join([
    f"SELECT '*' AS column_name, CAST(NULL AS VARCHAR) AS declared_type, 'PRESENT' AS presence, count(*) AS filled, "
    f"count(*) FILTER (WHERE NOT ({_SOUND})) AS bad, CAST(0 AS BIGINT) AS too_long FROM orders",
    _row("o_orderkey", "'BIGINT'"), _row("o_custkey", "'BIGINT'"), _row("o_orderstatus", "NULL", "EXTRA"),
    _row("o_totalprice", "'DECIMAL(12,2)'", bad="o_orderkey % 97 = 3"), _row("o_orderdate", "'DATE'", bad="o_orderkey % 89 = 5"),
    _row("o_orderpriority", "'VARCHAR(8)'", long="length(o_orderpriority) > 8"), _row("o_clerk", "'VARCHAR(15)'", "MISSING")])

_ROWS = f"""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 <> 3 THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 89 <> 5 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS o_orderdate,
  o_orderpriority, CAST(NULL AS VARCHAR) AS o_clerk FROM orders WHERE {_SOUND}
"""

DELIMITED = {"io_03_declared_faults": _FAULTS, "io_03_declared_rows": _ROWS}
