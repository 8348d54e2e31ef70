"""Exact quantiles, in SQL."""

from oracle.rules import with_views

PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _quantiles(table: str, by: str, columns: tuple[str, ...], function: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {by}, '{c}' AS column_name, count({c}) AS value_count, CAST({p} AS DOUBLE) AS probability, "
        f"round({function}(CAST({c} AS DOUBLE), {p}), 6) AS quantile FROM {table} GROUP BY {by} HAVING count({c}) > 0"
        for c in columns for p in PROBABILITIES)


QUANTILES = {
    "k24_quantiles": _quantiles("lineitem", "l_returnflag, l_linestatus", ("l_quantity", "l_extendedprice", "l_discount"),
                                "quantile_disc"),
    "stat_006_quantiles": with_views(_quantiles(
        "applications", "address_state", ("annual_income", "fico_score_at_application", "debt_to_income_ratio"), "quantile_cont")),
}
