"""Rows, nulls and bounds of the star tables, and ranges that they prove, in SQL."""

#: Columns by table; those with a plus are numbers, whose bounds footers hold.
_COLUMNS = {
    "region": "+r_regionkey r_name",
    "nation": "+n_nationkey n_name +n_regionkey",
    "customer": "+c_custkey c_name +c_nationkey +c_acctbal c_mktsegment",
    "supplier": "+s_suppkey s_name +s_nationkey +s_acctbal",
    "part": "+p_partkey p_name p_brand p_type +p_size +p_retailprice",
    "orders": "+o_orderkey +o_custkey o_orderstatus +o_totalprice o_orderdate o_orderpriority",
    "lineitem": "+l_orderkey +l_partkey +l_suppkey +l_linenumber +l_quantity +l_extendedprice +l_discount +l_tax "
                "l_returnflag l_linestatus l_shipdate",
    "events": "+event_id ts +user_id event_type +value props",
    "documents": "+doc_id text lang source +n_chars",
    "embeddings": "+vec_id embedding +label",
    "pages": "+page_id url html",
    "benchmark": "+item_id text",
    "labels": "+doc_id +quality +toxic",
    "conversations": "+conv_id +turn role text",
}


def _facts() -> str:
    rows = []
    for table, columns in _COLUMNS.items():
        for column in columns.split():
            name = column.removeprefix("+")
            low, high = (f"CAST({f}({name}) AS DOUBLE)" if column != name else "CAST(NULL AS DOUBLE)" for f in ("min", "max"))
            rows.append(f"SELECT '{table}' AS table_name, '{name}' AS column_name, count(*) AS row_count, "
                        f"count(*) - count({name}) AS null_count, {low} AS low, {high} AS high FROM {table}")
    return " UNION ALL ".join(rows)


#: table, column, low, high, whether nulls may stand, whether footers can prove the upper end (whole numbers).
_BOUNDS = (
    ("lineitem", "l_linenumber", 1, 7, False, True), ("lineitem", "l_quantity", 1, None, True, True),
    ("lineitem", "l_quantity", 1, 50, True, False), ("lineitem", "l_discount", 0.01, 0.09, True, False),
    ("lineitem", "l_orderkey", 10, None, False, True), ("lineitem", "l_extendedprice", None, None, False, True),
    ("orders", "o_totalprice", 0, None, False, True), ("orders", "o_orderkey", 0, None, True, True),
    ("orders", "o_totalprice", 2000, 400000, True, False), ("customer", "c_nationkey", 0, 24, False, True),
    ("customer", "c_acctbal", 0, None, True, True), ("events", "user_id", 0, None, False, True),
    ("events", "value", 0, 300, True, False), ("events", "event_id", None, None, False, True),
    ("documents", "n_chars", 1, 10000, True, True), ("documents", "lang", None, None, False, True),
)


def _bounds() -> str:
    rows = []
    for table, column, low, high, nulls, provable in _BOUNDS:
        parts = ([f"{column} < {low}"] if low is not None else []) + ([f"{column} > {high}"] if high is not None else [])
        parts += [] if nulls else [f"{column} IS NULL"]
        hit = f"count(*) FILTER (WHERE {' OR '.join(parts)})"
        ends = ["NULL" if x is None else str(x) for x in (low, high)]
        rows.append(f"SELECT '{table}' AS table_name, '{column}' AS column_name, CAST({ends[0]} AS DOUBLE) AS low, "
                    f"CAST({ends[1]} AS DOUBLE) AS high, {'TRUE' if provable else 'FALSE'} AND {hit} = 0 AS proved, {hit} AS violations FROM {table}")
    return " UNION ALL ".join(rows)


FOOTERS = {"io_02_column_facts": _facts(), "k05_proved_bounds": _bounds()}
