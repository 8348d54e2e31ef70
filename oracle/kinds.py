"""The rule kinds on the star-schema tables, in SQL."""

_STEPS = ("(SELECT *, lag(event_type) OVER w AS p_type, lag(value) OVER w AS p_value FROM events "
          "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")

KINDS = {
    "k01_foreign_key_orphan":
        "SELECT 'lineitem' AS child, l_orderkey AS key_value, count(*) AS violations FROM lineitem "
        "WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 2 UNION ALL "
        "SELECT 'events', user_id, count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 2 "
        "UNION ALL SELECT 'documents', doc_id, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 2",
    "k02_conditional_existence":
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' "
        "AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "k03_joined_predicate":
        "SELECT l_orderkey, count(*) AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
        "WHERE l_shipdate < o_orderdate GROUP BY 1",
    "k04_row_predicate": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0",
    "k05_range":
        "SELECT l_orderkey, l_linenumber, count(*) AS violations FROM lineitem "
        "WHERE l_discount < CAST(0.01 AS DOUBLE) OR l_discount > CAST(0.09 AS DOUBLE) GROUP BY 1, 2",
    "k06_enumeration":
        "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('signup', 'click', 'view', 'purchase')",
    "k07_cross_column":
        "SELECT l_orderkey, l_linenumber, count(*) AS violations FROM lineitem "
        "WHERE l_extendedprice / l_quantity > 2000 GROUP BY 1, 2",
    "k08_reconciliation":
        "SELECT o_orderkey, round(abs(net - o_totalprice), 4) AS difference FROM orders JOIN "
        "(SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS net FROM lineitem GROUP BY 1) "
        "ON l_orderkey = o_orderkey WHERE abs(net - o_totalprice) > 1000",
    "k09_text_format":
        "SELECT page_id, CAST(strlen(url) AS INTEGER) AS url_bytes FROM pages WHERE NOT starts_with(url, 'https://')",
    "k10_conditional_not_null":
        "SELECT doc_id FROM documents d WHERE lang = 'en' AND NOT EXISTS "
        "(SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality IS NOT NULL)",
    "k11_event_after_anchor":
        "SELECT event_id, user_id FROM events e WHERE event_type = 'purchase' AND ts > "
        "(SELECT max(ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup')",
    "k12_first_event_against_dimension":
        "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - CAST(first_ship AS DATE) AS INTEGER) AS days_early FROM orders JOIN "
        "(SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey "
        "WHERE first_ship < o_orderdate",
    "k13_group_sum_against_cap":
        "SELECT o_orderkey, round(total, 2) AS total FROM orders JOIN "
        "(SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey "
        "WHERE total > 3 * o_totalprice",
    "k14_terminal_state":
        f"SELECT user_id, count(*) AS violations FROM {_STEPS} "
        "WHERE p_type = 'purchase' AND event_type != 'purchase' GROUP BY 1",
    "k15_monotonic_measure":
        f"SELECT event_id, user_id, p_value AS prev_value, value FROM {_STEPS} WHERE value > p_value + 1",
    "k16_sequence_gap":
        "SELECT o_orderkey, o_custkey, CAST(gap AS INTEGER) AS gap FROM (SELECT o_orderkey, o_custkey, "
        "CAST(o_orderdate AS DATE) - CAST(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS gap "
        "FROM orders) WHERE gap > 365 OR gap < 7",
    "k17_latest_snapshot":
        "SELECT o_orderkey, o.o_custkey, strftime(o_orderdate, '%Y-%m') AS month, order_count FROM orders o JOIN "
        "(SELECT o_custkey, count(*) AS order_count FROM orders GROUP BY 1) c ON c.o_custkey = o.o_custkey "
        "WHERE strftime(o_orderdate, '%Y-%m') = (SELECT max(strftime(o_orderdate, '%Y-%m')) FROM orders)",
    "k18_key_uniqueness":
        "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS violations FROM lineitem",
    "k19_row_parity":
        "SELECT *, abs(n_left - n_right) AS violations FROM (SELECT (SELECT count(*) FROM documents) AS n_left, "
        "(SELECT count(*) FROM labels) AS n_right)",
    "k20_key_parity":
        "SELECT *, CASE WHEN abs(n_left - n_right) > 100 THEN abs(n_left - n_right) ELSE 0 END AS violations FROM "
        "(SELECT (SELECT count(DISTINCT o_orderkey) FROM orders) AS n_left, "
        "(SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_right)",
    "k21_one_to_one":
        "SELECT d.doc_id, count(l.doc_id) AS children FROM (SELECT DISTINCT doc_id FROM documents) d "
        "LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1 HAVING count(l.doc_id) != 1",
    "k03_pair_counts":
        "SELECT CASE WHEN ts < o_orderdate THEN 'before' ELSE 'after' END AS test, user_id, count(*) AS violations "
        "FROM events JOIN orders ON o_custkey = user_id WHERE event_type = 'purchase' AND o_orderstatus = 'F' "
        "AND ts IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY ALL",
    "k22_pair_counts":
        "WITH p AS (SELECT * FROM customer JOIN supplier ON s_nationkey = c_nationkey) "
        "SELECT 'poorer' AS test, c_mktsegment, count(*) AS violations FROM p WHERE c_acctbal < s_acctbal GROUP BY ALL "
        "UNION ALL SELECT 'far', c_mktsegment, count(*) FROM p WHERE c_acctbal < s_acctbal - 5000 OR c_acctbal > s_acctbal + 5000 GROUP BY ALL "
        "UNION ALL SELECT 'other_name', c_mktsegment, count(*) FROM p WHERE c_acctbal > 0 AND c_name <> s_name GROUP BY ALL "
        "UNION ALL SELECT 'pairs', c_mktsegment, count(*) FROM p GROUP BY ALL",
    "k22_cross_table_value":
        "SELECT c_nationkey, s_nationkey, count(*) AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
        "JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey "
        "WHERE c_nationkey != s_nationkey GROUP BY 1, 2",
    "k23_rate_in_band":
        "SELECT matching, total, round(matching * 100.0 / total, 6) AS pct, "
        "CASE WHEN matching * 100.0 / total BETWEEN 15 AND 25 THEN 'PASS' ELSE 'WARN' END AS status FROM "
        "(SELECT count(*) FILTER (WHERE event_type = 'purchase') AS matching, count(*) AS total FROM events)",
    "k24_distribution":
        "SELECT CAST(floor(o_totalprice / 50000) * 50000 AS BIGINT) AS bucket, count(*) AS row_count FROM orders GROUP BY 1",
    "k25_bucketed_mean":
        "SELECT CAST(floor(l_quantity / 10) * 10 AS BIGINT) AS bucket, count(*) AS row_count, "
        "round(avg(l_extendedprice), 4) AS avg_l_extendedprice FROM lineitem GROUP BY 1",
    "k25_correlation":
        "SELECT round(corr(l_quantity, l_extendedprice), 8) AS correlation, count(*) AS pairs FROM lineitem",
    "k26_cohort_rate":
        "SELECT strftime(o_orderdate, '%Y-%m') AS cohort, count(*) AS row_count, "
        + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS {s.lower()}_count" for s in "FOP") + ", "
        + ", ".join(f"round(count(*) FILTER (WHERE o_orderstatus = '{s}') * 100.0 / count(*), 6) AS {s.lower()}_pct" for s in "FOP")
        + " FROM orders GROUP BY 1",
    "k27_null_profile":
        "SELECT column_name, count(*) FILTER (WHERE v IS NULL) AS null_count, count(*) AS row_count, "
        "round(count(*) FILTER (WHERE v IS NULL) * 100.0 / count(*), 6) AS null_pct FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM d" for c in
            ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")) + ") GROUP BY 1",
    "k28_predicate_over_tables":
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS violations FROM {t} WHERE {c} > TIMESTAMP '2000-07-01'"
            for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))),
    "k29_duplicate_groups":
        "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "k30_amortization":
        "SELECT l_orderkey, count(*) AS violations, round(max(pmt), 6) AS largest_installment FROM "
        "(SELECT l_orderkey, l_extendedprice, CASE WHEN l_tax = 0 THEN o_totalprice / n ELSE "
        "o_totalprice * r * pow(1 + r, n) / (pow(1 + r, n) - 1) END AS pmt FROM "
        "(SELECT *, l_tax / 12 AS r, 12 * (1 + l_partkey % 6) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) "
        "WHERE abs(l_extendedprice - pmt) > 5000 GROUP BY 1",
    "k31_dispersion":
        "SELECT count(value) AS value_count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, "
        "min(value) AS minimum, max(value) AS maximum FROM events",
    "k32_flag_against_existence":
        "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 AND EXISTS "
        "(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)",
    "k33_schema_exhaustiveness":
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, {'TRUE' if there else 'FALSE'} AS present, "
            + (f"count({c})" if there else "count(NULL)") + f" AS filled FROM {t}"
            for t, c, there in (
                *[("orders", c, True) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")],
                ("orders", "o_clerk", False),
                *[("customer", c, True) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")],
                ("customer", "c_phone", False),
                *[("labels", c, True) for c in ("doc_id", "quality", "toxic")], ("labels", "source", False))),
    "k34_age_at_event":
        "SELECT l_orderkey, count(*) AS violations, round(max(age), 6) AS oldest FROM (SELECT l_orderkey, "
        "(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE)) / 365.25 AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey) "
        "WHERE age > 3 GROUP BY 1",
    "k35_token_count":
        "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'the')) AS INTEGER) AS tokens FROM documents "
        "WHERE len(regexp_extract_all(lower(text), 'the')) > 10",
}
KINDS["k27_null_profile"] = (
    "WITH d AS (SELECT documents.*, quality, toxic FROM documents LEFT JOIN (SELECT doc_id AS ld, max(quality) AS quality, "
    "max(toxic) AS toxic FROM labels GROUP BY 1) ON ld = doc_id) " + KINDS["k27_null_profile"])
