"""Existence by filtered keys in SQL."""

SIEVE = {
    "k32_sieved_holders": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN "
                          "(SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)",
    "k01_sieved_orphans": "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS "
                          "(SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_acctbal < -500)",
}
