"""Existence tests that shuffle only rows which may pass: a Bloom filter of the parents' keys before the join.

The filter is a row of 64-bit words made by one aggregation (bits are joined on the map side, so at most as many rows
are shuffled per task as there are words) and stands in the child's scan as a scalar subquery. It lets no true key out,
so what is behind it, the exact join, gives the same rows with and without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each parent row: 3 hashes then let through about one of thirty strangers.
BITS_PER_KEY = 10
#: Bits of a filter at most: 32 MB.
MOST_BITS = 1 << 28
#: Keys from which a filter of that size is no use, as it would let most rows through.
MOST_KEYS = MOST_BITS // 3
_HASHES = 3


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(_HASHES)]


def _word(place: Column) -> Column:
    return F.shiftright(place, 6).cast("int")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))


def key_words(parents: DataFrame, key: str, bits: int) -> DataFrame:
    """One row with the filter's words (``words``), ``bits`` / 64 of them."""
    places = parents.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), bits))).alias("place"))
    set_words = places.groupBy(_word(F.col("place")).alias("word")).agg(F.bit_or(_bit(F.col("place"))).alias("bits"))
    every = parents.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"))
    filled = every.join(set_words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
    return filled.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all")).select(F.col("all.bits").alias("words"))


def may_hold(parents: DataFrame, key: str) -> Column | None:
    """Whether a row's key may be among the parents' keys; never false for one that is. None where there are too many.

    The parents are counted to size the filter, which by Parquet tables reads footers only.
    """
    rows = parents.count()
    if rows > MOST_KEYS:
        return None
    bits = 1 << max(10, (max(rows, 1) * BITS_PER_KEY - 1).bit_length())
    words = key_words(parents, key, min(bits, MOST_BITS)).scalar()
    tests = [F.get(words, _word(p)).bitwiseAND(_bit(p)) != 0 for p in _places(F.col(key), min(bits, MOST_BITS))]
    out = F.col(key).isNotNull()
    for test in tests:
        out = out & test
    return out


def sieved_holders(child: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows whose key is among the parents' keys; only rows that pass the filter are shuffled.

    Null keys have no parent, and repeated rows of either side are kept and ignored. The key has the same type on
    both sides. Meant for parents that are few (filtered), as for holders of a rare mark.
    """
    maybe = may_hold(parents, key)
    rows = child if maybe is None else child.where(maybe)
    return rows.join(parents.select(key).distinct(), key, "left_semi").select(*child.columns)


def sieved_orphans(child: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows whose key isn't among the parents' keys, null keys included.

    Rows that the filter stops are orphans for certain and aren't shuffled; the others are looked up. Meant for
    children that mostly have no such parent.
    """
    maybe = may_hold(parents, key)
    known = parents.select(key).distinct()
    if maybe is None:
        return child.join(known, key, "left_anti").select(*child.columns)
    return child.where(~maybe).unionByName(child.where(maybe).join(known, key, "left_anti").select(*child.columns))
