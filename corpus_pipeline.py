"""From raw documents to packed training sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanward.llm.common import Scratch, send_package
from loanward.llm.jaccard import labelled
from loanward.llm.language import SURE, identify
from loanward.llm.packing import pack
from loanward.llm.quality import judge
from loanward.llm.repeats import without_repeats

#: Ids up to this many are broadcast to take documents out; beyond, the join shuffles.
BROADCAST_ROWS = 400_000


def _with_row(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns a stage reads beside the whole row, so that other columns can't clash with what it adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *needed)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which letters stand and one learned language has most of the posterior; the others go.

    The posterior is over the learned languages only, so a longer text in another language, or letter junk, stays
    under the learned language that it is least unlike. Nothing measures how well a text fits at all.
    """
    send_package(spark)
    found = identify(_with_row(docs, "doc_id", "text", "lang"), carry=["row"], within="row")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and come from no rejected host."""
    send_package(spark)
    return judge(_with_row(docs, "text", "source"), carry=["row"]).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones, that with the least id and then text key; a null id comes last.

    Rows that share an id are one document, of which one row stays: one that leads its group, with words if there is
    one, then that with the least text key. Rows with equal id and text are told apart by all their columns. Rows
    without words are linked to none; those of them that lack an id too all stay.
    """
    send_package(spark)
    scratch = Scratch(spark, "near")
    keyed = scratch.put("keyed", labelled(docs).groupBy("doc_id", "text_key").agg(
        F.min("comp").alias("comp"), F.count(F.lit(1)).alias("rows")))
    leaders = keyed.where("comp is not null").groupBy("comp").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("least"))
    leads = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))
    worded = keyed.join(leaders, "comp").select("doc_id", "text_key", "rows", leads.alias("leads"), F.lit(False).alias("empty"))
    empty = keyed.where("comp is null").select("doc_id", "text_key", "rows", F.lit(True).alias("leads"), F.lit(True).alias("empty"))
    led = scratch.put("led", worded.unionByName(empty))
    chosen = led.where("doc_id is not null and leads").groupBy("doc_id").agg(
        F.min(F.struct("empty", "text_key"))["text_key"].alias("chosen"))
    verdicts = led.join(chosen, "doc_id", "left").select(
        F.col("doc_id").alias("special_id"), F.col("text_key").alias("special_key"), "rows",
        F.when(F.col("doc_id").isNull(), F.col("leads")).otherwise(
            F.coalesce(F.col("text_key") == F.col("chosen"), F.lit(False))).alias("stays"),
        (F.col("doc_id").isNull() & F.col("empty")).alias("free"))
    special = scratch.put("special", verdicts.where("not free and (not stays or rows > 1)").select(
        "special_id", "special_key", "stays"))
    if special.count() <= BROADCAST_ROWS:
        special = F.broadcast(special)
    key = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    marked = _with_row(docs, F.col("doc_id").cast("long").alias("id"), key.alias("key")).join(
        special, F.col("id").eqNullSafe(F.col("special_id")) & (F.col("key") == F.col("special_key")), "left")
    plain = marked.where("special_key is null").select("row.*")
    repeated = marked.where("stays").groupBy("special_id", "special_key").agg(
        F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row")).select("row.*")
    return plain.unionByName(repeated)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without what stands more than once: strings of op1's size, and passages of over 50 words."""
    send_package(spark)
    clean = without_repeats(docs, words=True)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
            F.length("text")).cast(kind))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences."""
    send_package(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("packing", packing),
]

#: Language identification, the exact set join and the packing plan have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents in ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
