"""Exact duplicates by a heavy-hitter split; DataFrame functions only.

Digests of all texts are written once. A Misra-Gries sketch over them (``approx_top_k``) names
at most ``HEAVY`` frequent digests; a sketch may miss or overrate, so their exact counts and
winners come from one aggregate that is reduced before it is shuffled. The winners, at most
``HEAVY`` rows, are broadcast and settle every row of a frequent digest where it is read. All
other digests are shuffled once, and none of those groups can hold more than about
rows / ``TRACKED`` rows.

Defined cases: a null text counts as empty; equal length and text falls to the smallest doc_id;
a null doc_id comes after all others; rows that repeat a doc_id with its text get equal results;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopwise.llm.common import body, stored, table

#: Frequent digests that are broadcast, and counters of the sketch that finds them.
HEAVY = 1_000
TRACKED = 10_000

#: One more than the largest id, and the unit of lengths in a rank.
ABOVE_IDS = Decimal(2**63)
UNIT = Decimal(10**20)


def digest(text: Column) -> Column:
    """SHA-256 of the text without its ASCII white space."""
    return F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").cast("binary"), 256)


def _rank() -> Column:
    """Longer texts first, then smaller ids, as one number: a hash aggregate can keep its maximum.

    A decimal holds 38 digits; lengths take the upper ones, 2^63 - doc_id (0 for null) the rest.
    """
    from_end = F.lit(ABOVE_IDS) - F.col("doc_id").cast("decimal(20,0)")
    return F.col("n_points").cast("decimal(11,0)") * F.lit(UNIT) + F.coalesce(from_end, F.lit(0))


def _id_of(rank: Column) -> Column:
    from_end = rank % F.lit(UNIT)
    return F.when(from_end > 0, (F.lit(ABOVE_IDS) - from_end).cast("long"))


def digests(docs: DataFrame) -> DataFrame:
    text = body()
    return docs.select("doc_id", F.length(text).alias("n_points"), digest(text).alias("text_sha256"))


def frequent(found: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """At most ``heavy`` digests that a Misra-Gries sketch holds for frequent."""
    top = found.agg(F.expr(f"approx_top_k(text_sha256, {heavy}, {tracked})").alias("top"))
    return top.select(F.explode("top").alias("t")).where("t.count > 1").select("t.item").toDF(
        "text_sha256"
    )


def find_copies(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = stored(digests(docs), "digests")
    names = stored(frequent(found, heavy, tracked), "frequent")
    winners = (
        found.join(F.broadcast(names), "text_sha256")
        .withColumn("rank", _rank())
        .groupBy("text_sha256")
        .agg(F.max("rank").alias("best"), F.count("*").alias("group_size"))
    )
    winners = winners.select("text_sha256", "group_size", _id_of(F.col("best")).alias("keep_id"))
    hot = found.join(F.broadcast(winners), "text_sha256")

    group = Window.partitionBy("text_sha256")
    best_first = group.orderBy(F.desc("n_points"), F.asc_nulls_last("doc_id")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rare = (
        found.join(F.broadcast(names), "text_sha256", "left_anti")
        .withColumn("keep_id", F.first("doc_id").over(best_first))
        .withColumn("group_size", F.count("*").over(group))
    )
    columns = ("doc_id", "n_points", "text_sha256", "keep_id", "group_size")
    return (
        hot.select(*columns)
        .unionByName(rare.select(*columns))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
        )
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns. Rows that repeat a doc_id with an equal text
    stay once."""
    keys = find_copies(docs).where("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest")
    )
    tagged = docs.withColumn("__digest", digest(body()))
    same = tagged["doc_id"].eqNullSafe(keys["__id"]) & (tagged["__digest"] == keys["__digest"])
    stay = tagged.join(keys, same, "left_semi")
    # The first of the rows that share id and digest; the join has already brought them together.
    once = Window.partitionBy("doc_id", "__digest").orderBy(F.desc(F.length(body())))
    return stay.withColumn("__n", F.row_number().over(once)).where("__n = 1").select(*docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept,
       text_sha256
FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
