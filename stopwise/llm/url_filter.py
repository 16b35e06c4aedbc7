"""URL filtering by explicit rules and mined association rules; DataFrame functions only.

FP-growth (``pyspark.ml.fpm``) mines token combinations of the labelled urls together with the
outcome, block or allow. A combination becomes a rule for an outcome when it passes ``MIN_SUPPORT``,
``MIN_CONFIDENCE`` and ``MIN_LIFT``, and no part of it is a rule for that outcome of at least its
confidence. Rules are matched by an inverted index: a rule stands under its rarest token, the tokens
of each distinct url look it up there, and the remaining tokens of the rule are then tested on the
url's token set. Every other token of a url leaves at the join, and the number of rules is bounded
by the support, not by the number of urls.

A page's label is the verdict of the given rule that fits it, else that of the document of its id:
low quality or toxic means block. Given rules (host, path) go before mined ones; of several that
fit, the longest decides. Elsewhere the mined rule of the greatest confidence decides, at ties that
of the greatest support, then a block before an allow, then the greatest items. Where nothing fits
the page is allowed.

Defined cases: null urls and urls without ``://`` have empty host and path and no tokens; empty
tables and tables without any label give no mined rules; given rules of equal length that fit one
url are taken in their order as text; repeated pages get equal results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import stored, table

#: Share of labelled urls that a rule covers rightly, that of right ones among those it covers, and
#: how much more often the outcome must come with the rule than without regard to it.
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.1
#: Urls of its outcome that a rule rests on at least.
MIN_COUNT = 10

#: Host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

OUTCOME = "verdict="


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#``; A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, whole host, the words of its labels, path words, query names."""
    low = F.lower(F.coalesce(url, F.lit("")))
    labels = F.split(F.regexp_replace(host(url), r":\d*$", ""), r"\.")
    words = F.split(F.regexp_replace(path(low), r"\.", "/."), r"[/_-]+")
    query = F.regexp_extract_all(low, F.lit(r"[?&;]([^=&#;]+)="), 1)
    marked = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.regexp_extract(low, r"(?s)^(.*?)://", 1))),
        F.array(F.concat(F.lit("host:"), host(url))),
        F.transform(
            F.flatten(F.transform(labels, lambda x: F.split(x, "[-_]"))),
            lambda x: F.concat(F.lit("part:"), x),
        ),
        F.transform(words, lambda x: F.concat(F.lit("path:"), x)),
        F.transform(query, lambda x: F.concat(F.lit("query:"), x)),
    )
    useful = F.filter(marked, lambda x: ~x.rlike(r":(\d*|\.)$"))
    return F.when(low.contains("://"), F.array_distinct(useful)).otherwise(
        F.array().cast("array<string>")
    )


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and outcome, one row per labelled page; pages carry ``ruled``, a given rule's verdict."""
    bad = (F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    marks = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").alias("page_id"))
        .agg(F.max(bad).alias("bad"))
        .select("page_id", F.when(F.col("bad"), "block").when(~F.col("bad"), "allow").alias("told"))
    )
    return (
        pages.select("page_id", "url", "ruled")
        .join(marks, "page_id", "left")
        .select("url", F.coalesce("ruled", "told").alias("outcome"))
        .where("outcome is not null")
    )


def mine(
    seen: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """Rules: items (array), outcome, confidence, support, key (the rarest item)."""
    words = tokens(F.col("url"))
    items = F.concat(words, F.array(F.concat(F.lit(OUTCOME), "outcome")))
    baskets = stored(seen.where(F.size(words) > 0).select(items.alias("items")), "baskets")
    support = max(min_support, min_count / max(1, baskets.count()))
    model = FPGrowth(
        itemsCol="items", minSupport=min(1.0, support), minConfidence=min_confidence
    ).fit(baskets)
    sets = stored(model.freqItemsets, "itemsets")
    outcome = F.col("consequent")[0]
    rules = (
        model.associationRules.where(outcome.startswith(OUTCOME))
        .where(F.col("lift") >= min_lift)
        .select(
            F.array_sort("antecedent").alias("items"),
            F.substring(outcome, len(OUTCOME) + 1, 10).alias("outcome"),
            "confidence",
            "support",
        )
    )
    # Of baskets with one outcome each, no rule has the other one among its items.
    rules = stored(rules.where(F.size("items") > 0), "rules")
    # A rule is pruned when one of its parts is a rule of at least its confidence.
    shorter = rules.select(F.col("items").alias("part"), "outcome", F.col("confidence").alias("as_good"))
    parts = rules.select("items", "outcome", "confidence", F.explode("items").alias("left_out")).select(
        "items", "outcome", "confidence", F.array_except("items", F.array("left_out")).alias("part")
    )
    covered = (
        parts.join(shorter, ["part", "outcome"])
        .where("as_good >= confidence")
        .select("items", "outcome")
        .distinct()
    )
    rules = rules.join(covered, ["items", "outcome"], "left_anti")
    counts = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("key"), "freq")
    rarest = (
        rules.select("items", F.explode("items").alias("key"))
        .join(counts, "key")
        .groupBy("items")
        .agg(F.min(F.struct("freq", "key"))["key"].alias("key"))
    )
    return rules.join(rarest, "items").select("items", "outcome", "confidence", "support", "key")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, items, outcome and confidence of its best rule, for the distinct urls that one covers."""
    seen = urls.where("url is not null").select("url").distinct()
    seen = seen.withColumn("tokens", tokens(F.col("url")))
    found = seen.withColumn("key", F.explode("tokens")).join(rules, "key")
    covers = F.size(F.array_except("items", "tokens")) == 0
    return (
        found.where(covers)
        .groupBy("url")
        .agg(F.max(F.struct("confidence", "support", "outcome", "items")).alias("best"))
        .select("url", F.col("best.items").alias("mined_rule"), "best.outcome", "best.confidence")
    )


def judge(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES
) -> DataFrame:
    """One row per page: page_id, url, host, path, rule, verdict, mined_rule, confidence."""
    parts = pages.select(
        "page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")
    )
    longest_first = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [
        ((F.col("host") == name) | F.col("host").endswith(f".{name}"))
        & F.col("path").startswith(start)
        for name, start, _ in longest_first
    ]
    given = [F.when(fit, r[0] + r[1]) for fit, r in zip(fits, longest_first, strict=True)]
    ruled = [F.when(fit, r[2]) for fit, r in zip(fits, longest_first, strict=True)]
    none = F.lit(None).cast("string")
    parts = parts.withColumn("rule", F.coalesce(*given, none)).withColumn(
        "ruled", F.coalesce(*ruled, none)
    )
    mined = match(parts.where("rule is null"), mine(outcomes(parts, labels)))
    return parts.join(mined, "url", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", "outcome", F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.concat_ws(" ", "mined_rule")).alias("mined_rule"),
        F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"),
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
