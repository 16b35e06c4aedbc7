"""The registered queries of this subpackage and, where SQL can express them, the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stopwise.llm import (
    bpe,
    exact_dedup,
    hard_negatives,
    licenses,
    neighbours,
    ngram_join,
    packing,
    prefix_trie,
    secrets,
    suffix_dedup,
    toxicity,
    url_filter,
    warc,
)
from stopwise.llm.common import shipped

Run = Callable[[SparkSession, str], DataFrame]


def _on_cluster(run: Run) -> Run:
    """Executors get the package before any of its functions runs there."""
    return lambda spark, sf_dir: run(shipped(spark), sf_dir)


QUERIES: dict[str, Run] = {
    f.__name__: _on_cluster(f)
    for f in (
        url_filter.op1_url_filters,
        packing.op2_best_fit_packing,
        exact_dedup.op3_exact_dedup,
        warc.op4_warc,
        suffix_dedup.op5_suffix_dedup,
        toxicity.op6_toxicity,
        ngram_join.op7_ngram_jaccard,
        neighbours.op8_embedding_near_dedup,
        bpe.op9_bpe,
        licenses.op10_license_scans,
        hard_negatives.op11_hard_negatives,
        secrets.op12_secret_scans,
        prefix_trie.op13_prefix_trie,
    )
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op4_warc": warc.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
