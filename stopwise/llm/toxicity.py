"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document is a bag of sentences and is toxic when any of them is. A sentence's score is logistic in
its distinct words and their beginnings; a document's is the noisy-or of its sentences,
1 - prod(1 - p). The weights are fitted to document labels by gradient steps through the noisy-or, so what the labels say of whole
documents ends at the sentences that explain it, and those are located when a text is scored.

When a text is scored, only sentences that are evidence enter the noisy-or: above the background
(the bias) and at ``EVIDENCE`` or more alone. The background of every sentence and slightly telling
words would otherwise add up until any long text is toxic. A text without evidence has the score of
its strongest sentence.

The fit reads a bounded sample: the ``FIT_ROWS`` labelled documents of the smallest id hashes, of
which every fourth id class (crc32 of the id as text, modulo 4, equal to ``HELD_OUT``) is never
read. Features are words and beginnings of words (``PREFIXES`` letters) that are found in toxic
documents of the sample clearly more often than in others; the sample bounds what is sent to the
executors too. Scoring reads every whole text where it is stored, without a shuffle. Only texts
enter the scores.

Defined cases: null and empty texts are one sentence without words; ids with several labels count
as toxic when any of them says so, null labels and null ids are left out; without labels of both
kinds every weight is 0 and every score is the share of toxic labels (0 if there is none); a null
doc_id is scored and not held out; an empty table gives an empty result; rows are scored each for
itself; further columns are kept by ``score`` and ``drop_toxic``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from stopwise.llm.common import body, table

HELD_OUT = 2
THRESHOLD = 0.3
EVIDENCE = 0.1

FIT_ROWS = 8_000
PREFIXES = (4, 5, 6, 7)
#: A feature occurs in so many toxic documents (of few: in this share of them), at so many times the
#: rate of clean ones, and the rates differ by so many standard errors.
MIN_DOCUMENTS = 5
MIN_SHARE = 1 / 3
MIN_LIFT = 2.0
MIN_Z = 3.5
STEPS = 120
RATE = 0.3
SHRINK = 3e-5
#: Words whose weight a task remembers.
REMEMBERED = 150_000

SENTENCE = re.compile(r"[^.!?\n\r]+")
WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word and its proper beginnings."""
    return [word, *[f"^{word[:n]}" for n in PREFIXES if len(word) > n]]


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    known: dict[str, float] = field(default_factory=dict, compare=False, repr=False)

    def word(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = sum([self.weights.get(f, 0.0) for f in features(word)])
            self.known[word] = found
        return found

    def sentence(self, text: str) -> float:
        """Log-odds that a sentence (lower case) is toxic."""
        return self.bias + sum(map(self.word, set(WORD.findall(text))))

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score, and start, end and score of each sentence that reaches the threshold alone."""
        clean, strongest, spans = 0.0, None, []
        for m in SENTENCE.finditer(text):
            z = max(-60.0, min(60.0, self.sentence(m[0].lower())))
            strongest = z if strongest is None else max(strongest, z)
            if z > self.bias and z >= math.log(EVIDENCE / (1 - EVIDENCE)):
                clean -= math.log1p(math.exp(z))
            if z >= math.log(THRESHOLD / (1 - THRESHOLD)):
                spans.append((m.start(), m.end(), 1 / (1 + math.exp(-z))))
        if not clean:
            clean = -math.log1p(math.exp(self.bias if strongest is None else strongest))
        return -math.expm1(clean), spans


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text and toxic of at most ``rows`` labelled documents that are not held out."""
    marks = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", body().alias("text")).join(F.broadcast(marks), "doc_id")
    return found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))


def _telling(texts: pa.ChunkedArray, y: np.ndarray) -> list[str]:
    """The features that speak for a toxic document, the most certain ones first."""
    seen = (Counter(), Counter())
    for text, toxic in zip(texts, y, strict=True):
        words = set(WORD.findall(text.as_py().lower()))
        seen[int(toxic)].update({f for w in words for f in features(w)})
    n_toxic, n_clean = y.sum(), len(y) - y.sum()
    least = min(MIN_DOCUMENTS, max(2, math.ceil(MIN_SHARE * n_toxic)))
    found = []
    for f, n in seen[1].items():
        if n < least:
            continue
        rate, other = n / n_toxic, (seen[0][f] + 0.5) / n_clean
        both = (n + seen[0][f]) / len(y)
        z = (rate - other) / math.sqrt(both * (1 - both) * (1 / n_toxic + 1 / n_clean) + 1e-12)
        if rate >= MIN_LIFT * other and z >= MIN_Z:
            found.append((-z, f))
    return [f for _, f in sorted(found)]


def fit(rows: DataFrame, steps: int = STEPS) -> Model:
    """Fit the model to the (bounded) rows of ``sample``."""
    seen = rows.select("doc_id", "text", "toxic").orderBy("doc_id").toArrow()
    y = np.array(seen.column("toxic").to_pylist(), float)
    if not len(y) or y.min() == y.max():
        return Model(-60.0 if not len(y) or not y[0] else 60.0)
    number = {f: i for i, f in enumerate(_telling(seen.column("text"), y))}
    words, sentence_at, document_at = [], [], []
    n_words = n_sentences = 0
    for text in seen.column("text"):
        document_at.append(n_sentences)
        for s in SENTENCE.findall(text.as_py().lower()) or [""]:
            own = [number[f] for w in set(WORD.findall(s)) for f in features(w) if f in number]
            # One place for the bias keeps every sentence non-empty.
            words.append(np.array([len(number), *sorted(own)], np.int32))
            sentence_at.append(n_words)
            n_words += len(own) + 1
            n_sentences += 1
    flat = np.concatenate(words)
    sizes = np.diff([*sentence_at, n_words])
    bag = np.repeat(np.arange(len(y)), np.diff([*document_at, n_sentences]))
    weights = np.zeros(len(number) + 1)
    weights[-1] = -math.log(n_sentences / max(1.0, y.sum()))
    squares = np.full_like(weights, 1e-8)
    for _ in range(steps):
        z = np.add.reduceat(weights[flat], sentence_at)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_clean = np.bincount(bag, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))
        toxic = np.maximum(-np.expm1(log_clean), 1e-12)
        # Slope of the loss by each sentence's log-odds: p for clean documents, and less than 0
        # for toxic ones, shared out by how much each sentence explains.
        slope = np.where(y[bag] == 1, -p * np.exp(log_clean)[bag] / toxic[bag], p)
        gradient = np.bincount(flat, weights=np.repeat(slope, sizes), minlength=len(weights))
        squares += gradient**2
        weights -= RATE * gradient / np.sqrt(squares)
        shrink = SHRINK * len(y) * RATE / np.sqrt(squares[:-1])
        weights[:-1] = np.sign(weights[:-1]) * np.maximum(np.abs(weights[:-1]) - shrink, 0)
    kept = {w: float(weights[i]) for w, i in number.items() if weights[i]}
    return Model(float(weights[-1]), kept)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``score`` and ``offending`` (start, end, score of sentences) added."""
    span = StructType(
        [StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())]
    )
    kind = pa.list_(
        pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    )
    added = StructType([StructField("score", DoubleType()), StructField("offending", ArrayType(span))])
    own = {"score", "offending"}
    kept = [c for c in docs.columns if c not in own]
    schema = StructType([docs.schema[c] for c in kept] + added.fields)
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.document(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([s for s, _ in found], pa.float64()),
                    pa.array([[dict(zip(("start", "end", "score"), x, strict=True)) for x in spans]
                              for _, spans in found], kind),
                ],
                names=[*kept, "score", "offending"],
            )

    return docs.select(*kept).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below the threshold, with their columns."""
    model = fit(sample(docs, labels))
    return score(docs, model).where(F.col("score") < THRESHOLD).select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(sample(docs, labels))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "offending",
    )
