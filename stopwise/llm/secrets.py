"""Secret scans: patterns, and a battery of randomness tests for what no pattern names.

Base spans come from three patterns (assignments, access keys, hexadecimal strings). Every other run
of at least ``SHORTEST`` characters of the base-64 alphabets is a candidate. Its encoding is the
smallest alphabet of ``ENCODINGS`` that holds all its characters (padding apart). The battery asks of
the characters, as numbers of that alphabet:

* chi-squared: are all of them equally frequent?
* runs: do they change between the lower and the upper half of the alphabet as often as chance does?
* serial correlation: does a character tell the next one?

A short string passes any test of randomness, so passing is no evidence by itself. The p-value of a
candidate is the probability that *written text* of its length and encoding looks as random: the
frequencies and pairs of characters of all documents give, per encoding, the noncentral chi-squared
distribution and the shifted normal distributions of the three statistics. Long strings of text fail
clearly, short ones do not. The two p-values of order (runs, serial) and the one of frequency are
combined by Fisher's method. A candidate that the battery finds too far from random (below
``UNLIKELY`` in any test, corrected for three) is text whatever its length.

Candidates of one encoding and length band are a family of their own; in each, the procedure of
Benjamini and Hochberg holds the share of false discoveries at ``FALSE_DISCOVERIES``. Its threshold
comes from counts of p-values on a grid of ``GRID`` steps a decade (rounded up, so never too bold),
which is as large as the grid whatever the corpus.

Defined cases: null and empty texts have no spans; texts of any length are read whole; rows that
repeat a doc_id, or have none, are judged each on its own; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopwise.llm.common import body, stored, table

_KEYWORDS = "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    for w in ("password", "passwd", "secret", "token", "api_?key")
)
ASSIGN = re.compile(rf"""(?:{_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
#: Order of kinds among spans of one start.
KINDS = ("assign", "access", "hex", "random")

SHORTEST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: From the smallest alphabet to the largest.
ENCODINGS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "upper hex": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "lower base36": DIGITS + LOWER,
    "upper base36": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "mixed": UPPER + LOWER + DIGITS + "+/-_",
}
_NAMES = list(ENCODINGS)
UNLIKELY = 1e-3
FALSE_DISCOVERIES = 0.01
GRID, DEEPEST = 8, 400

#: Number of each ASCII character in each encoding, or -1.
_NUMBER = np.full((len(ENCODINGS), 256), -1, np.int64)
for _e, _alphabet in enumerate(ENCODINGS.values()):
    _NUMBER[_e, np.frombuffer(_alphabet.encode(), np.uint8)] = np.arange(len(_alphabet))
_HOLDS = [frozenset(a) for a in ENCODINGS.values()]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of the patterns' matches, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found)


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches (start, end) that ordered spans cover."""
    out: list[tuple[int, int]] = []
    for start, _, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def encoding_of(token: str) -> int:
    characters = set(token.rstrip("="))
    return next(e for e, holds in enumerate(_HOLDS) if characters <= holds)


def statistics(token: str) -> tuple[int, int, float, float, float]:
    """Encoding, length, chi-squared, changes of half and serial product of a candidate.

    The serial product is the mean product of neighbours, centred on the alphabet's middle and in
    units of its variance: of expectation 0 for random strings.
    """
    e = encoding_of(token)
    k = len(_HOLDS[e])
    x = _NUMBER[e][np.frombuffer(token.rstrip("=").encode(), np.uint8)]
    n = len(x)
    chi = float(((np.bincount(x, minlength=k) - n / k) ** 2).sum() * k / n)
    upper = x >= k / 2
    changes = int((upper[1:] != upper[:-1]).sum())
    centred = x - (k - 1) / 2
    serial = float((centred[1:] * centred[:-1]).mean() / ((k * k - 1) / 12))
    return e, n, chi, float(changes), serial


class Text:
    """What written text looks like to the battery: per encoding its distance from uniform, its
    share of changes of half and its serial product, from counts of pairs of ASCII characters."""

    def __init__(self, pairs: np.ndarray):
        pairs = pairs.reshape(128, 128).astype(np.float64)
        self.distance, self.change, self.serial = [], [], []
        self.change_random = []
        for alphabet in ENCODINGS.values():
            at = np.frombuffer(alphabet.encode(), np.uint8)
            k, own = len(at), pairs[np.ix_(at, at)]
            # One of each pair at least, so that no count is zero.
            own = own + 1.0 / k
            own /= own.sum()
            single = own.sum(axis=1)
            upper, centred = np.arange(k) >= k / 2, np.arange(k) - (k - 1) / 2
            half = upper.mean()
            self.distance.append(float(((single - 1 / k) ** 2).sum() * k))
            self.change.append(float(own[upper[:, None] != upper].sum()))
            self.change_random.append(2 * half * (1 - half))
            self.serial.append(float(centred @ own @ centred / ((k * k - 1) / 12)))


def _above(z: float) -> float:
    """Probability that a standard normal variable exceeds z."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _below_chi(x: float, df: int, shift: float) -> float:
    """Probability that a noncentral chi-squared variable is at most x (cube root of it as normal)."""
    mean, b = df + shift, shift / (df + shift)
    spread = 2 * (1 + b) / (9 * mean)
    return 1 - _above(((x / mean) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def p_values(text: Text, e: int, n: int, chi: float, changes: float, serial: float) -> tuple[float, float]:
    """How likely the statistics are at the least favourable end of the tests for a random string
    (the smallest p-value, corrected for three), and that written text looks as random."""
    k = len(_HOLDS[e])
    m = max(n - 1, 1)
    c0, c1 = text.change_random[e], min(max(text.change[e], 0.02), 0.98)
    z_changes = (changes - m * c0) / math.sqrt(m * c0 * (1 - c0))
    z_serial = serial * math.sqrt(m)
    random = min(1 - _below_chi(chi, k - 1, 0.0), 2 * _above(abs(z_changes)), 2 * _above(abs(z_serial)))
    # As text: as near to uniform, to random changes and to no correlation, or nearer.
    near = max(_below_chi(chi, k - 1, n * text.distance[e]), 1e-300)

    def toward(value: float, written: float, chance: float, deviation: float) -> float:
        side = 1 if chance >= written else -1
        # Not beyond chance: what lies there is no better than chance itself.
        best = min(side * value, side * chance)
        return max(_above((best - side * written) / deviation), 1e-300)

    runs = toward(changes, m * c1, m * c0, math.sqrt(m * c1 * (1 - c1)))
    order = toward(serial, text.serial[e], 0.0, 1 / math.sqrt(m))
    # Fisher: of three p-values, minus the logarithm of their product is a gamma variable.
    t = -(math.log(near) + math.log(runs) + math.log(order))
    return min(1.0, 3 * random), math.exp(-t) * (1 + t + t * t / 2)


def band(n: int) -> int:
    """Length band: four to a doubling."""
    return int(4 * math.log2(n))


def _grid(p: float) -> int:
    """Step of the grid at or above p."""
    return DEEPEST if p < 10.0 ** (-DEEPEST / GRID) else min(DEEPEST, int(-GRID * math.log10(min(p, 1.0)) + 1e-9))


_CANDIDATE = "start:long,stop:long,encoding:int,n:long,chi:double,changes:double,serial:double"
_SCANNED = (
    f"doc_id long, spans array<struct<start:long,kind:int,stop:long>>, candidates array<struct<{_CANDIDATE}>>, "
    "pairs array<long>"
)


def scan(docs: DataFrame) -> DataFrame:
    """Per document its base spans and candidates; a last row per task counts pairs of characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
        fields = [(f.split(":")[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[f.split(":")[1]])
                  for f in _CANDIDATE.split(",")]
        types = [pa.int64(), span, pa.list_(pa.struct(fields)), pa.list_(pa.int64())]
        names = ["doc_id", "spans", "candidates", "pairs"]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        pairs = np.zeros(128 * 128, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = base_spans(text)
                taken, candidates = merged(spans), []
                for m in CANDIDATE.finditer(text):
                    # The first taken stretch that ends behind the candidate's start.
                    i = bisect_right(taken, m.start(), key=lambda t: t[1])
                    if i < len(taken) and taken[i][0] < m.end():
                        continue
                    candidates.append(dict(zip([f for f, _ in fields], (m.start(), m.end(), *statistics(m[0])))))
                rows.append((
                    doc_id, [{"start": s, "kind": k, "stop": e} for s, k, e in spans], candidates, None,
                ))
                # In pieces, so that a long text needs little beside itself.
                for low in range(0, len(text), 1 << 20):
                    raw = text[low : low + (1 << 20) + 1].encode("ascii", "replace")
                    x = np.frombuffer(raw, np.uint8).astype(np.int64)
                    if len(x) > 1:
                        pairs += np.bincount(x[:-1] * 128 + x[1:], minlength=128 * 128)
            if rows:
                yield made(rows)
        yield made([(None, None, None, pairs.tolist())])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    return stored(rows.mapInArrow(run, _SCANNED), "scanned")


def written_text(scanned: DataFrame) -> Text:
    """Counts of pairs over all documents: 128 x 128 numbers, whatever their number."""
    counts = scanned.where("pairs is not null").select(F.posexplode("pairs").alias("at", "n"))
    pairs = np.zeros(128 * 128)
    for at, n in counts.groupBy("at").agg(F.sum("n")).collect():
        pairs[at] = n
    return Text(pairs)


def thresholds(scanned: DataFrame, text: Text) -> dict[tuple[int, int], int]:
    """Per encoding and length band the first step of the grid that counts as a discovery.

    At most encodings x bands rows: a band is a quarter of a doubling of the length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            steps = []
            for c in rows:
                random, p = p_values(text, *(c[f] for f in ("encoding", "n", "chi", "changes", "serial")))
                # What is no random string for certain is never a discovery.
                steps.append(_grid(p) if random >= UNLIKELY else 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c["encoding"] for c in rows], pa.int32()),
                    pa.array([band(c["n"]) for c in rows], pa.int32()),
                    pa.array(steps, pa.int32()),
                ],
                ["encoding", "band", "step"],
            )

    each = scanned.select(F.explode("candidates").alias("c")).select("c.encoding", "c.n", "c.chi", "c.changes", "c.serial")
    steps = each.mapInArrow(run, "encoding int, band int, step int").groupBy("encoding", "band", "step").agg(
        F.count("*").alias("rows")
    )
    family = Window.partitionBy("encoding", "band")
    beyond = family.orderBy(F.desc("step"))
    steps = steps.withColumn("all", F.sum("rows").over(family)).withColumn("found", F.sum("rows").over(beyond))
    bound = F.pow(F.lit(10.0), -F.col("step") / GRID) * F.col("all") <= FALSE_DISCOVERIES * F.col("found")
    least = steps.where(bound & (F.col("step") > 0)).groupBy("encoding", "band").agg(F.min("step").alias("step"))
    return {(r["encoding"], r["band"]): r["step"] for r in least.collect()}


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    scanned = scan(docs)
    text = written_text(scanned)
    least = thresholds(scanned, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, spans, candidates in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base = [(s["start"], s["kind"], s["stop"]) for s in spans]
                added = []
                for c in candidates:
                    step = least.get((c["encoding"], band(c["n"])))
                    if step is None:
                        continue
                    random, p = p_values(text, *(c[f] for f in ("encoding", "n", "chi", "changes", "serial")))
                    if random >= UNLIKELY and _grid(p) >= step:
                        added.append((c["start"], 3, c["stop"]))
                kinds = [k for _, k, _ in base]
                out.append((
                    doc_id, kinds.count(0), kinds.count(1), kinds.count(2),
                    hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + added)), len(added),
                ))
            columns = list(zip(*out, strict=True)) or [()] * 7
            whole, word = pa.int64(), pa.string()
            types = [whole, whole, whole, whole, word, word, whole]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return scanned.where("pairs is null").select("doc_id", "spans", "candidates").mapInArrow(run, schema)


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
