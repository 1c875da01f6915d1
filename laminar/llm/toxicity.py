"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams of its lower-cased bytes, present or not; white space is one character, so an n-gram can
hold a word's ends. Each is scaled by the log ratio of its smoothed share among toxic and clean texts, where that is several times
its standard error, and logistic weights on the scaled features are learnt with an L2 penalty, both classes weighing alike. The product of ratio and weight is one table indexed by hash, so scoring sums the table over a text's distinct
features, however long the text is.

The fit takes at most `per_class` labelled rows of each class, the first by a hash of doc_id, and twice as many
clean ones; their feature sets, each below 2^BITS, reach the driver. Scoring reads whole texts.

Cases: a null text equals an empty one, whose score is that of no feature at all; repeated rows get equal results; without labels of both
classes every score is the share of toxic labels (0 without labels); a null doc_id is scored like any other and teaches nothing; several labels for one document each teach;
extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of n-grams in bytes, and bits of their hash.
SIZES, BITS = (5, 7, 9), 20
#: Bytes hashed at a time; the n-grams across the seam belong to the first part.
PART = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def features(raw: bytes, seen: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of raw, in order; seen: a buffer of 2^BITS False, left as it was."""
    a = _LOWER[np.frombuffer(b" " + raw + b" ", np.uint8)]
    for at in range(0, len(a), PART):
        part = a[at : at + PART + max(SIZES) - 1].astype(np.uint32)
        for n in SIZES:
            many = min(PART, len(part) - n + 1)
            if many > 0:
                h = np.full(many, n, np.uint32)
                for j in range(n):
                    h = h * np.uint32(0x01000193) + part[j : j + many]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
                seen[h >> np.uint32(32 - BITS)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


class Model:
    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def score(self, found: np.ndarray) -> float:
        z = float(self.table[found].sum()) + self.bias
        return float(1 / (1 + np.exp(-min(max(z, -60.0), 60.0))))


def pack(found: np.ndarray) -> bytes:
    """Features, which are in order, by their differences and compressed."""
    gaps = np.diff(found.astype(np.int64), prepend=-1)
    small = bool(gaps.max(initial=0) < 1 << 16)
    return bytes([small]) + zlib.compress(gaps.astype("<u2" if small else "<u4").tobytes(), 1)


class Packed:
    """The features of some texts, each unpacked when it is its turn."""

    def __init__(self, parts: list[bytes]):
        self.parts = parts

    def __len__(self) -> int:
        return len(self.parts)

    def __iter__(self) -> Iterator[np.ndarray]:
        for raw in self.parts:
            yield np.cumsum(np.frombuffer(zlib.decompress(raw[1:]), "<u2" if raw[0] else "<u4"), dtype=np.int64) - 1


def ratios(rows: list[np.ndarray] | Packed, y: np.ndarray, sure: float = 4.0) -> np.ndarray:
    """Each feature's naive Bayes log-count ratio between toxic and clean texts; 0 unless it is `sure` times its standard error."""
    p, q = np.ones(1 << BITS), np.ones(1 << BITS)
    for r, toxic in zip(rows, y, strict=True):
        (p if toxic else q)[r] += 1
    ratio = np.log((p / (2 + (y == 1).sum())) / (q / (2 + (y == 0).sum())))
    ratio[np.abs(ratio) < sure * np.sqrt(1 / p + 1 / q)] = 0
    return ratio


def fit(rows: list[np.ndarray] | Packed, y: np.ndarray, penalty: float = 1e-3, rounds: int = 200) -> Model:
    """rows: the features of each text; y: 1 for toxic. Both classes weigh alike; features whose ratio may be chance are left out."""
    size = 1 << BITS
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        odds = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(size, np.float32), float(np.log(odds / (1 - odds))))
    ratio = ratios(rows, y)
    rows = [r[ratio[r] != 0].astype(np.int32) for r in rows]
    n = len(rows)
    at, doc = np.concatenate(rows), np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    x, weigh = ratio[at], np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / n
    # accelerated gradient descent; the step is the curvature's bound, its greatest eigenvalue by power iteration
    steep, v = 1.0, (ratio != 0) / max(1.0, np.sqrt((ratio != 0).sum()))
    for _ in range(12):
        v = np.bincount(at, weights=x * (weigh * np.bincount(doc, weights=x * v[at], minlength=n))[doc], minlength=size)
        steep = max(float(np.linalg.norm(v)), 1e-12)
        v = v / steep
    rate = 1 / (1.1 * (steep + 1) / 4 + penalty)
    w, b, t = np.zeros(size), 0.0, 1.0
    ahead, lead = w, b
    for _ in range(rounds):
        z = np.bincount(doc, weights=x * ahead[at], minlength=n) + lead
        d = weigh * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        new, bias = ahead - rate * (np.bincount(at, weights=x * d[doc], minlength=size) + penalty * ahead), lead - rate * d.sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, lead = new + (t - 1) / s * (new - w), bias + (t - 1) / s * (bias - b)
        w, b, t = new, bias, s
    return Model((w * ratio).astype(np.float32), float(b))


def sample(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int) -> tuple[Packed, np.ndarray]:
    """The features and labels of at most per_class toxic and twice as many clean rows, by a hash of doc_id."""
    own = labels.filter(learn).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    first = [own.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((0, 2 * per_class), (1, per_class))]
    own = first[0].unionByName(first[1])
    # at most 3 * per_class rows, so the broadcast has a fixed bound
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            found = [pack(features(t.as_py().encode("utf-8", "replace"), seen)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array(found, pa.binary())], ["doc_id", "toxic", "f"])

    got = rows.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, f binary").toPandas().sort_values(["doc_id", "toxic"])
    return Packed(list(map(bytes, got["f"]))), got["toxic"].to_numpy(np.int64)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))  # 2^BITS floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Model(*shared.value), np.zeros(1 << BITS, bool)
        for batch in batches:
            out = [own.score(features(t.as_py().encode("utf-8", "replace"), seen)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array([int(x >= threshold) for x in out], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
