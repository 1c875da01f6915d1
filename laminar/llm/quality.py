"""Quality: a sparse ensemble of rules over text statistics.

Each text gives a few statistics, taken in one pass over all its bytes. Shallow trees grown on reweighted labelled rows
give conjunctive rules (the paths to their nodes); a lasso-penalised logistic regression keeps few of them; and the
kept rules are compiled to Spark column expressions over the statistics' columns, where the score is evaluated.

The fit takes at most `per_class` labelled rows of each class, the first by a hash of doc_id.

Cases: a null text equals an empty one, whose statistics are all zero; repeated rows get equal results; labels other
than 0 and 1 teach nothing; without labels of both classes every score is the share of label 1 (1 without labels, so
nothing is rejected); a null doc_id is scored like any other; extra columns, whatever their names, are left out by score() and kept by
passing(); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from laminar.llm.common import as_in, plain

#: The statistics' columns, in order; shares are of bytes unless said.
STATS = tuple(f"_stat_{x}" for x in ("bytes", "words", "word_bytes", "upper", "symbols", "marks", "pipes", "digits", "lines", "short_lines", "distinct_words", "distinct_lines", "long_words", "shouted"))

_UPPER, _SYMBOL, _MARK = list(range(65, 91)), [ord(c) for c in "#$%&*@^~=+<>{}[]\\/_"], [ord(c) for c in "!?"]


def statistics(raw: bytes) -> tuple[float, ...]:
    if not raw:
        return (0.0,) * len(STATS)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words, lines = len(raw), raw.split(), raw.split(b"\n")
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    filled = [x for x in lines if x.strip()]
    letters = max(1, int(h[65:91].sum() + h[97:123].sum()))
    return (
        float(n), float(len(words)), float(sizes.sum() / m), float(h[_UPPER].sum() / n), float(h[_SYMBOL].sum() / n), float(h[_MARK].sum() / n),
        float(h[124] / n), float(h[48:58].sum() / n), float(len(lines) / n), float(sum(len(x) < 40 for x in filled) / max(1, len(filled))),
        float(len(set(words)) / m), float(len(set(filled)) / max(1, len(filled))), float((sizes > 24).sum() / m), float(h[65:91].sum() / letters),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with all its columns and the statistics of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics((t.as_py() or "").encode("utf-8", "replace")) for t in batch.column("text")]
            cols = list(zip(*rows, strict=True)) or [()] * len(STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.float64()) for c in cols]], [*batch.schema.names, *STATS])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(c, DoubleType()) for c in STATS]]))


#: A rule: conditions (statistic, above?, threshold), all of which must hold.
Rule = tuple[tuple[int, bool, float], ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, t in rule:
        out &= (x[:, k] > t) if above else (x[:, k] <= t)
    return out


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, columns: np.ndarray, depth: int, path: Rule = ()) -> list[tuple[Rule, float]]:
    """The nodes of a weighted tree as (path, mean label), by the greatest fall in squared error at quantile thresholds."""
    total = w.sum()
    mean = float((w * y).sum() / max(total, 1e-12))
    here = [(path, mean)] if path else []
    if depth == 0 or len(y) < 20 or total <= 0 or np.ptp(y) == 0:
        return here
    best = (1e-9, -1, 0.0)
    for k in columns:
        for t in np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 25))):
            left = x[:, k] <= t
            a = w[left].sum()
            if a <= 0 or a >= total:
                continue
            ya = (w[left] * y[left]).sum()
            gain = ya * ya / a + (mean * total - ya) ** 2 / (total - a) - mean * mean * total
            if gain > best[0]:
                best = (gain, int(k), float(t))
    _, k, t = best
    if k < 0:
        return here
    left = x[:, k] <= t
    return here + grow(x[left], y[left], w[left], columns, depth - 1, (*path, (k, False, t))) + grow(x[~left], y[~left], w[~left], columns, depth - 1, (*path, (k, True, t)))


class Ensemble:
    def __init__(self, rules: list[Rule], weights: np.ndarray, bias: float):
        self.rules, self.weights, self.bias = rules, weights, bias

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 0.002, seed: int = 5) -> Ensemble:
        share = float(y.mean()) if len(y) else 1.0
        if share in (0.0, 1.0):
            odds = min(max(share, 1e-6), 1 - 1e-6)
            return cls([], np.zeros(0), float(np.log(odds / (1 - odds))))
        rng, found, margin = np.random.default_rng(seed), {}, np.zeros(len(y))
        for _ in range(trees):
            # the next tree looks where the trees so far are wrong, on some rows and columns
            own, columns = rng.random(len(y)) < 0.6, rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]
            p = 1 / (1 + np.exp(-margin))
            nodes = grow(x[own], (y - p)[own], np.ones(own.sum()), columns, depth)
            for rule, _ in nodes:
                found[rule] = True
            leaves = {r: v for r, v in nodes if not any(q[: len(r)] == r and len(q) > len(r) for q, _ in nodes)}
            for rule, v in leaves.items():
                margin += 2.0 * v * holds(rule, x)
        if not (rules := list(found)):
            return cls([], np.zeros(0), float(np.log(share / (1 - share))))
        a = np.stack([holds(r, x) for r in rules], 1).astype(np.float64)
        # identical rules carry no more than one
        _, first = np.unique(a, axis=1, return_index=True)
        rules, a = [rules[i] for i in sorted(first)], a[:, sorted(first)]
        return cls(*_lasso(rules, a, y, penalty))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((w * holds(r, x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x)))

    def column(self) -> Column:
        """The score as an expression over the statistics' columns."""
        z = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            hit = F.lit(True)
            for k, above, t in rule:
                hit = hit & ((F.col(STATS[k]) > t) if above else (F.col(STATS[k]) <= t))
            z = z + F.when(hit, float(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _lasso(rules: list[Rule], a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[list[Rule], np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient; the rules that keep a weight."""
    n, m = a.shape
    w, b, share = np.zeros(m), 0.0, y.mean()
    b = float(np.log(share / (1 - share)))
    rate = 4.0 / max(np.linalg.norm(np.c_[a, np.ones(n)], 2) ** 2 / n, 1e-9)
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        d = (1 / (1 + np.exp(-np.clip(a @ v + c, -60, 60))) - y) / n
        step = v - rate * (a.T @ d)
        new, bias = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0), c - rate * d.sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / s * (new - w), bias + (t - 1) / s * (bias - b)
        w, b, t = new, bias, s
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return [rules[i] for i in kept], w[kept], float(b)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 3000) -> Ensemble:
    own = labels.filter(learn).select("doc_id", F.col("quality").cast("long").alias("quality"))
    # the first of each class by hash: at most 2 * per_class rows, so the broadcast and what returns have a fixed bound
    first = [own.filter(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(first[0].unionByName(first[1])), "doc_id")
    got = with_statistics(rows).drop("text").toPandas().sort_values(["doc_id", "quality"])
    return Ensemble.fit(got[list(STATS)].to_numpy(np.float64), got["quality"].to_numpy(np.float64))


def score(docs: DataFrame, model: Ensemble, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row."""
    scored = with_statistics(docs.select("doc_id", "text")).select("doc_id", model.column().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def passing(docs: DataFrame, model: Ensemble, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with their columns, whose score reaches the threshold."""
    return as_in(with_statistics(plain(docs, "text")).filter(model.column() >= threshold), docs, "text")
