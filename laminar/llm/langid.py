"""Language identification by a convolutional network over bytes.

Byte embeddings, filters of several widths, the maximum over a window, and softmax; trained in numpy by Adam on windows
of labelled texts. A text is cut into consecutive windows of fixed length (the last one ends with the text), and its
prediction is the mean of all its windows' probabilities. For use, embedding and filters fold into tables indexed by
byte pairs, so a window costs a few table rows per byte.

The fit takes at most `per_lang` labelled rows of each language, and ROWS in all, by hashes of doc_id, and one window of each: the more
languages there are, the fewer rows teach each of them, but every language is learnt. Windows are convolved in batches of STEP,
whichever documents they come from; a long text spans several batches.

Cases: a null text, and one without a letter, is `und` with score 0; shorter texts are padded with zero bytes; ties go to
the language first in order; rows that repeat get equal results; labels that are null teach nothing; without any label
every prediction is `und`; a lang column with more than ROWS values holds no languages and raises ValueError; a null doc_id is
predicted like any other; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes in a window, dimensions of a byte's embedding, widths of filters, filters of each width.
LENGTH, DIMS, WIDTHS, FILTERS = 192, 12, (2, 3, 4), 16
#: Windows that teach, of all languages together.
ROWS = 200_000
#: Windows convolved at a time.
STEP = 512
LETTER = regex.compile(r"\p{L}")


def windows(raw: bytes, length: int = LENGTH) -> np.ndarray:
    """All of raw in rows of `length` bytes; the last row ends where raw ends."""
    a = np.frombuffer(raw, np.uint8)
    if len(a) <= length:
        return np.pad(a, (0, length - len(a)))[None, :]
    whole = a[: len(a) // length * length].reshape(-1, length)
    return np.concatenate([whole, a[None, -length:]]) if len(a) % length else whole


class Network:
    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.5, (256, DIMS)), "v": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)), "c": np.zeros(classes)}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, (2 / (w * DIMS)) ** 0.5, (w * DIMS, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients on windows x with classes y."""
        p, n = self.p, len(x)
        e, pooled, best, views = p["e"][x], [], [], []
        for w in WIDTHS:
            view = np.lib.stride_tricks.sliding_window_view(e, w, 1).transpose(0, 1, 3, 2).reshape(n, x.shape[1] - w + 1, w * DIMS)
            made = view @ p[f"f{w}"] + p[f"b{w}"]
            at = made.argmax(1)
            best.append(at)
            views.append(view)
            pooled.append(np.maximum(np.take_along_axis(made, at[:, None], 1)[:, 0], 0))
        h = np.concatenate(pooled, 1)
        z = h @ p["v"] + p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        loss = float(-np.log(z[np.arange(n), y] + 1e-9).mean())
        z[np.arange(n), y] -= 1
        z /= n
        g = {"v": h.T @ z, "c": z.sum(0), "e": np.zeros_like(p["e"])}
        back = (z @ p["v"].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            taken = views[k][np.arange(n)[:, None], best[k]]
            g[f"f{w}"], g[f"b{w}"] = np.einsum("nfi,nf->if", taken, d), d.sum(0)
            to_e = (d[:, :, None] * p[f"f{w}"].T[None]).reshape(n, FILTERS, w, DIMS)
            for j in range(w):
                np.add.at(g["e"], x[np.arange(n)[:, None], best[k] + j], to_e[:, :, j])
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 7) -> Network:
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                _, grads = self.step(x[own], y[own])
                t += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def folded(self) -> Folded:
        return Folded(self.p)


class Folded:
    """The network with embedding and filters as tables by byte pair or byte."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.v, self.c, self.filters = p["v"], p["c"], []
        one = lambda w, j: p["e"] @ p[f"f{w}"][j * DIMS : (j + 1) * DIMS]
        for w in WIDTHS:
            tables = []
            for j in range(0, w, 2):
                first = one(w, j)
                pair = j + 1 < w
                tables.append((j, pair, (first[:, None] + one(w, j + 1)[None]).reshape(-1, FILTERS) if pair else first))
            self.filters.append((w, tables, p[f"b{w}"]))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(x), STEP):
            part = x[at : at + STEP]
            n = part.shape[1]
            pairs = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            pooled = []
            for w, tables, bias in self.filters:
                many = n - w + 1
                made = None
                for j, pair, t in tables:
                    got = t.take((pairs if pair else part)[:, j : j + many], 0)
                    made = got if made is None else np.add(made, got, out=made)
                pooled.append(np.maximum(made.max(1) + bias, 0))
            z = np.concatenate(pooled, 1) @ self.v + self.c
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out)


def sample(docs: DataFrame, learn: Column, per_lang: int) -> tuple[np.ndarray, list[str]]:
    """At most per_lang windows of each language, by a hash of doc_id, and their labels."""
    key = F.xxhash64("doc_id")
    own = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a few times per_lang rows of each language by hash, so that no task has to rank a language's every row
    langs = own.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    many = langs.limit(ROWS + 1).count()
    if many > ROWS:
        raise ValueError(f"more than {ROWS} values of lang")
    per_lang = max(1, min(per_lang, ROWS // max(1, many)))
    # ROWS rows at most
    share = langs.select(F.col("lang").alias("_lang"), (4.0 * per_lang / F.col("_n") + 20 / F.col("_n")).alias("_share"))
    own = own.join(F.broadcast(share), F.col("lang") == F.col("_lang")).filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    order = Window.partitionBy("lang").orderBy("_k", "doc_id")
    at = F.pmod(key, F.greatest(F.length("text") - LENGTH, F.lit(1))).cast("int") + 1
    cut = own.select("doc_id", "lang", key.alias("_k"), F.col("text").substr(at, F.lit(LENGTH)).alias("part"))
    rows = cut.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_lang).select("lang", "part").collect()
    rows = sorted((r["lang"], r["part"]) for r in rows if LETTER.search(r["part"]))
    x = [windows(part.encode()[:LENGTH])[0] for _, part in rows]
    return np.array(x, np.uint8).reshape(-1, LENGTH), [lang for lang, _ in rows]


def fit(docs: DataFrame, learn: Column, per_lang: int = 1000) -> tuple[list[str], Folded | None]:
    x, langs = sample(docs, learn, per_lang)
    known = sorted(set(langs))
    if not known:
        return [], None
    y = np.array([known.index(v) for v in langs])
    return known, Network(len(known)).fit(x, y, epochs=max(4, min(40, 28000 // len(x)))).folded()


def predict(docs: DataFrame, known: list[str], model: Folded | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            total, many = np.zeros((n, max(1, len(known)))), np.zeros(n, np.int64)
            waiting: list[tuple[int, np.ndarray]] = []

            def convolve() -> None:
                if waiting:
                    rows = np.repeat([k for k, _ in waiting], [len(x) for _, x in waiting])
                    np.add.at(total, rows, model.probabilities(np.concatenate([x for _, x in waiting])))
                    waiting.clear()

            size = 0
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text is None or model is None or not LETTER.search(text):
                    continue
                x = windows(text.encode("utf-8", "replace"))
                many[k] = len(x)
                for at in range(0, len(x), STEP):
                    waiting.append((k, x[at : at + STEP]))
                    size += len(waiting[-1][1])
                    if size >= STEP:
                        convolve()
                        size = 0
            convolve()
            mean = total / np.maximum(many, 1)[:, None]
            langs = [known[i] if m else "und" for i, m in zip(mean.argmax(1).tolist(), many.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.minimum(mean.max(1), 1.0), pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
