"""Exact top-k by inner product over an impact-ordered index, scored level by level.

Vectors have integer components. The index is built and written once: vectors, ordered so that alike ones are neighbours, go into
blocks, and each block keeps its postings (dimension, vector, value) by quantised impact, nothing else: level l holds the values of
magnitude 2^l to 2^(l+1) - 1. A block also has bounds, its least and greatest value in each dimension.

Queries first meet the bounds alone, which are packed many blocks to a row: each query is scored against the block that promises
most, and the k-th score there is its mark. Then only blocks whose bound reaches a query's mark are read for it. In a block
segments are processed by descending level. After each level a vector's score lies within |query| * |components not processed
yet| of its accumulator (Cauchy-Schwarz), which proves which vectors can still be members; processing stops once few are left, and
those are rescored exactly in integers.

Cases: vectors that are null or hold null or non-finite components, or have no vec_id, take no part; shorter vectors count as padded
with zeros; ties go to the smaller vec_id, then all rows with it; a query meets every row but those with its own id; rows with
one id and equal scores are hits of their own; extra columns are ignored; an empty table gives an empty result; where the scores of a
block might not fit 64-bit integers, the job fails with an OverflowError instead of giving wrong ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laminar.llm.common import discard, stash

#: Vectors in an index block, queries in a query block, blocks whose bounds share a row, possible members a query at which scoring stops.
BLOCK, QUERIES, BOUNDS, FEW = 4096, 512, 1024, 24
#: Cells of a segment's rows and columns for each posting, beyond which it is processed posting by posting.
DENSE = 8


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): v has floor(scale * x) of each component x as a double; rows that take no part are left out."""
    x = F.col("embedding")

    def fine(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: F.coalesce(fine(c), F.lit(False)))).select("vec_id", whole.alias("v"))


def matrix(vectors: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _pad(x: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, dims - x.shape[1]))))


def fits(queries: np.ndarray, vectors: np.ndarray) -> None:
    """OverflowError if an inner product might not fit a long."""
    peak = lambda m: max((abs(int(x)) for x in (m.max(initial=0), m.min(initial=0))), default=0)
    if queries.shape[1] * peak(queries) * peak(vectors) >= 1 << 62:
        raise OverflowError("scores may exceed 64 bits: scale the vectors down")


class Index:
    """Posting segments of one block by descending impact level: for each its dimensions, places and values."""

    def __init__(self, n: int, dims: int, segments: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.n, self.dims, self.segments = n, dims, segments

    @classmethod
    def build(cls, vectors: np.ndarray) -> Index:
        size = np.abs(vectors)
        level = np.where(size > 0, np.floor(np.log2(np.maximum(size, 1).astype(np.float64))).astype(np.int64), -1)
        segments = []
        for k in sorted(set(level[level >= 0].tolist()), reverse=True):
            dim, place = np.nonzero(level.T == k)
            segments.append((dim.astype(np.int32), place.astype(np.int32), vectors[place, dim]))
        return cls(len(vectors), vectors.shape[1], segments)

    @property
    def postings(self) -> int:
        return sum(len(v) for _, _, v in self.segments)

    def dump(self) -> bytes:
        head = np.array([self.n, self.dims, len(self.segments), *(len(v) for _, _, v in self.segments)], np.int64)
        return head.tobytes() + b"".join(x.tobytes() for s in self.segments for x in s)

    @classmethod
    def load(cls, raw: bytes) -> Index:
        n, dims, many = map(int, np.frombuffer(raw, np.int64, 3))
        sizes, at, segments = np.frombuffer(raw, np.int64, many, 24).tolist(), 8 * (3 + many), []
        for m in sizes:
            dim, place = np.frombuffer(raw, np.int32, m, at), np.frombuffer(raw, np.int32, m, at + 4 * m)
            segments.append((dim, place, np.frombuffer(raw, np.int64, m, at + 8 * m)))
            at += 16 * m
        return cls(n, dims, segments)

    def vectors(self, places: np.ndarray, dims: int) -> np.ndarray:
        """The whole vectors at some places, from the postings."""
        row = np.full(self.n, -1, np.int64)
        row[places] = np.arange(len(places))
        out = np.zeros((len(places), dims), np.int64)
        for dim, place, value in self.segments:
            own = row[place] >= 0
            out[row[place[own]], dim[own]] = value[own]
        return out

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, mark: np.ndarray | None = None) -> tuple[list[np.ndarray], int]:
        """For each query the places of all vectors that can be among its k best and reach its mark, and how many products that
        took; own: the query's id, which is no hit. queries have at least the block's dimensions."""
        q = queries.astype(np.float64)
        norms, work = np.sqrt((q**2).sum(1)), 0
        squares = np.zeros(self.n)
        for _, place, value in self.segments:
            squares += np.bincount(place, value.astype(np.float64) ** 2, self.n)
        slack = 1e-9 * norms[:, None] * np.sqrt(squares.max(initial=0)) + 1e-3  # covers the rounding of doubles
        score, least = np.zeros((len(q), self.n)), np.full(len(q), -np.inf) if mark is None else mark.astype(np.float64)
        barred = own[:, None] == ids[None, :]
        possible = ~barred
        for dim, place, value in self.segments:
            # a level holds few of the block's rows and columns as long as its impacts are high
            rows, row = np.unique(place, return_inverse=True)
            cols, col = np.unique(dim, return_inverse=True)
            if len(rows) * len(cols) <= DENSE * len(value):
                held = np.zeros((len(cols), len(rows)))
                held[col, row] = value
                score[:, rows] += q[:, cols] @ held
                work += held.size * len(q)
            else:  # few postings in many rows and columns: dimension by dimension
                for d, at in zip(cols.tolist(), np.split(np.arange(len(dim)), np.flatnonzero(np.diff(dim)) + 1), strict=True):
                    score[:, place[at]] += np.outer(q[:, d], value[at])
                work += len(value) * len(q)
            squares = np.maximum(squares - np.bincount(place, value.astype(np.float64) ** 2, self.n), 0)
            bound = norms[:, None] * (np.sqrt(squares) * (1 + 1e-9))[None, :] + slack
            if self.n > k:
                low = np.where(barred, -np.inf, score - bound)
                least = np.maximum(least, np.partition(low, -k, 1)[:, -k])
            possible = ~barred & (score + bound >= least[:, None])
            if possible.sum() <= FEW * len(q):
                break
        return [np.flatnonzero(p) for p in possible], work

    def best(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, mark: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and exact scores of its k best that reach its mark, in order."""
        queries = _pad(queries, self.dims)
        may, _ = self.search(queries, own, ids, k, mark)
        every = np.unique(np.concatenate([*may, np.zeros(0, np.int64)]).astype(np.int64))
        vectors = self.vectors(every, queries.shape[1])
        fits(queries, vectors)
        for q, places in zip(queries, may, strict=True):
            exact = vectors[np.searchsorted(every, places)] @ q
            order = np.lexsort((ids[places], -exact))[:k]
            yield places[order], exact[order]


def build_index(vectors: DataFrame, n: int) -> DataFrame:
    """(block, vec_ids, dims, low, high, postings), written: vectors with the same greatest component are neighbours; n: how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            vectors += [np.asarray(v.values, np.int64) for v in batch.column("v")]
        for at in range(0, len(ids), 2 * BLOCK):
            whole = matrix(vectors[at : at + 2 * BLOCK])
            row = {"vec_ids": np.array(ids[at : at + 2 * BLOCK], np.int64).tobytes(), "low": whole.min(0).tobytes(), "high": whole.max(0).tobytes(), "postings": Index.build(whole).dump()}
            yield pa.RecordBatch.from_pydict({"dims": pa.array([whole.shape[1]], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in row.items()}})

    size = F.transform("v", lambda x: F.abs(x))
    place = F.array_position(size, F.array_max(size))
    lead = F.coalesce(F.when(F.get("v", (place - 1).cast("int")) < 0, -place).otherwise(place), F.lit(0))
    ordered = vectors.withColumns({"lead": lead, "peak": F.array_max(size)}).repartitionByRange(max(1, -(-n // BLOCK)), "lead", F.desc("peak"), "vec_id")
    made = ordered.select("vec_id", "v").mapInArrow(run, "dims int, vec_ids binary, low binary, high binary, postings binary")
    return stash(made.withColumn("block", F.monotonically_increasing_id()), "index")


QUERY = "q_ids binary, q_dims int, q_vectors binary, marks binary"


def _query_blocks(queries: DataFrame, n: int) -> DataFrame:
    """QUERY rows of about QUERIES queries (vec_id, v, mark) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, marks = [], [], []
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            vectors += [np.asarray(v.values, np.int64) for v in batch.column("v")]
            marks += batch.column("mark").to_pylist()
        for at in range(0, len(ids), QUERIES):
            yield _query_row(np.array(ids[at : at + QUERIES], np.int64), matrix(vectors[at : at + QUERIES]), np.array(marks[at : at + QUERIES], np.float64))

    return queries.select("vec_id", "v", "mark").repartition(max(1, -(-n // QUERIES))).mapInArrow(run, QUERY)


def _query_row(ids: np.ndarray, vectors: np.ndarray, marks: np.ndarray, **more) -> pa.RecordBatch:
    cols = {"q_ids": pa.array([ids.tobytes()], pa.binary()), "q_dims": pa.array([vectors.shape[1]], pa.int32()), "q_vectors": pa.array([np.ascontiguousarray(vectors).tobytes()], pa.binary()), "marks": pa.array([marks.tobytes()], pa.binary())}
    return pa.RecordBatch.from_pydict({**cols, **more})


def _queries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, raw = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vectors"], np.int64)
    return ids, raw.reshape(len(ids), row["q_dims"]), np.frombuffer(row["marks"], np.float64)


def _bounds(index: DataFrame, chunks: int) -> DataFrame:
    """(chunk, blocks, dims, lows, highs) of about BOUNDS blocks a row; no postings are read."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        of = lambda c: [np.frombuffer(bytes(x), np.int64) for x in pdf[c]]
        low, high = matrix(of("low")), matrix(of("high"))
        return pd.DataFrame([{"chunk": pdf["chunk"].iloc[0], "blocks": pdf["block"].to_numpy(np.int64).tobytes(), "dims": low.shape[1], "lows": low.tobytes(), "highs": high.tobytes()}])

    # block numbers begin anew in each partition of the written index
    rows = index.select("block", "low", "high").withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int"))
    return rows.groupBy("chunk").applyInPandas(pack, "chunk int, blocks binary, dims int, lows binary, highs binary")


def promises(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and block a score that no vector of the block exceeds; a component that a vector lacks is 0."""
    dims = max(queries.shape[1], low.shape[1])
    q, low, high = (_pad(x, dims).astype(np.float64) for x in (queries, low, high))
    top = np.maximum(q, 0) @ np.maximum(high, 0 if dims else high).T + np.minimum(q, 0) @ np.minimum(low, 0).T
    return top + 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T) + 1e-3


def _work(queries: DataFrame, bounds: DataFrame, chunks: int, first: bool) -> DataFrame:
    """QUERY rows by the block they have to meet: for each query its most promising block of each row of bounds (with that promise), or
    all blocks that reach its mark. The query set meets all blocks' bounds, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, q, marks = _queries(row)
                blocks, dims = np.frombuffer(row["blocks"], np.int64), row["dims"]
                low, high = (np.frombuffer(row[c], np.int64).reshape(len(blocks), dims) for c in ("lows", "highs"))
                most = promises(q, low, high)
                if first:
                    best = most.argmax(1)
                    for b in np.unique(best).tolist():
                        at = np.flatnonzero(best == b)
                        yield _query_row(ids[at], q[at], most[at, b], block=pa.array([blocks[b]], pa.int64()))
                else:
                    for b in np.flatnonzero((most >= marks[:, None]).any(0)).tolist():
                        at = np.flatnonzero(most[:, b] >= marks)
                        yield _query_row(ids[at], q[at], marks[at], block=pa.array([blocks[b]], pa.int64()))

    every = queries.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return every.join(bounds.hint("merge"), "chunk").drop("chunk").mapInArrow(run, f"{QUERY}, block long")


def _hits(work: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best of each query in each block it has to meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, q, marks = _queries(row)
                ids, made = np.frombuffer(row["vec_ids"], np.int64), Index.load(row["postings"])
                found = list(made.best(q, own, ids, k, marks))
                many = [len(p) for p, _ in found]
                cols = (np.repeat(own, many), ids[np.concatenate([*(p for p, _ in found), np.zeros(0, np.int64)]).astype(np.int64)], np.concatenate([*(s for _, s in found), np.zeros(0, np.int64)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    # QUERIES-sized rows meet a block's postings; a block that many queries need is split by the join
    met = work.join(index.select("block", "vec_ids", "postings").hint("merge"), "block")
    return met.drop("block").mapInArrow(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows (vec_id, v) of both."""
    index, asked = build_index(vectors, vectors.count()), queries.count()
    chunks = max(1, -(-index.count() // BOUNDS))
    bounds = stash(_bounds(index, chunks), "bounds")
    plain = stash(_query_blocks(queries.withColumn("mark", F.lit(float("-inf"))), asked), "queries")
    seeds = stash(_work(plain, bounds, chunks, True), "seeds")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, most = _queries(row)
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "promise": most, "block": np.full(len(ids), row["block"])})

    # of the most promising blocks by row of bounds, the best one
    best = seeds.mapInArrow(apart, "vec_id long, promise double, block long").groupBy("vec_id").agg(F.max(F.struct("promise", "block"))["block"].alias("best"))
    one = queries.join(best.hint("merge"), "vec_id").withColumn("mark", F.lit(float("-inf")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    marks = _hits(_by_block(one), index, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
    marks = stash(marks.select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("mark")), "marks")
    marked = queries.join(marks.hint("merge"), "vec_id", "left").withColumn("mark", F.coalesce("mark", F.lit(float("-inf"))))
    work = stash(_work(stash(_query_blocks(marked, asked), "queries"), bounds, chunks, False), "work")
    discard(plain, seeds)
    return _hits(work, index, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_block(queries: DataFrame) -> DataFrame:
    """QUERY rows of up to QUERIES queries (vec_id, v, mark, best) that have one best block, whatever the number of its queries."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for at in range(0, len(pdf), QUERIES):
            part = pdf.iloc[at : at + QUERIES]
            made = _query_row(part["vec_id"].to_numpy(np.int64), matrix([np.asarray(v, np.int64) for v in part["v"]]), part["mark"].to_numpy(np.float64)).to_pandas()
            rows.append(made.assign(block=key[0]))
        return pd.concat(rows)

    chunks = stash(queries.groupBy("best").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks")), "chunks")
    salted = queries.join(chunks.hint("merge"), "best").withColumn("salt", F.pmod(F.xxhash64("vec_id"), "chunks"))
    return salted.select("best", "salt", "vec_id", "v", "mark").groupBy("best", "salt").applyInPandas(pack, f"{QUERY}, block long")
