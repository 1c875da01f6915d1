"""Best-fit packing of token sequences by length patterns.

The lengths' histogram has at most `size` entries whatever the corpus, so it alone reaches the driver. Patterns are
multisets of few lengths that fill a sequence or nearly so; non-negative least squares fits how often each is repeated
to the histogram, the counts are rounded down, and the pieces that remain are packed best-fit, still as counts by
length. The plan is a list of runs (length, first rank, how many, first sequence, offset). Each piece then gets its rank
among those of its length from a range sort, which splits a length that many pieces have, and finds its run by binary
search, so no task ever holds the pieces of a length or of a pattern.

Cases: a null or empty text is the single end-of-document id; ties and repeated rows are packed one by one; texts of any length
are cut into pieces of `size`, the first one shorter; a null doc_id is packed like any other; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.llm.bpe import _sliced, codec
from laminar.llm.common import partitions, stash

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's ids and its end id, cut into pieces of `size`; the first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at, texts in _sliced(batch):
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc, text in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts, strict=True):
                    raw = own.encode_raw(text) + end_id.to_bytes(4, "little")
                    n = len(raw) // 4
                    cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for col, x in zip(out, (doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])), strict=True):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)


def patterns(lengths: list[int], size: int, slack: int = 8, most: int = 4000) -> list[tuple[int, ...]]:
    """Multisets of one to four of the lengths whose sum leaves at most `slack` free, the fullest first: a whole sequence, pairs,
    and, over a thinned set of lengths, threes and fours. `most` bounds the number of patterns, not what they can pack."""
    there = sorted(set(lengths))
    have, thin = set(there), there[:: max(1, len(there) // 48)]
    out: list[tuple[int, ...]] = [(x,) for x in there if size - slack <= x <= size]
    tails = lambda rest, least: [x for x in range(rest, max(least, rest - slack) - 1, -1) if x in have][:1]
    out += [(a, b) for a in there if 2 * a <= size for b in tails(size - a, a)]
    threes = [(a, b, c) for i, a in enumerate(thin) for b in thin[i:] if a + 2 * b <= size for c in tails(size - a - b, b)]
    fours = [(a, b, c, d) for i, a in enumerate(thin[::2]) for b in thin[::2][i:] for c in thin[::4] if c >= b and a + b + 2 * c <= size for d in tails(size - a - b - c, c)]
    rest = sorted(threes + fours, key=lambda p: (size - sum(p), len(p), p))
    return list(dict.fromkeys(out + rest[: max(0, most - len(out))]))


def nnls(a: list[tuple[int, ...]], rows: dict[int, int], b: np.ndarray, weights: np.ndarray | float = 1.0, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares by projected coordinate descent over sparse columns: column j has its pattern's lengths. weights: of the rows."""
    cols = [(np.array([rows[x] for x in c]), np.array(list(c.values()), float)) for c in map(Counter, a)]
    x, left, weights = np.zeros(len(a)), b.astype(float).copy(), np.broadcast_to(np.square(weights, dtype=float), len(b))
    scale = [float(weights[at] @ (v * v)) for at, v in cols]
    for _ in range(rounds):
        moved = 0.0
        for j, (at, v) in enumerate(cols):
            step = max(-x[j], float((weights[at] * v) @ left[at]) / scale[j])
            if step:
                x[j] += step
                left[at] -= step * v
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan(histogram: dict[int, int], size: int) -> np.ndarray:
    """Runs (length, first rank, how many, first sequence, offset), sorted by length and rank."""
    return _best(histogram, size)[2]


def by_patterns(histogram: dict[int, int], size: int) -> int:
    """How many pieces the plan places as parts of patterns; the rest are residuals."""
    return _best(histogram, size)[1]


def _best(histogram: dict[int, int], size: int) -> tuple[int, int, np.ndarray]:
    """Of fits with more and less slack, of patterns of up to four, three and two pieces, the one of fewest sequences; then of most pieces in patterns."""
    return min((_plan(histogram, size, slack, parts) for parts in (4, 3, 2) for slack in (8, 1, 0)), key=lambda x: (x[0], -x[1]))


def _plan(histogram: dict[int, int], size: int, slack: int, parts: int = 4) -> tuple[int, int, np.ndarray]:
    left, taken = Counter({k: v for k, v in histogram.items() if v}), Counter()
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    #: bins by the room left in them, each a list of (first sequence, how many)
    rooms: dict[int, list[tuple[int, int]]] = {}

    def put(length: int, n: int, seq: int, offset: int) -> None:
        runs.append((length, taken[length], n, seq, offset))
        taken[length] += n
        left[length] -= n

    made = [p for p in patterns(list(left), size, slack) if len(p) <= parts]
    lengths = sorted(left)
    # in tokens, for what is left of long pieces is hard to place
    want = nnls(made, {x: i for i, x in enumerate(lengths)}, np.array([left[x] for x in lengths]), np.array(lengths)) if made else []
    for pattern, x in sorted(zip(made, want, strict=True), key=lambda t: (-sum(t[0]), -t[1])):
        needs = Counter(pattern)
        if n := min([int(x), *(left[k] // v for k, v in needs.items())]):
            at = 0
            for length in sorted(pattern, reverse=True):
                put(length, n, sequences, at)
                at += length
            if at < size:
                rooms.setdefault(size - at, []).append((sequences, n))
            sequences += n
    fitted = sum(taken.values())
    for length in sorted(left, reverse=True):
        while left[length]:
            if fits := [r for r in rooms if r >= length]:
                room = min(fits)
                seq, n = rooms[room].pop()
                take = min(n, left[length])
                if n > take:
                    rooms[room].append((seq + take, n - take))
                if not rooms[room]:
                    del rooms[room]
                put(length, take, seq, size - room)
                rest = room - length
            else:
                take, seq = left[length], sequences
                # as many of this length as fit go into each new sequence
                each = size // length
                take = max(1, left[length] // each)
                for k in range(each if left[length] >= each else 1):
                    put(length, take, seq, k * length)
                    rest = size - (k + 1) * length
                sequences += take
            if rest:
                rooms.setdefault(rest, []).append((seq, take))
    return sequences, fitted, np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, size: int = 2048) -> DataFrame:
    """pieces() rows with sequence_id and offset."""
    spark = cut.sparkSession
    n = partitions(spark)
    rows = stash(cut, "pieces")
    ordered = rows.repartitionByRange(n, "length", "doc_id", "piece", "start", "ids_crc32").sortWithinPartitions("length", "doc_id", "piece", "start", "ids_crc32")
    placed = stash(ordered.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # a count for each partition and one for each length: bounded by the number of tasks and by `size`
    per_part = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = np.zeros(max(per_part, default=0) + 1, np.int64), 0
    for p in sorted(per_part):
        before[p], total = total, total + per_part[p]
    first, total = np.zeros(size + 1, np.int64), 0
    for length in sorted(histogram):
        first[length], total = total, total + histogram[length]
    runs = plan(histogram, size)
    span = int(sum(histogram.values())) + 1
    keys = runs[:, 0] * span + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = before[batch.column("p").to_numpy()] + batch.column("within").to_numpy() - first[length]
            run = np.searchsorted(keys, length * span + rank, "right") - 1
            seq = runs[run, 3] + rank - runs[run, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(runs[run, 4])], [*batch.schema.names[:5], "sequence_id", "offset"])

    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", part.alias("p"), within.alias("within")).mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    return pack(pieces(docs, path, size, end_id), size)
