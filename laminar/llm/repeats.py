"""Repeated passages by suffix arrays: maximal repeat groups, and removal of what an earlier document holds.

`suffix_array`, `lcp_array` and `intervals` are the local engine: suffixes in order, their common prefixes, and a
stack scan that gives the tree of common-prefix intervals. An interval is a maximal repeat if what stands before its
suffixes differs (left-extension diversity); its group lists all its occurrences.

For a corpus, every string of `least` bytes belongs to the rarest of its k-grams by hash (its anchor), so equal strings
have equal anchors wherever they stand, and the runs of strings with one anchor (at most 76 bytes of text) can be dealt
by it. First anchors alone are counted, which leaves those of more than one document; then the runs at these meet, each
distinct run once for each group of documents; each bucket sorts the repeated suffixes of its runs, scans the interval
tree and returns, per maximal group, the length and the least doc_id that holds it. A hot passage thus crosses the
shuffle once for each group of documents, not once for each document. A bucket whose anchors have very many distinct runs (a phrase in
all documents, with other text around it each time) is dealt again, by the bytes before and after the anchor. Last, each document drops its spans.

Cases: a null text is empty; texts shorter than `least` keep all; a document is compared with smaller doc_ids only, so
rows that share a doc_id never remove from each other; a null doc_id orders last; repeats within one document stay;
extra columns are ignored; an empty table gives an empty result; texts of any length are read whole, in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.llm.common import partitions, plain, release, stash, sweep

#: Bytes of a repeat, of a k-gram; the k-grams in a string.
LEAST, GRAM = 50, 24
WIDE = LEAST - GRAM + 1
#: Window starts taken at a time; bytes of text in a group of documents; anchors and runs in a bucket.
PART, GROUP, BUCKET = 1 << 19, 2_000_000, 150_000
#: Bytes of text whose anchors are sorted at a time.
BATCH = 8_000_000
#: Runs in a bucket beyond which it is dealt anew.
HOT = 1_000_000
SEED = np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: MULT to the powers 1, 2, 4, ...
MULT = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(8)]
LAST = np.iinfo(np.int64).max


# the local engine


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of s (non-negative integers) in order, by prefix doubling."""
    n = len(s)
    rank, width = np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while n and rank.max(initial=0) < n - 1 and width < n:
        second = np.full(n, -1, np.int64)
        second[:-width] = rank[width:]
        order = np.lexsort((second, rank))
        new = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(new)])
        width *= 2
    return order


def lcp_array(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The common prefix of each suffix with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    live, n = np.arange(1, len(order)), len(s)
    while len(live):
        a, b = order[live - 1] + out[live], order[live] + out[live]
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        live = live[s[a] == s[b]]
        out[live] += 1
    return out


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every common-prefix interval of at least `least`, children before parents, by a stack scan."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now, first = int(lcp[i]) if i < len(lcp) else 0, i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def repeat_groups(texts: list[bytes], least: int = LEAST) -> list[tuple[int, list[tuple[int, int]]]]:
    """All maximal repeats of texts: (length, [(text, start) of every occurrence])."""
    parts, owner, start = [], [], []
    for k, t in enumerate(texts):
        parts += [np.frombuffer(t, np.uint8).astype(np.int64), [256 + k]]
        owner.append(np.full(len(t) + 1, k))
        start.append(np.arange(len(t) + 1))
    if not texts:
        return []
    s, owner, start = np.concatenate(parts).astype(np.int64), np.concatenate(owner), np.concatenate(start)
    order = suffix_array(s)
    before = np.where(start[order] > 0, s[order - 1], -1 - order)
    out = []
    for length, a, b in intervals(lcp_array(s, order), least):
        left = before[a : b + 1]
        if (left != left[0]).any():
            out.append((length, sorted(zip(owner[order[a : b + 1]].tolist(), start[order[a : b + 1]].tolist(), strict=True))))
    return out


# anchors and runs


def _hashes(a: np.ndarray) -> np.ndarray:
    """A hash of each k-gram of GRAM = 16 + 8 bytes."""
    h = SEED[a]
    for k in range(4):
        h = h[: -(1 << k)] * MULT[k] + h[1 << k :]
        if k == 2:
            eight = h
    n = len(a) - GRAM + 1
    h = h[:n] * MULT[3] + eight[16 : 16 + n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs_of(text: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of text (documents end to end, `ends` their ends): (anchor, first, last) of each run of strings that have
    one anchor; first and last are starts of strings."""
    for at in range(0, len(text) - LEAST + 1, PART):
        a = text[at : at + PART + LEAST - 1]
        many = len(a) - LEAST + 1
        key = (_hashes(a) & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(a) - GRAM + 1, dtype=np.uint64)
        width = 1
        while width * 2 <= WIDE:
            key, width = np.minimum(key[:-width], key[width:]), width * 2
        key = np.minimum(key[:many], key[WIDE - width : WIDE - width + many])
        good = np.ones(many, bool)
        for e in ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + many + LEAST - 1, "left")].tolist():
            good[max(0, e - at - LEAST + 1) : max(0, e - at)] = False
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (good[1:] != good[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [many]]) - 1
        keep = good[first]
        first, last = first[keep], last[keep]
        yield key[first] >> np.uint64(24), first + at, last + at


def _together(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]).astype(np.int64)


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8")[:, 0].astype(np.uint64)


def _logs(n: np.ndarray) -> bytes:
    """Numbers from 1 on in a byte each, rounded up by at most six in a hundred; 1 stays 1."""
    return np.minimum(np.ceil(np.log(n) / np.log(1.06) - 1e-9), 255).astype(np.uint8).tobytes()


def _from_logs(raw: bytes) -> np.ndarray:
    return np.ceil(1.06 ** np.frombuffer(raw, np.uint8).astype(np.float64)).astype(np.int64)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places that have it, in order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


def _anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, hashes, grps, many): the distinct anchors of each batch's documents by group; many: how many documents of the batch have it.

    An anchor that stands in more than one document of a batch is shared whatever other batches hold. One of its groups says so to
    the anchor's bucket, the others go past it, in buckets below 0: an anchor that all documents have makes a row for
    each batch there, not for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at, stop in _bounded(batch.column("text")):
                text, ends = _together([t.as_py().encode("utf-8", "replace") for t in batch.column("text").slice(at, stop - at)])
                yield _distinct_anchors(text, ends, batch.column("_grp").slice(at, stop - at).to_numpy().astype(np.uint64), buckets)

    return docs.select("_grp", "text").mapInArrow(run, "bucket int, hashes binary, grps binary, many binary")


def _bounded(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts, of one text or at most BATCH bytes, so that memory stays bounded whatever an Arrow batch holds."""
    first, size = 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        if k > first and size + n > BATCH:
            yield first, k
            first, size = k, 0
        size += n
    if len(texts):
        yield first, len(texts)


def _distinct_anchors(text: np.ndarray, ends: np.ndarray, group: np.ndarray, buckets: int) -> pa.RecordBatch:
    keys, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for anchor, first, _ in runs_of(text, ends):
        d = np.searchsorted(ends, first, "right")
        keys.append((anchor << np.uint64(24)) | group[d])
        doc.append(d.astype(np.int32))
    keys, doc = np.concatenate(keys), np.concatenate(doc)
    order = np.lexsort((doc, keys))
    keys, doc = keys[order], doc[order]
    anchor = keys >> np.uint64(24)
    head = np.concatenate([np.ones(min(1, len(keys)), bool), anchor[1:] != anchor[:-1]])
    new = np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])  # a group's first row of an anchor
    # a document is in one group, so within a group's rows of an anchor equal documents stand together
    other = new | np.concatenate([np.ones(min(1, len(keys)), bool), doc[1:] != doc[:-1]])
    many = np.add.reduceat(other.astype(np.int64), np.flatnonzero(head))[np.cumsum(head) - 1][new] if len(keys) else np.zeros(0, np.int64)
    keys, anchor, lead = keys[new], anchor[new], head[new]
    group_ = (keys & np.uint64((1 << 24) - 1)).astype(np.uint32)
    bucket = np.where((many > 1) & ~lead, -1 - (group_ % buckets).astype(np.int64), (anchor % np.uint64(buckets)).astype(np.int64))
    out: list[list] = [[], [], [], []]
    for b, at in _slices(bucket):
        for col, x in zip(out, (b, _five(anchor[at] & np.uint64((1 << 40) - 1)), group_[at].tobytes(), _logs(many[at])), strict=True):
            col.append(x)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]], ["bucket", "hashes", "grps", "many"])


def _shared(anchors: DataFrame) -> DataFrame:
    """(grp, hashes, n): for each group its anchors that stand in more than one document of the corpus, a row from each bucket; and a
    row with grp -1 for each bucket, with the number of documents at its shared anchors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.concatenate([_from_five(x) for x in pdf["hashes"]])
        g = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["grps"]])
        many = np.concatenate([_from_logs(x) for x in pdf["many"]])
        order = np.argsort(a, kind="stable")
        a, g, many = a[order], g[order], many[order]
        head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        size, held = np.diff(np.concatenate([head, [len(a)]])), np.add.reduceat(many, head)
        hit = np.repeat(held > 1, size)
        a, g = a[hit], g[hit].astype(np.int64)
        rows = [(k, _five(np.unique(a[at])), 0) for k, at in _slices(g)]
        if pdf["bucket"].iloc[0] >= 0:
            rows.append((-1, b"", int(held[held > 1].sum())))
        return pd.DataFrame(rows, columns=["grp", "hashes", "n"])

    return anchors.groupBy("bucket").applyInPandas(run, "grp int, hashes binary, n long")


class Held:
    """The runs at shared anchors of a group's documents, each distinct run under a number; the same for the same input."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, shared: np.ndarray):
        self.text, self.ends = _together(texts)
        self.ids = ids
        anchors, first, last = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, f, e in runs_of(self.text, self.ends):
            at = np.minimum(np.searchsorted(shared, a), max(0, len(shared) - 1))
            own = shared[at] == a if len(shared) else np.zeros(len(a), bool)
            anchors.append(a[own])
            first.append(f[own])
            last.append(e[own])
        anchors, self.first, last = np.concatenate(anchors), np.concatenate(first), np.concatenate(last)
        self.doc = np.searchsorted(self.ends, self.first, "right")
        raw, numbers = self.text.tobytes(), {}
        self.number = np.fromiter((numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(self.first.tolist(), (last + LEAST).tolist(), strict=True)), np.int64, len(last))
        self.runs = list(numbers)
        place = np.zeros(len(numbers), np.int64)
        place[self.number[::-1]] = np.arange(len(self.number))[::-1]
        self.anchor = anchors[place]
        self.least = np.full(len(numbers), LAST)
        self.most = np.full(len(numbers), np.iinfo(np.int64).min)
        np.minimum.at(self.least, self.number, ids[self.doc])
        np.maximum.at(self.most, self.number, ids[self.doc])


def _hold(docs: pd.DataFrame, shared: pd.DataFrame) -> Held:
    """docs: _id and text, in the same order whatever order the rows came in."""
    release()
    docs = docs.sort_values(["_id", "text"], kind="stable")
    ids = docs["_id"].to_numpy(np.int64)
    texts = [t.encode("utf-8", "replace") for t in docs["text"]]
    hashes = np.unique(np.concatenate([_from_five(bytes(x)) for x in shared["hashes"] if x is not None] + [np.zeros(0, np.uint64)]))
    return Held(texts, ids, hashes)


FOUND = "grp int, numbers binary, starts binary, lengths binary, least binary"
RUNS = "bucket long, depth int, n int, grp int, numbers binary, anchors binary, least binary, alone binary, lens binary, data binary"
RUN_COLUMNS = [c.split()[0] for c in RUNS.split(", ")]


def _runs(buckets: int) -> Callable:
    """Each group's distinct runs by bucket."""

    def run(key: tuple, docs: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        h, rows = _hold(docs, shared), []
        for b, at in _slices((h.anchor % np.uint64(buckets)).astype(np.int64)):
            own = [h.runs[k] for k in at.tolist()]
            rows.append((b, 0, len(at), key[0], at.astype(np.int32).tobytes(), _five(h.anchor[at]), h.least[at].tobytes(), (h.least[at] == h.most[at]).tobytes(), bytes(map(len, own)), b"".join(own)))
        return pd.DataFrame(rows, columns=RUN_COLUMNS)

    return run


# hot buckets

#: Places of an anchor in a string are 0 to WIDE - 1; at depth d they are dealt into 2^d intervals, at the last one each is its own.
DEPTHS = (WIDE - 1).bit_length()


def spans(depth: int) -> list[tuple[int, int]]:
    """The intervals (first, last) of an anchor's places in a string at a depth."""
    now = [(0, WIDE - 1)]
    for _ in range(depth):
        now = [x for a, b in now for x in ([(a, (a + b) // 2), ((a + b) // 2 + 1, b)] if b > a else [(a, b)])]
    return now


class Dealt:
    """The runs of a row of RUNS with their anchors' places, and the parts in which each of them can meet others at a depth."""

    def __init__(self, row: dict):
        self.row, self.text = row, np.frombuffer(row["data"], np.uint8)
        lens = np.frombuffer(row["lens"], np.uint8).astype(np.int64)
        self.ends = np.cumsum(lens)
        self.begins = self.ends - lens
        anchors = _from_five(row["anchors"])
        run = np.repeat(np.arange(len(lens)), lens)[: len(self.text) - GRAM + 1]
        at = np.flatnonzero((_hashes(self.text) >> np.uint64(24) == anchors[run]) & (np.arange(len(run)) + GRAM <= self.ends[run]))
        # a string's anchor is the first of its least k-grams, and so is a run's
        own, first = np.unique(run[at], return_index=True)
        self.place = np.zeros(len(lens), np.int64)
        self.place[own] = at[first]

    def parts(self, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(interval, runs, the bytes that all strings of a run have whose anchor's place is in the interval): strings that are equal
        have equal bytes, so runs need to meet only where these are equal."""
        before, after = self.place - self.begins, self.ends - self.place - GRAM
        for k, (a, b) in enumerate(spans(depth)):
            runs = np.flatnonzero(np.maximum(a, WIDE - 1 - after) <= np.minimum(b, before))
            if len(runs):
                yield k, runs, self.text[self.place[runs, None] - a + np.arange(LEAST - b + a)]

    def cut(self, runs: np.ndarray) -> dict:
        """The row with some of its runs only."""
        r = self.row
        pick = lambda c, kind: np.frombuffer(r[c], kind)[runs].tobytes()
        data = b"".join([r["data"][x:y] for x, y in zip(self.begins[runs].tolist(), self.ends[runs].tolist(), strict=True)])
        return {"n": len(runs), "grp": r["grp"], "numbers": pick("numbers", np.int32), "anchors": pick("anchors", "V5"), "least": pick("least", np.int64), "alone": pick("alone", bool), "lens": pick("lens", np.uint8), "data": data}


def _deeper(rows: DataFrame, buckets: int) -> DataFrame:
    """RUNS of hot buckets, dealt by more of the text around their anchors into new buckets, which have numbers below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kinds = {"bucket": pa.int64(), "depth": pa.int32(), "n": pa.int32(), "grp": pa.int32()}
        for batch in batches:
            for row in batch.to_pylist():
                dealt, depth, out = Dealt(row), row["depth"] + 1, []
                for k, runs, around in dealt.parts(depth):
                    h = np.full(len(runs), k, np.uint64)
                    for column in around.T:
                        h = h * MULT[0] + SEED[column]
                    h ^= h >> np.uint64(32)
                    for b, at in _slices((h % np.uint64(buckets)).astype(np.int64)):
                        out.append({"bucket": -1 - (depth << 40) - b, "depth": depth, **dealt.cut(runs[at])})
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kinds.get(c, pa.binary())) for c in RUN_COLUMNS], RUN_COLUMNS)

    return rows.mapInArrow(run, RUNS)


def _cooled(runs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """runs without hot buckets, and the rows that are hot at the last depth, if there are any.

    A bucket has all runs with its anchors. One anchor (a phrase) can stand in any number of documents, each with other text around
    it; the runs of a hot bucket are dealt again by what stands around. Those of the last depth are hot for single strings."""
    cool, last = None, None
    for depth in range(DEPTHS):
        sizes = runs.groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT)
        hot = stash(sizes, "hot")
        many = hot.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        part = runs if not many else runs.join(hot.hint("merge"), "bucket", "left_anti").select(*RUN_COLUMNS)
        cool = part if cool is None else cool.unionByName(part)
        if not many:
            break
        more = runs.join(hot.select("bucket").hint("merge"), "bucket", "left_semi").select(*RUN_COLUMNS)
        if depth == DEPTHS - 1:
            last = more
            break
        # a run is dealt to a few places; a quarter of HOT is what a new bucket has on average
        runs = stash(_deeper(more, max(1, 8 * many // HOT)), "runs")
    return cool, last


def _of_strings(rows: DataFrame) -> DataFrame:
    """FOUND of the strings of rows that are hot at the last depth: the least holder of a string is an aggregate, whatever the number of its
    runs. Of strings that these rows hold besides, not all holders are known here, but all are in other buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row in batch.to_pylist():
                dealt = Dealt(row)
                least, alone, numbers = np.frombuffer(row["least"], np.int64), np.frombuffer(row["alone"], bool), np.frombuffer(row["numbers"], np.int32)
                for k, runs, around in dealt.parts(DEPTHS):
                    start = (dealt.place - dealt.begins)[runs] - spans(DEPTHS)[k][0]
                    cols = (pa.array([x.tobytes() for x in around], pa.binary()), pa.array(np.full(len(runs), row["grp"], np.int32)), pa.array(numbers[runs]), pa.array(start.astype(np.int32)), pa.array(least[runs]), pa.array(alone[runs]))
                    yield pa.RecordBatch.from_arrays(list(cols), ["string", "grp", "number", "start", "first", "alone"])

    held = stash(rows.drop("bucket", "depth").mapInArrow(run, "string binary, grp int, number int, start int, first long, alone boolean").distinct(), "strings")
    least = stash(held.groupBy("string").agg(F.min("first").alias("low")), "least")
    met = held.join(least.hint("merge"), "string").filter((F.col("low") < F.col("first")) | ~F.col("alone"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda c, kind: [x.tobytes() for x in batch.column(c).to_numpy().astype(kind)]  # noqa: E731, B023
            cols = (of("number", np.int32), of("start", np.uint8), [bytes([LEAST])] * batch.num_rows, of("low", np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("grp"), *[pa.array(c, pa.binary()) for c in cols]], ["grp", "numbers", "starts", "lengths", "least"])

    return met.select("grp", "number", "start", "low").mapInArrow(pack, FOUND)


def scan(runs: list[bytes], least_id: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The maximal repeats of distinct runs: for every occurrence (run, start, length, least id of the group).

    A run's copies, which are one row here, are a group. Of runs that share an anchor, the suffixes whose first LEAST
    bytes return are put in order; what stands before a run is unknown and counts as different."""
    _, inverse, size = np.unique(anchor, return_inverse=True, return_counts=True)
    lens = np.array([len(r) for r in runs], np.int64)
    out = [[np.arange(len(runs))], [np.zeros(len(runs), np.int64)], [lens], [least_id]]
    rest = np.flatnonzero(size[inverse] > 1)
    if len(rest):
        text = np.frombuffer(b"".join([runs[k] for k in rest.tolist()]) + b"\0" * 128, np.uint8)
        own = lens[rest]
        begin = np.cumsum(own) - own
        strings = own - LEAST + 1
        run = np.repeat(np.arange(len(rest)), strings)
        off = np.arange(len(run)) - np.repeat(np.cumsum(strings) - strings, strings)
        at = begin[run] + off
        # suffixes whose first LEAST bytes hash alike; the others are in no interval
        h = _window_hashes(text)[at]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        returns = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        live = order[returns]
        run, off, at = run[live], off[live], at[live]
        if len(at):
            left = own[run] - off
            most = LEAST + WIDE + 3
            words = np.where(np.arange(most) < left[:, None], text[at[:, None] + np.arange(most)], 0)
            keys = np.ascontiguousarray(words.astype(np.uint8)).view(">u8").astype(np.uint64)
            order = np.lexsort((left, *keys.T[::-1]))
            run, off, at, left, words = run[order], off[order], at[order], left[order], words[order, :LEAST]
            lcp = _common(text, at, left, np.concatenate([[False], (words[1:] == words[:-1]).all(1)]))
            before = np.where(off > 0, text[at - 1].astype(np.int64), -1 - np.arange(len(at)))
            ids = least_id[rest[run]]
            heads = np.flatnonzero(lcp < LEAST)
            # a group of suffixes that all follow the same byte has no maximal repeat
            diverse = np.minimum.reduceat(before, heads) != np.maximum.reduceat(before, heads)
            tails = np.concatenate([heads[1:], [len(at)]])
            for a, b in zip(heads[diverse].tolist(), tails[diverse].tolist(), strict=True):
                for length, i, j in intervals(np.concatenate([[0], lcp[a + 1 : b]]), LEAST):
                    i, j = a + i, a + j + 1
                    if before[i:j].min() != before[i:j].max():
                        for col, x in zip(out, (rest[run[i:j]], off[i:j], np.full(j - i, length), np.full(j - i, ids[i:j].min())), strict=True):
                            col.append(x)
    return tuple(np.concatenate(c) for c in out)


def _window_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the LEAST = 32 + 16 + 2 bytes from each place on."""
    kept = [SEED[text]]
    for k in range(5):
        kept.append(kept[k][: -(1 << k)] * MULT[k] + kept[k][1 << k :])
    n = len(text) - LEAST + 1
    return (kept[5][:n] * MULT[4] + kept[4][32 : 32 + n]) * MULT[1] + kept[1][48 : 48 + n]


def _common(text: np.ndarray, at: np.ndarray, left: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The common prefix of each suffix with the one before, where it has LEAST bytes (same); else 0. left: bytes in its run."""
    out = np.where(same, LEAST, 0)
    live = np.flatnonzero(same)
    most = np.minimum(left[live], left[live - 1])
    while len(live):
        inside = out[live] < most
        live, most = live[inside], most[inside]
        equal = text[at[live] + out[live]] == text[at[live - 1] + out[live]]
        live, most = live[equal], most[equal]
        out[live] += 1
    return out


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """All runs of a bucket -> for each group of documents the maximal repeats of its runs that reach beyond their first holder."""
    release()
    numbers, owner, anchors, least, single = [], [], [], [], []
    known: dict[bytes, int] = {}
    which = []
    for k, r in enumerate(pdf.itertuples(index=False)):
        own = np.frombuffer(r.numbers, np.int32)
        numbers.append(own)
        owner.append(np.full(len(own), k))
        anchors.append(_from_five(r.anchors))
        least.append(np.frombuffer(r.least, np.int64))
        single.append(np.frombuffer(r.alone, bool))
        at, data = 0, r.data
        for n in r.lens:
            which.append(known.setdefault(data[at : at + n], len(known)))
            at += n
    numbers, owner, anchors, least, single = map(np.concatenate, (numbers, owner, anchors, least, single))
    which = np.array(which, np.int64)
    best, anchor = np.full(len(known), LAST), np.zeros(len(known), np.uint64)
    np.minimum.at(best, which, least)
    anchor[which] = anchors
    run, start, length, low = scan(list(known), best, anchor)
    order = np.argsort(run, kind="stable")
    run, start, length, low = run[order], start[order], length[order], low[order]
    # each group's copy of a run takes all the run's entries
    first, many = np.searchsorted(run, which, "left"), np.searchsorted(run, which, "right") - np.searchsorted(run, which, "left")
    row = np.repeat(np.arange(len(which)), many)
    entry = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(row))
    use = (low[entry] < least[row]) | ~single[row]
    row, entry = row[use], entry[use]
    grps, out = pdf["grp"].to_numpy(), []
    for k, at in _slices(owner[row]):
        r, e = row[at], entry[at]
        out.append((int(grps[k]), numbers[r].astype(np.int32).tobytes(), start[e].astype(np.uint8).tobytes(), length[e].astype(np.uint8).tobytes(), low[e].astype(np.int64).tobytes()))
    return pd.DataFrame(out, columns=["grp", "numbers", "starts", "lengths", "least"])


def _covered(docs: pd.DataFrame, rows: pd.DataFrame) -> tuple[Held, np.ndarray]:
    """The group's runs, and for each byte of its texts whether it goes."""
    h = _hold(docs, rows)
    found = rows[rows["numbers"].notna()]
    cat = lambda c, kind: np.concatenate([np.frombuffer(bytes(x), kind) for x in found[c]] + [np.zeros(0, kind)])
    number, start, length, low = cat("numbers", np.int32).astype(np.int64), cat("starts", np.uint8), cat("lengths", np.uint8), cat("least", np.int64)
    order = np.argsort(number, kind="stable")
    number, start, length, low = number[order], start[order].astype(np.int64), length[order].astype(np.int64), low[order]
    first = np.searchsorted(number, h.number, "left")
    many = np.searchsorted(number, h.number, "right") - first
    row = np.repeat(np.arange(len(h.number)), many)
    entry = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(row))
    goes = low[entry] < h.ids[h.doc[row]]
    a = h.first[row[goes]] + start[entry[goes]]
    edge = np.bincount(a, minlength=len(h.text) + 1) - np.bincount(a + length[entry[goes]], minlength=len(h.text) + 1)
    return h, np.cumsum(edge)[:-1] > 0


def _digests(docs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    h, gone = _covered(docs, rows)
    out, at = [], 0
    for doc, end in zip(h.ids.tolist(), h.ends.tolist(), strict=True):
        cut, text = gone[at:end], h.text[at:end]
        spans = int((np.diff(cut.view(np.int8), prepend=np.int8(0)) == 1).sum())
        out.append((doc, end - at, int(cut.sum()), spans, hashlib.sha256(text[~cut].tobytes()).hexdigest()))
        at = end
    return _nulls(pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]))


def _nulls(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf["doc_id"] = pdf["doc_id"].astype("Int64").mask(pdf["doc_id"] == LAST)
    return pdf


def _cut(docs: pa.Table, rows: pa.Table) -> pa.Table:
    """The documents with all their columns, texts without the characters whose bytes all go, and how many bytes went."""
    plain = docs.select(["_id", "text"]).to_pandas()
    h, gone = _covered(plain, rows.to_pandas())
    docs = docs.take(pa.array(plain.sort_values(["_id", "text"], kind="stable").index.to_numpy()))
    heads = np.flatnonzero((h.text & 0xC0) != 0x80)
    if len(heads):
        whole = np.minimum.reduceat(gone.astype(np.uint8), heads)
        gone = np.repeat(whole, np.diff(np.concatenate([heads, [len(gone)]]))).astype(bool)
    texts, lost, at = [], [], 0
    for end in h.ends.tolist():
        texts.append(h.text[at:end][~gone[at:end]].tobytes().decode("utf-8", "replace"))
        lost.append(int(gone[at:end].sum()))
        at = end
    docs = docs.set_column(docs.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
    return docs.drop_columns(["_id", "_grp"]).append_column("_lost", pa.array(lost, pa.int64()))


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with their _grp and _id, and by group the shared anchors and the repeats found at them."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    groups = min(1 << 22, max(1, n_bytes // GROUP, partitions(spark)))
    buckets = max(partitions(spark), n_bytes // (GRAM // 2 * BUCKET))
    grp = F.pmod(F.xxhash64("doc_id", F.octet_length(text)), F.lit(groups)).cast("int")
    own = docs.withColumns({"_grp": grp, "_id": F.coalesce("doc_id", F.lit(LAST)), "text": text})
    least = own.select("_grp", "_id", "text")
    shared = stash(_shared(_anchors(least, buckets)), "shared")
    sweep(spark)  # of the shuffled anchors
    most = shared.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    shared = shared.filter("grp >= 0").select("grp", "hashes")
    runs = least.groupBy("_grp").cogroup(shared.groupBy("grp")).applyInPandas(_runs(buckets), RUNS)
    # equal runs of a group are one, so a bucket's runs are at most the places of its anchors: about one for each document that has them.
    # Only if the documents at some bucket's anchors are that many, runs are written and counted; both ways are exact
    runs, strings = (runs, None) if most <= HOT else _cooled(stash(runs, "runs"))
    found = runs.groupBy("bucket").applyInPandas(_meet, FOUND)
    if strings is not None:
        found = found.unionByName(_of_strings(strings))
    rows = shared.select("grp", "hashes", *[F.lit(None).cast("binary").alias(c) for c in ("numbers", "starts", "lengths", "least")])
    return own, rows.unionByName(found.select("grp", F.lit(None).cast("binary").alias("hashes"), "numbers", "starts", "lengths", "least"))


def removed_digests(docs: DataFrame) -> DataFrame:
    """DIGESTS: for each document its bytes, the bytes and spans it loses, and the digest of the bytes it keeps."""
    own, rows = _plan(docs)
    return own.select("_grp", "_id", "text").groupBy("_grp").cogroup(rows.groupBy("grp")).applyInPandas(_digests, DIGESTS)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with shortened texts (null becomes empty), all other columns as they were, and _lost: the bytes removed (in place of a column
    of that name).

    Spans are cut at characters: one of which only some bytes repeat stays whole."""
    docs = docs.drop("_lost")
    own, rows = _plan(plain(docs, "doc_id", "text"))
    schema = own.drop("_id", "_grp").withColumn("_lost", F.lit(0).cast("long")).schema
    return own.groupBy("_grp").cogroup(rows.groupBy("grp")).applyInArrow(_cut, schema).toDF(*docs.columns, "_lost")
