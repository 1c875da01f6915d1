"""Exact deduplication through a minimal perfect hash over the distinct digests of the history.

The history's distinct digests are dealt into shards by digest prefix. Each shard gets a minimal perfect hash made of
levels of bit vectors: a key whose place no other key takes at a level is settled there, the rest go to the next level,
and a key's slot is the number of settled places before its own. Slots hold the whole digest and the winner's locator
(doc_id, code points, group size), so a lookup compares all 32 bytes and a nonmember can't pass for a member.

Every batch is first reduced to one row per digest with partial aggregation, so a group of copies of any size crosses
the shuffle as one row per task. Members update the winner in the history, nonmembers are grouped separately, and both
make the next history, in which every document is looked up for its verdict.

Cases: null text equals empty text; texts made of white space only equal the empty text; ties in code points go to the
smaller doc_id; rows that repeat a doc_id are members of their group like any other (the kept flag is then set on each
row of the winning doc_id with the most code points); a null doc_id orders last; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminar.llm.common import partitions, stash

#: What normalisation deletes.
WHITE = r"[\x20\x09-\x0D]"
#: Most keys in a shard of the index, and most rows looked up by one task at a time.
SHARD_KEYS, LOOKUP_ROWS = 1 << 15, 1 << 16
GAMMA = 2.0

INDEX = "shard int, n int, levels binary, digests binary, doc_ids binary, chars binary, sizes binary"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, chars, digest): digest is the SHA-256 of the normalised text in UTF-8."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.length(text).cast("long").alias("chars"), F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"))


def winners(rows: DataFrame) -> DataFrame:
    """One row per digest: digest, keep_id, chars, group_size; rows: digest, doc_id, chars and, if counted already, size."""
    size = F.sum("size") if "size" in rows.columns else F.count(F.lit(1))
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id")))
    return rows.groupBy("digest").agg(best.alias("b"), size.cast("long").alias("size")).select("digest", F.col("b.doc_id").alias("doc_id"), (-F.col("b.less")).alias("chars"), "size")


def _places(words: np.ndarray, level: int, m: int) -> np.ndarray:
    """Each key's place at a level, from two of the digest's four words mixed with the level."""
    with np.errstate(over="ignore"):
        x = words[:, level % 4] ^ (words[:, (level // 4 + 1 + level) % 4] * np.uint64(0x9E3779B97F4A7C15 + 2 * level))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(m)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte keys, given as an (n, 4) array of uint64."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.starts = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        levels, left = [], words
        while len(left):
            if len(levels) > 400:
                raise ValueError("keys are not distinct")
            m = max(1, int(GAMMA * len(left))) if len(left) > 1 else 1
            at = _places(left, len(levels), m)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is surely no member; other nonmembers get any slot."""
        out, left = np.full(len(words), -1, np.int64), np.arange(len(words))
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = _places(words[left], k, len(bits))
            hit = bits[at] == 1
            out[left[hit]] = self.starts[k] + ranks[at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return head.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
        for m in map(int, sizes):
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (m + 7) // 8, at), count=m))
            at += (m + 7) // 8
        return cls(levels)


def _words(digest: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, digest)), ">u8").astype(np.uint64).reshape(-1, 4)


def _ids(x: pd.Series) -> np.ndarray:
    return x.astype("Int64").fillna(np.iinfo(np.int64).max).to_numpy(np.int64)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    words = _words(pdf["digest"])
    made = PerfectHash.build(words)
    order = np.argsort(made.slots(words))
    cols = {"digests": b"".join(map(bytes, pdf["digest"].to_numpy()[order]))}
    cols |= {k: _ids(pdf[v])[order].tobytes() for k, v in (("doc_ids", "doc_id"), ("chars", "chars"), ("sizes", "size"))}
    return pd.DataFrame([{"shard": pdf["shard"].iloc[0], "n": len(pdf), "levels": made.dump(), **cols}])


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """history: one row per distinct digest, as from winners(). One row per shard that has keys."""
    keyed = history.select(_shard(shards).alias("shard"), "digest", "doc_id", "chars", "size")
    return keyed.groupBy("shard").applyInPandas(_build, INDEX)


def _look(key: tuple, rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = rows[["doc_id", "chars", "size", "digest"]].copy()
    n = len(rows)
    member, ids, chars, sizes = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n and len(index):
        x = index.iloc[0]
        slots = PerfectHash.load(bytes(x["levels"])).slots(_words(rows["digest"]))
        held = np.frombuffer(bytes(x["digests"]), "S1").reshape(-1, 32)
        own = np.frombuffer(b"".join(map(bytes, rows["digest"])), "S1").reshape(-1, 32)
        member = slots >= 0
        member[member] = (held[slots[member]] == own[member]).all(1)
        at = slots[member]
        for got, name in ((ids, "doc_ids"), (chars, "chars"), (sizes, "sizes")):
            got[member] = np.frombuffer(bytes(x[name]), np.int64)[at]
    none = ~member | (ids == np.iinfo(np.int64).max)
    out["member"] = member
    out["held_id"] = pd.Series(ids, index=out.index, dtype="Int64").mask(none)
    out["held_chars"], out["held_size"] = chars, sizes
    return out


def lookup(rows: DataFrame, index: DataFrame, shards: int, tasks: DataFrame | None = None) -> DataFrame:
    """rows (doc_id, chars, size, digest), each with member, held_id, held_chars, held_size.

    tasks (shard, tasks): how many tasks hold a copy of a shard's index and share its rows, so that a digest's rows never meet in one; else one each."""
    left, right = rows.withColumn("shard", _shard(shards)), index
    if tasks is None:
        left, right = left.withColumn("tasks", F.lit(1)), right.withColumn("tasks", F.lit(1))
    else:
        left, right = left.join(tasks, "shard"), right.join(tasks, "shard")
    left = left.withColumn("salt", F.pmod(F.xxhash64("doc_id", "chars"), F.col("tasks")).cast("int")).select("shard", "salt", "doc_id", "chars", "size", "digest")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    out = "doc_id long, chars long, size long, digest binary, member boolean, held_id long, held_chars long, held_size long"
    return left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(_look, out)


HISTORY = "digest binary, doc_id long, chars long, size long"


def _shards(spark, keys: int) -> int:
    return max(1, -(-keys // SHARD_KEYS), min(partitions(spark), keys // 256))


def absorb(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The history (one row per distinct digest: digest, doc_id, chars, size) after a batch of digests() rows."""
    spark = rows.sparkSession
    fresh = stash(winners(rows), "batch")
    if history is None:
        history = spark.createDataFrame([], HISTORY)
    shards = _shards(spark, max(fresh.count(), history.count()))
    met = lookup(fresh, build_index(history, shards), shards)
    held = met.filter("member").select("digest", F.col("held_id").alias("doc_id"), F.col("held_chars").alias("chars"), F.col("held_size").alias("size"))
    updated = winners(met.filter("member").select("digest", "doc_id", "chars", "size").unionByName(held))
    apart = winners(met.filter("not member").select("digest", "doc_id", "chars", "size"))
    untouched = history.join(fresh.select("digest"), "digest", "left_anti").select(*updated.columns)
    return stash(updated.unionByName(apart).unionByName(untouched), "history")


def judge(rows: DataFrame, history: DataFrame) -> DataFrame:
    """One row per row of digests(): doc_id, keep_id, group_size, kept, text_sha256, all from the history's index."""
    n, total = history.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    spark = rows.sparkSession
    shards = _shards(spark, n)
    share = min(LOOKUP_ROWS, max(256, total // (4 * partitions(spark))))
    tasks = history.groupBy(_shard(shards).alias("shard")).agg(F.ceil(F.sum("size") / share).cast("int").alias("tasks"))
    seen = lookup(rows.withColumn("size", F.lit(1).cast("long")), build_index(history, shards), shards, tasks)
    return seen.select(
        "doc_id",
        F.col("held_id").alias("keep_id"),
        F.col("held_size").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("chars") == F.col("held_chars"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, batches: int = 2) -> DataFrame:
    """Verdicts on all of docs, after their batches (by a hash of doc_id) have met the growing history one by one."""
    rows = stash(digests(docs), "digests")
    batch, history = F.pmod(F.xxhash64("doc_id"), F.lit(batches)), None
    for k in range(batches):
        history = absorb(rows.filter(batch == k), history)
    return judge(rows, history)
