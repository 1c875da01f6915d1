"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Vocabularies come as a tokenizer file or as ranks; for ranks the merges are recovered by merging each token's bytes by
the ranks below its own, and bytes map to characters by the byte-level alphabet. A text is cut where a single space
or a line's end stands between two visible characters: a pre-token of these patterns starts at each such space, and a
line's end is one of its own, so the pieces can be encoded apart; pieces that return are kept in a bounded memo. Decoding reverses the byte table;
bytes are joined before they become text, so characters split over tokens come out whole.

Cases: null and empty texts have no ids; special tokens' strings are ordinary text; texts of any length and any
Unicode are encoded whole; rows that repeat get equal results; a null doc_id is encoded like any other; extra columns are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.llm.common import kept

#: A space between two visible characters; pieces start there. \x1c-\x1f and the like count as white space here, which only makes fewer cuts.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space besides the space and the line's end.
OTHER = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words in a generation of a memo, and the length beyond which a word isn't kept.
MEMO, LONG = 400_000, 64
#: After letters, each of these is a pre-token of its own; so are letters with at most one space before them.
SIGNS = frozenset(",.;:!?")
#: Texts are encoded in runs of at most so many rows and code points, so that memory stays bounded whatever the batch holds.
ROWS, RUN = 256, 4_000_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable bytes stand for themselves, the rest follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b], more = chr(more), more + 1
    return [out[b] for b in range(256)]


def odd(text: str) -> bool:
    """Whether a space or a line's end may be no cut: it stands beside other white space or at an end, or there is white space of another kind."""
    ends = text[:1] + text[-1:]
    return " " in ends or "\n" in ends or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or OTHER.search(text) is not None


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def split_by_ranks(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts that stand before the last merge that makes token."""
    parts, most = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best = min(((ranks.get(a + b, most), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(most, 0))
        if best[0] >= most:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def tokenizer_from_ranks(path: str, pattern: str):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = load_ranks(path), byte_alphabet()
    shown = lambda t: "".join(chars[b] for b in t)
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
        parts = split_by_ranks(token, ranks)
        if len(parts) == 2:
            merges.append((shown(parts[0]), shown(parts[1])))
    made = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


def tokenizer_from_file(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


class Memo(dict):
    """word -> made(ids of prefix + word); two generations of at most MEMO words, so that frequent words stay. A word takes some 200 bytes."""

    def __init__(self, tokenizer, prefix: str, made):
        super().__init__()
        self.tokenizer, self.prefix, self.made, self.old = tokenizer, prefix, made, {}
        self.model, self.chars = tokenizer.model, dict(enumerate(byte_alphabet()))

    def ids(self, word: str) -> list[int]:
        if word.isalpha():
            return self.merged(self.prefix + word)
        if word[-1:] in SIGNS and word[:-1].isalpha():
            return self.merged(self.prefix + word[:-1]) + self.merged(word[-1])
        return self.tokenizer.encode(self.prefix + word, add_special_tokens=False).ids

    def merged(self, piece: str) -> list[int]:
        """The ids of one pre-token: its bytes become characters and go straight to the model."""
        return [t.id for t in self.model.tokenize(piece.encode("utf-8", "replace").decode("latin-1").translate(self.chars))]

    def __missing__(self, word: str):
        if (out := self.old.get(word)) is None:
            out = self.made(self.ids(word))
        if len(word) <= LONG:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


class Codec:
    """Encodes texts piece by piece with memos, and decodes ids."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.bytes = [b""] * (max(tokenizer.get_vocab().values()) + 1)
        for shown, i in tokenizer.get_vocab().items():
            self.bytes[i] = bytes(back[c] for c in shown) if all(c in back for c in shown) else shown.encode()
        self.raw = self.pieces(lambda ids: struct.pack(f"<{len(ids)}I", *ids))
        self.said = list(map(str, range(len(self.bytes))))
        self.sizes = np.array(list(map(len, self.bytes)), np.int64)

    def pieces(self, made):
        """A function from a text to what `made` makes of the ids of each of its pieces, in order."""
        bare, spaced, line = (Memo(self.tokenizer, p, made) for p in ("", " ", "\n"))
        first, later = bare.__getitem__, spaced.__getitem__

        def cut(text: str) -> list:
            if odd(text):
                parts = CUT.split(text)
                return [first(parts[0]), *map(later, parts[1:])]
            out = []
            for k, row in enumerate(text.split("\n")):
                if k:
                    out.append(line[""])
                words = row.split(" ")
                out.append(first(words[0]))
                out += map(later, words[1:])
            return out

        return cut

    def encode_raw(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.raw(text))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        return (np.frombuffer(self.encode_raw(t), "<u4") for t in texts)

    def decode(self, ids) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code points of the decoded text where each id begins and ends; an id that holds part of a character has the whole of it."""
        ends = np.cumsum(self.sizes[ids])
        head = (np.frombuffer(self.decode(ids.tolist()), np.uint8) & 0xC0) != 0x80
        point = np.concatenate([np.cumsum(head) - 1, [int(head.sum())]])
        first = point[ends - self.sizes[ids]]
        return first, np.maximum(first, point[ends - 1] + 1) if len(ids) else first


def runs(texts: list[str]) -> Iterator[list[str]]:
    """texts in order, in lists that hold one text or at most RUN code points."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > RUN:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


_CODECS: dict[tuple, Codec] = kept({})


def codec(path: str, pattern: str | None = None) -> Codec:
    """One codec per worker for each vocabulary; pattern: given for rank files."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(tokenizer_from_ranks(path, pattern) if pattern else tokenizer_from_file(path))
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """(doc_id, ids): ids as array<int>; with offsets also starts and ends, each id's place in the text in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at, run_ in _sliced(batch):
                ids = list(own.encode(run_))
                ends = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
                parts = [ids, *(zip(*map(own.offsets, ids), strict=True) if offsets and ids else ())]
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*x, np.zeros(0, np.uint32)]).astype(np.int32))) for x in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(run_)), *lists], ["doc_id", *names])

    names = ["ids", "starts", "ends"] if offsets else ["ids"]
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, ", ".join(["doc_id long", *(f"{c} array<int>" for c in names)]))


def decode(encoded: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, decoded): the bytes of the ids, as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            out = [own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Runs of a batch's texts with where they begin. Texts leave Arrow a few rows at a time: as strings they may take four times as much."""
    column = batch.column(1)
    for first in range(0, len(column), ROWS):
        at = first
        for run in runs(column.slice(first, ROWS).to_pylist()):
            yield at, run
            at += len(run)


def round_trip(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded in one pass, so that no ids cross a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            out = []
            for _, texts in _sliced(batch):
                for text in texts:
                    ids = np.frombuffer(own.encode_raw(text), "<u4").tolist()
                    said = ",".join([own.said[i] for i in ids])
                    out.append((len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
