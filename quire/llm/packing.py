"""Packing token pieces into sequences by minimum bin slack.

Each document is encoded once and cut into pieces of `capacity` ids and one remainder. Full pieces are sequences. Remainders
meet in groups of bounded size; in a group each window takes the longest piece left and then the multiset of remaining
lengths that fills it closest to capacity, found by subset sums in the bits of one integer, with counts by backtracking.

Defined results: a null or empty text is the end id alone; rows repeated with one doc_id are packed once each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

CAPACITY, END_ID, GROUP = 4096, 2, 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
CACHED, LONGEST = 600_000, 40
#: The tokenizer's own split pattern, with its classes written out for characters below U+0250.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
BELOW = 0x250
_encoders: dict[str, Encoder] = {}


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(BELOW)) if unicodedata.category(c).startswith(kind))


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


class Encoder:
    """Ids of a text as little-endian 32-bit bytes, each different word encoded once.

    Texts of characters below U+0250 are lower-cased and split here by the tokenizer's pattern, and its model encodes each
    new word. Other texts, and those with its special strings, are parted at blanks and line feeds, which never lie within a
    token and are dropped, and each new part goes through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        space = r"\t\n\x0b\x0c\r \x85\xa0"
        self.split = re.compile(SPLIT.format(L=_class("L"), N=_class("N"), S=space)).findall
        self.other = re.compile(f"[^\x00-\u024f]|<\\|").search
        self.names = _byte_names()
        self.words, self.parts = {}, {"": b""}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each process, so that its tasks share what is known."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _word(self, word: str) -> bytes:
        named = word if word.isascii() else "".join([self.names[b] for b in word.encode()])
        if not word.isprintable():
            named = "".join([self.names[b] for b in word.encode()])
        return struct.pack(f"<{len(got)}I", *got) if (got := [t.id for t in self.model.tokenize(named)]) else b""

    def _part(self, parts: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch(parts, add_special_tokens=False)
        return {p: struct.pack(f"<{len(e.ids)}I", *e.ids) for p, e in zip(parts, found, strict=True)}

    def _joined(self, known: dict[str, bytes], parts: list[str], encode) -> bytes:
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            pass
        new = encode([p for p in set(parts) if p not in known])
        out = b"".join([known[p] if p in known else new[p] for p in parts])
        if len(known) + len(new) > CACHED:
            known.clear()
            known[""] = b""
        known.update((k, v) for k, v in new.items() if len(k) <= LONGEST)
        return out

    def __call__(self, text: str) -> bytes:
        low = text.lower()
        if self.other(low):
            return self._joined(self.parts, text.replace("\n", " ").split(" "), self._part)
        return self._joined(self.words, self.split(low), lambda new: {w: self._word(w) for w in new})


def encode(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def pieces(batches):
        import pyarrow as pa

        ids, end = Encoder.of(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            out = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = ids(text.as_py() or "") + end
                n = len(got) // 4
                for start in range(0, n, capacity):
                    part = got[4 * start : 4 * (start + capacity)]
                    for column, x in zip(out, (doc_id, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(pieces, PIECES)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The lengths and how many of each, out of counts, whose sum comes closest to room from below."""
    if room <= 0:
        return {}
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def windows(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The positions in lengths that share each window."""
    by: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        by.setdefault(lengths[i], []).append(i)
    counts, out = {k: len(v) for k, v in by.items()}, []
    for seed in sorted(by, reverse=True):
        while by[seed]:
            counts[seed] -= 1
            room, window = capacity - seed, [by[seed].pop()]
            if not counts[seed]:
                del counts[seed]
            for length, n in fill(counts, room).items():
                window += [by[length].pop() for _ in range(n)]
                counts[length] -= n
                if not counts[length]:
                    del counts[length]
            out.append(window)
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    spark = docs.sparkSession
    made = materialize(spark, encode(docs, tokenizer, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = made.filter(F.col("length") == capacity)
    rest = made.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))

    def one(keys, table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("uid", "ascending")])
        lengths = table.column("length").to_numpy()
        n = len(lengths)
        sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k, members in enumerate(windows(lengths.tolist(), capacity)):
            own = lengths[members]
            sequence[members] = keys[0].as_py() << 32 | k
            offset[members] = np.cumsum(own) - own
        return table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    keyed = rest.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    packed = keyed.groupBy("group").applyInArrow(one, PIECES + ", sequence_id long, offset long")
    alone = whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
