"""Repeated substrings across documents by per-shard suffix arrays and cross-shard merging.

A byte goes if a SPAN-byte string that covers it also starts in a document with a smaller doc_id. Documents are stored in
shards of about SHARD_BYTES. Shipping every suffix would multiply the input, so suffixes are compared in two exchanges:

1. Every SPAN-byte string holds an anchor, the KGRAM-byte string of least hash in it, so equal strings share an anchor at one
   offset. Shards send each different (anchor, surroundings) pair once, with its smallest doc_id; surroundings are all bytes
   that a SPAN-byte string with this anchor can reach. Where equal surroundings come from a smaller document, all of them go.
   Anchors with very many surroundings, found by counting those of one shard in SAMPLED, are dealt by their surroundings instead
   of by themselves, so that no task gets a common phrase whole; they have several surroundings by what was counted.
2. An anchor with several surroundings stays open for the first document of each. Each shard sorts the suffixes of its open
   regions (Larsson-Sadakane refinement: only groups not yet told apart are sorted again, by the rank of what
   follows), takes common prefixes by Kasai's bound, and sends each different SPAN-byte string once, in sorted runs of 96-bit
   fingerprints, which meet and merge by binary search.

Common passages and groups of copies thus send one entry per shard, whatever their size, and no pairs are made.

Surroundings and strings are told apart by 96 bits of two hashes. With 7e12 different surroundings (100 TB) the odds that any two
of them are taken for equal are about 7e12 ** 2 / 2 ** 97, 3e-4.

Defined results: a null or empty text and texts under SPAN bytes lose nothing; of rows that repeat a doc_id none is smaller,
so they don't shorten each other; a row without a doc_id comes after all others and is never smaller than another; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import filesystem_ready
from .shingles import column_bytes, mix, powers, seeded
from .store import filesystem, fresh, materialize, release, tasks

SPAN, KGRAM = 50, 24
SHARD_BYTES = 3 << 20
#: Entries that one bucket holds on average; an anchor with over BUCKET / 8 surroundings, by one shard in SAMPLED, is dealt by them.
BUCKET, SAMPLED = 800_000, 16
#: Stands for a missing doc_id, after all others.
NO_ID = np.iinfo(np.int64).max
_U = np.uint64
_BYTE = seeded(256, 9)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width] for every i with that many."""
    size, got = 1, x
    while size * 2 <= width:
        got = best(got[:-size], got[size:])
        size *= 2
    return best(got[: len(x) - width + 1], got[width - size : len(x) - size + 1]) if size < width else got


class Shard:
    """Documents of one shard: ids, all bytes, offsets."""

    def __init__(self, ids, data, offsets, span: int = SPAN, kgram: int = KGRAM, texts_only: bool = False):
        self.ids, self.data, self.offsets, self.span, self.kgram = ids, data, offsets, span, kgram
        if texts_only:
            return
        n = len(data)
        self.owner = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(offsets))
        self.valid = np.zeros(n, bool)  # a string of span bytes starts here and ends in the same document
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            self.valid[a : max(a, b - span + 1)] = True
        _, self.down = powers(n + 1)
        self.total = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[data] * powers(n + 1)[0][:n], out=self.total[1:])

    def hash(self, a, b) -> np.ndarray:
        """Of the bytes from a to b, by prefix sums of a polynomial."""
        return mix((self.total[b] - self.total[a]) * self.down[a] + (b - a).astype(_U))

    def anchors(self):
        """Positions, hashes of anchors, two of their surroundings, and the surroundings' ends."""
        n, k, w = len(self.data), self.kgram, self.span - self.kgram + 1
        if n < self.span:
            none = np.zeros(0, np.int64)
            return none, none.astype(_U), none.astype(_U), none.astype(np.uint32), none, none
        h = mix((self.total[k:] - self.total[: n - k + 1]) * self.down[: n - k + 1])
        least = sliding(h, w, np.minimum)  # for each start of a string
        least = np.where(self.valid[: len(least)], least, _U(0))
        most = sliding(np.r_[np.zeros(w - 1, _U), least, np.zeros(w - 1, _U)], w, np.maximum)
        at = np.flatnonzero((most == h) & (most > 0))
        own = self.owner[at]
        lo = np.maximum(at - (self.span - k), self.offsets[own])
        hi = np.minimum(at + self.span, self.offsets[own + 1])
        # equal surroundings have the anchor at one place in them
        place = mix((at - lo).astype(_U))
        one = self.hash(lo, hi) ^ place
        two = mix(one + self.hash(lo + 3, hi - 5) * _U(3)).astype(np.uint32)
        return at, h[at], one, two, lo, hi

    def entries(self):
        """anchors(), the order of their different (anchor, surroundings) pairs, and each anchor's pair."""
        at, h, c, d, lo, hi = self.anchors()
        key = mix(c + d * _U(0x9E3779B97F4A7C15))  # the surroundings hold the anchor
        first, pair = np.unique(key, return_index=True, return_inverse=True)[1:] if len(at) else (np.zeros(0, np.int64),) * 2
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, pair, self.ids[self.owner[at]])
        return at, h, c, d, lo, hi, first, pair, least


def cover(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """True from each lo to its hi."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    return np.cumsum(step)[:n] > 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order (a suffix's end sorts first)."""
    n = len(text)
    padded = np.r_[text, np.zeros(8, np.uint8)].astype(_U)
    key = np.zeros(n, _U)
    for j in range(8):
        key = (key << _U(8)) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, np.int64)
    new = np.r_[True, key[order][1:] != key[order][:-1]] if n else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank[order] = group + 1
    sorted_to = 8
    while sorted_to < n:
        size = np.bincount(group, minlength=n)
        loose = np.flatnonzero(size[group] > 1)
        if not len(loose):
            break
        sub = order[loose]
        after = rank[np.minimum(sub + sorted_to, n)]
        turn = np.argsort(group[loose] * (n + 2) + after, kind="stable")
        sub, after, own = sub[turn], after[turn], group[loose][turn]
        order[loose] = sub
        new = np.r_[True, (own[1:] != own[:-1]) | (after[1:] != after[:-1])]
        # a group's number is the place of its first suffix
        group[loose] = np.maximum.accumulate(np.where(new, loose, 0))
        rank[sub] = group[loose] + 1
        sorted_to *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int, block: int = 64) -> np.ndarray:
    """Common prefix, `depth` at most, of each suffix in order with the one before it. By Kasai's bound: a suffix shares at
    most one byte less with its forerunner than the suffix one byte earlier does; blocks of positions go side by side."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    found = np.zeros(n, np.int64)
    heads = np.arange(0, n, block)
    last = np.zeros(len(heads), np.int64)
    for r in range(block):
        i = heads + r
        i = i[i < n]
        j = before[i]
        have = j >= 0
        k = np.where(have, np.maximum(last[: len(i)] - 1, 0), 0)
        live = np.flatnonzero(have & (k < depth))
        while len(live):
            a, b = i[live] + k[live], j[live] + k[live]
            live = live[(np.maximum(a, b) < n) & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])]
            k[live] += 1
            live = live[k[live] < depth]
        found[i] = k
        last = np.where(have, k, 0)
    return found[order]


def open_strings(shard: Shard, gone: np.ndarray, lo, hi):
    """Different span-byte strings of the open surroundings, in order: (positions by string, string of each, two fingerprints,
    smallest doc_id)."""
    n, span = len(shard.data), shard.span
    starts = cover(n, lo, np.maximum(lo, hi - span + 1)) & shard.valid & ~gone
    inside = cover(n, lo, hi)
    where = np.flatnonzero(inside)
    if not len(where) or not starts.any():
        none = np.zeros(0, np.int64)
        return none, none, none.astype(_U), none.astype(np.uint32), none
    text = shard.data[where]
    order = suffix_array(text)
    common = common_prefixes(text, order, span)
    mine = np.flatnonzero(starts[where][order])
    # what two neighbours among the starts share is the least of the prefixes between them
    new = np.r_[True, np.minimum.reduceat(common, mine[:-1] + 1)[: len(mine) - 1] < span] if len(mine) > 1 else np.ones(1, bool)
    if len(mine) > 1:
        last = common[mine[-2] + 1 : mine[-1] + 1].min() < span
        new[-1] = last
    string, at = np.cumsum(new) - 1, where[order[mine]]
    first = at[new]
    one = shard.hash(first, first + span)
    two = mix(one + shard.hash(first + 7, first + span - 5) * _U(3)).astype(np.uint32)
    least = np.minimum.reduceat(shard.ids[shard.owner[at]], np.flatnonzero(new))
    return at, string, one, two, least


def load(folder: str, name: str, texts_only: bool = False) -> Shard:
    import pyarrow.parquet as pq

    fs, base = filesystem(folder)
    table = pq.read_table(f"{base}/{name}", filesystem=fs)
    data, offsets = column_bytes(table.column("text").combine_chunks() if table.num_rows else table.column("text").chunk(0))
    import pyarrow.compute as pc

    return Shard(pc.fill_null(table.column("doc_id"), NO_ID).to_numpy(), data, offsets, texts_only=texts_only)


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the shards; returns those of finished tasks (shard, bytes)."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        fs, base = filesystem(folder)
        held, size, made = [], 0, []

        def write():
            nonlocal held, size
            if held:
                name = f"{uuid.uuid4().hex}.parquet"
                with fs.open_output_stream(f"{base}/{name}") as out:
                    pq.write_table(pa.Table.from_batches(held).combine_chunks(), out, compression="zstd", use_dictionary=False)
                made.append((name, size))
                held, size = [], 0

        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(0), pc.fill_null(batch.column(1), "").cast(pa.large_string())], ["doc_id", "text"])
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            a = 0
            while a < len(batch):
                done = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, done + SHARD_BYTES - size, "right")))
                held.append(batch.slice(a, b - a))
                size += int(ends[b - 1] - done)
                a = b
                if size >= SHARD_BYTES or a < len(batch):
                    write()
        write()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.int64())], ["shard", "bytes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "shard string, bytes long")


def _packed(*columns) -> bytes:
    """Columns of one length, side by side."""
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = len(data) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _dealt(bucket: np.ndarray, buckets: int):
    """(bucket, places) of each bucket that has entries."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, order[ends[b] : ends[b + 1]]) for b in range(buckets) if ends[b] < ends[b + 1]]


def _rows(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "shard", "data"])


ROWS = "bucket long, shard string, data binary"


def hot_anchors(shards: DataFrame, folder: str, total: int, sampled: int = SAMPLED) -> np.ndarray:
    """Anchors with about BUCKET / 8 surroundings or more, sorted: 8 numbers for each of the buckets at most. Counted in one shard of
    `sampled`, or in all where an anchor that common would stand in few shards."""
    share = 1 if total < 4 * sampled * SHARD_BYTES else sampled

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name in batch.column(0).to_pylist():
                _, h, _, _, _, _, first, _, _ = load(folder, name).entries()
                own, n = np.unique(h[first], return_counts=True)
                own, n = own[n > 1], n[n > 1]
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["h", "n"])

    some = shards.filter(F.pmod(F.xxhash64("shard"), F.lit(share)) == 0).select("shard")
    found = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= BUCKET // 8 // share)
    return np.sort(np.array([r.h for r in found.select("h").collect()], np.int64).view(_U))


def bucket_of(h: np.ndarray, c: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Where an anchor's entries meet."""
    own = h % _U(buckets)
    if len(hot):
        own = np.where(hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h, mix(h + c) % _U(buckets), own)
    return own.astype(np.int64)


def send_anchors(shards: DataFrame, folder: str, buckets: int, hot: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                s = load(folder, name)
                _, h, c, d, _, _, first, _, least = s.entries()
                h, c, d = h[first], c[first], d[first]
                # within a bucket 32 bits tell anchors apart: two taken for one only leaves them open
                rest = (h // _U(buckets)).astype(np.uint32)
                rows = [(b, name, _packed(rest[i], c[i], d[i], least[i])) for b, i in _dealt(bucket_of(h, c, hot, buckets), buckets)]
                if rows:
                    yield _rows(rows)

    return shards.select("shard").mapInArrow(run, ROWS)


def meet_anchors(hot: np.ndarray, buckets: int):
    hot_rest = np.unique((hot // _U(buckets)).astype(np.uint32))

    def run(keys, table):
        """Of one bucket's entries: 1 where a smaller document has the pair, 2 where it is the first of several surroundings."""
        import pyarrow as pa

        names, blobs = table.column("shard").to_pylist(), [_unpacked(x, np.uint32, _U, np.uint32, np.int64) for x in table.column("data").to_pylist()]
        h, c, d, doc = (np.concatenate(x) for x in zip(*blobs, strict=True))
        sizes = [len(b[0]) for b in blobs]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        dealt = np.isin(h, hot_rest)  # its other surroundings may lie in other buckets
        shared = order[np.r_[same, False] | np.r_[False, same] | dealt[order]]  # only anchors met twice
        state = np.zeros(len(h), np.uint8)
        if len(shared):
            turn = np.lexsort((doc[shared], d[shared], c[shared], h[shared]))
            i = shared[turn]
            new_h = np.r_[True, h[i][1:] != h[i][:-1]]
            new_c = new_h | np.r_[True, (c[i][1:] != c[i][:-1]) | (d[i][1:] != d[i][:-1])]
            several = (np.add.reduceat(new_c.astype(np.int64), np.flatnonzero(new_h))[np.cumsum(new_h) - 1] > 1) | dealt[i]
            lead = doc[i][np.flatnonzero(new_c)][np.cumsum(new_c) - 1]
            state[i] = np.where(doc[i] > lead, 1, np.where(several, 2, 0))
        rows, at = [], 0
        for name, n in zip(names, sizes, strict=True):
            own = state[at : at + n]
            at += n
            told = np.flatnonzero(own).astype(np.uint32)
            if len(told):
                rows.append((keys[0].as_py(), name, _packed(told, own[told])))
        return pa.Table.from_batches([_rows(rows)])

    return run


def merged(runs: list[tuple]) -> tuple:
    """Sorted runs (fingerprint, second, doc, origin) as one: each run's places in the other are found by binary search."""
    while len(runs) > 1:
        pairs = [runs[i : i + 2] for i in range(0, len(runs), 2)]
        runs = []
        for pair in pairs:
            if len(pair) == 1:
                runs += pair
                continue
            a, b = pair
            at = np.searchsorted(a[0], b[0], "right") + np.arange(len(b[0]))
            other = np.ones(len(a[0]) + len(b[0]), bool)
            other[at] = False
            joined = []
            for x, y in zip(a, b, strict=True):
                z = np.empty(len(other), x.dtype)
                z[at], z[other] = y, x
                joined.append(z)
            runs.append(tuple(joined))
    return runs[0]


def meet_strings(keys, table):
    """Of one bucket's strings: those that a smaller document of another shard has."""
    import pyarrow as pa

    names, runs, at = table.column("shard").to_pylist(), [], 0
    sizes = []
    for x in table.column("data").to_pylist():
        one, two, doc = _unpacked(x, _U, np.uint32, np.int64)
        runs.append((one, two, doc, np.arange(at, at + len(one))))
        sizes.append(len(one))
        at += len(one)
    one, two, doc, origin = merged(runs)
    new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
    least = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
    late = np.zeros(at, bool)
    late[origin] = doc > least
    rows, a = [], 0
    for name, n in zip(names, sizes, strict=True):
        told = np.flatnonzero(late[a : a + n]).astype(np.uint32)
        a += n
        if len(told):
            rows.append((keys[0].as_py(), name, _packed(told)))
    return pa.Table.from_batches([_rows(rows)])


def judged(shard: Shard, replies: dict[int, bytes], buckets: int, hot: np.ndarray):
    """(bytes that go, open strings) from the first exchange's replies."""
    at, h, c, _, lo, hi, first, pair, least = shard.entries()
    state = np.zeros(len(first), np.uint8)
    for b, i in _dealt(bucket_of(h[first], c[first], hot, buckets), buckets):
        if b in replies:
            told, value = _unpacked(replies[b], np.uint32, np.uint8)
            state[i[told]] = value
    mine = shard.ids[shard.owner[at]]
    covered = (mine > least[pair]) | (state[pair] == 1) if len(at) else np.zeros(0, bool)
    opened = ~covered & (state[pair] == 2) if len(at) else covered
    n = len(shard.data)
    gone = cover(n, lo[covered], hi[covered])
    told_apart = cover(n, lo[covered], np.maximum(lo[covered], hi[covered] - shard.span + 1))
    strings = open_strings(shard, told_apart, lo[opened], hi[opened])
    late = np.zeros(0, np.int64)
    if len(strings[0]):
        late = strings[0][shard.ids[shard.owner[strings[0]]] > strings[4][strings[1]]]
    return gone | cover(n, late, late + shard.span), strings


def string_bucket(one: np.ndarray, buckets: int) -> np.ndarray:
    """Where strings meet: ranges of the fingerprint, so that sorted strings stand by bucket."""
    return ((one >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def send_strings(folder: str, buckets: int, hot: np.ndarray):
    """Sends each shard's open strings, and keeps beside the shard what is decided of it: bytes that go, the strings' positions by
    fingerprint, how many each string has, and where each bucket's strings begin. Whatever attempt writes it, it is the same."""

    def run(keys, table):
        import pyarrow as pa

        name = keys[0].as_py()
        replies = {b: d for b, d in zip(table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True) if b >= 0}
        gone, (at, string, one, two, least) = judged(load(folder, name), replies, buckets, hot)
        order = np.argsort(one, kind="stable")
        one, two, least = one[order], two[order], least[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = rank[string]
        at = at[np.argsort(place, kind="stable")].astype(np.int32)
        sent = _dealt(string_bucket(one, buckets), buckets)
        fs, base = filesystem(folder)
        with fs.open_output_stream(f"{base}/{name}.judged", compression=None) as f:
            np.savez(f, gone=np.packbits(gone), at=at, n=np.bincount(place, minlength=len(one)).astype(np.int32), bucket=np.array([x for x, _ in sent], np.int64), start=np.array([i[0] for _, i in sent], np.int64))
        return pa.Table.from_batches([_rows([(x, name, _packed(one[i], two[i], least[i])) for x, i in sent])])

    return run


def finish(folder: str):
    def run(keys, table):
        import io

        import pyarrow as pa

        name = keys[0].as_py()
        shard = load(folder, name, texts_only=True)
        fs, base = filesystem(folder)
        with fs.open_input_stream(f"{base}/{name}.judged", compression=None) as f:
            kept = np.load(io.BytesIO(f.read()))
        gone, start = np.unpackbits(kept["gone"], count=len(shard.data)).astype(bool), dict(zip(kept["bucket"].tolist(), kept["start"].tolist(), strict=True))
        goes = np.zeros(len(kept["n"]), bool)
        for b, d in zip(table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True):
            if b >= 0:
                goes[start[b] + _unpacked(d, np.uint32)[0].astype(np.int64)] = True
        if goes.any():
            x = kept["at"][np.repeat(goes, kept["n"])].astype(np.int64)
            gone |= cover(len(shard.data), x, x + shard.span)
        out = [[] for _ in range(5)]
        for doc, a, b in zip(shard.ids.tolist(), shard.offsets[:-1].tolist(), shard.offsets[1:].tolist(), strict=True):
            own, text = gone[a:b], shard.data[a:b]
            row = (None if doc == NO_ID else doc, b - a, int(own.sum()), int((own & ~np.r_[False, own[:-1]]).sum()) if b > a else 0, hashlib.sha256(text[~own].tobytes()).hexdigest())
            for column, x in zip(out, row, strict=True):
                column.append(x)
        return pa.table({c.split()[0]: pa.array(x, k) for c, x, k in zip(RESULT.split(", "), out, [pa.int64()] * 4 + [pa.string()], strict=True)})

    return run


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    spark = docs.sparkSession
    folder = fresh(spark, "shards")
    filesystem_ready(spark, folder)
    shards = materialize(spark, store(docs, folder), "shards-of")
    total = shards.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(8, round(total * 2 / (SPAN - KGRAM + 2) / BUCKET))
    n = tasks(spark, total // (4 * SHARD_BYTES))
    spread = shards.repartition(n, "shard")
    hot = hot_anchors(spread, folder, total)
    met = send_anchors(spread, folder, buckets, hot).groupBy("bucket").applyInArrow(meet_anchors(hot, buckets), ROWS)
    answers = materialize(spark, met, "anchors")
    release(spark)
    every = shards.select(F.lit(-1).cast("long").alias("bucket"), "shard", F.lit(None).cast("binary").alias("data"))
    strings = answers.unionByName(every).repartition(n, "shard").groupBy("shard").applyInArrow(send_strings(folder, buckets, hot), ROWS)
    late = materialize(spark, strings.groupBy("bucket").applyInArrow(meet_strings, ROWS), "strings")
    release(spark)
    return late.unionByName(every).repartition(n, "shard").groupBy("shard").applyInArrow(finish(folder), RESULT)
