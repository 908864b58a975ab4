"""Language-model scores by cross-entropy difference.

A target model (documents labelled of good quality) and a background model (all documents) are bigram models of one form over one
vocabulary, which grows with the corpus: every word and word pair is counted under its own 64-bit hash. A document's score is
the mean over its words of the background's loss less the target's, in nats: above 0, the text is likelier under the target. A
target document is scored without its own words in the target model, as any other document is.

1. Each task writes its rows' words to the shared folder, in shards of about TOKENS words; texts are not shuffled.
2. Each shard counts its own grams, all and those of target rows, and sends them by ranges of the hash, sorted and packed.
3. Each range sums them and answers each shard with the corpus's counts of the grams it sent, in the same order.
4. Each shard scores its rows from the answers.

Defined results: null, empty and blank texts have 0 words and score 0; rows that repeat doc_id and text get equal scores, each
without its own words; without target documents the target model is the background's prior and scores are still defined; an empty table gives an empty result;
further columns are ignored. The prior is spread over the corpus's distinct words, UNIGRAMS at least.
"""

from __future__ import annotations

import io
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import filesystem_ready
from .store import drop, filesystem, fresh, materialize, release, tasks

UNIGRAMS = 1 << 16
BACKOFF, ADDED = 0.4, 0.5
#: Words of a shard (about; a longer row is a shard of its own), and of the corpus per range of hashes.
TOKENS, PER_RANGE = 1 << 22, 1 << 21


def packed(x) -> bytes:
    """An array of integers by byte planes, compressed."""
    import numpy as np
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpacked(data: bytes, n: int, kind: str):
    import numpy as np
    import pyarrow as pa

    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(kind)


def written(docs: DataFrame, folder: str, tokens: int) -> DataFrame:
    """shard, at, doc_id, n_words for each row of docs; folder/shard holds the words of the shard's rows that have any, in
    order: distinct hashes, the place of each word among them, words of each row, doc_ids and which of them are null."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .shingles import column_bytes, runs, word_hashes

        fs, base = filesystem(folder)
        ids, counts, words = [], [], []

        def flush():
            name, n = uuid.uuid4().hex, np.concatenate(counts)
            doc_ids = pa.concat_arrays(ids)
            some, null = n > 0, np.asarray(doc_ids.is_null())
            if some.any():
                hashes, place = np.unique(np.concatenate(words), return_inverse=True)
                with fs.open_output_stream(f"{base}/{name}", compression="zstd") as out:
                    for x in (hashes, place.astype(np.uint32), n[some], np.asarray(doc_ids.fill_null(0))[some], null[some]):
                        held = io.BytesIO()
                        np.save(held, x)
                        out.write(held.getvalue())
            at = np.where(some, np.cumsum(some) - 1, -1)
            made = pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(at, pa.int64()), doc_ids, pa.array(n, pa.int64())], ["shard", "at", "doc_id", "n_words"])
            for x in (ids, counts, words):
                x.clear()
            return made

        held = 0
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in runs(offsets):
                own, n = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if held and held + len(own) > tokens:
                    yield flush()
                    held = 0
                ids.append(batch.column(0).slice(a, b - a))
                counts.append(n)
                words.append(own)
                held += len(own)
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "shard string, at long, doc_id long, n_words long")


class Shard:
    """The words of a shard's rows and their grams: kinds[0] are its distinct words, kinds[1] its distinct pairs of a word and the
    one before (which at a row's start is none), both sorted."""

    def __init__(self, folder: str, name: str):
        import numpy as np

        from .shingles import mix

        fs, base = filesystem(folder)
        with fs.open_input_stream(f"{base}/{name}", compression="zstd") as f:
            data = io.BytesIO(f.read())
        hashes, place, self.counts, self.doc_ids, self.null = (np.load(data) for _ in range(5))
        words = hashes[place]
        self.starts = np.cumsum(self.counts) - self.counts
        before = np.r_[np.zeros(1, np.uint64), words[:-1]]
        before[self.starts] = 0
        pairs, first, self.pair = np.unique(mix(before * np.uint64(0x9E3779B97F4A7C15) + words), return_index=True, return_inverse=True)
        self.kinds, self.word, self.pair_word = (hashes, pairs), place, place[first]
        #: the place of the word before in each pair; -1 at a row's start
        self.pair_before = np.where(before[first] == 0, -1, place[np.maximum(first, 1) - 1].astype(np.int64))


def sent(marked: DataFrame, folder: str, ranges: int, n: int) -> DataFrame:
    """part, shard, n, keys, target, background: of each shard its distinct grams in one range of hashes; part is the range, for
    pairs counted on from `ranges`."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        shard = Shard(folder, key[0].as_py())
        hit = np.zeros(len(shard.counts), bool)
        hit[np.asarray(table["at"].filter(table["hit"]))] = True
        own = np.repeat(hit, shard.counts)
        fs, base = filesystem(folder)
        with fs.open_output_stream(f"{base}/{key[0].as_py()}-hit") as f:  # the same whatever attempt writes it
            f.write(hit.tobytes())
        bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
        out = []
        for kind, places in enumerate((shard.word, shard.pair)):
            keys = shard.kinds[kind]
            target, background = (np.bincount(x, minlength=len(keys)).astype(np.uint32) for x in (places[own], places))
            cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
            for i in range(ranges):
                a, b = cuts[i], cuts[i + 1]
                if a < b:
                    out.append((kind * ranges + i, key[0].as_py(), b - a, packed(np.diff(keys[a:b], prepend=np.uint64(0))), packed(target[a:b]), packed(background[a:b])))
        types = [pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * 3]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["part", "shard", "n", "keys", "target", "background"])

    return marked.filter("n_words > 0").select("shard", "at", "hit").repartition(n, "shard").groupBy("shard").applyInArrow(run, "part long, shard string, n long, keys binary, target binary, background binary")


def summed(grams: DataFrame, n: int) -> DataFrame:
    """part, shard, n, target, background: the corpus's counts of what each shard sent, in its order; distinct (in one row of each
    part, else 0) is the number of the part's grams."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        sizes = table["n"].to_pylist()
        keys = np.concatenate([np.cumsum(unpacked(x, k, "<u8"), dtype=np.uint64) for x, k in zip(table["keys"].to_pylist(), sizes, strict=True)])
        met, place = np.unique(keys, return_inverse=True)
        cuts = np.cumsum(sizes)[:-1]
        answers = []
        for name in ("target", "background"):
            local = np.concatenate([unpacked(x, k, "<u4") for x, k in zip(table[name].to_pylist(), sizes, strict=True)])
            total = np.zeros(len(met), np.int64)
            np.add.at(total, place, local.astype(np.int64))
            answers.append(pa.array([packed(x) for x in np.split(total[place], cuts)], pa.binary()))
        distinct = pa.array([len(met)] + [0] * (len(sizes) - 1), pa.int64())
        return pa.Table.from_arrays([table["part"], table["shard"], table["n"], *answers, distinct], ["part", "shard", "n", "target", "background", "distinct"])

    return grams.repartition(n, "part").groupBy("part").applyInArrow(run, "part long, shard string, n long, target binary, background binary, distinct long")


def probability(one, two, first, total, vocabulary: int):
    """Of a word met `one` times, `two` times of which after a word met `first` times, by an interpolated bigram model."""
    import numpy as np

    alone = (one + ADDED) / (total + ADDED * vocabulary)
    return BACKOFF * two / np.maximum(1, np.maximum(first, two)) + (1 - BACKOFF) * alone


def losses(shard: Shard, one, two, total: int, vocabulary: int):
    """Negative log probability of the word of each of the shard's pairs after the one before."""
    import numpy as np

    first = np.where(shard.pair_before < 0, 0, one[shard.pair_before])
    return -np.log(probability(one[shard.pair_word], two, first, total, vocabulary))


def held_out(shard: Shard, hit, one, two, total: int, vocabulary: int):
    """(places of the words of the rows in hit, negative log probability of each, by counts without those of its own row)."""
    import numpy as np

    at = np.flatnonzero(np.repeat(hit, shard.counts))
    row = np.repeat(np.arange(len(shard.counts)), shard.counts)[at]

    def own(place, kinds: int):
        return np.unique(row * kinds + place.astype(np.int64), return_inverse=True, return_counts=True)[1:]

    (w, wn), (p, pn) = own(shard.word[at], len(shard.kinds[0])), own(shard.pair[at], len(shard.kinds[1]))
    alone = one[shard.word[at]] - wn[w]
    start = np.isin(at, shard.starts)
    first = np.where(start, 0, np.r_[0, alone[:-1]])
    return at, -np.log(probability(alone, two[shard.pair[at]] - pn[p], first, total - shard.counts[row], vocabulary))


def scored(answers: DataFrame, folder: str, ranges: int, totals: tuple[int, int], vocabulary: int, n: int) -> DataFrame:
    """doc_id, n_words, score of each row with words."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        shard, table = Shard(folder, key[0].as_py()), table.sort_by("part")
        cut, sizes, loss = sum(x < ranges for x in table["part"].to_pylist()), table["n"].to_pylist(), []
        fs, base = filesystem(folder)
        with fs.open_input_stream(f"{base}/{key[0].as_py()}-hit") as f:
            hit = np.frombuffer(f.read(), bool)
        for name, total in zip(("target", "background"), totals, strict=True):
            counts = [unpacked(x, k, "<i8") for x, k in zip(table[name].to_pylist(), sizes, strict=True)]
            one, two = np.concatenate(counts[:cut]), np.concatenate(counts[cut:])
            loss.append(losses(shard, one, two, total, vocabulary)[shard.pair])
            if name == "target" and hit.any():
                at, without = held_out(shard, hit, one, two, total, vocabulary)
                loss[0][at] = without
        score = np.add.reduceat(loss[1] - loss[0], shard.starts) / shard.counts
        return pa.Table.from_arrays([pa.array(shard.doc_ids, pa.int64(), mask=shard.null), pa.array(shard.counts, pa.int64()), pa.array(score)], ["doc_id", "n_words", "score"])

    return answers.drop("distinct").repartition(n, "shard").groupBy("shard").applyInArrow(run, "doc_id long, n_words long, score double")


def score(docs: DataFrame, labels: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """doc_id, n_words, score for each row of docs."""
    spark = docs.sparkSession
    folder, made, at = fresh(spark, "words"), fresh(spark, "rows"), fresh(spark, "counts")
    filesystem_ready(spark, folder)
    rows = materialize(spark, written(docs, folder, tokens), "rows", made)
    target = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("target__id")).distinct()
    marked = rows.join(target, F.col("doc_id") == F.col("target__id"), "left").withColumn("hit", F.col("target__id").isNotNull())
    size = marked.agg(F.sum(F.when(F.col("hit"), F.col("n_words"))).alias("target"), F.sum("n_words").alias("background"), F.countDistinct("shard").alias("shards")).first()
    totals = (size.target or 0, size.background or 0)
    ranges = tasks(spark, totals[1] // PER_RANGE + 1)
    answers = materialize(spark, summed(sent(marked, folder, ranges, tasks(spark, size.shards)), tasks(spark, 2 * ranges)), "counts", at)
    release(spark)
    vocabulary = max(UNIGRAMS, answers.filter(F.col("part") < ranges).agg(F.sum("distinct")).first()[0] or 0)
    found = scored(answers, folder, ranges, totals, vocabulary, tasks(spark, size.shards))
    out = materialize(spark, found.unionByName(rows.filter("n_words = 0").select("doc_id", "n_words", F.lit(0.0).alias("score"))), "scores")
    for path in (folder, made, at):
        drop(spark, path)
    return out
