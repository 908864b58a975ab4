"""Training-data operators against brute force, on small fixtures with nulls, empty and repeated texts, ties and clashing columns."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import components, exact_dedup, lm_scoring, media, mixing, near_dedup, packing, quality, suffixes, toxicity, warc
from quire.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, h long, score double, uid long"


def make(spark, texts, sources=None):
    rows = [(i, t, None, (sources[i] if sources else "s"), None, True, 7, 8, 0.5, 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(n // 3)]
    line = " ".join(word() for _ in range(14))
    out = [None, "", " \n ", "x", "x", base[0] * 60]
    for b in base:
        out += [b, b.replace(" ", "\n", 1), line + "\n" + b]
        w = b.split()
        w[rng.randrange(len(w))] = "zz"
        out.append(" ".join(w))
    return out


def rows(df):
    return {r[0]: r for r in df.collect()}


def test_exact_dedup(spark):
    texts = corpus()
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    got = rows(exact_dedup.dedup(make(spark, texts)))
    for i, x in enumerate(norm):
        group = [j for j, y in enumerate(norm) if y == x]
        keep = min(group, key=lambda j: (-len(texts[j] or ""), j))
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(group), keep == i, hashlib.sha256(x.encode()).hexdigest())


def test_exact_dedup_unequal_bytes_under_one_digest(spark):
    texts = corpus(n=30)
    weak = exact_dedup.members(make(spark, texts), digest=lambda c: F.substring(exact_dedup.digest_of(c), 1, 1), files_per_batch=1)
    right = rows(exact_dedup.dedup(make(spark, texts)))
    for r in weak.collect():
        assert (r.keep_id, r.group_size) == (right[r.doc_id].keep_id, right[r.doc_id].group_size)


def test_exact_kept_rows(spark):
    docs = make(spark, ["a b", "ab", None, "", "c"])
    docs = docs.union(docs.filter("doc_id = 4"))
    got = exact_dedup.kept_rows(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 2, 4]


def test_mixing(spark):
    texts, names = corpus(), [None, "a", "b", "b", "c"]
    sources = [names[i % 5] for i in range(len(texts))]
    got = mixing.mix(make(spark, texts, sources)).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    total = {s: sum(sizes[i] for i in sizes if sources[i] == s) for s in set(sources)}
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}
    goal, budget, full = {}, 1.5 * sum(total.values()), set()
    while True:
        left = budget - sum(2 * total[s] for s in full)
        rest = [s for s in order if s not in full]
        goal = {s: 2 * total[s] if s in full else left * weight[s] / sum(weight[x] for x in rest) for s in order}
        more = {s for s in rest if goal[s] > 2 * total[s]}
        if not more:
            break
        full |= more
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert r["size"] == sizes[r.doc_id] and r.taken <= 2 * r["size"] and r.source_size == total[sources[r.doc_id]]
        assert abs(r.target - goal[sources[r.doc_id]]) < 1e-6
        taken[sources[r.doc_id]] += r.taken
    assert all(abs(taken[s] - goal[s]) <= max(sizes[i] for i in sizes if sources[i] == s) for s in order)
    docs = make(spark, texts, sources)
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_suffixes(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 1500)
    texts = corpus(3)
    got, seen = rows(suffixes.deduplicated(make(spark, texts))), set()
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone, own = np.zeros(len(b), bool), {b[k : k + 50] for k in range(len(b) - 49)}
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone[k : k + 50] = True
        seen |= own
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        assert tuple(got[i])[1:] == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_array_and_prefixes():
    text = np.frombuffer(b"banana bandana banana", np.uint8)
    order = suffixes.suffix_array(text)
    data = text.tobytes()
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    common = suffixes.common_prefixes(text, order, 5, block=4)
    for k in range(1, len(order)):
        a, b = data[order[k - 1] :], data[order[k] :]
        assert common[k] == min(5, next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b))))


@pytest.mark.parametrize("hot", [1000, 3])
def test_near_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(near_dedup, "HOT", hot)
    monkeypatch.setattr(near_dedup, "BLOCK", hot)
    texts = [*corpus(5), "A b c d e", "a B c d e"]
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
    got = rows(near_dedup.components_of(make(spark, texts)))
    assert all((got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), parent[i], parent[i] == i) for i, s in enumerate(sets))


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (2, 2)], "a long, b long")
    assert rows(components.components(links).filter("node <> 2")).items() >= {5: (5, 3), 9: (9, 3), 8: (8, 7)}.items()


def test_packing(spark):
    path = tokenizer_path()
    texts = [*corpus(7), "word " * 9000, "a <|endoftext|> b", "ºª ½ Ünïcode \x85 日本 Σ", "don't we'LL"]
    from tokenizers import Tokenizer

    reference, ids = Tokenizer.from_file(path), {}
    for i, t in enumerate(texts):
        ids[i] = reference.encode(t or "", add_special_tokens=False).ids + [2]
    got = packing.pack(make(spark, texts), path).toPandas()
    for i, own in got.groupby("doc_id"):
        at = 0
        for r in own.sort_values("start").itertuples():
            part = ids[i][r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 4096


def test_fill():
    counts = {2000: 2, 1000: 3, 96: 1, 7: 4}
    used = packing.fill(counts, 4096)
    assert sum(k * n for k, n in used.items()) == 4096 and all(n <= counts[k] for k, n in used.items())
    assert packing.fill({5: 1}, 4) == {}


def test_warc(spark):
    html = ["abc", None, "", "abc", "é" * 500, "abc", "longer text"]
    pages = spark.createDataFrame([(10 - i, "http://x/\r\n", h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, at long").repartition(3)
    for least in (0, 4):
        got = {r.page_id: r for r in warc.deduplicated(pages, least).collect()}
        for i, h in enumerate(html):
            data = (h or "").encode()
            same = min(10 - j for j, x in enumerate(html) if (x or "") == (h or ""))
            again = len(data) >= least and same != 10 - i
            r = got[10 - i]
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", same if again else None)


def test_media(spark):
    texts = corpus(9)
    got = rows(media.stored(make(spark, texts)))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        r, m = got[i], media.encode(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest()) and media.decode(m).tobytes() == p


def test_media_tries_members_again(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m", b"data")
        info = z.infolist()[0]

    class Broken:
        def read(self, _):
            raise OSError

    reader = media.ArchiveReader({"folder": str(tmp_path), "manifest": ""})
    from quire.llm.store import filesystem

    assert reader.member(filesystem(str(tmp_path))[0], str(tmp_path / "a.zip"), info, Broken()) == b"data"


def test_automaton():
    a = toxicity.Automaton({"moron": 0, "idiot": 1}, 1)
    assert a.match("moron") == (0, 0) and a.match("mron") == (1, 0) and a.match("idiiot") == (1, 1) and a.match("idiom") == (1, 1) and a.match("morons!") is None


def auc(score, label):
    p, n = score[label == 1].to_numpy(), score[label == 0].to_numpy()
    return ((p[:, None] > n[None, :]).mean() + 0.5 * (p[:, None] == n[None, :]).mean()) if len(p) and len(n) else 1.0


@pytest.mark.parametrize("operator, column", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, operator, column):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = operator.score(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % operator.FOLDS == operator.HELD) for i, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert auc(held.score, held[column]) > 0.9
    odd = make(spark, [None, "", "x", "word " * 30000])
    assert operator.score(odd, labels.limit(0)).count() == 4


def test_context():
    s = toxicity.Scorer({"idiot": 5.0}, {}, {"idiot": 5.0}, frozenset(["idiom"]))
    plain, quoted = s.matches("you idiot")[0], s.matches('he wrote "idiot" there')[0]
    assert plain == [5.0] and quoted[0] < 2 and s.matches("an idiom")[0] == [] and s.matches("1d1ot")[0]


def test_empty_tables(spark):
    none = make(spark, ["x"]).limit(0)
    for f in (exact_dedup.dedup, near_dedup.components_of, suffixes.deduplicated, media.stored, lambda d: packing.pack(d, tokenizer_path())):
        assert f(none).count() == 0
    assert warc.deduplicated(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lm_scoring(spark):
    texts = [None, "", "a b a b", "a b c a", "c d c d", "x y", "a b a b"]
    labels = spark.createDataFrame([(2, 1), (3, 1), (4, 0), (5, None)], "doc_id long, quality int")
    got = rows(lm_scoring.score(make(spark, texts), labels))
    assert [got[i].n_words for i in range(7)] == [0, 0, 4, 4, 4, 2, 4] and got[0].score == got[1].score == 0
    words = [(t or "").split() for t in texts]
    good = [w for i, w in enumerate(words) if i in (2, 3)]

    def loss(model, w, before):
        total, one = sum(map(len, model)), sum(x.count(w) for x in model)
        first = sum(x.count(before) for x in model) if before else 0
        two = sum(sum((([None] + x)[k], x[k]) == (before, w) for k in range(len(x))) for x in model)
        after = two / max(1, first, two)
        return -np.log(0.4 * after + 0.6 * (one + 0.5) / (total + 0.5 * lm_scoring.UNIGRAMS))

    for i, w in enumerate(words):
        others = [x for k, x in zip((2, 3), good, strict=True) if k != i]  # a target document is scored by the others
        want = sum(loss(words, x, b) - loss(others, x, b) for x, b in zip(w, [None, *w], strict=False)) / max(1, len(w))
        assert abs(want - got[i].score) < 1e-9
    assert got[2].score > got[4].score


def test_lm_scoring_counts_true_words(spark):
    # more distinct words and pairs than any fixed number of buckets keeps apart; small shards, so that counts meet across them
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(150_000)}" if rng.random() < 0.8 else rng.choice("abcdef") for _ in range(9000)) for _ in range(40)]
    texts += [texts[3], None, " \n"]
    docs = make(spark, texts).withColumn("doc_id", F.expr("CASE WHEN doc_id <> 7 THEN doc_id END"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)], "doc_id long, quality int")
    got = rows(lm_scoring.score(docs, labels, tokens=40_000))
    words = [(t or "").split() for t in texts]
    models = []
    for own in ([w for i, w in enumerate(words) if i < 30 and i % 3 == 0 and i != 7], words):
        models.append((Counter(x for w in own for x in w), Counter(p for w in own for p in zip([None, *w], w, strict=False)), sum(map(len, own))))
    vocabulary = max(lm_scoring.UNIGRAMS, len(models[1][0]))
    assert vocabulary > 100_000

    def loss(model, w, before):
        one, two, total = model
        after = two[before, w] / max(1, two[before, w], one[before] if before else 0)
        return -np.log(0.4 * after + 0.6 * (one[w] + 0.5) / (total + 0.5 * vocabulary))

    for i, w in enumerate(words):
        r, target = got[None if i == 7 else i], models[0]
        if i < 30 and i % 3 == 0 and i != 7:  # scored without its own words
            target = (target[0] - Counter(w), target[1] - Counter(zip([None, *w], w, strict=False)), target[2] - len(w))
        want = sum(loss(models[1], x, b) - loss(target, x, b) for x, b in zip(w, [None, *w], strict=False)) / max(1, len(w))
        assert r.n_words == len(w) and abs(want - r.score) < 1e-9
    assert len(got) == len(texts) and got[3].score < got[40].score
    assert lm_scoring.score(docs.limit(0), labels).count() == 0


def test_near_dedup_of_hot_sets(spark, tmp_path, monkeypatch):
    # a pair of similarity 54 / 66 whose retained values are all hot and whose first six differ
    monkeypatch.setattr(near_dedup, "HOT", 10)
    sets = [[*range(1, 7), *range(20, 74)], [*range(7, 13), *range(20, 74)]]
    sets += [[*(range(1, 13) if k % 2 else ()), *range(20, 40 if k % 2 else 52), *range(1000 * (k + 1), 1000 * (k + 1) + 200)] for k in range(24)]
    made, at = [], 0
    with open(tmp_path / "sets", "wb") as f:
        for i, x in enumerate(sets):
            f.write(np.array(x, "<u8").tobytes())
            made.append((i, len(x), x[: near_dedup.RETAINED], "sets", at))
            at += 8 * len(x)
    classes = spark.createDataFrame(made, "doc_id long, n long, keys array<long>, file string, at long")
    links = near_dedup.links_of(classes, str(tmp_path), 80).collect()
    assert {frozenset(r) for r in links} == {frozenset((0, 1))}


def test_exact_kept_rows_without_doc_ids(spark):
    # null ids: a unique text, the longest copy of a group, and two equal rows
    made = [(None, "only"), (None, "a  b"), (1, "a b"), (2, "ab"), (None, "twice"), (None, "twice"), (3, "c"), (None, None)]
    got = exact_dedup.kept_rows(spark.createDataFrame(made, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == [("3", "c"), ("None", "None"), ("None", "a  b"), ("None", "only"), ("None", "twice")]


def test_near_dedup_searches_no_set_pair_by_pair(monkeypatch):
    # 240 sets around a common passage that lie under the bound, and chains of sets above it, light and heavy
    rng = np.random.default_rng(5)
    common, sets = rng.integers(0, 2**63, 90, dtype=np.uint64), []
    for i in range(240):
        own = np.concatenate([common, rng.integers(0, 2**63, 60, dtype=np.uint64)])
        for _ in range(1 + (i % 8 == 0) * 3):
            sets.append(np.unique(own))
            own = np.concatenate([own[8:], rng.integers(0, 2**63, 8, dtype=np.uint64)])
    n, heavy, asks = len(sets), [i % 5 == 0 for i in range(len(sets))], [i % 3 > 0 for i in range(len(sets))]
    searched, real = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **b: searched.append(1) or real(*a, **b))
    for coded in (near_dedup.CODED, 0):
        monkeypatch.setattr(near_dedup, "CODED", coded, raising=False)
        for asking in (None, asks):
            links = near_dedup.link_group(list(range(n)), sets, 80, heavy, asking)
            assert len(searched) < 10 * n
            searched.clear()
            want = list(range(n))
            for i in range(n):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True)) if abs(i - j) < 9 else 0
                    if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and not (heavy[i] and heavy[j]) and (asking is None or asking[i] or asking[j]):
                        want = [want[j] if x == want[i] else x for x in want]
            got = list(range(n))
            for i, j in links:
                got = [got[j] if x == got[i] else x for x in got]
            assert {tuple(k for k in range(n) if x[k] == c) for x in [want] for c in x} == {tuple(k for k in range(n) if x[k] == c) for x in [got] for c in x}


def test_near_dedup_without_doc_ids(spark):
    # copies of one text, one of them without a doc_id, and a near copy of them
    text = " ".join(f"w{i}" for i in range(80))
    made = [(5, text), (None, text), (6, text), (3, text + " end"), (None, "quite another text than those above"), (None, None), (9, "alone here with some words")]
    got = near_dedup.components_of(spark.createDataFrame(made, "doc_id long, text string").repartition(3)).collect()
    want = [("3", "3", True), ("5", "3", False), ("6", "3", False), ("9", "9", True), ("None", "3", False), ("None", "None", True), ("None", "None", True)]
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == want


def test_toxicity_signs_in_words():
    scorer = toxicity.Scorer({"idiot": 2.0, "trash": 1.5, "asshole": 3.0}, {}, {"idiot": 2.0, "trash": 1.5, "asshole": 3.0}, frozenset())
    for text, want in (("an Idi@t he is", [2.0 / 1.15]), ("tra$h", [1.5]), ("a$$hole", [3.0]), ("id*ot", [2.0 / 1.15]), ("tr_sh", [1.5 / 1.15]), ("idiot@home and my_trash", [2.0, 1.5]), ("snake_case me@home $5 a*b", [])):
        assert scorer.matches(text)[0] == want, text


@pytest.mark.parametrize("digest", [exact_dedup.digest_of, lambda c: F.substring(exact_dedup.digest_of(c), 1, 1)])
def test_exact_dedup_over_two_runs(spark, tmp_path, digest):
    # texts of the second run that the first has too, longer copies, and, with a short digest, different texts under one digest
    first, second = corpus(11, 30), [*corpus(11, 24)[5:], "new one", "x  ", "x", None, *corpus(12, 9)]
    parts, at = [], 0
    for k, texts in enumerate((first, second)):
        path = str(tmp_path / f"in put{k}")
        make(spark, texts).withColumn("doc_id", F.col("doc_id") + 1000 * (1 - k)).write.parquet(path)
        parts.append([(i + 1000 * (1 - k), t or "") for i, t in enumerate(texts)])
        got = {r.doc_id: r for r in exact_dedup.members(spark.read.parquet(path), digest=digest, state=str(tmp_path / "state")).collect()}
        every = [(i, t, re.sub(r"[\x20\x09-\x0D]", "", t)) for part in parts for i, t in part]
        assert len(got) == len(texts)
        for i, t in parts[k]:
            group = [(j, x) for j, x, n in every if n == re.sub(r"[\x20\x09-\x0D]", "", t)]
            keep = min(group, key=lambda g: (-len(g[1]), g[0]))[0]
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(group), keep == i)
    with pytest.raises(ValueError):
        exact_dedup.dedup(make(spark, ["a"]), state=str(tmp_path / "state"))


def test_exact_dedup_shuffles_hits_only(spark, tmp_path):
    make(spark, [f"text number {i} " * 50 for i in range(400)] + ["twice", "twice"]).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    rows, known = exact_dedup.located(docs)
    assert known
    hits = rows.filter("doc_id >= 400").select("locator", F.lit(1).alias("uid"))
    hits.write.parquet(str(tmp_path / "hits"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exact_dedup.hit_texts(spark, rows.select("locator", "text"), spark.read.parquet(str(tmp_path / "hits")).filter("uid > 0"), ["locator"], "t")
        assert found.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_without_ids(spark):
    texts = ["abc " * 30, "abc " * 30, None, "d" * 80 + "e" * 40, "d" * 80]
    docs = spark.createDataFrame([(None, texts[0]), (4, texts[1]), (None, None), (None, texts[3]), (9, texts[4])], "doc_id long, text string").repartition(2)
    assert sorted(str(r.doc_id) for r in media.stored(docs).collect()) == ["4", "9", "None", "None", "None"]
    assert sorted(str(r.doc_id) for r in packing.pack(docs, tokenizer_path()).collect()) == ["4", "9", "None", "None", "None"]
    # rows without an id come after all others, and are never smaller than another
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffixes.deduplicated(docs).collect()}
    assert got == {(None, 120): 80, (4, 120): 0, (None, 0): 0, (9, 80): 0} or got == {(None, 120): 120, (4, 120): 0, (None, 0): 0, (9, 80): 0}
    pages = spark.createDataFrame([(None, "u", "same"), (7, "v", "same"), (None, "w", "own"), (None, "x", "own")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.deduplicated(pages).collect())
    assert got == [("7", "response", "None"), ("None", "response", "None"), ("None", "revisit", "7"), ("None", "revisit", "None")]
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, labels).count() == quality.score(docs, labels).count() == mixing.mix(docs.withColumn("source", F.lit("s"))).count() == 5


def test_warc_headers_of_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "p"), (2, "http://b/\r\n", "p")], "page_id long, url string, html string")
    for name in ("in", "out"):
        (tmp_path / name).mkdir()
    headers = warc.write(pages, str(tmp_path / "in"))
    headers = spark.createDataFrame(headers.collect(), headers.schema)
    archives = [r.archive for r in warc.rewrite(warc.resolve(headers), str(tmp_path / "in"), str(tmp_path / "out")).collect()]
    found = [warc.parse(data)[0] for a in archives for _, data in warc.members(str(tmp_path / "out"), a)]
    revisit = next(h for h in found if h["WARC-Type"] == "revisit")
    assert revisit["WARC-Refers-To-Target-URI"] == "http://a/" and revisit["WARC-Refers-To-Date"] == warc.DATE and revisit["WARC-Target-URI"] == "http://b/"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [1, 2])
def test_automaton_as_dynamic_programming(k):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    terms = sorted({word() for _ in range(40)})
    a = toxicity.Automaton({t: i for i, t in enumerate(terms)}, k)
    for _ in range(1500):
        w = word()
        least = min(edit_distance(w, t) for t in terms)
        found = a.match(w)
        assert (found is None) == (least > k)
        if found:
            assert found[0] == least == edit_distance(w, terms[found[1]])


def test_near_dedup_of_hot_families(spark, monkeypatch):
    # passages in many documents, with own words about the bound where two of them become similar; lists over several blocks
    monkeypatch.setattr(near_dedup, "HOT", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(2)
    texts = []
    for f in range(2):
        passage = [f"p{f}x{i}" for i in range(60)]
        for k in range(60):
            own = [f"o{f}x{k}x{i}" for i in range(rng.choice([0, 1, 3, 6, 8, 12, 16]))]
            if k % 5 == 4:  # shares another's own words
                own = [f"o{f}x{k - 1}x{i}" for i in range(14)][: rng.choice([8, 14])]
            texts.append(" ".join(passage[: rng.choice([60, 60, 52])] + own))
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
    got = rows(near_dedup.components_of(make(spark, texts)))
    assert len(set(parent)) > 4 and [got[i].component_id for i in range(len(texts))] == parent


def test_near_dedup_kept_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    made = [(5, text, 1), (None, text, 2), (3, text + " end", 3), (None, "no id here at all, and nothing like it", 4), (None, "no id here at all, and nothing like it", 5), (7, None, 6), (8, "", 7)]
    docs = spark.createDataFrame(made, "doc_id long, text string, key long").repartition(3)
    got = near_dedup.kept_rows(docs)
    assert got.columns == docs.columns and sorted(str(r.doc_id) for r in got.collect()) == ["3", "7", "8", "None"]


def test_clashing_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = docs.selectExpr("*", "0.5 AS score", "1 AS score_", "2 AS label__id", "3 AS i", "4 AS t", "5 AS y", "6 AS keep_id", "7 AS key", "8 AS mix__copy")
    kept = toxicity.clean_rows(odd, labels)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
    assert kept.count() == toxicity.clean_rows(docs, labels).count() == toxicity.score(odd, labels).filter("predicted = 0").count()
    assert exact_dedup.kept_rows(odd).columns == near_dedup.kept_rows(odd).columns == odd.columns
    assert quality.score(odd, labels).count() == lm_scoring.score(odd, labels).count() == odd.count()


def test_more_empty_tables(spark):
    none, labels = make(spark, ["x"]).limit(0), spark.createDataFrame([(0, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for f in (toxicity.score, toxicity.clean_rows, quality.score, lm_scoring.score):
        assert f(none, labels).count() == 0
        assert f(make(spark, ["a b", None]), labels.limit(0)).count() == 2
    assert exact_dedup.kept_rows(none).count() == near_dedup.kept_rows(none).count() == mixing.mixed_rows(none).count() == 0


def test_pipeline(spark, tmp_path):
    # each stage against brute force on its own input: planted toxic, equal, near, empty and nameless rows beside the test data's
    import corpus_pipeline
    from quire.llm import store

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = " ".join(f"word{i}" for i in range(120))
    made = [(90_000, base), (90_001, base.replace(" ", "  ")), (90_002, base + " more"), (90_003, None), (90_004, ""), (None, "nameless " * 9), (None, base), (90_005, "of its own " + base[:200])]
    odd = spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    stages, at, kept = dict(corpus_pipeline.STAGES), spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in list(stages.items())[:-1]:
        before = [(r.doc_id, r.text, r.source) for r in at.collect()]
        at = store.materialize(spark, stage(spark, at, str(tmp_path)), f"test-{name}")
        assert at.columns == docs.columns
        kept[name] = before, [(r.doc_id, r.text, r.source) for r in at.collect()]
    key = lambda r: (str(r[0]), str(r[1]))

    before, after = kept["toxicity"]
    scored = {(str(r.doc_id), r.predicted) for r in toxicity.score(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert sorted(map(key, after)) == sorted(key(r) for r in before if (str(r[0]), 0) in scored) and 0 < len(after) < len(before)

    before, after = kept["exact_dedup"]
    groups = {}
    for r in before:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    want = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    assert sorted(map(key, after)) == sorted(map(key, want))

    before, after = kept["near_dedup"]
    sets = []
    for _, t, _ in before:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if (both := len(sets[i] & sets[j])) and 100 * both >= 80 * len(sets[i] | sets[j]) and before[i][0] is not None and before[j][0] is not None:
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
    least = {p: min(r[0] for r, q in zip(before, parent, strict=True) if q == p) for p in set(parent) if before[p][0] is not None}
    want = [r for r, p in zip(before, parent, strict=True) if r[0] is None or r[0] == least[p]]
    assert sorted(map(key, after)) == sorted(map(key, want)) and len(after) < len(before)

    before, after = kept["mixing"]
    size = lambda rows, s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, x in rows if x == s)
    for s in {x for _, _, x in before}:
        target = next(iter(mixing.mix(make_again(spark, before)).filter(F.col("source_size") == size(before, s)).select("target").collect()))[0]
        assert abs(size(after, s) - target) <= max(len((t or "").split()) for _, t, x in before if x == s)
    assert set(map(key, after)) <= set(map(key, before)) and all(n <= 2 for n in Counter(map(key, after)).values())

    folder = store.filesystem(store.shared_dir(spark))[1]
    there = set(os.listdir(folder))  # the folder may be that of earlier sessions too
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenizer_path())
    want = sum(len(reference.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in after)
    assert pieces.length.sum() == want and (pieces.groupby("sequence_id").length.sum() <= 4096).all()
    left = [x for x in os.listdir(folder) if "quire-stage-" in x and x not in there]
    assert [x.rsplit("-", 1)[0] for x in left] == ["quire-stage-mixing"]  # the last stage's input


def make_again(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")
