"""Toxicity by Levenshtein automata over a lexicon trie, with context-window scores.

The lexicon is learned from labelled rows: whole words and word stems that toxic documents hold far more often, counted by
distinct neighbours so that copies of one document do not vote often. Whole terms are also met misspelled: a lazily
determinised automaton walks all of the trie's terms within one or two edits at once. Each match weighs its log odds, less
where quotation marks or reporting words stand around it; a logistic model of the summed weights gives the score.

Defined results: null and empty texts get the score of no match; rows repeated get equal scores; without labelled rows of
both classes every score is 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import logistic, mapped, remainder, sample, sigmoid
from .store import unused

FOLDS, HELD, THRESHOLD = 4, 2, 0.3
#: Labelled rows that the fit uses at most (about): toxic and clean.
SAMPLE = {1: 1500, 0: 3000}
#: Lengths of stems; a term of SHORTEST letters or more is met misspelled, within one edit, from LONG letters within two. Shorter
#: terms are met as they are only: at four letters most words within one edit are other words.
STEMS, SHORTEST, LONG = range(4, 8), 5, 8
#: What an entry needs: the log odds, and different neighbours by toxic document. Of one text it counts PER_TEXT times at most and
#: gives NEIGHBOURS neighbours, so that no text votes alone.
ODDS, SHARE, PER_TEXT, NEIGHBOURS = 1.5, 0.02, 8, 2
WINDOW = 6
MARKS = '"“”„«»'
#: Words that report what someone else said.
REPORTING = frozenset("said says saying quote quoted quotes quoting called calling wrote word words term terms phrase slur insult reported according".split())
LEET = str.maketrans("0134578@$", "oieastbas")
TOKEN = re.compile(rf"[^\W_]+|[{MARKS}]").findall
#: A word with signs between its letters, and the letters they stand for; * and _ are any, so one edit, and full stops none.
INNER = re.compile(r"[@$*_.](?=[^\W_])").search
SIGNED = re.compile(r"[^\W_]+(?:[@$*_.]+[^\W_]+)+").sub
LETTERS = str.maketrans({"@": "a", "$": "s", "*": "ʘ", "_": "ʘ", ".": ""})
QUOTED, REPORTED = 0.2, 0.5
CACHED = 150_000


class Automaton:
    """The terms within k edits of a word, for all terms of a trie at once.

    A state is the set of (trie node, edits) pairs that the letters so far allow; states and steps are made when first met."""

    def __init__(self, terms: dict[str, int], k: int):
        self.k, self.next, self.end = k, [{}], {}
        for term, value in terms.items():
            at = 0
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                at = self.next[at][c]
            self.end[at] = value
        self.steps: dict[tuple, tuple] = {}
        self.start = self._closed({(0, 0)})

    def _closed(self, pairs: set) -> tuple:
        """With letters of a term left out; of one node only its fewest edits."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if best.get(node, self.k + 1) <= e:
                continue
            best[node] = e
            if e < self.k:
                todo += [(x, e + 1) for x in self.next[node].values()]
        return tuple(sorted(best.items()))

    def step(self, state: tuple, c: str) -> tuple:
        if (state, c) not in self.steps:
            if len(self.steps) > CACHED:
                self.steps.clear()
            to = set()
            for node, e in state:
                if c in self.next[node]:
                    to.add((self.next[node][c], e))
                if e < self.k:
                    to.add((node, e + 1))
                    to.update((x, e + 1) for x in self.next[node].values())
            self.steps[state, c] = self._closed(to)
        return self.steps[state, c]

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, value) of the nearest term."""
        state = self.start
        for c in word:
            state = self.step(state, c)
            if not state:
                return None
        return min(((e, self.end[n]) for n, e in state if n in self.end), default=None)


class Scorer:
    """words, stems: entry -> weight. fuzzy: terms that are met misspelled too. clean: words that are never a misspelling."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], fuzzy: dict[str, float], clean: frozenset):
        self.words, self.stems, self.fuzzy, self.clean = words, stems, fuzzy, clean
        self.terms = sorted(fuzzy)
        self._ready()

    def _ready(self):
        long = {t: i for i, t in enumerate(self.terms) if len(t) >= LONG}
        short = {t: i for i, t in enumerate(self.terms) if SHORTEST <= len(t) < LONG}
        self.automata = [Automaton(x, k) for x, k in ((short, 1), (long, 2)) if x]
        self.hits, self.seen, self.signed = {}, set(), {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("automata", "hits", "seen", "signed")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._ready()

    def nearest(self, word: str) -> tuple[int, int] | None:
        """(edits, place in terms) of the nearest term that may be met misspelled."""
        return min((m for a in self.automata if (m := a.match(word))), default=None)

    def weigh(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        for n in reversed(STEMS):
            if len(word) >= n and word[:n] in self.stems:
                return self.stems[word[:n]]
        plain = word.translate(LEET) if not word.isalpha() and not word.isdigit() else word
        if plain != word and plain in self.words:
            return self.words[plain]
        if len(plain) < SHORTEST - 1 or plain in self.clean:
            return 0.0
        found = self.nearest(plain)
        return self.fuzzy[self.terms[found[1]]] / (1 + 0.15 * found[0]) if found else 0.0

    def spelled(self, found: re.Match) -> str:
        """A word with signs in letters, if only so it is a term; else as it is."""
        word = found[0]
        if word not in self.signed:
            if len(self.signed) > CACHED:
                self.signed.clear()
            plain = word.translate(LETTERS)
            self.signed[word] = plain if self.weigh(plain) and not any(map(self.weigh, TOKEN(word))) else word
        return self.signed[word]

    def matches(self, text: str) -> tuple[list[float], int]:
        """The weight of each match in its context, and the number of words."""
        text = text.lower()
        tokens = TOKEN(SIGNED(self.spelled, text) if INNER(text) else text)
        different = set(tokens)
        if new := different - self.seen:
            if len(self.seen) > CACHED:
                self.seen, self.hits = set(), {}
                new = different
            self.hits |= {w: x for w in new if (x := self.weigh(w))}
            self.seen |= new
        found = self.hits.keys() & different
        if not found:
            return [], len(tokens)
        marked, out = not different.isdisjoint(MARKS), []
        for i, t in enumerate(tokens):
            if t in found:
                before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
                x = self.hits[t]
                if marked and any(c in MARKS for c in before) and any(c in MARKS for c in after):
                    x *= QUOTED
                elif not REPORTING.isdisjoint(before):
                    x *= REPORTED
                out.append(x)
        return out, len(tokens)

    def features(self, text: str) -> list[float]:
        got, n = self.matches(text)
        total, rate = math.log1p(sum(got)), math.log1p(100 * sum(got) / (n + 20))
        return [total, rate, math.log1p(len(got)), max(got, default=0.0), total * rate, rate * rate, math.log1p(n) * bool(got)]


def entries(word: str) -> tuple[str, ...]:
    """What may enter the lexicon of a word: itself, marked by a blank, and its stems."""
    return (f"{word} ", *(word[:n] for n in STEMS if len(word) >= n))


def counted(texts: list[str], y: list[int], ids: list[int]) -> tuple[list, ...]:
    """entry, y, n, near, words: how often each entry stands in the texts of one label, the neighbours met by it, and how many words all
    texts have (entry null). An entry counts up to PER_TEXT times a text and gives up to NEIGHBOURS neighbours."""
    import xxhash

    counts, near, total = [Counter(), Counter()], defaultdict(set), [0, 0]
    for text, label in zip(texts, y, strict=True):
        tokens = [t for t in TOKEN(text.lower()) if t not in MARKS]
        total[label] += len(tokens)
        own: Counter = Counter()
        for i, t in enumerate(tokens):
            for e in entries(t):
                own[e] += 1
                if label and own[e] <= NEIGHBOURS:
                    around = "\0".join((tokens[i - 1] if i else "", t, tokens[i + 1] if i + 1 < len(tokens) else ""))
                    near[e].add(xxhash.xxh64_intdigest(around) >> 1)
        for e, n in own.items():
            counts[label][e] += min(n, PER_TEXT)
    rows = [(e, label, n, list(near[e]) if label and e in near else []) for label in (0, 1) for e, n in counts[label].items()]
    rows += [(None, label, total[label], []) for label in (0, 1)]
    return tuple(zip(*rows, strict=True))


def words_of(texts: list[str], y: list[int], ids: list[int]) -> tuple[list, ...]:
    """word, y, n of the texts."""
    met = [Counter(), Counter()]
    for text, label in zip(texts, y, strict=True):
        met[label].update(t for t in TOKEN(text.lower()) if t not in MARKS)
    rows = [(w, label, n) for label in (0, 1) for w, n in met[label].items()]
    return tuple(zip(*rows, strict=True)) if rows else ([], [], [])


def lexicon(rows: DataFrame, toxic: int) -> Scorer:
    """Words and stems whose log odds reach ODDS and whose different neighbours number SHARE of the toxic documents, counted where
    the sample lies; the driver gets the entries that pass, and the sample's words."""
    found = mapped(rows, counted, "entry string, y int, n long, near array<long>")
    sums = found.groupBy("entry").agg(
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"),
        F.size(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"),
    )
    least = max(4, SHARE * toxic)
    total, strong, around, clean_count = [1, 1], {}, {}, {}
    for r in sums.filter(F.col("entry").isNull() | (F.col("near") >= least)).orderBy("entry").collect():  # null comes first
        if r.entry is None:
            total = [r.n0 + 1, r.n1 + 1]
            continue
        x = math.log((r.n1 + 0.5) / total[1]) - math.log((r.n0 + 0.5) / total[0])
        if x >= ODDS:
            strong[r.entry], around[r.entry], clean_count[r.entry] = x, r.near, (r.n0, r.n1)
    words = {e[:-1]: x for e, x in strong.items() if e[-1] == " "}
    stems = {e: x for e, x in strong.items() if e[-1] != " "}
    vocabulary = mapped(rows, words_of, "word string, y int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1")
    ).collect()
    clean = frozenset(r.word for r in vocabulary if r.n0 >= 2 and r.word not in words)
    sure = {w: x for w, x in words.items() if len(w) >= SHORTEST and around[f"{w} "] >= 0.1 * toxic and clean_count[f"{w} "][0] * 20 <= clean_count[f"{w} "][1]}
    # misspellings of a term count only if they are met in toxic rows at least as often as in clean ones
    probe, met = Scorer({}, {}, {w: 1.0 for w in sure}, clean), {w: [0, 0] for w in sure}
    for r in vocabulary:
        if r.word not in words and r.word not in clean and len(r.word) >= SHORTEST - 1 and (m := probe.nearest(r.word)):
            met[probe.terms[m[1]]][0] += r.n0
            met[probe.terms[m[1]]][1] += r.n1
    fuzzy = {w: x for w, x in sure.items() if met[w][0] * total[1] <= met[w][1] * total[0] or met[w][0] <= 1}
    return Scorer(words, stems, fuzzy, clean)


def fit(docs: DataFrame, labels: DataFrame):
    """(scorer, coefficients); None without training rows of both classes."""
    import numpy as np

    rows, counts = sample(docs, labels, "toxic", FOLDS, HELD, SAMPLE)
    toxic = rows.filter("y = 1").count()
    if not toxic or not rows.filter("y = 0").head(1):
        return None
    scorer = lexicon(rows, toxic)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # the sample's words
    made = mapped(rows, lambda t, y, i: (i, y, [shared.value.features(x) for x in t]), "i long, y int, x array<double>").collect()
    made.sort(key=lambda r: r.i)
    x, y = np.array([r.x for r in made]), np.array([r.y for r in made])
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    return scorer, logistic(x, y, weight * len(y) / weight.sum())


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels), "score")
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def with_score(docs: DataFrame, model, name: str) -> DataFrame:
    """docs with one more column of that name, which docs doesn't have."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon of the bounded sample's words

    def run(batches):
        import numpy as np
        import pyarrow as pa

        scorer, w = shared.value
        for batch in batches:
            x = np.array([scorer.features(t.as_py() or "") for t in batch.column("text")]).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(x @ w[:-1] + w[-1]), pa.float64())], [*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType().add(name, DoubleType()).fields]))


def clean_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns."""
    name = unused(docs, "score")
    return with_score(docs, fit(docs, labels), name).filter(F.col(name) < THRESHOLD).select(*docs.columns)
