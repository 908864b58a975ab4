"""A quality classifier by positive-unlabelled learning.

Trusted positives are labelled training rows of quality 1 (a bounded sample, POSITIVES); no other label is read. The unlabelled
set is every document: their features are summed in 2 ** PLANES cells, by the sides of fixed hyperplanes on which they lie, so
that the fit takes all of them whatever their number, a cell's mean weighing as much as the cell has documents. The class prior
is estimated by the best bin: the least ratio, over thresholds of a first classifier of positives against unlabelled ones, of
the unlabelled to the positives above it. A small network over a text's character classes, words and repetitions minimises the
non-negative unbiased risk: the part of the unlabelled risk that positives explain is taken away, and a step that would push the
remainder under zero is reversed instead.

Defined results: null and empty texts get the model's score of an empty text; rows repeated get equal scores; without
positives every score is 1; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import logistic, mapped, remainder, sample, sigmoid

FOLDS, HELD, THRESHOLD = 5, 0, 0.3
#: Trusted positives that the fit uses at most (about).
POSITIVES = 3000
PLANES, SCALE = 12, 1 << 20
HIDDEN, STEPS, RATE, BATCH = 16, 1500, 0.01, 512
#: Classes of bytes whose shares are features.
GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:?'\"-", b"!", b"|", b"#$%&*@^~", b"<>{}[]()=/\\_+", bytes(range(128, 256))]
LINE = re.compile(r"\n+").split


def features(text: str) -> list[float]:
    """Shares of byte classes; lengths of text, words and lines; shares of different and of most frequent words and lines."""
    import numpy as np

    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    out = [float(counts[list(g)].sum()) / n for g in GROUPS]
    words, lines = text.split(), LINE(text)
    different = Counter(words)
    most = different.most_common(1)[0][1] if words else 0
    w = max(1, len(words))
    repeats = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    return [*out, np.log1p(len(data)), len(data) / w, len(different) / w**0.8, most / (w + 5), len(set(lines)) / len(lines), np.log1p(n / len(lines)), np.sqrt(repeats / w)]


def train(positive, unlabelled, weight, prior: float, seed: int = 1):
    """Weights of a one-layer network by non-negative positive-unlabelled risk with the logistic loss (Adam, fixed seed); weight: of
    each row of unlabelled."""
    import numpy as np

    rng = np.random.default_rng(seed)
    mean, scale = spread(unlabelled, weight)
    ends = np.cumsum(weight) / np.sum(weight)
    p, u = np.clip((positive - mean) / scale, -6, 6), np.clip((unlabelled - mean) / scale, -6, 6)
    w = [rng.normal(0, 0.5, (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]

    def back(x, slope):
        """Gradient of the mean of slope(g) over rows x."""
        h = np.tanh(x @ w[0] + w[1])
        d = slope(h @ w[2] + w[3][0]) / len(x)
        inner = d[:, None] * w[2] * (1 - h * h)
        return [x.T @ inner, inner.sum(0), h.T @ d, np.array([d.sum()])]

    def output(x):
        return np.tanh(x @ w[0] + w[1]) @ w[2] + w[3][0]

    for t in range(1, STEPS + 1):
        a, b = p[rng.integers(0, len(p), BATCH)], u[np.minimum(np.searchsorted(ends, rng.random(2 * BATCH)), len(u) - 1)]
        ga, gb = output(a), output(b)
        negative = np.logaddexp(0, gb).mean() - prior * np.logaddexp(0, ga).mean()
        up, down = lambda g: -sigmoid(-g), lambda g: sigmoid(g)  # noqa: E731  slopes of the losses for label 1 and 0
        rest = [x - prior * y for x, y in zip(back(b, down), back(a, down), strict=True)]
        grad = [prior * x + y for x, y in zip(back(a, up), rest, strict=True)] if negative >= 0 else [-x for x in rest]
        for i, g in enumerate(grad):
            g = g + 1e-4 * w[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return mean, scale, w


def apply(model, x):
    import numpy as np

    mean, scale, w = model
    return sigmoid(np.tanh(np.clip((x - mean) / scale, -6, 6) @ w[0] + w[1]) @ w[2] + w[3][0])


def spread(x, weight):
    """Mean and deviation of each column of x."""
    import numpy as np

    mean = np.average(x, axis=0, weights=weight)
    return mean, np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight)) + 1e-3


def cell_of(x, mean, scale):
    """The cell of each row: on which sides of PLANES fixed hyperplanes it lies."""
    import numpy as np

    planes = np.random.default_rng(3).normal(size=(x.shape[1], PLANES))
    return ((((x - mean) / scale) @ planes > 0) << np.arange(PLANES)).sum(1)


def cells(docs: DataFrame, mean, scale):
    """(cell, mean features, number) of the cells of all rows of docs; sums are of whole numbers, so that reruns agree."""
    import numpy as np

    k = len(mean)

    def run(batches):
        import pyarrow as pa

        sums, n = np.zeros((1 << PLANES, k), np.int64), np.zeros(1 << PLANES, np.int64)
        for batch in batches:
            if len(batch):
                x = np.array([features(t.as_py() or "") for t in batch.column(0)])
                at = cell_of(x, mean, scale)
                np.add.at(sums, at, np.rint(x * SCALE).astype(np.int64))
                np.add.at(n, at, 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), *(pa.array(sums[some, i]) for i in range(k))], ["cell", "n", *(f"s{i}" for i in range(k))])

    names = [f"s{i}" for i in range(k)]
    found = docs.select("text").mapInArrow(run, ", ".join(f"{c} long" for c in ("cell", "n", *names)))
    rows = found.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).orderBy("cell").collect()  # 2 ** PLANES at most
    n = np.array([r.n for r in rows], float)
    return np.array([r.cell for r in rows], np.int64), np.array([[r[c] for c in names] for r in rows]).reshape(len(rows), k) / SCALE / n[:, None], n


def estimated_prior(held, unlabelled, weight) -> float:
    """The share of positives among the unlabelled. held: how many positives each cell has. Cells are put in order by a first
    classifier of positives against unlabelled ones; of their leading parts that hold a tenth of the positives or more, the least
    ratio of the unlabelled to the positives, with a margin for the positives' number."""
    import numpy as np

    mean, scale = spread(unlabelled, weight)
    x = np.clip((unlabelled - mean) / scale, -6, 6)
    k, n = len(x), held.sum()
    w = logistic(np.r_[x, x], np.r_[np.ones(k), np.zeros(k)], np.r_[held, weight * n / weight.sum()])
    order = np.argsort(-(x @ w[:-1] + w[-1]), kind="stable")
    p, u = np.cumsum(held[order]) / n, np.cumsum(weight[order]) / weight.sum()
    margin = 1 / np.sqrt(2 * n)
    return float(np.clip(np.min(((u + margin) / np.maximum(p, 1e-9))[p >= 0.1]), 0.01, 0.98))


def fit(docs: DataFrame, labels: DataFrame):
    """The model; None without positives."""
    import numpy as np

    rows, _ = sample(docs, labels, "quality", FOLDS, HELD, {1: POSITIVES, 0: 0})
    made = mapped(rows.filter("y = 1"), lambda t, y, i: (i, [features(x) for x in t]), "i long, x array<double>").collect()
    if not made:
        return None
    positive = np.array([r.x for r in sorted(made, key=lambda r: r.i)])
    scaling = spread(positive, np.ones(len(positive)))
    cell, unlabelled, weight = cells(docs, *scaling)
    own = cell_of(positive, *scaling)
    held = np.array([(own == c).sum() for c in cell.tolist()], float)  # positives are documents too, so each has its cell
    return train(positive, unlabelled, weight, estimated_prior(held, unlabelled, weight))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, labels)
    if model is None:
        scored = rows.select("doc_id", F.lit(1.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                x = np.array([features(t.as_py() or "") for t in batch.column(1)]).reshape(len(batch), -1)
                got = apply(shared.value, x) if len(batch) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

        scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
