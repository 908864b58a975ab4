"""Bounded samples of labelled documents. Their texts stay on executors; the driver gets counts and numbers, and fits small models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: A labelled document is fitted on whole or, if longer than this, not at all (it is scored whatever its length): bounds the sample.
MOST_BYTES = 200_000


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of doc_id as text, modulo k."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def hashed_share(doc_id: Column, share: Column | float) -> Column:
    """True for that share of ids, by a hash: reruns choose the same rows."""
    return F.xxhash64(doc_id.cast("long"), F.lit(7)).bitwiseAND(F.lit((1 << 30) - 1)) < F.lit(share) * F.lit(float(1 << 30))


def sample(docs: DataFrame, labels: DataFrame, column: str, k: int, held: int, per_class: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(i, t, y) of training rows, about per_class[y] of each class at most, written to the shared folder; each class's true count.

    Only labels of rows whose remainder isn't `held` are read; of a document labelled twice the larger label counts."""
    spark = docs.sparkSession
    train = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), k) != held))
    train = train.groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.max(F.col(column).cast("int")).alias("y"))
    counts = {int(r["y"]): r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect() if r["y"] in per_class}
    wanted = F.lit(0.0)
    for y, n in counts.items():
        wanted = F.when(F.col("y") == y, F.lit(min(1.0, per_class[y] / n))).otherwise(wanted)
    ids = materialize(spark, train.filter(hashed_share(F.col("i"), wanted)), "sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("t")).filter(F.octet_length("t") <= MOST_BYTES)
    once = texts.join(ids, "i").groupBy("t").agg(F.min("i").alias("i"), F.max("y").alias("y"))
    return materialize(spark, once, "labelled"), counts


def mapped(rows: DataFrame, f, schema: str) -> DataFrame:
    """f over (t, y) of each batch of a sample: lists in, lists of columns out; runs where the rows lie."""
    from pyspark.sql.types import StructType

    kinds = [x.dataType for x in StructType.fromDDL(schema)]
    names = StructType.fromDDL(schema).fieldNames()

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            out = f(batch.column("t").to_pylist(), batch.column("y").to_pylist(), batch.column("i").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x, to_arrow_type(k)) for x, k in zip(out, kinds, strict=True)], names)

    return rows.mapInArrow(run, schema)


def sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x, y, weight, ridge: float = 1.0, steps: int = 30):
    """Coefficients of a weighted, ridge-penalised logistic regression by Newton steps; the last column is the constant."""
    import numpy as np

    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w = w - np.linalg.solve(hessian, gradient)
    return w
