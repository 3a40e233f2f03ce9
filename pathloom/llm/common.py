"""What the text operators share: tables, labels, Arrow batches, logistic models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.storage import discard, shared_dir, stored

__all__ = ["bounded_sample", "discard", "fold_of", "logistic_fit", "map_texts", "shared_dir", "shuffle_partitions", "sigmoid", "sample_texts", "small_batches", "stored", "table", "text_chunks"]

#: Text bytes that a Python worker turns into objects at a time.
CHUNK_BYTES = 4 << 20
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(0))


def bounded_sample(labelled: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` ids of each label, those with the least hashes, in two scans however many labels there are.

    ``labelled`` has doc_id and the label column.  Rows with a null are left
    out, repeated rows count once, an id with several labels has the least.  The
    first scan estimates the ids of each label; the second keeps the ids whose
    hash is in the share that holds ``per_class`` of them (with some to spare, so
    that the estimate does not show), which are then ranked.
    """
    rows = labelled.select("doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    share = rows.groupBy(label).agg(F.approx_count_distinct("doc_id", 0.02).alias("ids")).select(F.col(label).alias("__label"), F.least(F.lit(1.0), F.lit(1.25 * per_class + 100) / F.col("ids")).alias("__share"))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # One number for each label, of which there are no more than the model that is learned can hold.
    some = rows.join(F.broadcast(share), rows[label] == share["__label"]).where(chance <= F.col("__share")).select("doc_id", label).distinct()
    rank = F.row_number().over(Window.partitionBy(label).orderBy(chance, "doc_id"))
    return some.withColumn("__rank", rank).where(F.col("__rank") <= per_class).groupBy("doc_id").agg(F.min(label).alias(label))


def sample_texts(docs: DataFrame, sample: DataFrame, label: str) -> DataFrame:
    """text and label of the ids in a bounded sample, one text for each id (of repeated ids the least), over as many tasks as can work on it at once (64 at most)."""
    ids = sample.select(F.col("doc_id").alias("__id"), F.col(label).alias("__label"))
    one = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("__label").alias(label))
    return one.select("text", label).repartition(max(1, min(64, docs.sparkSession.sparkContext.defaultParallelism)))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands texts to Python in batches of BATCH_BYTES or less, as ten thousand long texts would fill a worker.

    The setting holds when the frame is run, so it stays; one that the session was made with is left alone.
    """
    conf = df.sparkSession.conf
    if _BATCH not in conf.getAll:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def text_chunks(batch: pa.RecordBatch, columns: list[str], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most about ``most`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    batch = batch.select(columns)
    sizes = pc.fill_null(pc.binary_length(batch.column(columns.index(text))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        start = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, start + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_texts(docs: DataFrame, columns: list[str], per_chunk, schema: str, text: str = "text") -> DataFrame:
    """``per_chunk(record batch) -> dict of arrays`` over slices of bounded text size."""

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, columns, text):
                got = per_chunk(part)
                yield pa.RecordBatch.from_arrays(list(got.values()), names=list(got))

    return small_batches(docs).select(*columns).mapInArrow(run, schema)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model by Newton's method; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w
