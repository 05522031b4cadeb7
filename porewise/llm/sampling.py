"""A bounded, reproducible sample of labelled rows for fitting a classifier, and the task that fits it."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back_memory


def labelled_sample(docs: DataFrame, label: Column, per_label: int, id_col: str = "doc_id", text: str = "text", seed: int = 7, most_rows: int | None = None, most_broadcast: int = 100_000) -> DataFrame:
    """(id, label, text) of at most ``per_label`` identifiers of each label; with ``most_rows``, the labels share that many.

    Identifiers are chosen by a seeded hash, so it does not matter how often one is repeated. Rows
    with a null label or identifier are left out; of rows with one identifier, the one with the
    smallest (label, text) stands for all. Only identifiers are ranked; texts are fetched for the
    chosen ones alone.
    """
    rows = docs.select(F.col(id_col).alias("id"), label.alias("label"), F.col(text).alias("text")).where("label is not null and id is not null")
    # distinct identifiers of each label, up to a few percent
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.approx_count_distinct("id", 0.02).alias("n")).collect()}
    each = per_label if most_rows is None else max(1, min(per_label, most_rows // max(1, len(counts))))
    # of a frequent label, only the hashes that may rank high enough are sorted: four times as many as are wanted
    kind = rows.schema["label"].dataType.simpleString()
    limits = docs.sparkSession.createDataFrame([(k, min(1 << 20, (each << 22) // max(1, n) + 1)) for k, n in counts.items()], f"label {kind}, `limit` long")
    few = F.broadcast if len(counts) <= most_broadcast else lambda df: df
    ranked = rows.select("label", "id", F.xxhash64(F.lit(seed), "id").alias("h")).join(few(limits), "label")
    ranked = ranked.where(F.pmod(F.col("h"), F.lit(1 << 20)) < F.col("limit")).select("label", "id", "h").distinct()
    order = Window.partitionBy("label").orderBy("h", "id")
    chosen = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).select("id").distinct()
    if each * len(counts) <= most_broadcast:
        chosen = F.broadcast(chosen)
    hit = rows.join(chosen, "id", "left_semi")
    return hit.groupBy("id").agg(F.min(F.struct("label", "text")).alias("row")).select("id", "row.label", "row.text")


def fit_in_one_task(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object | None:
    """What ``fit`` makes of a bounded sample, in the order of ``id``, in one task of an executor; None if there are no rows.

    Only the result, pickled, reaches the driver.
    """

    def run(batches):
        if held := list(batches):
            fitted = pickle.dumps(fit(pa.Table.from_batches(held)))
            del held
            give_back_memory()
            yield pa.RecordBatch.from_arrays([pa.array([fitted], pa.binary())], names=["fitted"])

    row = rows.repartition(1).sortWithinPartitions("id").mapInArrow(run, "fitted binary").first()
    return pickle.loads(row["fitted"]) if row else None
