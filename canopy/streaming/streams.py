"""The incremental counterparts: running confusion counts, nightly counts, and class centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.arrays import l2_normalise
from ..operators.metrics import class_f1


def stream_confusion(pred: DataFrame) -> DataFrame:
    """Streaming tp, fp, fn for each level and class; complete or update mode."""
    hit = F.col("label").eqNullSafe(F.col("prediction"))
    sides = F.explode(F.array(F.struct(F.col("label").alias("class"), hit.alias("tp"), F.lit(False).alias("fp"), (~hit).alias("fn")), F.struct(F.when(~hit, F.col("prediction")).alias("class"), F.lit(False).alias("tp"), (~hit).alias("fp"), F.lit(False).alias("fn"))))
    rows = pred.select("level", sides.alias("s")).where("s.class is not null")
    return rows.groupBy("level", F.col("s.class").alias("class")).agg(*(F.count_if(F.col(f"s.{c}")).alias(c) for c in ("tp", "fp", "fn")))


def stream_nights(detections: DataFrame, late: str = "2 days", key: str = "event_id") -> DataFrame:
    """Detections of each trap and noon-to-noon night; late rows and repeated ids go. ts is cast to timestamp."""
    rows = detections.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    else:
        rows = rows.dropDuplicates([key])
    return rows.groupBy("trap", F.window("ts", "1 day", "1 day", "12 hours").alias("w")).agg(F.count("*").alias("n")).select("trap", F.to_date("w.start").alias("night"), "n")


def stream_centroid_sums(emb: DataFrame) -> DataFrame:
    """Sum and count of each class and dimension, from which centroids follow at any time."""
    return emb.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.sum(F.col("x").cast("double")).alias("total"), F.count("*").alias("n"))


def stream_centroids(sums: DataFrame) -> DataFrame:
    """label, vector: normalised means from stream_centroid_sums, as a batch of its result."""
    rows = sums.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", (F.col("total") / F.col("n")).alias("x")))).alias("v"))
    return rows.select("label", l2_normalise(F.transform("v", lambda p: p["x"])).alias("vector"))


class CentroidState(StatefulProcessor):
    """Of each class the sum of its unit vectors and their number, kept as long as the class is met again in time."""

    def __init__(self, expiry_ms: int | None):
        self.expiry_ms = expiry_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("sums", "total array<double>, n long", self.expiry_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.state.get()
        total, n = (np.array(known[0], np.float64), known[1]) if known is not None else (0.0, 0)
        for frame in rows:
            total, n = total + np.sum(np.stack(frame["total"].to_numpy()), axis=0), n + int(frame["n"].sum())
        self.state.update((total.tolist(), n))
        norm = float(np.linalg.norm(total))
        yield pd.DataFrame({"label": [key[0]], "n": [n], "vector": [(total / norm if norm else total).tolist()]})

    def close(self) -> None:
        pass


def stateful_centroids(emb: DataFrame, label: str = "label", vector: str = "embedding", expiry_ms: int | None = None) -> DataFrame:
    """label, n, vector: after each batch the centroids (unit vectors) of the classes that were in it; update mode.

    Tasks sum their rows first, so a class with most rows sends a row a task to its state. The state, a vector and a
    number a class, is in the checkpoint: a restarted query goes on from there. With expiry_ms a class that isn't met for
    so long is forgotten. Needs the RocksDB state store (use_rocksdb).
    """
    kind = emb.schema[label].dataType.simpleString()

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}
        for frame in frames:
            for name, group in frame.groupby("label", sort=False):
                x = np.stack(group["vector"].to_numpy()).astype(np.float64)
                total, n = found.get(name, (0.0, 0))
                found[name] = total + x.sum(0), n + len(x)
        if found:  # Arrow can't tell the kind of an empty column of lists
            yield pd.DataFrame({"label": list(found), "total": [list(t) for t, _ in found.values()], "n": [n for _, n in found.values()]})

    rows = emb.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.col(vector).alias("vector"))
    parts = rows.mapInPandas(sums, f"label {kind}, total array<double>, n long")
    mode = "ProcessingTime" if expiry_ms else "None"
    return parts.groupBy("label").transformWithStateInPandas(CentroidState(expiry_ms), f"label {kind}, n long, vector array<double>", "Update", mode)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_macro_f1(pred: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes, after each batch, macro-F1 of all levels to path/batch=n."""

    def report(counts: DataFrame, batch: int) -> None:
        f1 = class_f1(counts).where(F.col("tp") + F.col("fn") > 0)
        f1.groupBy("level").agg(F.avg("f1").alias("macro_f1")).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream_confusion(pred).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(report).trigger(availableNow=True).start()


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Takes all that is there now, and returns the result table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
