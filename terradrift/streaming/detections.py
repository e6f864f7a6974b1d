"""Streaming summaries of detections and incremental epochs."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terradrift.operators.graph import added_nodes, match_nodes, modified_nodes, removed_nodes, tagged_delta
from terradrift.session import save_table, work_dir

CELL_DEG = 0.05


def windowed_counts(
    detections: DataFrame, width: str = "1 hour", late: str = "2 hours", time: str = "ts", slide: str | None = None
) -> DataFrame:
    """Detections and area per window, class and 0.05-degree cell; rows later than ``late`` are dropped.

    Works on a stream or a batch. State is one row per open window, class and cell.
    """
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return (
        detections.withWatermark(time, late)
        .groupBy(
            span.alias("w"), "class", F.floor(F.col("lat") / CELL_DEG).alias("cell_lat"),
            F.floor(F.col("lon") / CELL_DEG).alias("cell_lon"),
        )
        .agg(F.count("*").alias("n"), F.round(F.sum("area_sq_m"), 2).alias("area_sq_m"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "class", "cell_lat", "cell_lon", "n",
            "area_sq_m",
        )
    )


def first_sightings(detections: DataFrame, late: str = "2 hours", time: str = "ts", key: str = "feature_id") -> DataFrame:
    """Each detection id once; repeats within the watermark are dropped."""
    return detections.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def latest_baseline(nodes: DataFrame, history: DataFrame, key: str = "site_id") -> DataFrame:
    """Each node with the latest strictly earlier record of the same site (as-of join).

    Both sides are reduced to one row per site and epoch before a running "last" is taken,
    so the sort of a busy site covers its distinct epochs and not its records.
    """
    past = history.groupBy(key, "epoch").agg(F.max_by(F.struct("epoch", "node_id", "area_m2"), F.col("node_id")).alias("_p"))
    asked = nodes.groupBy(key, "epoch").agg(F.lit(True).alias("_ask"))
    line = W.partitionBy(key).orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    steps = past.join(asked, [key, "epoch"], "full").withColumn("_b", F.last("_p", ignorenulls=True).over(line))
    return nodes.join(steps.filter("_ask").select(key, "epoch", "_b"), [key, "epoch"], "left").select(
        *nodes.columns, F.col("_b.epoch").alias("baseline_epoch"), F.col("_b.node_id").alias("baseline_id"),
        F.col("_b.area_m2").alias("baseline_area_m2"),
    )


def ingest_epochs(
    stream: DataFrame, baseline_path: str, delta_path: str, lat0: float, lon0: float, checkpoint: str | None = None
) -> StreamingQuery:
    """Keep the nodes of every epoch and, per epoch, the difference to the latest earlier one.

    Batches are not epochs: an epoch may arrive in several files or batches, several epochs in one batch, and a late file
    may extend an old one. A batch adds its nodes to their epochs and recomputes the difference of every epoch it touched and
    of the one after it; both tables are overwritten by epoch, so a replayed batch changes nothing. Of several rows of a
    node in an epoch one is kept, the same whatever the order of arrival.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = save_table(batch, "batch")
        touched = [r[0] for r in fresh.select("epoch").distinct().collect()]  # one value per epoch of a batch
        if not touched:
            return
        stored = _stored(spark, baseline_path, fresh)
        merged = fresh if stored is None else fresh.unionByName(stored.filter(F.col("epoch").isin(touched)))
        row = F.struct(*merged.columns)
        one = merged.groupBy("epoch", "node_id").agg(F.max_by(row, F.sha2(F.to_json(row), 256)).alias("_r")).select("_r.*")
        _overwrite(save_table(one, "epoch-nodes"), baseline_path)
        nodes = _stored(spark, baseline_path, fresh)
        epochs = sorted(r[0] for r in nodes.select("epoch").distinct().collect())
        later = {epochs[i + 1] for i in range(len(epochs) - 1) if epochs[i] in touched}
        for epoch in sorted(later.union(touched)):
            at = epochs.index(epoch)
            now = nodes.filter(F.col("epoch") == epoch)
            if at == 0:
                changes = tagged_delta(now, now.limit(0), _no_changes(now))
            else:
                before = nodes.filter(F.col("epoch") == epochs[at - 1])
                matches = save_table(match_nodes(before, now, lat0, lon0), "matches")
                changes = tagged_delta(added_nodes(now, matches), removed_nodes(before, matches), modified_nodes(before, now, matches))
            _overwrite(changes.withColumn("delta_epoch", F.lit(epoch)), delta_path, "delta_epoch")

    place = checkpoint or f"{work_dir(spark)}/ingest-checkpoint-{uuid.uuid4().hex}"
    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", place).trigger(availableNow=True).start()
    )


def _overwrite(df: DataFrame, path: str, by: str = "epoch") -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    """The stored nodes in the columns of ``like``; None before the first batch."""
    try:
        return spark.read.schema(like.schema).parquet(path).select(*like.columns)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _no_changes(nodes: DataFrame) -> DataFrame:
    empty = nodes.limit(0)
    return empty.select(
        F.col("node_id").alias("old_id"), F.col("class").alias("class_t2"), F.col("lat").alias("lat_t2"),
        F.col("lon").alias("lon_t2"), F.col("area_m2").alias("area_t2_m2"), F.col("area_m2").alias("area_delta_m2"),
        F.col("area_m2").alias("_gap"),
    )
