"""Chunk-queue state kept by a stream of operations, one small state per item.

`queue_states` keeps the states in Spark's state store: a batch costs what it touches, but every item that it touches a call
of Python.  `start_queue` keeps them as a table: a batch folds the operations of all its items by built-in functions and
writes the next table, so it suits batches that touch much of the queue.  Both follow `apply_operation`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import struct
from ..operators.queues import VISIBILITY_SECONDS

OPERATIONS = "id string, op string, at timestamp, worker string, error string"
OUTPUT = ("id string, status string, claimed_by string, claimed_at timestamp, visible_after timestamp, "
          "retry_count int, last_error string")
STATE = "status string, claimed_by string, claimed_at long, visible_after long, retry_count int, last_error string"


def apply_operation(item: tuple | None, op: str, at: int, worker, error, max_retries: int, visibility: int) -> tuple | None:
    """Next state of one item, times in seconds; operations that do not fit the state change nothing."""
    if op == "enqueue":
        return item or ("queued", None, None, None, 0, None)
    if item is None:
        return None
    status, by, since, until, retries, last = item
    if op == "claim" and status == "queued" and (until is None or until <= at):
        return ("processing", worker, at, at + visibility, retries, last)
    if op == "ack":
        return ("completed", by, since, until, retries, last)
    if op == "fail":
        return ("failed" if retries >= max_retries else "queued", by, since, None, retries + 1, error)
    if op == "recover" and status == "processing" and until is not None and until < at:
        return ("queued", None, None, None, retries, last)
    return item


def queue_states(operations: DataFrame, max_retries: int = 3, visibility: int = VISIBILITY_SECONDS) -> DataFrame:
    """Update-mode stream of item states after each micro-batch, keyed and spread by item id."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        item = tuple(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for row in rows.itertuples(index=False):
            item = apply_operation(item, row.op, int(row.at.timestamp()), row.worker, row.error, max_retries, visibility)
        if item is None:
            return
        state.update(item)
        stamp = lambda s: None if s is None else pd.Timestamp(s, unit="s")
        yield pd.DataFrame([(key[0], item[0], item[1], stamp(item[2]), stamp(item[3]), item[4], item[5])],
                           columns=["id", "status", "claimed_by", "claimed_at", "visible_after", "retry_count", "last_error"])

    return operations.groupBy("id").applyInPandasWithState(
        step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def folded(state: Column, operations: Column, max_retries: int, visibility: int) -> Column:
    """The state (struct of STATE, null for none) after an array of operations in their order, `at` in seconds."""
    kinds = dict(field.split() for field in STATE.split(", "))

    def now(**new) -> Column:
        return struct(**{n: new[n].cast(kind) for n, kind in kinds.items()})

    def step(s: Column, o: Column) -> Column:
        held = {n: s[n] for n in kinds}
        none, op, at = F.lit(None), o["op"], o["at"]
        empty = dict.fromkeys(("claimed_by", "claimed_at", "visible_after"), none)
        claimable = (s["status"] == "queued") & (s["visible_after"].isNull() | (s["visible_after"] <= at))
        return (
            F.when(op == "enqueue", F.coalesce(s, now(status=F.lit("queued"), **empty, retry_count=F.lit(0), last_error=none)))
            .when(s.isNull(), s)
            .when((op == "claim") & claimable, now(**{**held, "status": F.lit("processing"), "claimed_by": o["worker"], "claimed_at": at, "visible_after": at + visibility}))
            .when(op == "ack", now(**{**held, "status": F.lit("completed")}))
            .when(op == "fail", now(**{**held, "status": F.when(s["retry_count"] >= max_retries, "failed").otherwise("queued"), "visible_after": none,
                                       "retry_count": s["retry_count"] + 1, "last_error": o["error"]}))
            .when((op == "recover") & (s["status"] == "processing") & (s["visible_after"] < at), now(**{**held, **empty, "status": F.lit("queued")}))
            .otherwise(s))

    return F.aggregate(operations, state.cast("struct<" + STATE.replace(" string", ":string").replace(" long", ":bigint").replace(" int", ":int") + ">"), step)


def _written(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches whose table is whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batch=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def _table(spark: SparkSession, root: str, batch: int | None) -> DataFrame:
    schema = f"id string, {STATE}"
    return spark.createDataFrame([], schema) if batch is None else spark.read.schema(schema).parquet(f"{root}/batch={batch}")


def start_queue(operations: DataFrame, root: str, checkpoint: str, max_retries: int = 3, visibility: int = VISIBILITY_SECONDS, **trigger) -> StreamingQuery:
    """Keep the states of all items below `root`, a table a batch, of which the last two stay.

    A batch reads the table before it and writes its own anew, so one that is done again makes the same.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [n for n in _written(spark, root) if n < batch_id]
        # operations of one moment keep the order they came in
        rows = batch.select("id", F.struct("at", F.monotonically_increasing_id().alias("n"), "op", "worker", "error").alias("o"))
        given = rows.groupBy("id").agg(F.sort_array(F.collect_list("o")).alias("_ops"))
        told = given.withColumn("_ops", F.transform("_ops", lambda o: struct(
            op=o["op"], at=F.unix_seconds(o["at"]), worker=o["worker"], error=o["error"])))
        held = _table(spark, root, before[-1] if before else None).select("id", F.struct(*[f.split()[0] for f in STATE.split(", ")]).alias("_s"))
        after = held.join(told, "id", "full").select("id", F.when(F.col("_ops").isNull(), F.col("_s")).otherwise(
            folded(F.col("_s"), F.col("_ops"), max_retries, visibility)).alias("_s"))
        after.filter(F.col("_s").isNotNull()).select("id", "_s.*").write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
        for old in before[:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batch={old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return operations.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def current_states(spark: SparkSession, root: str) -> DataFrame:
    """The states after the last whole batch, as `queue_states` tells them."""
    at = lambda name: F.timestamp_seconds(name).alias(name)
    return _table(spark, root, (_written(spark, root) or [None])[-1]).select(
        "id", "status", "claimed_by", at("claimed_at"), at("visible_after"), "retry_count", "last_error")
