"""Work-queue semantics as table transitions.

In a cluster the row locks of a database queue are not needed: one micro-batch
claims, works and acknowledges as one job.  What stays is the state of every
item as a function of the operations and of a given time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import CHUNK_PAYLOAD

VISIBILITY_SECONDS = 300  # Fixed value: how long a claim holds.
OPEN = ["queued", "processing"]


def _now(now: str):
    return F.lit(now).cast("timestamp_ntz")


def _updated(queue: DataFrame, hits: DataFrame, **new) -> DataFrame:
    """Rows whose id is in `hits`, with the new column values; others unchanged."""
    marked = queue.join(hits.select("id", F.lit(True).alias("_hit")), "id", "left")
    return marked.select(*[
        F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in queue.columns])


# --------------------------------------------------------------- file queue

def next_files(queue: DataFrame, n: int = 1) -> DataFrame:
    """Head of the file queue: priority first, then age."""
    return queue.filter(F.col("status") == "queued").orderBy(
        F.desc("priority"), F.asc("created_at"), F.asc("id")).limit(n)


def claim_files(queue: DataFrame, now: str, n: int = 1) -> DataFrame:
    return _updated(queue, next_files(queue, n), status=F.lit("processing"), started_at=_now(now))


def claimed_files(queue: DataFrame, jobs: DataFrame, n: int = 1) -> DataFrame:
    """What a claim hands to the worker: the files with their job's namespace."""
    return next_files(queue, n).join(jobs.select("job_id", "vector_namespace"), "job_id").select(
        "id", "tenant_id", "job_id", "file_path", "file_content", "content_hash", "vector_namespace")


def finish_files(queue: DataFrame, done: DataFrame, now: str) -> DataFrame:
    """Complete the listed files that are being processed."""
    hits = queue.filter(F.col("status") == "processing").select("id").join(done.select("id").distinct(), "id", "left_semi")
    return _updated(queue, hits, status=F.lit("completed"), completed_at=_now(now))


def file_queue_depth(queue: DataFrame) -> DataFrame:
    """Per job open files and whether none is left."""
    return queue.groupBy("job_id").agg(F.count_if(F.col("status").isin(*OPEN)).alias("depth")).withColumn(
        "complete", F.col("depth") == 0)


# -------------------------------------------------------------- chunk queue

def next_chunks(queue: DataFrame, now: str, n: int) -> DataFrame:
    visible = F.col("visible_after").isNull() | (F.col("visible_after") <= _now(now))
    return queue.filter((F.col("status") == "queued") & visible).orderBy("created_at", "id").limit(n)


def claim_chunks(queue: DataFrame, worker: str, now: str, n: int, visibility_seconds: int = VISIBILITY_SECONDS) -> DataFrame:
    until = _now(now) + F.make_dt_interval(secs=F.lit(visibility_seconds))
    return _updated(queue, next_chunks(queue, now, n), status=F.lit("processing"), claimed_at=_now(now),
                    claimed_by=F.lit(worker), visible_after=until)


def ack_chunks(queue: DataFrame, done: DataFrame, now: str) -> DataFrame:
    return _updated(queue, done.select("id").distinct(), status=F.lit("completed"), completed_at=_now(now))


def requeue_chunks(queue: DataFrame, failed: DataFrame) -> DataFrame:
    """Give back failed items (id, error); one whose retries are used up fails for good.

    The budget is tested before the retry is counted.
    """
    errors = failed.groupBy("id").agg(F.max("error").alias("_error"))
    joined = queue.join(errors, "id", "left")
    hit = F.col("_error").isNotNull()
    new = {
        "status": F.when(F.col("retry_count") >= F.col("max_retries"), "failed").otherwise("queued"),
        "last_error": F.col("_error"),
        "visible_after": F.lit(None).cast("timestamp_ntz"),
        "retry_count": F.col("retry_count") + 1,
    }
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
                           for c in queue.columns])


def timed_out(queue: DataFrame, now: str) -> DataFrame:
    return queue.filter((F.col("status") == "processing") & (F.col("visible_after") < _now(now)))


def recover_timed_out(queue: DataFrame, now: str) -> DataFrame:
    """Put items whose claim ran out back in the queue; a row-wise change, no shuffle."""
    late = F.coalesce((F.col("status") == "processing") & (F.col("visible_after") < _now(now)), F.lit(False))
    cleared = {"status": F.lit("queued"), "claimed_at": F.lit(None), "claimed_by": F.lit(None), "visible_after": F.lit(None)}
    return queue.select(*[F.when(late, cleared[c]).otherwise(F.col(c)).alias(c) if c in cleared else F.col(c)
                          for c in queue.columns])


def chunk_queue_depth(queue: DataFrame) -> DataFrame:
    """Per job items in every state, and whether none is open."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return queue.groupBy("job_id").agg(count("queued"), count("processing"), count("completed"), count("failed")).withColumn(
        "complete", F.col("queued") + F.col("processing") == 0)


def jobs_done(file_queue: DataFrame, chunk_queue: DataFrame) -> DataFrame:
    """Per job whether both queues are empty, and the status that follows.

    The two queues are counted in one aggregation over their union.
    """
    open_item = F.col("status").isin(*OPEN)
    both = file_queue.select("job_id", open_item.alias("open"), (F.col("status") == "failed").alias("bad")).unionByName(
        chunk_queue.select("job_id", open_item.alias("open"), (F.col("status") == "failed").alias("bad")))
    return both.groupBy("job_id").agg(F.count_if("open").alias("open_items"), F.bool_or("bad").alias("_bad")).select(
        "job_id", "open_items",
        F.when(F.col("open_items") > 0, "running").when(F.col("_bad"), "failed").otherwise("completed").alias("status"))


def enqueue_chunks(chunks: DataFrame, created_at) -> DataFrame:
    """Chunk rows as queue rows with a JSON payload."""
    payload = F.to_json(F.struct(*[f.name for f in CHUNK_PAYLOAD.fields]))
    none_ts = F.lit(None).cast("timestamp_ntz")
    return chunks.select(
        F.col("chunk_id").alias("id"), "job_id", payload.alias("chunk_data"), F.lit("queued").alias("status"),
        none_ts.alias("claimed_at"), F.lit(None).cast("string").alias("claimed_by"), none_ts.alias("visible_after"),
        F.lit(0).alias("retry_count"), F.lit(3).alias("max_retries"), F.lit(None).cast("string").alias("last_error"),
        created_at.alias("created_at"), none_ts.alias("completed_at"))


def decoded_chunks(queue: DataFrame) -> DataFrame:
    """Payloads as columns; items whose payload does not parse are left out."""
    parsed = queue.withColumn("_c", F.from_json("chunk_data", CHUNK_PAYLOAD, {"mode": "PERMISSIVE"}))
    return parsed.filter(F.col("_c.file_path").isNotNull() & F.col("_c.content").isNotNull()).select("id", "job_id", "_c.*")
