"""Work-queue transitions over whole queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import queues as Q
from . import corpus as c
from .registry import query

NOW = c.NOW
_NOW = f"TIMESTAMP '{NOW}'"
_Q, _FQ = [c.CHUNK_QUEUE], [c.CHUNK_QUEUE, c.FILE_QUEUE]


@query("queue_claim", c.with_sql(*_Q, select=f"""
SELECT q.id, CASE WHEN h.id IS NULL THEN q.status ELSE 'processing' END AS status,
  CASE WHEN h.id IS NULL THEN q.claimed_by ELSE 'w1' END AS claimed_by, CASE WHEN h.id IS NULL THEN q.claimed_at ELSE {_NOW} END AS claimed_at,
  CASE WHEN h.id IS NULL THEN q.visible_after ELSE {_NOW} + INTERVAL 300 SECOND END AS visible_after
FROM chunk_queue q LEFT JOIN (SELECT id FROM chunk_queue WHERE status = 'queued' AND (visible_after IS NULL OR visible_after <= {_NOW})
  ORDER BY created_at, id LIMIT 64) h ON h.id = q.id"""))
def queue_claim(spark, folder):
    after = Q.claim_chunks(c.chunk_queue(spark, folder), "w1", NOW, 64)
    return after.select("id", "status", "claimed_by", "claimed_at", "visible_after")


@query("queue_ack", c.with_sql(*_Q, select=f"""
SELECT id, CASE WHEN id::BIGINT % 9 = 0 THEN 'completed' ELSE status END AS status,
  CASE WHEN id::BIGINT % 9 = 0 THEN {_NOW} ELSE completed_at END AS completed_at FROM chunk_queue"""))
def queue_ack(spark, folder):
    q = c.chunk_queue(spark, folder)
    return Q.ack_chunks(q, q.filter(F.col("id").cast("long") % 9 == 0), NOW).select("id", "status", "completed_at")


@query("queue_requeue", c.with_sql(*_Q, select="""
SELECT id, CASE WHEN status <> 'processing' THEN status WHEN retry_count >= max_retries THEN 'failed' ELSE 'queued' END AS status,
  CASE WHEN status = 'processing' THEN retry_count + 1 ELSE retry_count END AS retry_count,
  CASE WHEN status = 'processing' THEN 'timeout' ELSE last_error END AS last_error,
  CASE WHEN status = 'processing' THEN NULL ELSE visible_after END AS visible_after FROM chunk_queue"""))
def queue_requeue(spark, folder):
    q = c.chunk_queue(spark, folder)
    failed = q.filter(F.col("status") == "processing").select("id", F.lit("timeout").alias("error"))
    return Q.requeue_chunks(q, failed).select("id", "status", "retry_count", "last_error", "visible_after")


@query("queue_recover", c.with_sql(*_Q, select=f"""
SELECT id, CASE WHEN late THEN 'queued' ELSE status END AS status, CASE WHEN late THEN NULL ELSE claimed_by END AS claimed_by,
  CASE WHEN late THEN NULL ELSE visible_after END AS visible_after
FROM (SELECT *, coalesce(status = 'processing' AND visible_after < {_NOW}, false) AS late FROM chunk_queue)"""))
def queue_recover(spark, folder):
    return Q.recover_timed_out(c.chunk_queue(spark, folder), NOW).select("id", "status", "claimed_by", "visible_after")


@query("queue_timed_out_count", c.with_sql(*_Q, select=f"""
SELECT count(*) AS recovered FROM chunk_queue WHERE status = 'processing' AND visible_after < {_NOW}"""))
def queue_timed_out(spark, folder):
    return Q.timed_out(c.chunk_queue(spark, folder), NOW).agg(F.count("*").alias("recovered"))


@query("queue_depth", c.with_sql(*_Q, select="""
SELECT job_id, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'processing') AS processing,
  count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status IN ('queued', 'processing')) = 0 AS complete FROM chunk_queue GROUP BY job_id"""))
def queue_depth(spark, folder):
    return Q.chunk_queue_depth(c.chunk_queue(spark, folder))


@query("file_queue_next", c.with_sql(*_FQ, select="""
SELECT id, job_id, file_path, priority FROM file_queue WHERE status = 'queued' ORDER BY priority DESC, created_at, id LIMIT 5"""))
def file_queue_next(spark, folder):
    return Q.next_files(c.file_queue(spark, folder), 5).select("id", "job_id", "file_path", "priority")


@query("file_queue_claim", c.with_sql(*_FQ, c.JOBS, select="""
SELECT q.id, q.tenant_id, q.job_id, q.file_path, q.file_content, q.content_hash, j.vector_namespace
FROM (SELECT * FROM file_queue WHERE status = 'queued' ORDER BY priority DESC, created_at, id LIMIT 1) q JOIN jobs j ON j.job_id = q.job_id"""))
def file_queue_claim(spark, folder):
    """What the worker gets: the head of the queue with its job's namespace."""
    return Q.claimed_files(c.file_queue(spark, folder), c.jobs(spark, folder))


@query("file_queue_after_claim", c.with_sql(*_FQ, select=f"""
SELECT q.id, CASE WHEN h.id IS NULL THEN q.status ELSE 'processing' END AS status, CASE WHEN h.id IS NULL THEN q.started_at ELSE {_NOW} END AS started_at
FROM file_queue q LEFT JOIN (SELECT id FROM file_queue WHERE status = 'queued' ORDER BY priority DESC, created_at, id LIMIT 10) h ON h.id = q.id"""))
def file_queue_after_claim(spark, folder):
    return Q.claim_files(c.file_queue(spark, folder), NOW, 10).select("id", "status", "started_at")


@query("file_queue_completed", c.with_sql(*_FQ, select=f"""
SELECT id, CASE WHEN status = 'processing' AND id::BIGINT % 2 = 0 THEN 'completed' ELSE status END AS status,
  CASE WHEN status = 'processing' AND id::BIGINT % 2 = 0 THEN {_NOW} ELSE completed_at END AS completed_at FROM file_queue"""))
def file_queue_completed(spark, folder):
    q = c.file_queue(spark, folder)
    return Q.finish_files(q, q.filter(F.col("id").cast("long") % 2 == 0), NOW).select("id", "status", "completed_at")


@query("file_queue_depth", c.with_sql(*_FQ, select="""
SELECT job_id, count(*) FILTER (WHERE status IN ('queued', 'processing')) AS depth,
  count(*) FILTER (WHERE status IN ('queued', 'processing')) = 0 AS complete FROM file_queue GROUP BY job_id"""))
def file_queue_depth(spark, folder):
    return Q.file_queue_depth(c.file_queue(spark, folder))


@query("jobs_done", c.with_sql(*_FQ, select="""
SELECT job_id, count(*) FILTER (WHERE status IN ('queued', 'processing')) AS open_items,
  CASE WHEN count(*) FILTER (WHERE status IN ('queued', 'processing')) > 0 THEN 'running' WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'completed' END AS status
FROM (SELECT job_id, status FROM file_queue UNION ALL SELECT job_id, status FROM chunk_queue) GROUP BY job_id"""))
def jobs_done(spark, folder):
    """Completion needs both queues empty."""
    return Q.jobs_done(c.file_queue(spark, folder), c.chunk_queue(spark, folder))


@query("chunks_per_job", "SELECT 'job-' || user_id AS job_id, count(*) AS chunks FROM events GROUP BY user_id")
def chunks_per_job(spark, folder):
    return c.chunk_queue(spark, folder).groupBy("job_id").agg(F.count("*").alias("chunks"))


@query("batch_time_mean", "SELECT event_type, count(*) AS batches, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def batch_time_mean(spark, folder):
    return c.table(spark, folder, "events").groupBy("event_type").agg(
        F.count("*").alias("batches"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("queue_payload_roundtrip", c.with_sql(c.FILES, c.CHUNKS, select="""
SELECT chunk_id AS id, file_path, content, start_line, end_line, kind, name, chunk_index AS file_chunk_index FROM chunks"""))
def queue_payload_roundtrip(spark, folder):
    """Chunks to JSON queue rows and back."""
    rows = c.chunks(spark, folder).withColumn("language", F.lit("x")).withColumn("token_count", F.lit(1)).withColumn(
        "file_chunk_index", F.col("chunk_index")).withColumn("job_id", F.lit("j"))
    back = Q.decoded_chunks(Q.enqueue_chunks(rows, F.lit(NOW).cast("timestamp_ntz")))
    return back.select("id", "file_path", "content", "start_line", "end_line", "kind", "name", "file_chunk_index")


@query("queue_payload_bad_rows", "SELECT count(*) AS decodable FROM events WHERE json_extract_string(props, '$.file_path') IS NOT NULL")
def queue_payload_bad_rows(spark, folder):
    """Payloads of another shape are dropped, not failed on."""
    return Q.decoded_chunks(c.chunk_queue(spark, folder)).agg(F.count("*").alias("decodable"))
