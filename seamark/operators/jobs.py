"""Indexing jobs: creation, progress, completion, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import BRANCH_KEY, JOB_STATUSES
from .catalog import where_key

ACTIVE = ["pending", "running"]


def invalid_statuses(jobs: DataFrame) -> DataFrame:
    """Rows that break the status constraint; empty for a sound table."""
    return jobs.filter(~F.coalesce(F.col("status").isin(*JOB_STATUSES), F.lit(False)))


def started_jobs(requests: DataFrame, files: DataFrame) -> DataFrame:
    """One running job per request (job_id, branch key, repository_url, commit, started_at).

    `files_total` counts the files queued for it.
    """
    queued = files.groupBy("job_id").agg(F.count("*").cast("int").alias("files_total"))
    return requests.join(queued, "job_id", "left").withColumn("files_total", F.coalesce("files_total", F.lit(0))).withColumn(
        "status", F.lit("running")).withColumn("files_processed", F.lit(0)).withColumn("chunks_created", F.lit(0))


def with_progress(jobs: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add logged counter changes (job_id, files_delta, chunks_delta) to the jobs."""
    added = deltas.groupBy("job_id").agg(F.sum("files_delta").alias("_f"), F.sum("chunks_delta").alias("_c"))
    joined = jobs.join(added, "job_id", "left")
    zero = F.lit(0).cast("long")
    return joined.select(*[
        (F.col("files_processed") + F.coalesce("_f", zero)).cast("int").alias(c) if c == "files_processed"
        else (F.col("chunks_created") + F.coalesce("_c", zero)).cast("int").alias(c) if c == "chunks_created"
        else F.col(c) for c in jobs.columns])


def with_completion(jobs: DataFrame, ended: DataFrame) -> DataFrame:
    """Set status, error and end of jobs listed in `ended` (job_id, end_status, error, ended_at)."""
    joined = jobs.join(ended.select("job_id", "end_status", "error", "ended_at"), "job_id", "left")
    hit = F.col("end_status").isNotNull()
    new = {"status": F.when(hit, F.col("end_status")).otherwise(F.col("status")),
           "completed_at": F.when(hit, F.col("ended_at")).otherwise(F.col("completed_at")),
           "error_message": F.when(hit, F.col("error")).otherwise(F.col("error_message"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in jobs.columns])


def branches_after_completion(branches: DataFrame, jobs: DataFrame, ended: DataFrame) -> DataFrame:
    """Refresh `last_indexed` of the branches whose jobs completed, tenant included."""
    done = ended.filter(F.col("end_status") == "completed").select("job_id", "ended_at")
    latest = jobs.select("job_id", *BRANCH_KEY).join(done, "job_id").groupBy(*BRANCH_KEY).agg(
        F.max("ended_at").alias("_at"))
    return branches.join(latest, BRANCH_KEY, "left").select(
        *[F.coalesce("_at", "last_indexed").alias(c) if c == "last_indexed" else F.col(c) for c in branches.columns])


def job_row(jobs: DataFrame, job_id: str) -> DataFrame:
    return where_key(jobs, job_id=job_id)


def recent_jobs(jobs: DataFrame, tenant_id: str | None = None, repository_id: str | None = None, limit: int | None = 100) -> DataFrame:
    """The newest jobs, `limit` of them or, without one, all; both filters apply when given."""
    key = {"tenant_id": tenant_id, "repository_id": repository_id}
    found = where_key(jobs, **{k: v for k, v in key.items() if v is not None}).orderBy(F.desc("started_at"), F.asc("job_id"))
    return found if limit is None else found.limit(limit)


def running_flags(jobs: DataFrame) -> DataFrame:
    """Per branch whether a job is pending or running."""
    return jobs.groupBy(*BRANCH_KEY).agg(F.bool_or(F.col("status").isin(*ACTIVE)).alias("has_running_jobs"))


def has_running_jobs(jobs: DataFrame, tenant_id: str, repository_id: str, branch: str) -> DataFrame:
    mine = where_key(jobs, tenant_id=tenant_id, repository_id=repository_id, branch=branch)
    return mine.agg(F.coalesce(F.bool_or(F.col("status").isin(*ACTIVE)), F.lit(False)).alias("has_running_jobs"))


def progress_percent() -> Column:
    return F.when(F.col("files_total") > 0, F.round(100.0 * F.col("files_processed") / F.col("files_total"), 2))
