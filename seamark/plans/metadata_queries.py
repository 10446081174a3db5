"""File states, upserts, deletes, moves, jobs, counts, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import catalog, changes, context, jobs as J
from ..schemas import BRANCH_KEY, CHUNK_KEY, FILE_KEY
from . import corpus as c
from .registry import query

_KEY = "tenant_id, repository_id, branch, file_path"
_ON = " AND ".join(f"{{a}}.{k} = {{b}}.{k}" for k in FILE_KEY)


def on(a: str, b: str) -> str:
    return _ON.format(a=a, b=b)


# --------------------------------------------------------------------- scans

@query("file_lookup", c.with_sql(c.FILES, select="""
SELECT doc_id, file_path, content_hash, generation, size_bytes FROM files
WHERE tenant_id = 't1' AND repository_id = 'org/repo-1' AND branch = 'main' AND file_path = 'tests/doc_1.py'"""))
def file_lookup(spark, folder):
    row = catalog.file_row(c.files(spark, folder), "t1", "org/repo-1", "main", "tests/doc_1.py")
    return row.select("doc_id", "file_path", "content_hash", "generation", "size_bytes")


@query("branch_files", c.with_sql(c.FILES, select="""
SELECT file_path, content_hash, size_bytes, indexed_at FROM files
WHERE tenant_id = 't0' AND repository_id = 'org/repo-3' AND branch = 'dev' ORDER BY file_path"""))
def branch_files(spark, folder):
    rows = catalog.branch_files(c.files(spark, folder), "t0", "org/repo-3", "dev")
    return rows.select("file_path", "content_hash", "size_bytes", "indexed_at")


@query("file_chunks", c.with_sql(c.FILES, c.CHUNKS, select="""
SELECT chunk_index, chunk_id, start_line, end_line, byte_start, byte_end FROM chunks
WHERE tenant_id = 't1' AND repository_id = 'org/repo-1' AND branch = 'main' AND file_path = 'tests/doc_1.py' ORDER BY chunk_index"""))
def file_chunks(spark, folder):
    rows = catalog.file_chunks(c.chunks(spark, folder), "t1", "org/repo-1", "main", "tests/doc_1.py")
    return rows.select("chunk_index", "chunk_id", "start_line", "end_line", "byte_start", "byte_end")


_PATHS = ["src/doc_0.rs", "tests/doc_1.py", "lib/doc_12.rs", "docs/missing.md"]


@query("files_by_paths", c.with_sql(c.FILES, select=f"""
SELECT doc_id, branch, file_path, content_hash FROM files WHERE tenant_id = 't0'
  AND file_path IN ({', '.join(repr(p) for p in _PATHS)})"""))
def files_by_paths(spark, folder):
    return catalog.files_by_paths(c.files(spark, folder), "t0", _PATHS).select("doc_id", "branch", "file_path", "content_hash")


@query("branches_in_pairs", c.with_sql(c.FILES, c.BRANCHES, select="""
SELECT tenant_id, repository_id, branch, first_seen FROM branches WHERE tenant_id = 't2'
  AND (repository_id, branch) IN (('org/repo-2', 'main'), ('org/repo-5', 'dev'), ('org/none', 'main'))"""))
def branches_in_pairs(spark, folder):
    pairs = [("org/repo-2", "main"), ("org/repo-5", "dev"), ("org/none", "main")]
    return catalog.branches_in(c.branches(spark, folder), "t2", pairs).select("tenant_id", "repository_id", "branch", "first_seen")


@query("branches_with_jobs", c.with_sql(c.FILES, c.BRANCHES, c.JOBS, select="""
SELECT tenant_id, repository_id, branch FROM branches b
WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.tenant_id = b.tenant_id AND j.repository_id = b.repository_id AND j.branch = b.branch)"""))
def branches_with_jobs(spark, folder):
    return catalog.branches_among(c.branches(spark, folder), c.jobs(spark, folder)).select("tenant_id", "repository_id", "branch")


@query("context_by_preference", c.with_sql(c.FILES, select=f"""
SELECT tenant_id, repository_id, file_path, branch, content_hash, indexed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, repository_id, file_path ORDER BY
    CASE branch WHEN 'main' THEN 1 WHEN 'master' THEN 2 ELSE 3 END, indexed_at DESC, branch DESC) AS rn
  FROM (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN 'feature-' || branch ELSE branch END AS branch) FROM files)) WHERE rn = 1"""))
def context_by_preference(spark, folder):
    """The version each path resolves to when no branch is asked for."""
    branch = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("feature-"), F.col("branch"))).otherwise(F.col("branch"))
    return context.preferred_files(c.files(spark, folder).withColumn("branch", branch))


@query("context_lookup", c.with_sql(c.FILES, select="""
SELECT repository_id, branch, file_path, content_hash FROM (
  SELECT * FROM files WHERE tenant_id = 't0' AND file_path = 'src/fixtures/doc_3.go' ORDER BY indexed_at DESC LIMIT 1)
UNION ALL SELECT repository_id, branch, file_path, content_hash FROM (
  SELECT * FROM files WHERE tenant_id = 't0' AND repository_id = 'org/repo-3' AND file_path = 'src/fixtures/doc_3.go'
  ORDER BY CASE branch WHEN 'main' THEN 1 WHEN 'master' THEN 2 ELSE 3 END, indexed_at DESC LIMIT 1)
UNION ALL SELECT repository_id, branch, file_path, content_hash FROM (
  SELECT * FROM files WHERE tenant_id = 't0' AND branch = 'dev' AND file_path = 'src/fixtures/doc_3.go' ORDER BY indexed_at DESC LIMIT 1)"""))
def context_lookup(spark, folder):
    """One path asked for with and without repository and branch."""
    f, path = c.files(spark, folder), "src/fixtures/doc_3.go"
    found = [context.preferred_file(f, path, "t0"), context.preferred_file(f, path, "t0", repository_id="org/repo-3"),
             context.preferred_file(f, path, "t0", branch="dev")]
    out = found[0].unionByName(found[1]).unionByName(found[2])
    return out.select("repository_id", "branch", "file_path", "content_hash")


# ------------------------------------------------------------ change detection

_STATES = f"""states AS (
  SELECT i.*, CASE WHEN x.content_hash IS NULL THEN 'new' WHEN x.content_hash = i.content_hash THEN 'unchanged' ELSE 'updated' END AS state,
    CASE WHEN x.content_hash <> i.content_hash THEN x.generation END AS old_generation,
    CASE WHEN x.content_hash IS NULL THEN 1 WHEN x.content_hash <> i.content_hash THEN x.generation + 1 END AS new_generation
  FROM incoming i LEFT JOIN indexed x ON {on('i', 'x')})"""

_BASE = [c.FILES, c.INCOMING, c.INDEXED, _STATES]


@query("file_state", c.with_sql(*_BASE, select="SELECT doc_id, state, old_generation, new_generation FROM states"))
def file_state(spark, folder):
    states = changes.file_states(c.incoming(spark, folder), c.indexed(spark, folder))
    return states.select("doc_id", "state", "old_generation", "new_generation")


def _changed(spark, folder):
    states = changes.file_states(c.incoming(spark, folder), c.indexed(spark, folder)).filter(F.col("state") != "unchanged")
    return states.withColumn("generation", F.col("new_generation")).withColumn(
        "indexed_at", F.col("indexed_at") + F.expr("INTERVAL 30 DAYS"))


@query("upsert_files", c.with_sql(*_BASE, select=f"""
SELECT doc_id, {_KEY}, content_hash, generation, size_bytes, indexed_at FROM indexed x
WHERE NOT EXISTS (SELECT 1 FROM states s WHERE s.state <> 'unchanged' AND {on('s', 'x')})
UNION ALL
SELECT doc_id, {_KEY}, content_hash, new_generation, size_bytes, indexed_at + INTERVAL 30 DAY FROM states WHERE state <> 'unchanged'"""))
def upsert_files(spark, folder):
    after = changes.upsert_files(c.indexed(spark, folder), _changed(spark, folder))
    return after.select("doc_id", *FILE_KEY, "content_hash", "generation", "size_bytes", "indexed_at")


@query("upsert_branches", c.with_sql(c.FILES, c.BRANCHES, select="""
SELECT coalesce(s.tenant_id, b.tenant_id) AS tenant_id, coalesce(s.repository_id, b.repository_id) AS repository_id,
  coalesce(s.branch, b.branch) AS branch, coalesce(s.url, b.repository_url) AS repository_url,
  coalesce(b.first_seen, s.seen) AS first_seen, b.last_indexed
FROM (SELECT * FROM branches WHERE branch <> 'dev') b FULL JOIN (
  SELECT tenant_id, repository_id, branch, max(repository_url) AS url, TIMESTAMP '2024-03-01 00:00:00' AS seen
  FROM files WHERE branch IN ('dev', 'main') GROUP BY tenant_id, repository_id, branch) s
ON b.tenant_id = s.tenant_id AND b.repository_id = s.repository_id AND b.branch = s.branch"""))
def upsert_branches(spark, folder):
    known = c.branches(spark, folder).filter(F.col("branch") != "dev")
    seen = c.files(spark, folder).filter(F.col("branch").isin("dev", "main")).withColumn(
        "seen_at", F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    return changes.upsert_branches(known, seen)


_CB = [c.FILES, c.CHUNKS]


@query("insert_chunks_ignore", c.with_sql(*_CB, select="""
SELECT chunk_id, tenant_id, chunk_index FROM chunks n
WHERE NOT EXISTS (SELECT 1 FROM chunks e WHERE e.chunk_index % 2 = 0 AND e.tenant_id = n.tenant_id AND e.chunk_id = n.chunk_id)"""))
def insert_chunks_ignore(spark, folder):
    """All chunks twice against a table that holds the even ones: the odd ones go in, once."""
    all_chunks = c.chunks(spark, folder, with_content=False)
    existing = all_chunks.filter(F.col("chunk_index") % 2 == 0)
    return changes.insert_chunks(existing, all_chunks.unionByName(all_chunks)).select("chunk_id", "tenant_id", "chunk_index")


_UPDATES = "updates AS (SELECT tenant_id, repository_id, branch, file_path, 2 AS new_generation FROM files WHERE doc_id % 10 = 0)"


def _updates(spark, folder):
    return c.files(spark, folder).filter(F.col("doc_id") % 10 == 0).select(
        *FILE_KEY, F.lit(2).cast("long").alias("new_generation"))


@query("replace_file_chunks", c.with_sql(*_CB, _UPDATES, select=f"""
SELECT chunk_id AS deleted_chunk_id FROM chunks c
WHERE EXISTS (SELECT 1 FROM updates u WHERE {on('u', 'c')} AND c.generation < u.new_generation)"""))
def replace_file_chunks(spark, folder):
    gone = changes.replaced_chunks(c.chunks(spark, folder, with_content=False), _updates(spark, folder))
    return gone.select(F.col("chunk_id").alias("deleted_chunk_id"))


@query("chunks_after_replace", c.with_sql(*_CB, _UPDATES, select=f"""
SELECT {_KEY}, count(*) AS chunks FROM chunks c
WHERE NOT EXISTS (SELECT 1 FROM updates u WHERE {on('u', 'c')} AND c.generation < u.new_generation) GROUP BY {_KEY}"""))
def chunks_after_replace(spark, folder):
    kept = changes.without_replaced(c.chunks(spark, folder, with_content=False), _updates(spark, folder))
    return kept.groupBy(*FILE_KEY).agg(F.count("*").alias("chunks"))


@query("orphan_chunks", c.with_sql(*_CB, c.INDEXED, select=f"""
SELECT chunk_id, chunk_index FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM indexed x WHERE {on('x', 'c')})"""))
def orphan_chunks(spark, folder):
    gone = changes.orphaned_chunks(c.chunks(spark, folder, with_content=False), c.indexed(spark, folder))
    return gone.select("chunk_id", "chunk_index")


_MOVES = """moves AS (
  SELECT doc_id AS id, tenant_id, repository_id, branch, file_path AS old_path, 'moved/' || file_path AS new_path,
    indexed_at AS detected_at, doc_id % 14 = 0 AS processed FROM files WHERE doc_id % 7 = 0)"""


def _moves(spark, folder):
    return c.files(spark, folder).filter(F.col("doc_id") % 7 == 0).select(
        F.col("doc_id").alias("id"), "tenant_id", "repository_id", "branch", F.col("file_path").alias("old_path"),
        F.concat(F.lit("moved/"), "file_path").alias("new_path"), F.col("indexed_at").alias("detected_at"),
        (F.col("doc_id") % 14 == 0).alias("processed"))


@query("file_moves", c.with_sql(c.FILES, _MOVES, select="""
SELECT f.doc_id, coalesce(m.new_path, f.file_path) AS file_path, f.content_hash FROM files f
LEFT JOIN moves m ON NOT m.processed AND m.tenant_id = f.tenant_id AND m.repository_id = f.repository_id
  AND m.branch = f.branch AND m.old_path = f.file_path"""))
def file_moves(spark, folder):
    return changes.apply_moves(c.files(spark, folder), _moves(spark, folder)).select("doc_id", "file_path", "content_hash")


@query("chunk_moves", c.with_sql(*_CB, _MOVES, select="""
SELECT coalesce(m.new_path, f.file_path) AS file_path, count(*) AS chunks FROM chunks f
LEFT JOIN moves m ON NOT m.processed AND m.tenant_id = f.tenant_id AND m.repository_id = f.repository_id
  AND m.branch = f.branch AND m.old_path = f.file_path GROUP BY 1"""))
def chunk_moves(spark, folder):
    moved = changes.apply_moves(c.chunks(spark, folder, with_content=False), _moves(spark, folder))
    return moved.groupBy("file_path").agg(F.count("*").alias("chunks"))


@query("moves_processed", c.with_sql(c.FILES, c.INDEXED, _MOVES, select="""
SELECT id, processed OR EXISTS (SELECT 1 FROM indexed f WHERE m.tenant_id = f.tenant_id AND m.repository_id = f.repository_id
  AND m.branch = f.branch AND m.old_path = f.file_path) AS processed FROM moves m"""))
def moves_processed(spark, folder):
    return changes.marked_processed(_moves(spark, folder), c.indexed(spark, folder)).select("id", "processed")


@query("cascade_delete", c.with_sql(*_CB, c.BRANCHES, c.JOBS, select="""
SELECT 'project_branches' AS entity, tenant_id || '/' || repository_id || '/' || branch AS kept FROM branches WHERE tenant_id <> 't1'
UNION ALL SELECT 'indexed_files', tenant_id || '/' || repository_id || '/' || branch || '/' || file_path FROM files WHERE tenant_id <> 't1'
UNION ALL SELECT 'chunk_metadata', tenant_id || '/' || chunk_id FROM chunks WHERE tenant_id <> 't1'
UNION ALL SELECT 'indexing_jobs', job_id FROM jobs j WHERE EXISTS (SELECT 1 FROM branches b WHERE b.tenant_id <> 't1'
  AND b.tenant_id = j.tenant_id AND b.repository_id = j.repository_id AND b.branch = j.branch)"""))
def cascade_delete(spark, folder):
    """Deleting one tenant takes everything below it along: the rows that stay."""
    tenants = c.files(spark, folder).select("tenant_id").distinct().filter(F.col("tenant_id") != "t1")
    kept = changes.cascade({
        "tenants": tenants, "project_branches": c.branches(spark, folder), "indexed_files": c.files(spark, folder),
        "chunk_metadata": c.chunks(spark, folder, with_content=False), "indexing_jobs": c.jobs(spark, folder)})
    keys = {"project_branches": BRANCH_KEY, "indexed_files": FILE_KEY, "chunk_metadata": CHUNK_KEY, "indexing_jobs": ["job_id"]}
    rows = [kept[name].select(F.lit(name).alias("entity"), F.concat_ws("/", *key).alias("kept")) for name, key in keys.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("vector_upsert", c.with_sql(c.POINTS, select="""
SELECT vec_id, chunk_id, generation, unnest(range(1, len(embedding) + 1)) AS dim,
  unnest([round((CASE WHEN vec_id % 2 = 0 AND vec_id % 5 <> 0 THEN -x ELSE x END)::DOUBLE, 6) FOR x IN embedding]) AS value
FROM (SELECT vec_id, chunk_id, CASE WHEN vec_id % 2 = 0 AND vec_id % 5 <> 0 THEN 2 ELSE generation END AS generation, embedding FROM points)"""))
def vector_upsert(spark, folder):
    """New points replace stored ones; points without a vector are skipped."""
    p = c.points(spark, folder)
    new = p.filter(F.col("vec_id") % 2 == 0).withColumn("generation", F.lit(2).cast("long")).withColumn(
        "embedding", F.when(F.col("vec_id") % 5 != 0, F.transform("embedding", lambda x: -x)))
    after = changes.upsert_points(p, new)
    return after.select("vec_id", "chunk_id", "generation", F.posexplode("embedding").alias("p", "x")).select(
        "vec_id", "chunk_id", "generation", (F.col("p") + 1).cast("long").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("value"))


@query("vector_delete", c.with_sql(c.POINTS, select="SELECT vec_id, chunk_id, repository_id FROM points WHERE vec_id % 4 <> 0"))
def vector_delete(spark, folder):
    p = c.points(spark, folder)
    return changes.delete_points(p, p.filter(F.col("vec_id") % 4 == 0)).select("vec_id", "chunk_id", "repository_id")


@query("vector_count", "SELECT count(*) AS vector_count FROM embeddings")
def vector_count(spark, folder):
    return catalog.vector_count(c.points(spark, folder))


# ---------------------------------------------------------------------- jobs

@query("jobs_recent", c.with_sql(c.JOBS, select="""
SELECT job_id, tenant_id, repository_id, status, started_at FROM jobs ORDER BY started_at DESC, job_id LIMIT 100"""))
def jobs_recent(spark, folder):
    return J.recent_jobs(c.jobs(spark, folder)).select("job_id", "tenant_id", "repository_id", "status", "started_at")


@query("jobs_recent_of_repository", c.with_sql(c.JOBS, select="""
SELECT job_id, status, started_at FROM jobs WHERE tenant_id = 't1' AND repository_id = 'org/repo-1' ORDER BY started_at DESC, job_id LIMIT 100"""))
def jobs_recent_of_repository(spark, folder):
    return J.recent_jobs(c.jobs(spark, folder), "t1", "org/repo-1").select("job_id", "status", "started_at")


@query("job_status", c.with_sql(c.JOBS, select="""
SELECT job_id, repository_id, branch, status, files_total, files_processed, chunks_created, error_message, started_at, completed_at
FROM jobs WHERE job_id = 'job-8'"""))
def job_status(spark, folder):
    return J.job_row(c.jobs(spark, folder), "job-8").select(
        "job_id", "repository_id", "branch", "status", "files_total", "files_processed", "chunks_created", "error_message",
        "started_at", "completed_at")


@query("job_progress_percent", c.with_sql(c.JOBS, select="""
SELECT job_id, status, CASE WHEN files_total > 0 THEN round(100.0::DOUBLE * files_processed / files_total, 2) END AS percent FROM jobs"""))
def job_progress_percent(spark, folder):
    return c.jobs(spark, folder).select("job_id", "status", J.progress_percent().alias("percent"))


@query("has_running_jobs", c.with_sql(c.JOBS, select="""
SELECT tenant_id, repository_id, branch, bool_or(status IN ('pending', 'running')) AS has_running_jobs FROM jobs GROUP BY ALL"""))
def has_running_jobs(spark, folder):
    return J.running_flags(c.jobs(spark, folder))


@query("job_progress", c.with_sql(c.JOBS, select="""
SELECT j.job_id, (j.files_processed + count(*) FILTER (WHERE e.event_type = 'purchase'))::INTEGER AS files_processed,
  (j.chunks_created + sum(e.event_id % 4))::INTEGER AS chunks_created
FROM jobs j JOIN events e ON j.job_id = 'job-' || e.user_id GROUP BY j.job_id, j.files_processed, j.chunks_created"""))
def job_progress(spark, folder):
    """Counter increments as a log, summed per job."""
    log = c.table(spark, folder, "events").select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("files_delta"), (F.col("event_id") % 4).alias("chunks_delta"))
    return J.with_progress(c.jobs(spark, folder), log).select("job_id", "files_processed", "chunks_created")


_ENDED = """ended AS (SELECT job_id, CASE status WHEN 'running' THEN 'completed' ELSE 'failed' END AS end_status,
  CASE status WHEN 'pending' THEN 'no worker' END AS error, TIMESTAMP '2024-02-01 00:00:00' AS ended_at
  FROM jobs WHERE status IN ('running', 'pending'))"""


def _ended(spark, folder):
    open_jobs = c.jobs(spark, folder).filter(F.col("status").isin("running", "pending"))
    return open_jobs.select(
        "job_id", F.when(F.col("status") == "running", "completed").otherwise("failed").alias("end_status"),
        F.when(F.col("status") == "pending", "no worker").alias("error"),
        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("ended_at"))


@query("job_complete", c.with_sql(c.JOBS, _ENDED, select="""
SELECT j.job_id, coalesce(e.end_status, j.status) AS status, CASE WHEN e.job_id IS NULL THEN j.error_message ELSE e.error END AS error_message,
  coalesce(e.ended_at, j.completed_at) AS completed_at FROM jobs j LEFT JOIN ended e ON e.job_id = j.job_id"""))
def job_complete(spark, folder):
    return J.with_completion(c.jobs(spark, folder), _ended(spark, folder)).select("job_id", "status", "error_message", "completed_at")


@query("branches_after_completion", c.with_sql(c.FILES, c.BRANCHES, c.JOBS, _ENDED, select="""
SELECT b.tenant_id, b.repository_id, b.branch, coalesce(d.at, b.last_indexed) AS last_indexed FROM branches b LEFT JOIN (
  SELECT j.tenant_id, j.repository_id, j.branch, max(e.ended_at) AS at FROM jobs j JOIN ended e ON e.job_id = j.job_id
  WHERE e.end_status = 'completed' GROUP BY ALL) d
ON d.tenant_id = b.tenant_id AND d.repository_id = b.repository_id AND d.branch = b.branch"""))
def branches_after_completion(spark, folder):
    after = J.branches_after_completion(c.branches(spark, folder), c.jobs(spark, folder), _ended(spark, folder))
    return after.select("tenant_id", "repository_id", "branch", "last_indexed")


@query("jobs_started", c.with_sql(c.FILES, select="""
SELECT tenant_id || '/' || repository_id || '/' || branch AS job_id, 'running' AS status, count(*)::INTEGER AS files_total, 0 AS files_processed
FROM files WHERE NOT contains(file_content, chr(0)) GROUP BY tenant_id, repository_id, branch"""))
def jobs_started(spark, folder):
    job = F.concat_ws("/", "tenant_id", "repository_id", "branch").alias("job_id")
    pushed = c.files(spark, folder).select(
        F.concat_ws(":", "repository_id", "branch").alias("project_id"), "tenant_id", F.col("file_path").alias("path"),
        F.col("file_content").alias("content"))
    queued = changes.pushed_files(pushed, F.col("tenant_id")).select(job)
    requests = c.files(spark, folder).select(job).distinct()
    return J.started_jobs(requests, queued).select("job_id", "status", "files_total", "files_processed")


@query("job_status_check", c.with_sql(c.JOBS, select="""
SELECT count(*) AS invalid_jobs FROM jobs WHERE status NOT IN ('pending', 'running', 'completed', 'failed', 'cancelled')"""))
def job_status_check(spark, folder):
    return J.invalid_statuses(c.jobs(spark, folder)).agg(F.count("*").alias("invalid_jobs"))


# -------------------------------------------------------------------- counts

@query("index_stats", c.with_sql(*_CB, c.INDEXED, select=f"""
SELECT f.tenant_id, f.repository_id, f.branch, count(DISTINCT f.file_path) AS total_files, count(DISTINCT c.chunk_id) AS total_chunks,
  0::BIGINT AS total_size_bytes, max(f.indexed_at) AS last_indexed, count(DISTINCT f.commit_sha) AS unique_commits
FROM indexed f LEFT JOIN chunks c ON {on('c', 'f')} GROUP BY f.tenant_id, f.repository_id, f.branch"""))
def index_stats(spark, folder):
    return catalog.index_stats(c.indexed(spark, folder), c.chunks(spark, folder, with_content=False))


@query("stats", c.with_sql(*_CB, c.BRANCHES, select="""
SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM embeddings) AS vectors,
  round(((SELECT sum(strlen(file_content)) FROM files) + (SELECT sum(len(embedding) * 4) FROM embeddings)) / 1048576.0::DOUBLE, 2) AS db_size_mb,
  (SELECT max(last_indexed) FROM branches) AS last_indexed"""))
def stats(spark, folder):
    return catalog.stats(c.files(spark, folder), c.chunks(spark, folder, with_content=False), c.points(spark, folder),
                         c.branches(spark, folder))


@query("status_counts", c.with_sql(*_CB, c.BRANCHES, select="""
SELECT (SELECT count(*) FROM branches) AS project_branches, (SELECT count(*) FROM files) AS total_files,
  (SELECT count(*) FROM chunks) AS total_chunks,
  round((SELECT sum(strlen(file_content)) FROM files) / 1048576.0::DOUBLE, 2) AS db_size_mb,
  (SELECT max(last_indexed) FROM branches) AS last_indexed_at"""))
def status_counts(spark, folder):
    return catalog.status(c.files(spark, folder), c.chunks(spark, folder, with_content=False), c.branches(spark, folder))


@query("clean_stale", c.with_sql(*_CB, c.INDEXED, select=f"""
SELECT count(*) AS removed_chunks, coalesce(round(sum(byte_end - byte_start) / 1048576.0::DOUBLE, 6), 0) AS freed_space_mb FROM chunks c
WHERE NOT EXISTS (SELECT 1 FROM indexed x WHERE {on('x', 'c')}) OR created_at < TIMESTAMP '2024-01-01 03:00:00'"""))
def clean_stale(spark, folder):
    """Chunks of vanished files, and those older than 7 days at a given time."""
    gone = catalog.stale_chunks(c.chunks(spark, folder, with_content=False), c.indexed(spark, folder), missing_files=True,
                                older_than_seconds=7 * 86400, now="2024-01-08 03:00:00")
    return catalog.clean_report(gone)


@query("compact_sizes", c.with_sql(c.FILES, select="""
SELECT tenant_id, repository_id, branch, count(*) AS n_files, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY ALL"""))
def compact_sizes(spark, folder):
    """Stored text per branch partition, the measure a compaction works by."""
    return c.files(spark, folder).groupBy("tenant_id", "repository_id", "branch").agg(
        F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"))


@query("content_push", c.with_sql(c.FILES, select="""
SELECT repository_id, branch, file_path, sha256(file_content) AS content_hash FROM files WHERE NOT contains(file_content, chr(0))"""))
def content_push(spark, folder):
    pushed = c.files(spark, folder).select(
        F.concat_ws(":", "repository_id", "branch").alias("project_id"), F.col("file_path").alias("path"),
        F.col("file_content").alias("content"))
    return changes.pushed_files(pushed, ids.NIL_TENANT).select("repository_id", "branch", "file_path", "content_hash")


@query("create_tenants", """
SELECT source AS name, TIMESTAMP '2024-01-01 00:00:00' AS created_at, 36::INTEGER AS id_length FROM documents GROUP BY source""")
def create_tenants(spark, folder):
    names = c.table(spark, folder, "documents").select(F.col("source").alias("name")).distinct()
    made = changes.created_tenants(names, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return made.select("name", "created_at", F.length("tenant_id").alias("id_length"))
