"""Table schemas of the index, oldest columns first; new columns go to the end."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(name, nullable=True):
    return T.StructField(name, T.StringType(), nullable)


def _l(name, nullable=True):
    return T.StructField(name, T.LongType(), nullable)


def _i(name, nullable=True):
    return T.StructField(name, T.IntegerType(), nullable)


def _t(name, nullable=True):
    return T.StructField(name, T.TimestampNTZType(), nullable)


BRANCH_KEY = ["tenant_id", "repository_id", "branch"]
FILE_KEY = [*BRANCH_KEY, "file_path"]
CHUNK_KEY = ["tenant_id", "chunk_id"]
CHUNK_POSITION_KEY = [*FILE_KEY, "chunk_index", "generation"]
COMMIT_COLUMNS = ["commit_sha", "commit_message", "commit_date", "author"]

JOB_STATUSES = ["pending", "running", "completed", "failed", "cancelled"]
QUEUE_STATUSES = ["queued", "processing", "completed", "failed"]

TENANTS = T.StructType([_s("tenant_id", False), _s("name", False), _t("created_at"), _t("updated_at"), _s("metadata")])

PROJECT_BRANCHES = T.StructType(
    [_s("tenant_id", False), _s("repository_id", False), _s("branch", False), _s("repository_url"),
     _t("first_seen"), _t("last_indexed")]
)

INDEXED_FILES = T.StructType(
    [_s("tenant_id", False), _s("repository_id", False), _s("branch", False), _s("file_path", False),
     _s("file_content"), _s("content_hash"), _s("encoding"), _l("size_bytes"), _l("generation"),
     _s("commit_sha"), _s("commit_message"), _t("commit_date"), _s("author"), _t("indexed_at")]
)

CHUNK_METADATA = T.StructType(
    [_s("chunk_id", False), _s("tenant_id", False), _s("repository_id", False), _s("branch", False),
     _s("file_path", False), _i("chunk_index"), _l("generation"), _i("start_line"), _i("end_line"),
     _l("byte_start"), _l("byte_end"), _s("kind"), _s("name"), _t("created_at")]
)

# One wide row per point: payload and vector side by side, so a search needs no join.
VECTORS = T.StructType(
    [_s("chunk_id", False), _s("tenant_id", False), _s("repository_id", False), _s("branch", False),
     _s("file_path", False), _i("chunk_index"), _l("generation"), _s("content"), _i("start_line"),
     _i("end_line"), _l("byte_start"), _l("byte_end"), _s("language"), _s("kind"), _s("name"),
     _i("token_count"), _s("repository_url"), _s("commit_sha"), _s("commit_message"), _t("commit_date"),
     _s("author"), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)

INDEXING_JOBS = T.StructType(
    [_s("job_id", False), _s("tenant_id", False), _s("repository_id", False), _s("branch", False),
     _s("status", False), _i("files_total"), _i("files_processed"), _i("chunks_created"),
     _s("repository_url"), _s("commit_sha"), _s("commit_message"), _t("commit_date"), _s("author"),
     _s("vector_namespace"), _s("correlation_id"), _t("started_at"), _t("completed_at"), _s("error_message")]
)

FILE_QUEUE = T.StructType(
    [_s("id", False), _s("job_id", False), _s("tenant_id", False), _s("repository_id", False),
     _s("branch", False), _s("file_path", False), _s("file_content"), _s("content_hash"), _s("status"),
     _i("priority"), _i("retry_count"), _s("error_message"), _t("created_at"), _t("started_at"),
     _t("completed_at")]
)

CHUNK_QUEUE = T.StructType(
    [_s("id", False), _s("job_id", False), _s("chunk_data"), _s("status"), _t("claimed_at"),
     _s("claimed_by"), _t("visible_after"), _i("retry_count"), _i("max_retries"), _s("last_error"),
     _t("created_at"), _t("completed_at")]
)

FILE_MOVES = T.StructType(
    [_l("id"), _s("tenant_id", False), _s("repository_id", False), _s("branch", False), _s("old_path", False),
     _s("new_path", False), _t("detected_at"), T.StructField("processed", T.BooleanType())]
)

# The chunk queue carries one chunk as JSON; this is the shape it must parse to.
CHUNK_PAYLOAD = T.StructType(
    [_s("file_path"), _s("content"), _i("start_line"), _i("end_line"), _l("byte_start"), _l("byte_end"),
     _s("kind"), _s("language"), _s("name"), _i("token_count"), _l("generation"), _i("file_chunk_index")]
)

ALL = {
    "tenants": TENANTS,
    "project_branches": PROJECT_BRANCHES,
    "indexed_files": INDEXED_FILES,
    "chunk_metadata": CHUNK_METADATA,
    "vectors": VECTORS,
    "indexing_jobs": INDEXING_JOBS,
    "indexing_job_file_queue": FILE_QUEUE,
    "chunk_processing_queue": CHUNK_QUEUE,
    "file_moves": FILE_MOVES,
}
