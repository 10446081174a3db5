"""What an incoming set of files changes, and the table versions that result.

Each function takes tables and returns the new version of one of them (or the
rows concerned); writing is left to the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ids, text
from ..functions.paths import split_project_id
from ..schemas import BRANCH_KEY, CHUNK_KEY, CHUNK_POSITION_KEY, COMMIT_COLUMNS, FILE_KEY


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of every key.

    Filtering `row_number() = 1` lets Spark prune each key inside every task
    before the shuffle, so a key with very many rows arrives as one row per task.
    """
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")


# ------------------------------------------------------------------ incoming

# Columns a push may carry beside its key and text.
PUSH_EXTRAS = ["repository_url", *COMMIT_COLUMNS, "pushed_at"]


def pushed_files(files: DataFrame, tenant_id: Column | str = ids.NIL_TENANT, project_id: Column | None = None) -> DataFrame:
    """Content push: (path, content) rows keyed, hashed, binary ones left out; commit, url and time of the push are kept.

    `content` is text, or bytes that are decoded (those that are no text are left out).
    An empty branch is `main`; a push without a repository belongs to `unknown`.
    """
    tenant = F.lit(tenant_id) if isinstance(tenant_id, str) else tenant_id
    repository, branch = split_project_id(F.col("project_id") if project_id is None else project_id)
    named = lambda part, other: F.coalesce(F.when(part != "", part), F.lit(other))
    if dict(files.dtypes)["content"] == "binary":
        rows = decoded_files(files)
    else:
        rows = files.filter(~text.contains_nul(F.col("content"))).withColumn("file_content", F.col("content"))
    extras = [c for c in (*PUSH_EXTRAS, "encoding", "size_bytes") if c in rows.columns]
    return rows.select(
        tenant.alias("tenant_id"), named(repository, "unknown").alias("repository_id"), named(branch, "main").alias("branch"),
        F.col("path").alias("file_path"), "file_content", ids.content_hash(F.col("file_content")).alias("content_hash"), *extras)


def decoded_files(raw: DataFrame, content: str = "content") -> DataFrame:
    """Binary content to text with its encoding; rows that are not text are left out."""
    seen = raw.withColumn("_text", text.decode_bytes(F.col(content))).filter(F.col("_text").isNotNull())
    return seen.withColumn("file_content", F.col("_text.content")).withColumn(
        "encoding", F.col("_text.encoding")).withColumn(
        "size_bytes", F.octet_length(content).cast("long")).drop("_text", content)


def file_states(incoming: DataFrame, indexed: DataFrame) -> DataFrame:
    """Label incoming files new, unchanged or updated, with old and new generation."""
    known = indexed.select(*FILE_KEY, F.col("content_hash").alias("_hash"), F.col("generation").alias("_gen"))
    joined = incoming.join(known, FILE_KEY, "left")
    is_new = F.col("_gen").isNull()
    same = F.col("_hash") == F.col("content_hash")
    return joined.select(
        *[F.col(c) for c in incoming.columns],
        F.when(is_new, "new").when(same, "unchanged").otherwise("updated").alias("state"),
        F.when(~is_new & ~same, F.col("_gen")).alias("old_generation"),
        F.when(is_new, F.lit(1).cast("long")).when(~same, F.col("_gen") + 1).alias("new_generation"),
    )


# ------------------------------------------------------------------- upserts

def upsert_branches(branches: DataFrame, seen: DataFrame) -> DataFrame:
    """Add unseen branches; a known one only takes the new url.

    `seen` has the key, `repository_url` and `seen_at`.  One aggregation over
    the union, combined before the shuffle.
    """
    columns = [*BRANCH_KEY, "repository_url", "first_seen", "last_indexed", "_at"]
    old = branches.withColumn("_at", F.lit(None).cast("timestamp_ntz")).select(*columns)
    new = seen.select(*BRANCH_KEY, "repository_url", F.col("seen_at").alias("first_seen"),
                      F.lit(None).cast("timestamp_ntz").alias("last_indexed"), F.col("seen_at").alias("_at"))
    order = F.struct(F.col("_at").isNotNull(), "_at", "repository_url")
    kept = F.struct(F.col("_at").isNull(), F.when(F.col("_at").isNotNull(), -F.unix_micros(F.col("_at").cast("timestamp"))))
    return old.unionByName(new).groupBy(*BRANCH_KEY).agg(
        F.max_by("repository_url", order).alias("repository_url"),
        F.max_by("first_seen", kept).alias("first_seen"),
        F.max("last_indexed").alias("last_indexed"),
    )


def upsert_files(indexed: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded rows replace stored ones of the same key; the newest record of a key wins."""
    newest = first_per_key(recorded.select(*indexed.columns), FILE_KEY,
                           F.desc("indexed_at"), F.desc("generation"), F.asc("content_hash"))
    return indexed.join(newest.select(*FILE_KEY), FILE_KEY, "left_anti").unionByName(newest)


def unique_chunks(new: DataFrame) -> DataFrame:
    """One row per chunk id and one per position in a file; the first wins."""
    order = [F.asc("generation"), F.asc("chunk_index"), F.asc("byte_start"), F.asc("chunk_id")]
    unique = first_per_key(new, CHUNK_KEY, *order)
    return first_per_key(unique, CHUNK_POSITION_KEY, F.asc("byte_start"), F.asc("chunk_id"))


def insert_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of `new` that are really inserted: ids and positions not yet taken."""
    return unique_chunks(new).join(existing.select(*CHUNK_KEY), CHUNK_KEY, "left_anti").join(
        existing.select(*CHUNK_POSITION_KEY), CHUNK_POSITION_KEY, "left_anti")


def upsert_points(points: DataFrame, new: DataFrame) -> DataFrame:
    """Points with an embedding replace those of the same id."""
    ready = first_per_key(new.filter(F.col("embedding").isNotNull()).select(*points.columns), CHUNK_KEY,
                          F.desc("generation"), F.asc("chunk_index"))
    return points.join(ready.select(*CHUNK_KEY), CHUNK_KEY, "left_anti").unionByName(ready)


# ------------------------------------------------------------------- deletes

def _older(chunks: DataFrame, updates: DataFrame):
    new = updates.select(*[F.col(c).alias(f"_{c}") for c in FILE_KEY], F.col("new_generation").alias("_gen"))
    condition = F.col("generation") < F.col("_gen")
    for key in FILE_KEY:
        condition = condition & (F.col(key) == F.col(f"_{key}"))
    return new, condition


def replaced_chunks(chunks: DataFrame, updates: DataFrame) -> DataFrame:
    """Chunks that an update (file key, new_generation) makes obsolete; their ids go to the vector store."""
    new, condition = _older(chunks, updates)
    return chunks.join(new, condition, "left_semi")


def without_replaced(chunks: DataFrame, updates: DataFrame) -> DataFrame:
    new, condition = _older(chunks, updates)
    return chunks.join(new, condition, "left_anti")


def delete_points(points: DataFrame, gone: DataFrame) -> DataFrame:
    return points.join(gone.select(*CHUNK_KEY).distinct(), CHUNK_KEY, "left_anti")


def orphaned_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.join(files.select(*FILE_KEY), FILE_KEY, "left_anti")


def cascade(kept: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Follow deletions down the foreign keys.

    Give the tables as they are after deleting from some of them; rows whose
    parent is gone go too: tenant, branch, file, chunk, and job, queues.
    """
    links = [
        ("project_branches", "tenants", ["tenant_id"]),
        ("indexed_files", "project_branches", BRANCH_KEY),
        ("chunk_metadata", "indexed_files", FILE_KEY),
        ("vectors", "indexed_files", FILE_KEY),
        ("indexing_jobs", "project_branches", BRANCH_KEY),
        ("indexing_job_file_queue", "indexing_jobs", ["job_id"]),
        ("chunk_processing_queue", "indexing_jobs", ["job_id"]),
    ]
    out = dict(kept)
    for child, parent, keys in links:
        if child in out and parent in out:
            out[child] = out[child].join(out[parent].select(*keys), keys, "left_semi")
    return out


# --------------------------------------------------------------------- moves

def valid_moves(moves: DataFrame, files: DataFrame) -> DataFrame:
    """Pending moves whose new path is free, or becomes free by another move; of several to one path the latest."""
    pending = first_per_key(moves.filter(~F.col("processed")), [*BRANCH_KEY, "old_path"], F.desc("detected_at"), F.desc("id"))
    taken = files.select(*BRANCH_KEY, F.col("file_path").alias("new_path"))
    leaving = pending.select(*BRANCH_KEY, F.col("old_path").alias("new_path"))
    blocked = taken.join(leaving, [*BRANCH_KEY, "new_path"], "left_anti")
    free = pending.join(blocked, [*BRANCH_KEY, "new_path"], "left_anti").select(*moves.columns)
    return first_per_key(free, [*BRANCH_KEY, "new_path"], F.desc("detected_at"), F.desc("id"))


def apply_moves(table: DataFrame, moves: DataFrame) -> DataFrame:
    """Rewrite `file_path` of files or chunks by pending moves; the latest move of a path counts."""
    pending = first_per_key(moves.filter(~F.col("processed")), [*BRANCH_KEY, "old_path"],
                            F.desc("detected_at"), F.desc("id"))
    pairs = pending.select(*BRANCH_KEY, F.col("old_path").alias("file_path"), F.col("new_path").alias("_new"))
    return table.join(pairs, FILE_KEY, "left").select(
        *[F.coalesce("_new", "file_path").alias(c) if c == "file_path" else F.col(c) for c in table.columns])


def marked_processed(moves: DataFrame, files: DataFrame) -> DataFrame:
    """Moves with `processed` set where the old path was in the index."""
    had = files.select(*BRANCH_KEY, F.col("file_path").alias("old_path"), F.lit(True).alias("_had"))
    return moves.join(had, [*BRANCH_KEY, "old_path"], "left").select(
        *[(F.col("processed") | F.coalesce("_had", F.lit(False))).alias(c) if c == "processed" else F.col(c)
          for c in moves.columns])


def created_tenants(names: DataFrame, at: Column) -> DataFrame:
    """Tenant rows for `name`s; the id comes from the name, so a task done again makes the same."""
    return names.select(ids.uuid5(ids.CHUNK_NAMESPACE, F.concat(F.lit("tenant:"), "name")).alias("tenant_id"), "name", at.alias("created_at"),
                        F.lit(None).cast("timestamp_ntz").alias("updated_at"), F.lit(None).cast("string").alias("metadata"))
