"""Lookups, counts and maintenance figures over the index tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..errors import InvalidRequest
from ..schemas import BRANCH_KEY, FILE_KEY

_MB = 1048576.0


def where_key(df: DataFrame, **key: str) -> DataFrame:
    """Rows with the given column values."""
    for column, value in key.items():
        df = df.filter(F.col(column) == value)
    return df


def file_row(files: DataFrame, tenant_id: str, repository_id: str, branch: str, file_path: str) -> DataFrame:
    return where_key(files, tenant_id=tenant_id, repository_id=repository_id, branch=branch, file_path=file_path)


def branch_files(files: DataFrame, tenant_id: str, repository_id: str, branch: str) -> DataFrame:
    """Files of a branch by path, without their content."""
    return where_key(files, tenant_id=tenant_id, repository_id=repository_id, branch=branch).drop(
        "file_content").orderBy("file_path")


def file_chunks(chunks: DataFrame, tenant_id: str, repository_id: str, branch: str, file_path: str) -> DataFrame:
    return file_row(chunks, tenant_id, repository_id, branch, file_path).orderBy("chunk_index")


def files_by_paths(files: DataFrame, tenant_id: str, file_paths: Sequence[str]) -> DataFrame:
    """Files of a tenant with one of the paths of a request; no path, no rows."""
    return where_key(files, tenant_id=tenant_id).filter(F.col("file_path").isin(list(file_paths)))


def branches_in(branches: DataFrame, tenant_id: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Branches listed in a request as (repository, branch) pairs."""
    wanted = F.lit(False)
    for repository_id, branch in pairs:
        wanted = wanted | ((F.col("repository_id") == repository_id) & (F.col("branch") == branch))
    return where_key(branches, tenant_id=tenant_id).filter(wanted)


def branches_among(branches: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same for a table of wanted branches of any size, tenant included; a branch wanted often is asked for once."""
    return branches.join(wanted.select(*BRANCH_KEY).distinct(), BRANCH_KEY, "left_semi")


# -------------------------------------------------------------------- counts

def index_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per branch: files, chunks that belong to a file, latest indexing, distinct commits.

    Files and chunks are counted apart, so no file row is multiplied by its chunks;
    paths and chunk ids are keys, so counting rows counts them.
    """
    of_files = files.groupBy(*BRANCH_KEY).agg(
        F.count("*").alias("total_files"),
        F.max("indexed_at").alias("last_indexed"),
        F.countDistinct("commit_sha").alias("unique_commits"),
    )
    of_chunks = chunks.join(files.select(*FILE_KEY), FILE_KEY, "left_semi").groupBy(*BRANCH_KEY).agg(
        F.count("*").alias("total_chunks"))
    return of_files.join(of_chunks, BRANCH_KEY, "left").select(
        *BRANCH_KEY, "total_files", F.coalesce("total_chunks", F.lit(0).cast("long")).alias("total_chunks"),
        F.lit(0).cast("long").alias("total_size_bytes"), "last_indexed", "unique_commits")


def _one_row(parts: dict[str, tuple[DataFrame, dict]]) -> DataFrame:
    """Several global aggregates as one row, without joining them."""
    columns = [c for _, aggregates in parts.values() for c in aggregates]
    rows = None
    for df, aggregates in parts.values():
        row = df.agg(*[expr.alias(name) for name, expr in aggregates.items()])
        rows = row if rows is None else rows.unionByName(row, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in columns])


def stats(files: DataFrame, chunks: DataFrame, points: DataFrame, branches: DataFrame, dimension: int | None = None) -> DataFrame:
    """Index totals in one row; the size is that of the stored text and vectors.

    Sizes come from short columns: files know theirs, and vectors of one index are equally long
    (`dimension`; if not given, the first vector tells).
    """
    if dimension is None:
        first = points.select(F.size("embedding").alias("n")).filter("n >= 0").limit(1).collect()
        dimension = first[0]["n"] if first else 0
    out = _one_row({
        "files": (files, {"files": F.count("*"), "_text": F.coalesce(F.sum("size_bytes"), F.lit(0))}),
        "chunks": (chunks, {"chunks": F.count("*")}),
        "points": (points, {"vectors": F.count("*"), "_vec": F.count("*") * dimension * 4}),
        "branches": (branches, {"last_indexed": F.max("last_indexed")}),
    })
    return out.select("files", "chunks", "vectors", F.round((F.col("_text") + F.col("_vec")) / _MB, 2).alias("db_size_mb"),
                      "last_indexed")


def status(files: DataFrame, chunks: DataFrame, branches: DataFrame) -> DataFrame:
    """Index part of the status answer."""
    out = _one_row({
        "files": (files, {"total_files": F.count("*"),
                          "_text": F.coalesce(F.sum("size_bytes"), F.lit(0))}),
        "chunks": (chunks, {"total_chunks": F.count("*")}),
        "branches": (branches, {"project_branches": F.count("*"), "last_indexed_at": F.max("last_indexed")}),
    })
    return out.select("project_branches", "total_files", "total_chunks",
                      F.round(F.col("_text") / _MB, 2).alias("db_size_mb"), "last_indexed_at")


def vector_count(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("vector_count"))


# --------------------------------------------------------------- maintenance

def stale_chunks(chunks: DataFrame, files: DataFrame, missing_files: bool = False,
                 older_than_seconds: int | None = None, now: str | None = None) -> DataFrame:
    """Chunks a clean-up removes: their file is gone, or they were made too long ago."""
    if not missing_files and older_than_seconds is None:
        return chunks.filter(F.lit(False))
    marked = chunks.join(files.select(*FILE_KEY, F.lit(True).alias("_known")), FILE_KEY, "left") if missing_files \
        else chunks.withColumn("_known", F.lit(True))
    drop = F.col("_known").isNull()
    if older_than_seconds is not None:
        if now is None:
            raise InvalidRequest("older_than needs the present time")
        oldest = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(older_than_seconds))
        drop = drop | (F.col("created_at") < oldest)
    return marked.filter(drop).select(*chunks.columns)


def clean_report(removed: DataFrame) -> DataFrame:
    return removed.agg(
        F.count("*").alias("removed_chunks"),
        F.coalesce(F.round(F.sum(F.col("byte_end") - F.col("byte_start")) / _MB, 6), F.lit(0.0)).alias("freed_space_mb"),
    )
