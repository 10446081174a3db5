"""File excerpts: pick one stored version of a path, cut the lines around a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import InvalidRequest
from ..functions import text
from ..functions.languages import excerpt_language


def branch_preference(branch: Column) -> Column:
    return F.when(branch == "main", 1).when(branch == "master", 2).otherwise(3)


def preferred_file(files: DataFrame, file_path: str, tenant_id: str, repository_id: str | None = None,
                   branch: str | None = None) -> DataFrame:
    """The one stored row for a path.

    With a repository but no branch main is preferred, then master; otherwise
    the latest indexed row wins.
    """
    if not file_path.strip():
        raise InvalidRequest("file path cannot be empty")
    found = files.filter((F.col("tenant_id") == tenant_id) & (F.col("file_path") == file_path))
    order = [F.desc("indexed_at"), F.asc("repository_id"), F.asc("branch")]
    if repository_id is not None:
        found = found.filter(F.col("repository_id") == repository_id)
        if branch is None:
            order.insert(0, branch_preference(F.col("branch")))
    if branch is not None:
        found = found.filter(F.col("branch") == branch)
    return found.orderBy(*order).limit(1)


def preferred_files(files: DataFrame) -> DataFrame:
    """For every (tenant, repository, path) the version a request without a branch gets.

    `max_by` combines before the shuffle, so a path with very many branches
    sends one row per task, never its whole group.
    """
    rank = F.struct((-branch_preference(F.col("branch"))).alias("p"), F.col("indexed_at"), F.col("branch"))
    return files.groupBy("tenant_id", "repository_id", "file_path").agg(
        F.max_by(F.struct("branch", "content_hash", "indexed_at"), rank).alias("f")
    ).select("tenant_id", "repository_id", "file_path", "f.*")


def excerpt(files: DataFrame, line: int | None = None, radius: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Excerpt rows for the given files, with the columns to `keep`; an empty file has no lines."""
    lined = files.withColumn("_lines", text.lines(F.col("file_content")))
    cut = lined.withColumn("_cut", text.line_range(F.col("_lines"), line, radius))
    return cut.select(
        "file_path", "tenant_id", "repository_id", "branch",
        F.col("_cut.content").alias("content"),
        F.struct("_cut.start", "_cut.end", "_cut.requested", "_cut.total").alias("lines"),
        excerpt_language(F.col("file_path")).alias("language"),
        F.coalesce("encoding", F.lit("UTF-8")).alias("encoding"),
        F.octet_length("file_content").cast("long").alias("size_bytes"), *keep,
    )

