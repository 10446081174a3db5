"""Filtered nearest-neighbour search, metadata re-ranking, similar code, usages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import InvalidRequest
from ..functions import paths, ranking, text, vectors
from ..functions.columns import struct
from ..schemas import BRANCH_KEY, CHUNK_KEY, FILE_KEY

# Limits of the search requests.
SEARCH_LIMIT, USAGES_LIMIT, MAX_LIMIT = 10, 50, 100
MAX_QUERY_BYTES, MAX_SYMBOL_BYTES = 1000, 500
OVERFETCH = 3
USAGE_TYPES = ("all", "definitions", "references")


def checked_query(query: str) -> str:
    if not query.strip():
        raise InvalidRequest("query cannot be empty")
    if len(query.encode()) > MAX_QUERY_BYTES:
        raise InvalidRequest(f"query exceeds {MAX_QUERY_BYTES} bytes")
    return query


def checked_symbol(symbol: str) -> str:
    if not symbol.strip():
        raise InvalidRequest("symbol cannot be empty")
    if len(symbol.encode()) > MAX_SYMBOL_BYTES:
        raise InvalidRequest(f"symbol exceeds {MAX_SYMBOL_BYTES} bytes")
    return symbol.strip()


def checked_limit(limit: int | None, default: int, max_limit: int = MAX_LIMIT) -> int:
    """A request's limit; one above `max_limit` is refused, not cut."""
    limit = default if limit is None else limit
    if limit < 0:
        raise InvalidRequest("limit cannot be negative")
    if limit > max_limit:
        raise InvalidRequest(f"limit exceeds {max_limit}")
    return limit


def scoped(points: DataFrame, tenant_id: str | None, repository_id: str | None = None,
           branch: str | None = None) -> DataFrame:
    """Equality filters on the partition columns, before any scoring."""
    for column, value in zip(BRANCH_KEY, (tenant_id, repository_id, branch)):
        if value is not None:
            points = points.filter(F.col(column) == value)
    return points


def _ties(df: DataFrame, name: str) -> list[Column]:
    return [F.asc(c) for c in (name, "chunk_index") if c == name or c in df.columns]


def nearest(points: DataFrame, query_vector: Sequence[float], limit: int, tie_break: str = "chunk_id") -> DataFrame:
    """Exact top-`limit` by cosine; each task keeps its own top rows, only those meet.

    The vector column is dropped from the result.
    """
    scored = points.filter(F.col("embedding").isNotNull()).withColumn(
        "similarity", vectors.cosine_to(F.col("embedding"), query_vector))
    return scored.drop("embedding").orderBy(F.desc("similarity"), *_ties(scored, tie_break)).limit(limit)


def rerank(candidates: DataFrame, query: str) -> DataFrame:
    return candidates.withColumn(
        "similarity",
        F.col("similarity") * ranking.boost(query, F.col("name"), F.col("kind"), F.col("file_path")),
    )


def top(candidates: DataFrame, limit: int, tie_break: str = "chunk_id") -> DataFrame:
    """Total order: similarity descending, nulls last, then id and place."""
    return candidates.orderBy(F.desc_nulls_last("similarity"), *_ties(candidates, tie_break)).limit(limit)


def search(points: DataFrame, query: str, query_vector: Sequence[float], tenant_id: str,
           repository_id: str | None = None, branch: str | None = None, limit: int | None = None) -> DataFrame:
    """Filter, fetch three times the limit by cosine, re-rank by metadata, keep the best.

    The result is without text, see `with_content`.
    """
    checked_query(query)
    limit = checked_limit(limit, SEARCH_LIMIT)
    inside = scoped(points.drop("content"), tenant_id, repository_id, branch)
    return top(rerank(nearest(inside, query_vector, OVERFETCH * limit), query), limit)


def repo_commit(df: DataFrame) -> tuple[Column, Column]:
    """Repository name and commit struct of a payload row; the commit only if complete."""
    parts = ["commit_sha", "commit_message", "author", "commit_date"]
    complete = F.lit(True)
    for part in parts:
        complete = complete & F.col(part).isNotNull()
    commit = F.when(complete, struct(
        sha=F.col("commit_sha"), message=F.col("commit_message"), author=F.col("author"),
        date=F.date_format("commit_date", "yyyy-MM-dd HH:mm:ss 'UTC'")))
    return paths.repository_name(F.col("repository_url")), commit


def pinned(found: DataFrame, most: int) -> tuple[DataFrame, list]:
    """A ranked result of bounded size as literal rows, so that what is fetched for it can be pruned."""
    rows = found.limit(most + 1).collect()
    if len(rows) > most:
        raise InvalidRequest(f"a ranked result of at most {most} rows is expected")
    return found.sparkSession.createDataFrame(rows, found.schema), rows


def with_content(found: DataFrame, points: DataFrame, most: int = MAX_LIMIT) -> DataFrame:
    """Text of the ranked chunks.

    Ranking reads vectors and short columns only; the text of the winners is
    then read by literal keys, which skips all other partitions and row groups.
    """
    pin, rows = pinned(found, most)
    # two chunks of a file may share their range and so their id; then their place tells them apart
    keys = [*CHUNK_KEY, "chunk_index"] if "chunk_index" in found.columns and "chunk_index" in points.columns else CHUNK_KEY
    wanted = points
    for key in (*FILE_KEY, "chunk_id"):
        wanted = wanted.filter(F.col(key).isin(sorted({row[key] for row in rows})))
    return pin.join(wanted.select(*keys, "content"), keys, "left")


def with_file_context(matches: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of the file around each match of a response."""
    pin, rows = pinned(matches, MAX_LIMIT)
    wanted = files.select(*FILE_KEY, "file_content")
    for key in FILE_KEY:
        wanted = wanted.filter(F.col(key).isin(sorted({row[key] for row in rows})))
    lined = pin.join(wanted, FILE_KEY, "left").withColumn("_lines", text.lines(F.col("file_content")))
    around = text.surrounding_lines(F.col("_lines"), F.col("start_line"), F.col("end_line"))
    return lined.withColumn("context", around).drop("_lines", "file_content")


def as_matches(results: DataFrame, query: str) -> DataFrame:
    """Response rows of a search; joins nothing.  A `context` column is kept if present."""
    repository, commit = repo_commit(results)
    context = F.col("context") if "context" in results.columns else F.lit(None).cast("struct<before:string,after:string>")
    return results.select(
        paths.base_name(F.col("file_path")).alias("file"),
        F.col("file_path").alias("path"),
        repository.alias("repository"),
        "content",
        "language",
        F.col("kind").alias("type"),
        "name",
        struct(start=F.col("start_line"), end=F.col("end_line")).alias("lines"),
        "similarity",
        context.alias("context"),
        text.highlight_ranges(F.col("content"), query).alias("highlights"),
        text.symbols(F.col("name"), F.col("kind")).alias("symbols"),
        commit.alias("commit"),
    )


def similar(points: DataFrame, code_vector: Sequence[float], tenant_id: str, repository_id: str | None = None,
            branch: str | None = None, exclude_file: str | None = None, limit: int | None = None) -> DataFrame:
    """Chunks nearest to a snippet, optionally without the file it came from."""
    limit = checked_limit(limit, SEARCH_LIMIT)
    inside = scoped(points.drop("content"), tenant_id, repository_id, branch)
    if exclude_file is not None:
        inside = inside.filter(F.col("file_path") != exclude_file)
    return nearest(inside, code_vector, limit)


def as_similar(found: DataFrame) -> DataFrame:
    """Response rows of a similarity search."""
    return found.select(
        F.col("file_path").alias("file"), "content", F.col("start_line").alias("line_start"),
        F.col("end_line").alias("line_end"), "similarity",
        text.symbols(F.col("name"), F.col("kind")).alias("symbols"))


def classified(results: DataFrame, symbol: str, usage_type: str = "all") -> DataFrame:
    """Keep the chunks that define or mention `symbol`, labelled."""
    usage_type = usage_type.lower()
    if usage_type not in USAGE_TYPES:
        raise InvalidRequest(f"usage_type must be one of {', '.join(USAGE_TYPES)}")
    defines = ranking.is_definition(F.col("name"), F.col("kind"), symbol)
    mentions = ranking.is_reference(F.col("name"), F.col("kind"), F.col("content"), symbol)
    keep = {"all": defines | mentions, "definitions": defines, "references": mentions}[usage_type]
    return results.filter(keep).withColumn(
        "usage_type", F.when(defines, "definition").otherwise("reference"))


def ranked_usages(labelled: DataFrame, limit: int) -> DataFrame:
    return labelled.orderBy(
        F.when(F.col("usage_type") == "definition", 0).otherwise(1),
        F.desc_nulls_last("similarity"), *_ties(labelled, "chunk_id"),
    ).limit(limit)


def as_usages(labelled: DataFrame) -> DataFrame:
    repository, commit = repo_commit(labelled)
    return labelled.select(
        paths.base_name(F.col("file_path")).alias("file"),
        F.col("file_path").alias("path"),
        F.col("start_line").alias("line"),
        "content",
        "usage_type",
        "language",
        F.when(F.col("usage_type") == "definition", F.col("kind")).alias("kind"),
        "similarity",
        repository.alias("repository"),
        commit.alias("commit"),
    )


def usages(points: DataFrame, symbol: str, symbol_vector: Sequence[float] | None, tenant_id: str,
           repository_id: str | None = None, branch: str | None = None, usage_type: str = "all",
           limit: int | None = None, mode: str = "exact") -> DataFrame:
    """Definitions and references of a symbol, definitions first.

    `exact` reads every chunk in scope, so it finds all of them, and needs no vector; chunks without
    a vector have no similarity and come last.  `semantic` looks among the nearest chunks only.
    """
    symbol = checked_symbol(symbol)
    limit = checked_limit(limit, USAGES_LIMIT)
    if mode == "semantic":
        wanted = OVERFETCH * limit
        inside = scoped(points.drop("content"), tenant_id, repository_id, branch)
        nearby = top(rerank(nearest(inside, symbol_vector, OVERFETCH * wanted), symbol), wanted)
        pool = with_content(nearby, points, wanted)
    elif mode == "exact":
        pool = scoped(points, tenant_id, repository_id, branch)
        if symbol_vector is None:
            pool = pool.withColumn("similarity", F.lit(None).cast("double"))
        else:
            scored = vectors.cosine_to(F.coalesce("embedding", F.array(*[F.lit(0.0).cast("float")] * len(symbol_vector))), symbol_vector)
            pool = rerank(pool.withColumn("similarity", F.when(F.col("embedding").isNotNull(), scored)), symbol)
    else:
        raise InvalidRequest("mode must be semantic or exact")
    return ranked_usages(classified(pool, symbol, usage_type), limit)


def usage_counts(found: DataFrame) -> DataFrame:
    """Totals over the usages actually returned."""
    return found.agg(
        F.count("*").alias("total_usages"),
        F.count_if(F.col("usage_type") == "definition").alias("definitions"),
        F.count_if(F.col("usage_type") == "reference").alias("references"),
    )


def current_points(points: DataFrame, files: DataFrame) -> DataFrame:
    """Points of each file's present generation only; older ones must not be found."""
    return points.join(files.select(*FILE_KEY, "generation"), [*FILE_KEY, "generation"], "left_semi")
