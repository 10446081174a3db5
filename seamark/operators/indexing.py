"""Files to chunks to points, and the incremental batch that keeps an index current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import ids, tokens
from ..functions.embedding import EmbeddingProvider
from ..schemas import (
    ALL, BRANCH_KEY, CHUNK_METADATA, COMMIT_COLUMNS, FILE_KEY, INDEXED_FILES, INDEXING_JOBS, VECTORS,
)
from ..session import bounded_batches
from ..sources.tables import IndexTables, Version, VersionTaken, partition_keys, unique_batch
from . import changes, chunking, parsing


def chunked_files(files: DataFrame, max_tokens: int = parsing.MAX_TOKENS, mode: str = "definitions") -> DataFrame:
    """Chunks of files that carry a generation, with ids; nothing is shuffled."""
    keep = [c for c in files.columns if c not in ("file_content", "language")]
    spans = parsing.parse_spans(files, mode, max_tokens)
    rows = chunking.chunk_rows(chunking.split_large_spans(spans, max_tokens), *keep, "language")
    return rows.withColumn("chunk_id", ids.chunk_id(
        "repository_id", "branch", "file_path", "generation", "byte_start", "byte_end"))


def packed_files(files: DataFrame, budget: chunking.TokenBudget, mode: str = "definitions") -> DataFrame:
    """The same with small neighbours packed up to the token budget."""
    keep = [c for c in files.columns if c not in ("file_content", "language")]
    spans = parsing.parse_spans(files, mode, budget.hard)
    rows = chunking.chunk_rows(chunking.pack_spans(spans, budget), *keep, "language")
    return rows.withColumn("chunk_id", ids.chunk_id(
        "repository_id", "branch", "file_path", "generation", "byte_start", "byte_end"))


def embedded(chunks: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """Chunks with the vector of the text in their byte range; a header repeated in front of it does not count."""
    sized = chunks if "token_count" in chunks.columns else chunks.withColumn(
        "token_count", tokens.token_count(F.col("content")))
    ranged = F.coalesce("own", "content") if "own" in chunks.columns else F.col("content")
    return sized.withColumn("embedding", provider.embed(ranged))


def _conformed(df: DataFrame, schema) -> DataFrame:
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _given(incoming: DataFrame) -> DataFrame:
    """A push with all columns a batch reads, those it came without as nulls."""
    kinds = {"repository_url": "string", "encoding": "string", "size_bytes": "long", "pushed_at": "timestamp_ntz",
             **{c: "timestamp_ntz" if c == "commit_date" else "string" for c in COMMIT_COLUMNS}}
    for column, kind in kinds.items():
        if column not in incoming.columns:
            incoming = incoming.withColumn(column, F.lit(None).cast(kind))
    return incoming


def index_batch(spark: SparkSession, tables: IndexTables, incoming: DataFrame, provider: EmbeddingProvider,
                batch: str, indexed_at: Column, max_tokens: int = parsing.MAX_TOKENS, mark: tuple[str, int] | None = None,
                complete: set[tuple[str, str, str]] | None = None, budget: chunking.TokenBudget | None = None) -> DataFrame:
    """Bring the index up to date with `incoming` files; returns the job of each branch with its counts.

    The push is staged once.  Its jobs are `running` in a version of their own; all new files, chunks, points, jobs and
    branches then become visible together with the last version, or not at all: then the jobs are `failed`, and
    the batch is simply done again.  Of a file pushed twice the later push counts (`pushed_at`; without it, or
    at the same time, the smaller content hash).  If another writer was faster, the merge is made again on what it left.
    `mark` names a stream and the number of its batch; a batch that the index holds already changes nothing.
    Of the branches in `complete` (tenant, repository, branch) the push is all there is: their other files leave the index.
    With a `budget` small neighbours share a chunk, and its counter and limit hold; else each span of up to `max_tokens` is one.
    """
    bounded_batches(spark)
    tables = tables.latest()
    known = _held(spark, tables, tables.current(spark), mark)
    if known is not None:
        return known
    run = unique_batch(batch)
    staged = tables.staging(run, "push")
    _given(incoming).write.parquet(staged)
    push = spark.read.parquet(staged)
    branches = partition_keys(push, BRANCH_KEY) | (complete or set())
    at = spark.range(1).select(indexed_at.alias("at")).first()["at"]
    moment = F.lit(at).cast("timestamp_ntz")
    started = push.groupBy(*BRANCH_KEY).agg(F.countDistinct("file_path").cast("int").alias("files_total"), F.max(F.struct(
        "commit_date", "commit_sha", "commit_message", "author", "repository_url")).alias("_commit")).withColumn("job_id", _job_id(batch)).select(
        "*", "_commit.*", F.lit(batch).alias("correlation_id"), moment.alias("started_at"), F.lit(0).alias("files_processed"), F.lit(0).alias("chunks_created"))
    _jobs_only(spark, tables, started.withColumn("status", F.lit("running")), branches, batch)
    try:
        report = _merged(spark, tables, push, branches, provider, batch, run, moment, max_tokens, mark, complete, budget)
    except Exception as error:
        failed = started.withColumn("status", F.lit("failed")).withColumn("completed_at", moment).withColumn("error_message", F.lit(str(error)[:500]))
        try:
            _jobs_only(spark, tables, failed, branches, batch)
        except Exception as second:
            error.add_note(f"the failed job could not be written: {second}")
        raise
    finally:
        tables.discard(spark, run)
    return report


def _report_of(tables: IndexTables, own: str) -> str:
    return f"{tables.root.rstrip('/')}/reports/{own}"


def _held(spark: SparkSession, tables: IndexTables, version: Version, mark: tuple[str, int] | None) -> DataFrame | None:
    """The report of a stream's batch that is in the index; of an older one than the last an empty report."""
    last = version.marks.get(mark[0]) if mark else None
    if last is None or last[0] < mark[1]:
        return None
    report = spark.read.parquet(_report_of(tables, last[1]))
    return report if last[0] == mark[1] else report.limit(0)


def _job_id(batch: str) -> Column:
    """A batch repeated under its name is the same job."""
    return ids.uuid5(ids.CHUNK_NAMESPACE, F.concat_ws(":", F.lit(batch), *BRANCH_KEY))


def _retried(attempt, most: int = 20):
    """Do a merge again as long as other writers come first."""
    for _ in range(most):
        try:
            return attempt()
        except VersionTaken:
            continue
    raise VersionTaken(f"{most} times")


def _jobs_only(spark: SparkSession, tables: IndexTables, jobs: DataFrame, branches: set, batch: str) -> None:
    def attempt() -> None:
        base, own = tables.current(spark), unique_batch(batch)
        tenants = _with_jobs(spark, tables.at(base), jobs, branches, own)
        tables.commit(spark, base, own, {"indexing_jobs": tenants})
    _retried(attempt)


def _with_jobs(spark: SparkSession, tables: IndexTables, jobs: DataFrame, branches: set, own: str) -> set:
    """Write the tenants' job rows with `jobs` in the place of those of the same id."""
    tenants = {(key[0],) for key in branches}
    new = _conformed(jobs, INDEXING_JOBS)
    old = tables.read(spark, "indexing_jobs", tenants).join(new.select("job_id"), "job_id", "left_anti").select(*INDEXING_JOBS.names)
    tables.write(old.unionByName(new), "indexing_jobs", own)
    return tenants


def _merged(spark: SparkSession, tables: IndexTables, push: DataFrame, branches: set, provider: EmbeddingProvider, batch: str, run: str,
            at: Column, max_tokens: int, mark: tuple[str, int] | None = None, complete: set[tuple[str, str, str]] | None = None, budget: chunking.TokenBudget | None = None) -> DataFrame:
    cut = (lambda files: packed_files(files, budget)) if budget else (lambda files: chunked_files(files, max_tokens))

    def attempt() -> DataFrame:
        base, own = tables.current(spark), unique_batch(batch)
        known = _held(spark, tables, base, mark)
        if known is not None:
            return known
        seen_from = tables.at(base)

        def stage(df: DataFrame, name: str) -> DataFrame:
            path = tables.staging(run, f"{own}-{name}")
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        late = F.desc_nulls_last("pushed_at")
        unique = changes.first_per_key(push.drop("file_content"), FILE_KEY, late, F.asc("content_hash"))
        states = changes.file_states(unique, seen_from.read(spark, "indexed_files", branches).select(*FILE_KEY, "content_hash", "generation"))
        seen = stage(states.withColumnRenamed("new_generation", "generation"), "states")

        # text is moved for changed files only; most files of an incremental push are not
        texts = push.select(*FILE_KEY, F.col("content_hash").alias("_hash"), "file_content")
        with_text = seen.filter(F.col("state") != "unchanged").join(texts, FILE_KEY).filter(F.col("_hash") == F.col("content_hash"))
        changed = stage(changes.first_per_key(with_text.drop("_hash"), FILE_KEY, F.asc("content_hash")).withColumn(
            "encoding", F.coalesce("encoding", F.lit("UTF-8"))).withColumn(
            "size_bytes", F.coalesce("size_bytes", F.octet_length("file_content").cast("long"))).withColumn("indexed_at", at), "files")
        points = stage(_conformed(embedded(cut(changed), provider), VECTORS), "points")

        vanished = stage(seen_from.read(spark, "indexed_files", complete or set()).select(*FILE_KEY).join(unique.select(*FILE_KEY), FILE_KEY, "left_anti"), "vanished")
        rewritten = changed.select(*FILE_KEY).unionByName(vanished)
        touched = partition_keys(rewritten, BRANCH_KEY)

        def merge(name: str, fresh: DataFrame) -> None:
            old = seen_from.read(spark, name, touched).join(rewritten, FILE_KEY, "left_anti").select(*ALL[name].names)
            tables.write(old.unionByName(fresh.select(*ALL[name].names)), name, own)

        if touched:
            # a file is one row and cut once, so a chunk is unique by its place; parts of a class and of its method may share range and id
            merge("vectors", points)
            merge("chunk_metadata", _conformed(points.withColumn("created_at", at), CHUNK_METADATA))
            merge("indexed_files", _conformed(changed, INDEXED_FILES))

        report = _batch_report(seen, points, vanished, batch)
        done = report.select("*", "_commit.*").withColumn("status", F.lit("completed")).withColumn(
            "files_total", F.col("files_processed")).withColumn("started_at", at).withColumn("completed_at", at)
        tenants = _with_jobs(spark, seen_from, done, branches, own)
        known = seen_from.read(spark, "project_branches", tenants)
        arrived = report.select(*BRANCH_KEY, "_commit.repository_url", at.alias("seen_at"))
        now = changes.upsert_branches(known, arrived).join(arrived.select(*BRANCH_KEY, "seen_at"), BRANCH_KEY, "left")
        tables.write(now.withColumn("last_indexed", F.coalesce("seen_at", "last_indexed")), "project_branches", own)
        kept = _report_of(tables, own)
        report.select("job_id", *BRANCH_KEY, "files_processed", "new_files", "updated_files", "unchanged_files", "chunks_created", "deleted_files").write.parquet(kept)
        tables.commit(spark, base, own, {"vectors": touched, "chunk_metadata": touched, "indexed_files": touched, "indexing_jobs": tenants, "project_branches": tenants}, mark)
        return spark.read.parquet(kept)

    return _retried(attempt)


def _batch_report(seen: DataFrame, points: DataFrame, vanished: DataFrame, batch: str) -> DataFrame:
    """Per branch: job id, counts, and the commit it was pushed with."""
    files_done = seen.groupBy(*BRANCH_KEY).agg(
        F.count("*").alias("files_processed"), F.count_if(F.col("state") == "new").alias("new_files"),
        F.count_if(F.col("state") == "updated").alias("updated_files"),
        F.count_if(F.col("state") == "unchanged").alias("unchanged_files"),
        F.max(F.struct("commit_date", "commit_sha", "commit_message", "author", "repository_url")).alias("_commit"))
    chunks_done = points.groupBy(*BRANCH_KEY).agg(F.count("*").alias("chunks_created"))
    gone = vanished.groupBy(*BRANCH_KEY).agg(F.count("*").alias("deleted_files"))
    counts = ["files_processed", "new_files", "updated_files", "unchanged_files", "chunks_created", "deleted_files"]
    return files_done.join(chunks_done, BRANCH_KEY, "left").join(gone, BRANCH_KEY, "full").withColumns(
        {n: F.coalesce(n, F.lit(0).cast("long")) for n in counts}).withColumn("job_id", _job_id(batch)).withColumn("correlation_id", F.lit(batch))


def clean(spark: SparkSession, tables: IndexTables, removed: DataFrame) -> None:
    """The next version is without the `removed` chunks and their points.

    Their files are marked as changed (no content hash), so that the next push of one is indexed again.
    """
    def attempt() -> None:
        base, own = tables.current(spark), unique_batch("clean")
        now = tables.at(base)
        gone = removed.select(*FILE_KEY, "chunk_id").distinct()
        touched = partition_keys(removed, BRANCH_KEY)
        if not touched:
            return
        for name in ("vectors", "chunk_metadata"):
            tables.write(changes.delete_points(now.read(spark, name, touched), gone), name, own)
        hit = gone.select(*FILE_KEY, F.lit(True).alias("_hit")).distinct()
        files = now.read(spark, "indexed_files", touched).join(hit, FILE_KEY, "left").withColumn(
            "content_hash", F.when(F.col("_hit"), F.lit("")).otherwise(F.col("content_hash")))
        tables.write(files, "indexed_files", own)
        tables.commit(spark, base, own, {name: touched for name in ("vectors", "chunk_metadata", "indexed_files")})
    _retried(attempt)


def compact(spark: SparkSession, tables: IndexTables) -> None:
    """The next version holds the same rows in evenly sized, sorted files."""
    def attempt() -> None:
        base, own = tables.current(spark), unique_batch("compact")
        for name in ALL:
            tables.write(tables.at(base).read(spark, name), name, own)
        tables.commit(spark, base, own, dict.fromkeys(ALL))
    _retried(attempt)


def move(spark: SparkSession, tables: IndexTables, moves: DataFrame) -> None:
    """Rename files by pending moves, in files, chunks and points alike; ids stay."""
    def attempt() -> None:
        base, own = tables.current(spark), unique_batch("move")
        now, touched = tables.at(base), partition_keys(moves, BRANCH_KEY)
        files = now.read(spark, "indexed_files", touched)
        valid = changes.valid_moves(moves, files)
        for name in ("indexed_files", "chunk_metadata", "vectors"):
            tables.write(changes.apply_moves(now.read(spark, name, touched), valid), name, own)
        tables.commit(spark, base, own, {name: touched for name in ("vectors", "chunk_metadata", "indexed_files")})
    _retried(attempt)
