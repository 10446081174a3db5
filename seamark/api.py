"""The engine behind one object: requests in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .errors import InvalidRequest, NotFound
from .functions.durations import seconds
from .functions.embedding import EmbeddingProvider, HashedEmbedding, embed_text
from .functions.ids import NIL_TENANT
from .operators import catalog, changes, context, indexing, jobs, search as S
from .operators.chunking import TokenBudget
from .operators.parsing import MAX_TOKENS
from .sources.files import tree_push
from .sources.tables import IndexTables


class Index:
    """An index under one root folder, with the embedding provider its vectors were made by."""

    def __init__(self, spark: SparkSession, tables: IndexTables, provider: EmbeddingProvider | None = None):
        self.spark, self.tables = spark, tables
        self.provider = provider or HashedEmbedding()

    def table(self, name: str, tenant_id: str | None = None, repository_id: str | None = None, branch: str | None = None) -> DataFrame:
        """A table; given part of a key, only the folders of that scope are listed and read."""
        scope = (tenant_id, repository_id, branch)
        return self.tables.read(self.spark, name, lambda key: all(want is None or want == have for want, have in zip(scope, key)))

    def _vector(self, text: str) -> list[float]:
        return embed_text(self.spark, self.provider, text)

    # ------------------------------------------------------------- retrieval

    def search(self, query: str, tenant_id: str = NIL_TENANT, repository_id: str | None = None, branch: str | None = None,
               limit: int | None = None) -> DataFrame:
        S.checked_query(query)
        points = self.table("vectors", tenant_id, repository_id, branch)
        best = S.search(points, query, self._vector(query), tenant_id, repository_id, branch, limit)
        full = S.with_file_context(S.with_content(best, points), self.table("indexed_files", tenant_id, repository_id, branch))
        return S.as_matches(full, query).orderBy(F.desc_nulls_last("similarity"), "path", "lines.start")

    def similar(self, code: str, tenant_id: str = NIL_TENANT, repository_id: str | None = None, branch: str | None = None,
                exclude_file: str | None = None, limit: int | None = None) -> DataFrame:
        if not code.strip():
            raise InvalidRequest("code cannot be empty")
        points = self.table("vectors", tenant_id, repository_id, branch)
        found = S.similar(points, self._vector(code), tenant_id, repository_id, branch, exclude_file, limit)
        return S.as_similar(S.with_content(found, points)).orderBy(F.desc("similarity"), "file", "line_start")

    def usages(self, symbol: str, tenant_id: str = NIL_TENANT, repository_id: str | None = None, branch: str | None = None,
               usage_type: str = "all", limit: int | None = None, mode: str = "exact") -> DataFrame:
        symbol = S.checked_symbol(symbol)
        found = S.usages(self.table("vectors", tenant_id, repository_id, branch), symbol, self._vector(symbol), tenant_id, repository_id, branch, usage_type,
                         limit, mode)
        return S.as_usages(found)

    def context(self, file_path: str, tenant_id: str = NIL_TENANT, repository_id: str | None = None, branch: str | None = None,
                line: int | None = None, radius: int | None = None) -> DataFrame:
        found = context.preferred_file(self.table("indexed_files", tenant_id, repository_id, branch), file_path, tenant_id, repository_id, branch)
        excerpt = context.excerpt(found, line, radius)
        if excerpt.isEmpty():
            raise NotFound(f"file is not in the index: {file_path}")
        return excerpt

    # -------------------------------------------------------------- indexing

    def index(self, files: DataFrame, batch: str, tenant_id: str = NIL_TENANT, indexed_at: Column | None = None,
              max_tokens: int = MAX_TOKENS, budget: TokenBudget | None = None) -> DataFrame:
        """Index a push of (project_id, path, content) rows; `batch` names it, repeating a name repeats the batch.

        repository_url, commit_sha, commit_message, commit_date, author and pushed_at are kept if present;
        `content` may be bytes, which are decoded.  With a `budget` small definitions share chunks up to its soft limit.
        """
        if files.isEmpty():
            raise InvalidRequest("files cannot be empty")
        at = F.localtimestamp() if indexed_at is None else indexed_at
        return indexing.index_batch(self.spark, self.tables, changes.pushed_files(files, tenant_id), self.provider, batch, at,
                                    max_tokens, budget=budget)

    def sync(self, root: str, repository_id: str, branch: str, batch: str, tenant_id: str = NIL_TENANT, indexed_at: Column | None = None,
             max_tokens: int = MAX_TOKENS, glob: str | None = None) -> DataFrame:
        """Make the index of a branch what the text files below `root` are: new and changed ones are indexed, vanished ones leave."""
        at = F.localtimestamp() if indexed_at is None else indexed_at
        return indexing.index_batch(self.spark, self.tables, tree_push(self.spark, root, tenant_id, repository_id, branch, glob), self.provider, batch, at,
                                    max_tokens, complete={(tenant_id, repository_id, branch)})

    def job_status(self, job_id: str) -> DataFrame:
        found = jobs.job_row(self.table("indexing_jobs"), job_id).withColumn("progress_percent", jobs.progress_percent())
        if found.isEmpty():
            raise NotFound(f"no such job: {job_id}")
        return found

    def jobs(self, tenant_id: str | None = None, project_id: str | None = None, limit: int | None = 100) -> DataFrame:
        """The newest jobs, all of them with `limit=None`; of `repository:branch` the repository filters."""
        repository = project_id.split(":", 1)[0] if project_id else None
        return jobs.recent_jobs(self.table("indexing_jobs"), tenant_id, repository, limit)

    # ----------------------------------------------------------- maintenance

    def stats(self) -> DataFrame:
        return catalog.stats(self.table("indexed_files"), self.table("chunk_metadata"), self.table("vectors"),
                             self.table("project_branches"))

    def status(self) -> DataFrame:
        return catalog.status(self.table("indexed_files"), self.table("chunk_metadata"), self.table("project_branches"))

    def clean(self, missing_files: bool = False, older_than: str | None = None, now: str | None = None) -> tuple[Index, DataFrame]:
        """The cleaned index and a report; this object goes on reading the version before."""
        age = None if older_than is None else seconds(older_than)
        before = self._stay()
        gone = catalog.stale_chunks(before.table("chunk_metadata"), before.table("indexed_files"), missing_files, age, now)
        indexing.clean(self.spark, self.tables.latest(), gone)
        return Index(self.spark, self.tables.latest(), self.provider), catalog.clean_report(gone)

    def compact(self) -> Index:
        """The compacted index; this object goes on reading the version before."""
        self._stay()
        indexing.compact(self.spark, self.tables.latest())
        return Index(self.spark, self.tables.latest(), self.provider)

    def reclaim(self, keep: int = 1, grace_hours: float = 24.0) -> DataFrame:
        """Free what the newest `keep` versions do not need; bytes before and after, folders and versions that went.

        Objects that read an older version cannot go on; this one then reads the newest.
        """
        tables = self.tables.latest()
        before = tables.size(self.spark)
        folders, versions = tables.sweep(self.spark, keep, grace_hours)
        self.tables = tables
        return self.spark.createDataFrame([(before, tables.size(self.spark), folders, versions)], "size_before long, size_after long, folders long, versions long")

    def move(self, moves: DataFrame) -> None:
        """Apply pending file moves; those onto a path that stays taken are left out."""
        indexing.move(self.spark, self.tables.latest(), moves)

    def _stay(self) -> Index:
        self.tables = self.tables.pinned(self.spark)
        return self
