"""Incremental indexing as a stream: every micro-batch is one index batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.embedding import EmbeddingProvider
from ..operators.changes import pushed_files
from ..operators.indexing import index_batch
from ..operators.parsing import MAX_TOKENS
from ..sources.files import tree_push
from ..sources.tables import IndexTables


def start_indexing(pushes: DataFrame, tables: IndexTables, provider: EmbeddingProvider, checkpoint: str,
                   tenant_id: str, indexed_at: Column | None = None, max_tokens: int = MAX_TOKENS,
                   on_report: Callable[[int, DataFrame], None] | None = None, **trigger) -> StreamingQuery:
    """Index a stream of (project_id, path, content) rows.

    Jobs are named by the query and the batch, so a batch repeated after a failure is the same
    job, and two streams on one index have jobs of their own.  The version that holds a batch names it too: one
    that is done again after its commit is recognised and changes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        report = index_batch(batch.sparkSession, tables, pushed_files(batch, tenant_id), provider,
                             f"stream-{query}-{batch_id}", F.localtimestamp() if indexed_at is None else indexed_at, max_tokens, (query, batch_id))
        if on_report is not None:
            on_report(batch_id, report)

    return pushes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def start_watching(spark: SparkSession, root: str, tables: IndexTables, provider: EmbeddingProvider, checkpoint: str, tenant_id: str, repository_id: str,
                   branch: str, indexed_at: Column | None = None, max_tokens: int = MAX_TOKENS, on_report: Callable[[int, DataFrame], None] | None = None,
                   **trigger) -> StreamingQuery:
    """Keep the index of a branch equal to the text files below `root`, at every trigger (a minute, if none is given).

    Each micro-batch lists the tree anew: added and changed files are indexed, vanished ones leave the index, all in one
    version; one that is done again after its commit changes nothing.  Files are told apart by content, so an
    unchanged tree costs its reading and writes no file, chunk or vector.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        query = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        report = index_batch(session, tables, tree_push(session, root, tenant_id, repository_id, branch), provider, f"watch-{query}-{batch_id}",
                             F.localtimestamp() if indexed_at is None else indexed_at, max_tokens, (query, batch_id), {(tenant_id, repository_id, branch)})
        if on_report is not None:
            on_report(batch_id, report)

    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()
