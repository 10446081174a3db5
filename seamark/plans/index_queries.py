"""Embedding and the whole way from files to a ranked answer; incremental and streaming indexing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import embedding, ids, vectors
from ..functions.columns import struct
from ..operators import chunking, indexing, parsing
from ..operators import search as S
from ..schemas import BRANCH_KEY, FILE_KEY
from ..session import shared_dir
from ..sources.tables import IndexTables
from ..streaming.index_stream import start_indexing
from ..streaming.queue_stream import current_states, start_queue
from . import corpus as c
from .chunk_queries import _BLOCKS, _GROUPED, _LS, _big_sql, _container_sql, _pack_sql, _split_sql
from .registry import query
from .text_queries import count_sql

D = 64
ASKED = "the and of"
LARGE = 4096


def features_sql(source: str, key: str, content: str) -> str:
    """Signed bucket sums per row of `source`, one row per touched bucket."""
    return f"""words AS (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower({content}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS word FROM {source}),
hashed AS (SELECT {key}, (('0x' || substr(md5(word), 1, 8))::UBIGINT % {2 * D})::BIGINT AS h FROM words),
buckets AS (SELECT {key}, h // 2 AS dim, sum(1 - 2 * (h % 2))::DOUBLE AS x FROM hashed GROUP BY {key}, h // 2),
norms AS (SELECT {key}, sqrt(sum(x * x)) AS norm FROM buckets GROUP BY {key})"""


@query("embed_hashed", c.with_sql(features_sql("documents", "doc_id", "text"), select="""
SELECT doc_id, dim, round((x / norm)::FLOAT::DOUBLE, 5) AS value FROM buckets JOIN norms USING (doc_id) WHERE x <> 0"""))
def embed_hashed(spark, folder):
    v = c.table(spark, folder, "documents").select("doc_id", embedding.HashedEmbedding(D).embed(F.col("text")).alias("v"))
    return v.select("doc_id", F.posexplode_outer("v").alias("p", "x")).filter(F.col("x") != 0).select(
        "doc_id", F.col("p").cast("long").alias("dim"), F.round(F.col("x").cast("double"), 5).alias("value"))


@query("embed_normalized", c.with_sql(features_sql("documents", "doc_id", "text"), select="""
SELECT d.doc_id, CASE WHEN coalesce(n.norm, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents d LEFT JOIN norms n USING (doc_id)"""))
def embed_normalized(spark, folder):
    v = embedding.HashedEmbedding(D).embed(F.col("text"))
    return c.table(spark, folder, "documents").select("doc_id", F.round(vectors.norm_expr(v), 4).alias("norm"))


@query("search_text_end_to_end", c.with_sql(
    c.FILES, c.CHUNKS, "asked AS (SELECT 0 AS q, '" + ASKED + "' AS content)",
    features_sql("(SELECT doc_id::VARCHAR || '/' || chunk_index AS k, content FROM chunks UNION ALL SELECT 'q', content FROM asked)", "k", "content"),
    select="""
SELECT c.doc_id, c.chunk_index, c.chunk_id, round(sim, 5) AS similarity FROM chunks c JOIN (
  SELECT b.k, sum(b.x * a.x) / (any_value(n.norm) * (SELECT norm FROM norms WHERE k = 'q')) AS sim
  FROM buckets b JOIN (SELECT dim, x FROM buckets WHERE k = 'q') a USING (dim) JOIN norms n ON n.k = b.k WHERE b.k <> 'q' AND n.norm > 0 GROUP BY b.k) s
ON s.k = c.doc_id::VARCHAR || '/' || c.chunk_index WHERE c.tenant_id = 't0' ORDER BY sim DESC, chunk_id LIMIT 10"""))
def search_text_end_to_end(spark, folder):
    """Chunk, embed and search in one job; the filter reaches the scan before anything is embedded."""
    provider = embedding.HashedEmbedding(D)
    chunks = S.scoped(c.chunks(spark, folder), "t0")
    points = chunks.withColumn("embedding", provider.embed(F.col("content"))).select("doc_id", "chunk_index", "chunk_id", "embedding")
    found = S.nearest(points, embedding.embed_text(spark, provider, ASKED), 10)
    return found.withColumn("similarity", F.round("similarity", 5))


@query("index_chunk_ids", c.with_sql(c.FILES, c.CODE, _BLOCKS, select=f"""
SELECT doc_id, kind, name, start_line, end_line, {c.UUID5_SQL.format(h='h')} AS chunk_id FROM (
  SELECT s.*, {c.sha1_sql("repository_id || ':' || branch || ':' || file_path || ':1:' || byte_start || ':' || byte_end")} AS h FROM code_spans s JOIN files f USING (doc_id))"""))
def index_chunk_ids(spark, folder):
    """Spans of the source files with their ids."""
    spans = chunking.rows_of(parsing.parse_spans(c.code_files(spark, folder)), "spans", "i", "doc_id", *FILE_KEY, "generation")
    rows = spans.withColumn("chunk_id", ids.chunk_id(*FILE_KEY[1:], "generation", "byte_start", "byte_end"))
    return rows.select("doc_id", "kind", "name", F.col("start_line").cast("long").alias("start_line"),
                       F.col("end_line").cast("long").alias("end_line"), "chunk_id")


MOST = 512
_CONTAINERS = ", ".join(f"'{k}'" for k in chunking.CONTAINER_KINDS)

# Spans in the order of their file, each whole or cut: behind a header, in windows of pieces, or in two halves.
def _split_spans_sql(most: int) -> str:
    return f"""numbered AS MATERIALIZED (
  SELECT *, doc_id * 100000 + i AS unit, {count_sql('content')} AS t FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY byte_start, byte_end) AS i FROM code_spans)),
code_units AS (SELECT unit AS doc_id, {_LS} AS ls FROM (SELECT unit, string_split(content, chr(10)) AS l FROM numbered WHERE t > {most} AND kind IN ({_CONTAINERS}))),
{_container_sql(most)},
loose AS MATERIALIZED (
  SELECT *, {_LS} AS ls, regexp_extract_all(content, '(\\S+\\s*|\\s+)', 1) AS pieces FROM (
    SELECT *, string_split(content, chr(10)) AS l FROM numbered WHERE t > {most} AND coalesce(kind NOT IN ({_CONTAINERS}), true))),
cuts AS (
  SELECT unit, 0 AS part, kind AS k, start_line AS a, end_line AS b, byte_start AS p, byte_end AS q, t FROM numbered WHERE t <= {most}
  UNION ALL
  SELECT n.unit, r.f, n.kind || '_part', n.start_line + r.f - 1, n.start_line + r.t - 1, n.byte_start + strlen(array_to_string(ls[1:r.f - 1], chr(10))) + 1,
    n.byte_start + strlen(array_to_string(ls[1:r.t], chr(10))), {count_sql("(head || chr(10) || array_to_string(ls[r.f:r.t], chr(10)))")}
  FROM runs JOIN numbered n ON n.unit = runs.doc_id
  UNION ALL
  SELECT unit, k, kind || '_part' || (k + 1), start_line + (k * {most} * len(ls)) // len(pieces),
    start_line + (k * {most} * len(ls)) // len(pieces) + len(string_split(body, chr(10))) - CASE WHEN body LIKE '%' || chr(10) THEN 1 ELSE 0 END,
    byte_start + strlen(array_to_string(pieces[1:k * {most}], '')), byte_start + strlen(array_to_string(pieces[1:k * {most} + {most}], '')), len(pieces[k * {most} + 1:k * {most} + {most}])
  FROM (SELECT *, array_to_string(pieces[k * {most} + 1:k * {most} + {most}], '') AS body FROM (
    SELECT *, unnest(range(0, ceil(len(pieces) / {most}::DOUBLE)::BIGINT)) AS k FROM loose WHERE len(pieces) > {most}))
  UNION ALL
  SELECT unit, 1, kind || '_part1', start_line, start_line + u, byte_start, byte_start + strlen(array_to_string(ls[1:u], chr(10))), {count_sql("array_to_string(ls[1:u], chr(10))")}
  FROM (SELECT *, len(ls) // 2 + least(10, len(ls) // 10) AS u FROM loose WHERE len(pieces) <= {most})
  UNION ALL
  SELECT unit, 2, kind || '_part2', start_line + m, start_line + len(ls) - 1, byte_start + strlen(array_to_string(ls[1:m], chr(10))) + CASE WHEN m > 0 THEN 1 ELSE 0 END, byte_end,
    {count_sql("array_to_string(ls[m + 1:len(ls)], chr(10))")}
  FROM (SELECT *, len(ls) // 2 AS m FROM loose WHERE len(pieces) <= {most})),
index_cuts AS (
  SELECT n.doc_id, (row_number() OVER (PARTITION BY n.doc_id ORDER BY n.i, part) - 1)::INTEGER AS chunk_index, k AS kind, name, a::INTEGER AS start_line, b::INTEGER AS end_line, p, q, c.t::INTEGER AS token_count
  FROM cuts c JOIN numbered n USING (unit))"""


def _with_ids_sql(source: str) -> str:
    return f"""SELECT doc_id, chunk_index, {c.UUID5_SQL.format(h='h')} AS chunk_id, kind, name, start_line, end_line, token_count FROM (
  SELECT s.*, {c.sha1_sql("repository_id || ':' || branch || ':' || file_path || ':1:' || p || ':' || q")} AS h FROM {source} s JOIN files f USING (doc_id))"""


@query("index_chunks", c.with_sql(c.FILES, c.CODE, _BLOCKS, _split_spans_sql(MOST), select=_with_ids_sql("index_cuts")))
def index_chunks(spark, folder):
    """Source files to chunks as an index batch makes them, those above 512 tokens in parts."""
    rows = indexing.chunked_files(c.code_files(spark, folder))
    return rows.select("doc_id", "chunk_index", "chunk_id", "kind", "name", "start_line", "end_line", "token_count")


_BOUNDARIES = ", ".join(f"'{k}'" for k in chunking.BOUNDARY_KINDS)
_BUDGET = chunking.TokenBudget(MOST, 64)
_ORDERED = f"""spans AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY byte_start, byte_end) AS i, {count_sql('content')} AS t FROM code_spans)"""
_PACKED = """index_packed AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY unit, i) - 1)::INTEGER AS chunk_index, kind, name, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, p, q, token_count FROM (
    SELECT doc_id, first_i AS unit, 0 AS i, kind, name, start_line, end_line, byte_start AS p, byte_end AS q, token_count FROM grouped WHERE NOT big AND content <> ''
    UNION ALL SELECT doc_id, unit, i, kind, name, start_line, end_line, byte_start, byte_end, token_count FROM parts))"""


@query("index_packed_chunks", c.with_sql(
    c.FILES, c.CODE, _BLOCKS, _ORDERED, _pack_sql(_BUDGET.hard, _BUDGET.soft, _BOUNDARIES), _GROUPED, _big_sql(_BUDGET.hard), _split_sql("big_spans", _BUDGET.soft, _BUDGET.overlap), _PACKED,
    select=_with_ids_sql("index_packed")))
def index_packed_chunks(spark, folder):
    """Source files packed to the default token budget."""
    rows = indexing.packed_files(c.code_files(spark, folder), _BUDGET)
    return rows.select("doc_id", "chunk_index", "chunk_id", "kind", "name", "start_line", "end_line", "token_count")


_PUSH = "tenant_id, repository_id, branch, file_path"


def _pushes(files):
    return files.select("tenant_id", "repository_id", "branch", "file_path", "file_content", "content_hash", "size_bytes",
                        "repository_url", "commit_sha", "commit_message", "commit_date", "author")


def _fresh_tables(spark) -> IndexTables:
    return IndexTables(f"{shared_dir(spark)}/index-{uuid.uuid4().hex}").create(spark)


# The source files once more, every tenth with a line at its end.
_CHANGED = c.CODE.replace("code_lines AS (", "code_once AS (") + """,
code_lines AS (
  SELECT * FROM code_once UNION ALL SELECT doc_id, any_value(language), max(k) + 1, '// changed' FROM code_once WHERE doc_id % 10 = 0 GROUP BY doc_id)"""
def _indexed_sql(generation: str) -> str:
    """Chunks of `index_cuts` with keys and ids, and their texts."""
    return f"""index_named AS MATERIALIZED (
  SELECT tenant_id, repository_id, branch, file_path, chunk_index, x.doc_id, kind, name, start_line, end_line, token_count, generation, {c.UUID5_SQL.format(h='h')} AS chunk_id FROM (
    SELECT *, {c.sha1_sql("repository_id || ':' || branch || ':' || file_path || ':' || generation || ':' || p || ':' || q")} AS h FROM (
      SELECT s.*, tenant_id, repository_id, branch, file_path, {generation} AS generation FROM index_cuts s JOIN files f USING (doc_id))) x),
index_texts AS (
  SELECT n.doc_id::VARCHAR || '/' || (row_number() OVER (PARTITION BY n.doc_id ORDER BY n.i, part) - 1) AS key, decode(encode(code)[p + 1:q]) AS content
  FROM cuts JOIN numbered n USING (unit) JOIN code_text t ON t.doc_id = n.doc_id)"""


@query("index_incremental", c.with_sql(c.FILES, _CHANGED, _BLOCKS, _split_spans_sql(LARGE), _indexed_sql("CASE WHEN s.doc_id % 10 = 0 THEN 2 ELSE 1 END"), features_sql("index_texts", "key", "content"), select="""
SELECT tenant_id, repository_id, branch, file_path, n.chunk_index, chunk_id, generation::BIGINT AS generation, kind, name, start_line, end_line, token_count, coalesce(components, 0)::BIGINT AS components
FROM index_named n LEFT JOIN (SELECT key, count(*) FILTER (x <> 0) AS components FROM buckets GROUP BY key) b ON b.key = n.doc_id::VARCHAR || '/' || n.chunk_index"""))
def index_incremental(spark, folder):
    """Index all source files, then again with every tenth changed: the points that are left, those of the changed files in generation 2."""
    tables = _fresh_tables(spark)
    provider, at = embedding.HashedEmbedding(D), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    code = c.code_files(spark, folder)
    indexing.index_batch(spark, tables, _pushes(code), provider, "one", at, LARGE)
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat("file_content", F.lit("\n// changed"))).otherwise(F.col("file_content"))
    again = code.withColumn("file_content", changed).withColumn("content_hash", F.sha2("file_content", 256))
    indexing.index_batch(spark, tables, _pushes(again), provider, "two", at, LARGE)
    return tables.read(spark, "vectors").select(
        "tenant_id", "repository_id", "branch", "file_path", "chunk_index", "chunk_id", "generation", "kind", "name", "start_line", "end_line", "token_count",
        F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("components"))


@query("index_vanished", c.with_sql(c.FILES, c.CODE, _BLOCKS, _split_spans_sql(LARGE), select="""
SELECT tenant_id, repository_id, branch, file_path, 1::BIGINT AS generation, count(index_cuts.doc_id)::BIGINT AS chunks, count(index_cuts.doc_id)::BIGINT AS points
FROM files LEFT JOIN index_cuts USING (doc_id) WHERE branch = 'release' OR doc_id % 3 <> 0 GROUP BY tenant_id, repository_id, branch, file_path"""))
def index_vanished(spark, folder):
    """Index all source files, then say that every third of all branches but one is gone: files with their chunks and points after that."""
    tables = _fresh_tables(spark)
    provider, at = embedding.HashedEmbedding(D), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    code = c.code_files(spark, folder)
    indexing.index_batch(spark, tables, _pushes(code), provider, "one", at, LARGE)
    left = code.filter(F.col("doc_id") % 3 != 0)
    complete = {tuple(r) for r in code.select(*BRANCH_KEY).distinct().collect() if r["branch"] != "release"}
    indexing.index_batch(spark, tables, _pushes(left), provider, "two", at, LARGE, complete=complete)
    counted = lambda name, into: tables.read(spark, name).groupBy(*FILE_KEY).agg(F.count("*").alias(into))
    files = tables.read(spark, "indexed_files").select(*FILE_KEY, "generation")
    return files.join(counted("chunk_metadata", "chunks"), FILE_KEY, "left").join(counted("vectors", "points"), FILE_KEY, "left").fillna(0, ["chunks", "points"])


_TOLD = "chunk_index, chunk_id, generation::BIGINT AS generation, kind, name, start_line, end_line, token_count, coalesce(components, 0)::BIGINT AS components"


@query("stream_index", c.with_sql(c.FILES, c.CODE, _BLOCKS, _split_spans_sql(LARGE), _indexed_sql("1"), features_sql("index_texts", "key", "content"), select=f"""
SELECT 'stream' AS tenant_id, repository_id, branch, file_path, {_TOLD}
FROM index_named n LEFT JOIN (SELECT key, count(*) FILTER (x <> 0) AS components FROM buckets GROUP BY key) b ON b.key = n.doc_id::VARCHAR || '/' || n.chunk_index
WHERE doc_id IN (SELECT doc_id FROM files WHERE NOT contains(file_content, chr(0)))"""))
def stream_index(spark, folder):
    """The documents, as source code, read as a stream of pushes and indexed micro-batch by micro-batch: all points."""
    tables = _fresh_tables(spark)
    docs = c.table_stream(spark, folder, "documents", maxFilesPerTrigger=1000)
    pushes = c.code_of(c.files_of(docs)).select(
        F.concat("repository_id", F.lit(":"), "branch").alias("project_id"), F.col("file_path").alias("path"), F.col("file_content").alias("content"))
    running = start_indexing(pushes, tables, embedding.HashedEmbedding(D), f"{tables.root}/checkpoint", "stream",
                             F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), LARGE)
    running.awaitTermination()
    return tables.read(spark, "vectors").select(
        "tenant_id", "repository_id", "branch", "file_path", "chunk_index", "chunk_id", "generation", "kind", "name", "start_line", "end_line", "token_count",
        F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("components"))


@query("stream_queue_state")
def stream_queue_state(spark, folder):
    """The events table as a stream of queue operations, five per item; final state of every item."""
    events = c.table_stream(spark, folder, "events", maxFilesPerTrigger=1000)
    k = F.col("event_id") % 5
    op = F.when(k == 0, "enqueue").when(k.isin(1, 3), "claim").when(F.col("event_type") == "error", "fail") \
        .when(F.col("event_type") == "view", "recover").otherwise("ack")
    operations = events.select(
        F.concat(F.lit("item-"), F.expr("event_id div 5").cast("string")).alias("id"), op.alias("op"),
        F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("w"), (F.col("user_id") % 8).cast("string")).alias("worker"),
        F.col("event_type").alias("error"))
    root = f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}"
    start_queue(operations, f"{root}/states", f"{root}/checkpoint").awaitTermination()
    return current_states(spark, f"{root}/states").select("id", "status", "retry_count", "claimed_by", "last_error")
