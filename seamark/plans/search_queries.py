"""Search, similar code, usages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text, vectors
from ..operators import search as S
from . import corpus as c
from .registry import query

WORD = "the"
TENANT = "t0"

_NAME_NORM = "translate(lower(name), '_-', '')"
BOOST_SQL = f"""(CASE WHEN {_NAME_NORM} <> '' AND (contains('{WORD}', {_NAME_NORM}) OR contains({_NAME_NORM}, '{WORD}')) THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END)
  * (CASE WHEN kind IN ('function','method','class','struct','enum','trait','impl','interface') THEN 1.10::DOUBLE ELSE 1.0::DOUBLE END)
  * (CASE WHEN regexp_matches(file_path, '(^|/)(tests?|specs?|mocks?|generated|fixtures)(/|$)')
       OR regexp_matches(file_path, '(_test\\.|_spec\\.|\\.test\\.|\\.spec\\.)[^/]*$') THEN 0.80::DOUBLE ELSE 1.0::DOUBLE END)"""

_SIM = c.similarity_sql()


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumn("similarity", F.round("similarity", 6)).select(*columns)


@query("knn_topk", c.with_sql(c.POINTS, select=f"""
SELECT vec_id, chunk_id, file_path, round(sim, 6) AS similarity
FROM (SELECT *, {_SIM} AS sim FROM points) ORDER BY sim DESC, chunk_id LIMIT 30"""))
def knn_topk(spark, folder):
    found = S.nearest(c.points(spark, folder), c.query_vector(spark, folder), 30)
    return _rounded(found, "vec_id", "chunk_id", "file_path", "similarity")


@query("knn_filtered_tenant_repo_branch", c.with_sql(c.POINTS, select=f"""
SELECT vec_id, chunk_id, file_path, round(sim, 6) AS similarity
FROM (SELECT *, {_SIM} AS sim FROM points WHERE tenant_id = 't1' AND repository_id = 'repo-3' AND branch = 'main')
ORDER BY sim DESC, chunk_id LIMIT 10"""))
def knn_filtered(spark, folder):
    inside = S.scoped(c.points(spark, folder), "t1", "repo-3", "main")
    return _rounded(S.nearest(inside, c.query_vector(spark, folder), 10), "vec_id", "chunk_id", "file_path", "similarity")


@query("knn_filtered_repository_only", c.with_sql(c.POINTS, select=f"""
SELECT vec_id, branch, round(sim, 6) AS similarity
FROM (SELECT *, {_SIM} AS sim FROM points WHERE tenant_id = 't2' AND repository_id = 'repo-1') ORDER BY sim DESC, chunk_id LIMIT 20"""))
def knn_repository(spark, folder):
    inside = S.scoped(c.points(spark, folder), "t2", "repo-1")
    return _rounded(S.nearest(inside, c.query_vector(spark, folder), 20), "vec_id", "branch", "similarity")


@query("cosine_scores", f"SELECT vec_id, round({_SIM}, 6) AS similarity FROM embeddings")
def cosine_scores(spark, folder):
    """Scores of all points by the Arrow path."""
    scored = c.table(spark, folder, "embeddings")
    return scored.select("vec_id", F.round(vectors.cosine_to(F.col("embedding"), c.query_vector(spark, folder)), 6).alias("similarity"))


@query("cosine_scores_builtin", f"SELECT vec_id, round({_SIM}, 6) AS similarity FROM embeddings")
def cosine_scores_builtin(spark, folder):
    """The same by built-in expressions."""
    wanted = F.array(*[F.lit(x) for x in c.query_vector(spark, folder)])
    return c.table(spark, folder, "embeddings").select(
        "vec_id", F.round(vectors.cosine_expr(F.col("embedding"), wanted), 6).alias("similarity"))


@query("vector_normalize", """
SELECT vec_id, i AS dim, round(scaled[i], 6) AS value FROM (
  SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i,
    list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS scaled
  FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 3)) AS embedding FROM embeddings))""")
def vector_normalize(spark, folder):
    longer = c.table(spark, folder, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)).alias("v"))
    unit = longer.select("vec_id", vectors.l2_normalize(F.col("v")).alias("v"))
    return unit.select("vec_id", F.posexplode_outer("v").alias("p", "x")).select(
        "vec_id", (F.col("p") + 1).cast("long").alias("dim"), F.round("x", 6).alias("value"))


@query("masked_mean_pooling", """
SELECT g AS vec_group, d AS dim, round(sum(m * x) / greatest(sum(m)::DOUBLE, 1e-9), 6) AS value FROM (
  SELECT vec_id // 8 AS g, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS m, unnest(range(1, len(embedding) + 1)) AS d, unnest(embedding::DOUBLE[]) AS x
  FROM embeddings) GROUP BY g, d""")
def masked_mean_pooling(spark, folder):
    """Eight neighbouring vectors as the token states of one text, every third masked out, pooled over all dimensions."""
    v = c.table(spark, folder, "embeddings").select(
        F.expr("vec_id div 8").alias("vec_group"), F.struct("vec_id", F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1).alias("m"), "embedding").alias("state"))
    texts = v.groupBy("vec_group").agg(F.sort_array(F.collect_list("state")).alias("states"))    # eight of them
    pooled = texts.select("vec_group", vectors.masked_mean(F.col("states.embedding"), F.col("states.m")).alias("v"))
    return pooled.select("vec_group", F.posexplode("v").alias("p", "x")).select("vec_group", (F.col("p") + 1).cast("long").alias("dim"), F.round("x", 6).alias("value"))


@query("rerank_scores", c.with_sql(c.POINTS, select=f"""
SELECT vec_id, name, kind, file_path, round({_SIM} * ({BOOST_SQL}), 6) AS similarity FROM points"""))
def rerank_scores(spark, folder):
    scored = c.points(spark, folder).withColumn(
        "similarity", vectors.cosine_to(F.col("embedding"), c.query_vector(spark, folder)))
    return _rounded(S.rerank(scored, WORD), "vec_id", "name", "kind", "file_path", "similarity")


def _ranked_sql(tenant: str, fetch: int, keep: int) -> str:
    return f"""near AS (SELECT *, {_SIM} AS sim FROM points WHERE tenant_id = '{tenant}' ORDER BY sim DESC, chunk_id LIMIT {fetch}),
ranked AS (SELECT *, sim * ({BOOST_SQL}) AS similarity FROM near ORDER BY similarity DESC, chunk_id LIMIT {keep})"""


_BEFORE = "CASE WHEN least(start_line - 1, len(ls)) >= greatest(start_line - 3, 1) THEN array_to_string(ls[greatest(start_line - 3, 1):start_line - 1], chr(10)) END"
_AFTER = "CASE WHEN len(ls) > end_line THEN array_to_string(ls[end_line + 1:end_line + 3], chr(10)) END"


@query("search_flagship", c.with_sql(c.POINTS, c.SOURCES, _ranked_sql(TENANT, 30, 10), select=f"""
SELECT regexp_extract(file_path, '[^/]*$') AS file, file_path AS path, regexp_extract(repository_url, '[^/]*$') AS repository,
  content, language, kind AS type, name, start_line AS line_start, end_line AS line_end, round(similarity, 6) AS similarity,
  before, after,
  (strlen(lower(content)) - strlen(replace(lower(content), '{WORD}', ''))) // {len(WORD)} AS n_highlights,
  concat_ws(' ', name, CASE WHEN kind IS NOT NULL THEN kind || ':' || coalesce(name, 'anonymous') END) AS symbols,
  commit_sha, CASE WHEN commit_sha IS NOT NULL THEN strftime(commit_date, '%Y-%m-%d %H:%M:%S UTC') END AS commit_date
FROM (SELECT r.*, {c.POINT_CONTENT_SQL} AS content, {_BEFORE} AS before, {_AFTER} AS after
      FROM ranked r LEFT JOIN source_lines USING (vec_id))"""))
def search_flagship(spark, folder):
    """Filter, top 30 by cosine, re-rank, top 10, then the text of just those ten."""
    best = S.search(c.points(spark, folder), WORD, c.query_vector(spark, folder), TENANT)
    matches = S.as_matches(c.with_point_content(best, c.point_sources(spark, folder), context=True, most=10), WORD)
    return matches.select(
        "file", "path", "repository", "content", "language", "type", "name", F.col("lines.start").alias("line_start"),
        F.col("lines.end").alias("line_end"), F.round("similarity", 6).alias("similarity"),
        F.col("context.before").alias("before"), F.col("context.after").alias("after"),
        F.size("highlights").cast("long").alias("n_highlights"), F.array_join("symbols", " ").alias("symbols"),
        F.col("commit.sha").alias("commit_sha"), F.col("commit.date").alias("commit_date"))


@query("find_similar_exclude_file", c.with_sql(c.POINTS, select=f"""
SELECT file_path AS file, start_line AS line_start, end_line AS line_end, round(sim, 6) AS similarity, chunk_id
FROM (SELECT *, {c.similarity_sql(vec_id=3)} AS sim FROM points WHERE tenant_id = 't0' AND file_path <> {c.path_sql('3', 'vec')})
ORDER BY sim DESC, chunk_id LIMIT 10"""))
def find_similar(spark, folder):
    """Nearest chunks to chunk 3, not from its own file."""
    found = S.similar(c.points(spark, folder), c.query_vector(spark, folder, 3), "t0", exclude_file="src/fixtures/vec_3.go")
    return _rounded(found.select(F.col("file_path").alias("file"), F.col("start_line").alias("line_start"),
                                 F.col("end_line").alias("line_end"), "similarity", "chunk_id"),
                    "file", "line_start", "line_end", "similarity", "chunk_id")


_DEF = f"(coalesce(lower(name) = '{WORD}', false) AND kind IS NOT NULL)"
_REF = f"(NOT {_DEF} AND contains(lower(content), '{WORD}'))"


def _usages_sql(keep: str, limit: int, pool: str) -> str:
    return f"""labelled AS (
  SELECT *, CASE WHEN {_DEF} THEN 'definition' ELSE 'reference' END AS usage_type
  FROM (SELECT r.*, {c.POINT_CONTENT_SQL} AS content FROM {pool} r LEFT JOIN source_lines USING (vec_id)) WHERE {keep}),
found AS (SELECT * FROM labelled ORDER BY usage_type = 'reference', similarity DESC, chunk_id LIMIT {limit})"""


_USAGE_COLUMNS = f"""SELECT regexp_extract(file_path, '[^/]*$') AS file, file_path AS path, start_line AS line, content, usage_type, language,
  CASE WHEN usage_type = 'definition' THEN kind END AS kind, round(similarity, 6) AS similarity,
  regexp_extract(repository_url, '[^/]*$') AS repository, commit_sha FROM found"""


_WHOLE_SCOPE = f"scored AS (SELECT *, {_SIM} * ({BOOST_SQL}) AS similarity FROM points WHERE tenant_id = '{TENANT}')"


def _usages(spark, folder, usage_type, limit=20):
    """Every chunk of the tenant is read, so no usage is missed."""
    p = c.with_point_content(S.scoped(c.points(spark, folder), TENANT), c.point_sources(spark, folder))
    return S.usages(p, WORD, c.query_vector(spark, folder), TENANT, usage_type=usage_type, limit=limit)


def _usage_rows(found: DataFrame) -> DataFrame:
    rows = S.as_usages(found)
    return rows.withColumn("similarity", F.round("similarity", 6)).withColumn("commit_sha", F.col("commit.sha")).drop("commit")


_KEEP = {"all": f"({_DEF} OR {_REF})", "definitions": _DEF, "references": _REF}
_NO_COMMIT = _USAGE_COLUMNS


def _register_usages(kind: str) -> None:
    sql = c.with_sql(c.POINTS, c.SOURCES, _WHOLE_SCOPE, _usages_sql(_KEEP[kind], 20, "scored"), select=_USAGE_COLUMNS)

    @query(f"usages_{kind}", sql)
    def run(spark, folder):
        return _usage_rows(_usages(spark, folder, kind))


for _kind in _KEEP:
    _register_usages(_kind)


@query("usages_counts", c.with_sql(c.POINTS, c.SOURCES, _WHOLE_SCOPE, _usages_sql(_KEEP["all"], 20, "scored"), select="""
SELECT count(*) AS total_usages, count(*) FILTER (WHERE usage_type = 'definition') AS definitions,
  count(*) FILTER (WHERE usage_type = 'reference') AS "references" FROM found"""))
def usages_counts(spark, folder):
    return S.usage_counts(_usages(spark, folder, "all"))


@query("usages_exact", c.with_sql(
    c.POINTS, c.SOURCES,
    f"scored AS (SELECT *, {_SIM} * ({BOOST_SQL}) AS similarity FROM points WHERE tenant_id = 't1')",
    _usages_sql(_KEEP["all"], 50, "scored"), select=_USAGE_COLUMNS))
def usages_exact(spark, folder):
    """Every chunk of the tenant is read, so no usage is missed."""
    p = c.with_point_content(S.scoped(c.points(spark, folder), "t1"), c.point_sources(spark, folder))
    return _usage_rows(S.usages(p, WORD, c.query_vector(spark, folder), "t1", mode="exact"))


@query("current_generation_points", c.with_sql(c.POINTS, select="""
SELECT tenant_id, repository_id, count(*) AS points FROM points WHERE vec_id % 7 <> 0 GROUP BY tenant_id, repository_id"""))
def current_generation(spark, folder):
    """Points whose file has moved on to generation 2 are not found."""
    p = c.points(spark, folder)
    moved = F.when(F.col("vec_id") % 7 == 0, 2).otherwise(1).cast("long")
    files = p.select("tenant_id", "repository_id", "branch", "file_path", moved.alias("generation"))
    return S.current_points(p, files).groupBy("tenant_id", "repository_id").agg(F.count("*").alias("points"))
