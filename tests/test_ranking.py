"""Boosts, limits, usages, isolation."""

import math

import pytest
from pyspark.sql import functions as F

from seamark.errors import InvalidRequest
from seamark.functions import ranking, vectors
from seamark.operators import search as S

COLUMNS = "chunk_id string, file_path string, name string, kind string, similarity double"


def scores(spark, query, rows):
    df = spark.createDataFrame([(str(i), *row) for i, row in enumerate(rows)], COLUMNS)
    return {r.file_path: r.similarity for r in S.rerank(df, query).collect()}


@pytest.mark.parametrize("query, row, expected", [
    ("parse_config", ("src/config.rs", "parse_config", None, 1.0), 1.15),
    ("ParseConfig", ("src/config.rs", "parse_config", None, 1.0), 1.15),
    ("anything", ("src/a.rs", None, "function", 1.0), 1.10),
    ("anything", ("src/b.rs", None, "comment", 1.0), 1.0),
    ("anything", ("src/tests/config_test.rs", None, None, 1.0), 0.80),
    ("parse_config", ("src/config.rs", "parse_config", "function", 1.0), 1.265),
    ("something_completely_unrelated", ("src/a.rs", None, None, 0.9), 0.9),
    ("anything", ("src/attestation/a.rs", None, None, 1.0), 1.0),
    ("anything", ("src/contest/a.rs", None, None, 1.0), 1.0),
    ("anything", ("src/latest_config.rs", None, None, 1.0), 1.0),
    ("anything", ("src/a.spec.ts", None, None, 1.0), 0.80),
    ("anything", ("src/a.rs", "_", None, 1.0), 1.0),
])
def test_boosts(spark, query, row, expected):
    assert scores(spark, query, [row])[row[0]] == pytest.approx(expected, abs=1e-9)


def test_top_truncates_and_orders(spark):
    rows = [(str(i), f"src/{i}.rs", None, None, (8 - i) / 10) for i in range(9)]
    best = S.top(spark.createDataFrame(rows, COLUMNS), 3).collect()
    assert [r.similarity for r in best] == [0.8, 0.7, 0.6]


def unit(seed, dimension=768):
    v = [math.sin((i + seed) / 1000) for i in range(dimension)]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


@pytest.fixture(scope="module")
def points(spark):
    rows = []
    for i in range(40):
        rows.append((f"c{i:02d}", f"t{i % 2}", f"repo-{i % 4}", "main" if i % 8 < 4 else "dev/ü", f"src/f{i}.rs", "fn test_fn() {}",
                     "test_fn", "function", 1, 10, "rust", None, None, None, None, None, unit(i * 50)))
    return spark.createDataFrame(rows, (
        "chunk_id string, tenant_id string, repository_id string, branch string, file_path string, content string, name string, "
        "kind string, start_line int, end_line int, language string, repository_url string, commit_sha string, commit_message string, "
        "commit_date timestamp_ntz, author string, embedding array<float>"))


@pytest.mark.parametrize("tenant, repository, branch, n", [
    ("t0", "repo-0", None, 10), ("t0", None, "main", 10), ("t0", "repo-0", "main", 5), ("t0", None, None, 20),
    ("t1", "repo-0", None, 0), ("none", None, None, 0), ("t0", "repo-0", "dev/ü", 5)])
def test_filters_apply_before_ranking(points, tenant, repository, branch, n):
    found = S.nearest(S.scoped(points, tenant, repository, branch), unit(0), 100).collect()
    assert len(found) == n
    assert all(r.tenant_id == tenant for r in found)


def test_nearest_is_exact_and_drops_vectors(points):
    found = S.nearest(points, unit(0), 5)
    assert "embedding" not in found.columns
    rows = found.collect()
    assert rows[0].chunk_id == "c00" and rows[0].similarity == pytest.approx(1.0, abs=1e-6)
    assert [r.chunk_id for r in rows] == [f"c{i:02d}" for i in range(5)]


def test_arrow_and_builtin_scores_agree(points):
    q = unit(333)
    both = points.select(vectors.cosine_to(F.col("embedding"), q).alias("a"),
                         vectors.cosine_expr(F.col("embedding"), F.array(*[F.lit(x) for x in q])).alias("b")).collect()
    assert all(r.a == pytest.approx(r.b, abs=1e-9) for r in both)


def test_points_without_vector_are_skipped_and_wrong_dimension_fails(spark, points):
    some = points.withColumn("embedding", F.when(F.col("chunk_id") != "c00", F.col("embedding")))
    assert S.nearest(some, unit(0), 1).first().chunk_id == "c01"
    with pytest.raises(Exception, match="dimension"):
        S.nearest(points, [1.0, 0.0], 1).collect()


def test_zero_vector_scores_zero(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0])], "chunk_id string, embedding array<float>")
    assert S.nearest(df, [1.0, 0.0], 1).first().similarity == 0.0


def test_with_content_reads_the_winners_only(points):
    best = S.search(points, "test_fn", unit(0), "t0", limit=3)
    assert "content" not in best.columns
    full = S.with_content(best, points).collect()
    assert sorted(r.content for r in full) == ["fn test_fn() {}"] * 3
    with pytest.raises(InvalidRequest):
        S.with_content(points.drop("content", "embedding"), points, most=10)


def test_usages_modes(spark):
    rows = [("1", "t", "a.rs", "fn Parse() {}", "Parse", "function", [1.0, 0.0]), ("2", "t", "b.rs", "parse(x)", "main", "function", [0.9, 0.1]),
            ("3", "t", "c.rs", "other", "other", "function", [0.8, 0.2]), ("4", "t", "d.rs", "PARSE it", None, None, [0.0, 1.0]),
            ("5", "t", "e.rs", "x", "parse", None, [0.1, 0.9])]
    df = spark.createDataFrame(rows, "chunk_id string, tenant_id string, file_path string, content string, name string, kind string, embedding array<float>")
    df = df.withColumn("repository_id", F.lit("r")).withColumn("branch", F.lit("main"))
    found = S.usages(df, " parse ", [1.0, 0.0], "t").collect()
    assert [(r.chunk_id, r.usage_type) for r in found] == [("1", "definition"), ("2", "reference"), ("4", "reference")]
    assert [r.chunk_id for r in S.usages(df, "parse", [1.0, 0.0], "t", usage_type="DEFINITIONS").collect()] == ["1"]
    assert [r.chunk_id for r in S.usages(df, "parse", None, "t", usage_type="references", mode="exact").collect()] == ["2", "4"]
    counts = S.usage_counts(S.usages(df, "parse", [1.0, 0.0], "t", limit=2)).first()
    assert (counts.total_usages, counts.definitions, counts.references) == (2, 1, 1)


@pytest.mark.parametrize("call", [
    lambda: S.checked_query("  "), lambda: S.checked_query("ü" * 501), lambda: S.checked_symbol(""), lambda: S.checked_symbol("x" * 501),
    lambda: S.checked_limit(-1, 10)])
def test_bad_requests(call):
    with pytest.raises(InvalidRequest):
        call()


def test_limits():
    assert S.checked_limit(None, 10) == 10 and S.checked_limit(100, 10) == 100 and S.checked_limit(0, 10) == 0
    with pytest.raises(InvalidRequest):     # refused, not cut
        S.checked_limit(101, 10)
    assert S.checked_query("日本語 🎉") == "日本語 🎉"


def test_definition_is_not_also_a_reference(spark):
    df = spark.createDataFrame([("Foo", "class", "class Foo"), ("foo", None, "foo"), (None, "class", "no")], "name string, kind string, content string")
    flags = df.select(ranking.is_definition(F.col("name"), F.col("kind"), "foo").alias("d"),
                      ranking.is_reference(F.col("name"), F.col("kind"), F.col("content"), "foo").alias("r")).collect()
    assert [(r.d, r.r) for r in flags] == [(True, False), (False, True), (False, False)]


def test_stale_generations_vanish(spark):
    cols = "tenant_id string, repository_id string, branch string, file_path string, generation long, chunk_id string"
    pts = spark.createDataFrame([("t", "r", "b", "f", 1, "old"), ("t", "r", "b", "f", 2, "new"), ("t", "r", "b", "g", 1, "kept")], cols)
    files = spark.createDataFrame([("t", "r", "b", "f", 2), ("t", "r", "b", "g", 1)], cols.rsplit(",", 1)[0])
    assert sorted(r.chunk_id for r in S.current_points(pts, files).collect()) == ["kept", "new"]


@pytest.mark.parametrize("content, symbol, expected", [
    ("call PARSE(x)", "parse", True), ("É", "é", False), ("é", "é", True), ("a.b", "A.B", True), ("axb", "a.b", False), ("\u212a", "k", False),
    ("line\nFoo_Bar", "foo_bar", True), ("\\E+", "\\e+", True)])
def test_reference_folds_ascii_only(spark, content, symbol, expected):
    df = spark.createDataFrame([(content,)], "content string")
    found = df.select(ranking.is_reference(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("content"), symbol).alias("r"))
    assert found.first().r is expected
