"""Trained operators: held-out accuracy on the given tables, and defined results at the edges."""

import numpy as np
from pyspark.sql import functions as F

from seamark.llm import quality, toxicity, urls
from seamark.llm.common import held_out, read

FOLDER = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    docs, labels = read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels")
    model = toxicity.train(docs, labels)
    out = toxicity.toxicity(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    assert len(out) > 500 and (out.predicted[out.toxic == 0] == 0).mean() > 0.99
    assert out.score[out.toxic == 1].median() > 0.9 > 0.1 > out.score[out.toxic == 0].median()
    assert (out.predicted[out.toxic == 1] == 1).mean() > 0.7
    assert 0 < len(model.features) < toxicity.SIZE / 20


def test_toxicity_edges(spark):
    model = toxicity.fit_ftrl([], np.zeros(0))
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "word " * 100_000, "c")], "doc_id long, text string, score string")
    out = toxicity.toxicity(docs, model).collect()
    assert len(out) == 3 and all(r.predicted == 0 and 0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


def test_ftrl_is_sparse_and_right():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 400).astype(float)
    rows = [np.unique(np.concatenate([rng.integers(100, 5000, 30), [7] if y else [8]])) for y in labels]
    model = toxicity.fit_ftrl(rows, labels)
    weight = dict(zip(model.features.tolist(), model.weights))
    assert weight[7] > 0 > weight[8] and len(model.features) < 200


def test_quality_held_out(spark):
    docs, labels = read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels")
    model = quality.train(docs, quality.grades_of(labels), 3)
    assert (np.diff(model.thresholds) > 0).all()
    out = quality.select_quality(docs, model).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).select("quality", "toxic", "quality_grade.*").toPandas()
    assert ((out.kept.astype(int)) == out.quality).mean() > 0.99 and out.kept[out.quality == 1].all()
    means = [out.expected[out.quality == 0].mean(), out.expected[out.quality == 1].mean()]
    assert means[0] < 0.5 < 1.5 < means[1]


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (2, "long " * 100_000, "c"), (None, "A", "d")], "doc_id long, text string, f string")
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, grade int"), 3)
    assert all(r.kept for r in quality.select_quality(docs, none).select("quality_grade.kept").collect())
    graded = spark.createDataFrame([(1, 0), (1, None), (2, 2), (7, 1), (None, 1)], "doc_id long, grade int")
    model = quality.train(docs, graded, 3)
    out = quality.select_quality(docs, model).select("f", "quality_grade.*").collect()
    assert len(out) == 4 and all(0 <= r.tail <= 1 and 0 <= r.expected <= 2 for r in out)


def test_ordinal_fit_orders_grades():
    grades = np.arange(600) % 4
    texts, features = np.arange(600), 10 + grades
    model = quality.fit(texts, features, np.ones(600), grades.astype(np.int64), 4, rounds=80)
    latent = model.weights[[10, 11, 12, 13]]
    above = model.above(latent)
    assert (np.diff(latent) > 0).all() and (np.diff(above, axis=1) <= 0).all()
    assert list(np.round(above.sum(axis=1))) == [0, 1, 2, 3]


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    given = ["http://WWW.Example.com/en/x?y#z", "https://example.com/en", "https://a.example.com/en/", "ftp://example.net/es/1", "http://x.net/fr/", "http://net/fr/",
             "http://com", "http://com/", "no scheme", "", None, "http://evilcom/", "http://a://b.net/es/", "http://\u00c9x.com/\n/p", "http://h?://x", "http://x.net/de/" + "a" * 20_000]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)] + [(0, given[0], "again")], "page_id long, url string, host string")
    out = urls.judge_urls(pages, RULES).collect()
    assert len(out) == len(given) + 1
    for r in out:
        host, path, rule = plain(given[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == dict(RULES)[rule] if rule else r.verdict in ("allow", "block")


def test_url_model_learns_and_edges(spark):
    rows = [(f"good{i}.org", f"/wiki/{i}", 0) for i in range(60)] + [(f"casino{i}.biz", f"/win/{i}", 1) for i in range(60)]
    labelled = spark.createDataFrame(rows, "host string, path string, block int")
    pages = spark.createDataFrame([(1, "http://bestcasino.biz/win/now"), (2, "http://goodbook.org/wiki/now")], "page_id long, url string")
    assert [r.verdict for r in urls.judge_urls(pages, [], labelled=labelled).orderBy("page_id").collect()] == ["block", "allow"]
    assert urls.judge_urls(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, RULES).collect()} == {"allow"}
