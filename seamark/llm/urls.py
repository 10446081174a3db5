"""URL filter: prefix rules first, and for all other URLs logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_sample, lower_ascii

GRAM, DIMENSIONS, SAMPLE = 3, 4096, 5000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for a null URL or one without "://"."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*+", 0)), F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does.  A rule is a host, "/" and the start of a path."""
    rule = verdict = None
    for text, result in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, result) if verdict is None else verdict.when(fits, result)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _grams(part: Column, mark: str) -> Column:
    """Character n-grams with a sign at both ends; the mark keeps host and path apart."""
    closed = F.concat(F.lit("^"), part, F.lit("$"))
    at = F.sequence(F.lit(1), F.greatest(F.char_length(closed) - GRAM + 1, F.lit(1)))
    return F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(closed, i, F.lit(GRAM))))


def featured(urls: DataFrame) -> DataFrame:
    """Adds `features`: which hashed n-grams of `host` and `path` occur."""
    grams = urls.withColumn("_grams", F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p")))
    return HashingTF(numFeatures=DIMENSIONS, binary=True, inputCol="_grams", outputCol="features").transform(grams).drop("_grams")


def train(labelled: DataFrame, sample: int = SAMPLE) -> LogisticRegressionModel | None:
    """Fit on at most `sample` distinct rows (host, path, block 0/1), chosen by a hash; None if one of the classes is missing."""
    rows = labelled.filter(F.col("block").isin(0, 1)).groupBy("host", "path").agg(F.max("block").cast("double").alias("label"))
    chosen = bounded_sample(rows, F.concat_ws("\n", "host", "path"), sample)
    both = featured(chosen).select("label", "features")
    if both.select("label").distinct().count() < 2:
        return None
    return LogisticRegression(maxIter=25, regParam=0.002, aggregationDepth=2).fit(both)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the model's chance that it should be blocked.

    `labelled` (host, path, block) is a small table; without one, the URLs that a rule decides are
    the labels.  Where nothing can be learned (no label of one class) the model allows.  A null URL
    has an empty host and path and is judged by the model; repeated rows and ties are judged alike,
    each row by itself.  An empty table gives an empty result; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumn("rule", rule).withColumn("decided", verdict)
    if labelled is None:
        labelled = ruled.filter("decided is not null").select("host", "path", (F.col("decided") == "block").cast("int").alias("block"))
    model = train(labelled)
    if model is None:
        scored = ruled.withColumn("p_block", F.lit(0.0))
    else:
        scored = model.transform(featured(ruled)).withColumn("p_block", vector_to_array("probability")[1])
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("decided", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")
