"""Shared pieces: scratch tables, ids kept apart from user columns, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import bounded_batches, shared_dir

# The characters that part words when a contract says "white space": blank, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = r"\x20\x09-\x0D"


class Scratch:
    """A folder of its own, below the shared folder, for the tables one call writes."""

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/seamark-llm/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._tables: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write `df` and read it back: lineage is cut, and any executor may be lost afterwards."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._tables[id(table)] = table, path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables this folder holds that nothing reads any more; others are left alone."""
        for table in tables:
            if id(table) in self._tables:
                _, path = self._tables.pop(id(table))
                place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z only, whatever the locale or the script."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def of_kind(kind: str):
    """Predicate on a span, for F.filter."""
    return lambda span: span["kind"] == kind


def held_out(doc_id: Column) -> Column:
    """A fifth of all ids, by CRC-32 of the id as text; never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def connected_components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(vertex, component): the smallest vertex that links lead to, for every vertex that has a link.

    Each round gives every vertex its smallest neighbour as label, follows labels to their end, and goes on with
    the ends as vertices, at most half as many; links inside a label are done, and in dense groups those are
    nearly all after the first round.  A vertex with very many links is pre-aggregated on the map side, and its
    rows in the joins are split by adaptive execution.  Nothing but a yes or no reaches the driver.
    """
    both = links.select(F.col(a).alias("v"), F.col(b).alias("u")).filter("v <> u")
    edges = scratch.keep(both.select(F.least("v", "u").alias("v"), F.greatest("v", "u").alias("u")).distinct(), "edges")
    found = None
    for _ in range(max_rounds):
        ends = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        step = scratch.keep(ends.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("label")), "nearest")
        for _ in range(max_rounds):     # follow labels to their end, doubling the steps; one row per vertex
            further = step.select(F.col("v").alias("label"), F.col("label").alias("next"))
            step = scratch.keep(step.join(further, "label").select("v", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moved")), "labels")
            if step.filter("moved").isEmpty():
                break
        if found is None:
            found = step.select(F.col("v").alias("vertex"), F.col("label").alias("component"))
        else:
            moved = found.join(step.select(F.col("v").alias("component"), F.col("label").alias("lower")), "component", "left")
            found = scratch.keep(moved.select("vertex", F.coalesce("lower", "component").alias("component")), "found")
        first = edges.join(step.select("v", F.col("label").alias("x")), "v")
        second = first.join(step.select(F.col("v").alias("u"), F.col("label").alias("y")), "u").filter("x <> y")
        edges = scratch.keep(second.select(F.least("x", "y").alias("v"), F.greatest("x", "y").alias("u")).distinct(), "edges")
        if edges.isEmpty():
            return found
    raise RuntimeError("components did not settle")


def bounded_sample(rows: DataFrame, key: Column, limit: int) -> DataFrame:
    """At most `limit` rows in the order of a hash of `key`: the same rows on every run and at every partitioning."""
    return rows.withColumn("_order", F.xxhash64(F.lit("sample"), key)).orderBy("_order", key).limit(limit).drop("_order")
