"""Mixing sources to target weights by a low-discrepancy schedule over equal blocks of words.

Slot t of the schedule takes the point frac(t * golden ratio); the targets, laid
end to end, tell which source that point falls on.  The k-th slot of a source takes the
k-th block of the source's documents, which are shuffled by a hash and cut into blocks of equally
many words; after the last block the first comes again.  Any stretch of the schedule thus holds
the sources in their shares, up to a few blocks.

A source may hold most of the corpus: words are summed in ranges of the shuffle hash, and only
within such a range (its number grows with the source) in the order of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import SPACE_CLASS, Scratch

GOLDEN = 0.6180339887498949
RANGES = 4          # hex digits of the shuffle hash that name a range: 65,536 of them in each source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds weight and target to (source, source_size): one row for each source, null last.

    Weights repeat over the sources in code-point order.  Together the targets are `share` of all
    sizes; none is above `most` times its source, what is too much goes to the others by weight.
    That water level has a closed form: sources fill up in the order of most * size / weight.
    The windows here run over one row per source, not over documents.
    """
    spread = F.array(*[F.lit(float(w)) for w in weights])
    whole = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("place", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn(
        "weight", F.element_at(spread, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(float(most)))
    order = whole.orderBy(F.col("most") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn(
        "left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))).withColumn(
        "total", F.sum("source_size").over(whole) * F.lit(float(share))).withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    # sources before the level are full; the first one that it does not fill decides it
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("ratio"), "place", "level"))
    open_ = level.withColumn("water", F.min(fits).over(whole)["level"])
    return open_.select("source", "source_size", "weight", F.when(
        F.col("water").isNull() | (F.col("water") * F.col("weight") > F.col("most")), F.col("most")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def _positions(rows: DataFrame) -> DataFrame:
    """Where each document's words begin in the shuffled order of its source."""
    by_range = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)   # at most 16 ** RANGES rows a source
    base = by_range.select(F.col("source").alias("_s"), F.col("range").alias("_r"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "range").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r"))).withColumn(
        "begin", F.col("base") + F.col("within")).drop("_s", "_r", "base", "within")


def shuffled(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """(id, source, size, order, range): what the mix needs of each document."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("order")).withColumn(
        "range", F.substring("order", 1, RANGES))


def schedule(targets: DataFrame, spark: SparkSession, scratch: Scratch, block: int, chunk: int = 1 << 14) -> DataFrame:
    """(slot, source, rank, first, words): what each slot takes, as a stretch of its source's words laid end to end again and again.

    A source's last slot ends at its target.  Slots that the golden-ratio points leave a source
    short of (a few, by their discrepancy) follow at the end.
    """
    goal = targets.withColumn("goal", F.floor("target").cast("long")).filter("goal > 0")
    whole = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ends = goal.withColumn("high", F.sum("goal").over(whole)).withColumn("low", F.col("high") - F.col("goal"))   # one row per source
    ends = scratch.keep(ends.withColumn("need", F.ceil(F.col("goal") / block)), "ends")
    total = ends.agg(F.coalesce(F.max("high"), F.lit(0))).first()[0]
    slots = -(-total // block)
    # sources meet points by ranges of equal width: a source is listed in each range it touches
    cells = max(1, min(1 << 16, slots))
    spans = ends.select("source", "goal", "need", "low", "high", F.explode(F.sequence(
        F.floor(F.col("low") / total * cells), F.least(F.floor(F.col("high") / total * cells), F.lit(cells - 1)))).alias("cell"))
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("x", F.pmod(F.col("slot") * F.lit(GOLDEN), F.lit(1.0)) * total).withColumn(
        "cell", F.least(F.floor(F.col("x") / total * cells), F.lit(cells - 1)))
    dealt = points.join(spans, "cell").filter("x >= low and x < high").select("slot", "source", "goal", "need", F.floor(F.col("slot") / chunk).alias("chunk"))
    dealt = scratch.keep(dealt, "dealt")
    counted = dealt.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)   # one row per chunk of slots
    base = counted.select(F.col("source").alias("_s"), F.col("chunk").alias("_c"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "chunk").orderBy("slot")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(
        base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("chunk") == F.col("_c"))).withColumn("rank", F.col("rank") + F.col("base")).filter(
        F.col("rank") < F.col("need")).select("slot", "source", "goal", "rank")
    got = counted.groupBy("source").agg(F.sum("n").alias("got")).withColumnRenamed("source", "_s")
    short = ends.join(got, F.col("source").eqNullSafe(F.col("_s")), "left").filter(F.coalesce("got", F.lit(0)) < F.col("need")).select(
        "source", "goal", F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("need") - 1)).alias("rank"))
    tail = short.select((F.lit(slots) + F.xxhash64("source", "rank").bitwiseAND(F.lit((1 << 40) - 1))).alias("slot"), "source", "goal", "rank")
    first = F.col("rank") * block
    return ranked.unionByName(tail).select("slot", "source", "rank", first.alias("first"), F.least(F.lit(block), F.col("goal") - first).alias("words"))


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 256,
        weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(pieces, report) of a mix in which each source comes to its target.

    pieces: slot, source, id, begin, words: the words a slot takes of a document, from the
    document's word `begin` on; ordered by slot they are the mixed corpus.
    report: one row per row of `docs`: id, source, size, source_size, target, taken.

    Null and empty texts have no words and are never taken; a null source is a source of its own,
    the last.  Rows that share an id are taken each for itself; the order among equal
    (hash, id, size) is open, which changes no figure.  No document is taken more than twice its words
    as long as `most` is 2.  An empty table gives empty results.  Reruns agree.
    """
    scratch = Scratch(spark, "mix")
    rows = scratch.keep(shuffled(docs, id_col, text_col, source_col, seed), "sizes")
    targets = scratch.keep(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    placed = scratch.keep(_positions(rows).withColumn("row", F.monotonically_increasing_id()), "placed")
    slots = schedule(targets, spark, scratch, block)
    # cut slots and documents at the same places: blocks of a source's words
    sized = slots.join(targets.select(F.col("source").alias("_s"), "source_size"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    wrapped = sized.withColumn("at", F.col("first") % F.col("source_size")).withColumn("part", F.explode(F.array(
        F.struct(F.col("at").alias("from"), F.least(F.col("at") + F.col("words"), F.col("source_size")).alias("to")),
        F.struct(F.lit(0).cast("long").alias("from"), F.greatest(F.col("at") + F.col("words") - F.col("source_size"), F.lit(0)).alias("to"))))).filter(
        "part.to > part.from").select("slot", "source", "part.from", "part.to")
    by_block = wrapped.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    texts = placed.filter("size > 0").select("row", "id", "source", "begin", "size", F.explode(F.sequence(
        F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))).alias("block"))
    right = by_block.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "slot", "from", "to")
    low = F.greatest("from", "begin", F.col("block") * block)
    high = F.least(F.col("to"), F.col("begin") + F.col("size"), (F.col("block") + 1) * block)
    pieces = texts.join(right, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).withColumn("low", low).withColumn(
        "high", high).filter("high > low").select("slot", "source", "id", "row", (F.col("low") - F.col("begin")).alias("begin"), (F.col("high") - F.col("low")).alias("words"))
    pieces = scratch.keep(pieces, "pieces")
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    report = placed.join(taken, "row", "left").join(targets.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return pieces.drop("row").withColumnRenamed("id", id_col), report
