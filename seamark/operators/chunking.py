"""Spans to chunks within a token budget.

A file's spans stay in its row: integer arrays are prepared by Spark, searches in
their running sums answer with index ranges, and the text is cut once at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text, tokens, walks
from ..functions.columns import let, running_starts, struct


@dataclass(frozen=True)
class TokenBudget:
    """How many tokens a chunk may hold; `counter` maps a text column to its tokens where the heuristic is not wanted."""

    hard: int = 512
    overlap: int = 0
    chars_per_token: float = tokens.DEFAULT_CHARS_PER_TOKEN
    counter: Callable[[Column], Column] | None = None

    @property
    def soft(self) -> int:
        return tokens.soft_limit(self.hard)

    def count(self, content: Column) -> Column:
        return self.counter(content).cast("int") if self.counter else tokens.token_count(content, self.chars_per_token)


# Kinds that may start a chunk of their own.
BOUNDARY_KINDS = ["function", "method", "class", "struct", "enum", "trait", "impl", "interface"]
# Kinds split at their body, and the line put between header and body part.
CONTAINER_KINDS = ["class", "struct", "impl"]
CONTINUED = "    // ... (continued)"

def with_fixed_groups(files: DataFrame, content: str, size: int = 5, into: str = "chunks") -> DataFrame:
    """Add consecutive groups of `size` lines with line and byte ranges."""
    df = files.withColumn("_lines", text.lines(F.col(content)))
    firsts = F.when(F.size("_lines") > 0, F.sequence(F.lit(1), F.size("_lines"), F.lit(size))).otherwise(
        F.expr("cast(array() as array<int>)"))
    df = df.withColumn("_bodies", F.transform(firsts, lambda first: text.join_lines(F.slice("_lines", first, F.lit(size)))))
    df = df.withColumn("_starts", running_starts(F.transform("_bodies", lambda body: F.octet_length(body) + 1)))
    group = lambda body, i: struct(
        content=body, start_line=i * size + 1, end_line=F.least((i + 1) * size, F.size("_lines")),
        byte_start=F.element_at("_starts", i + 1), byte_end=F.element_at("_starts", i + 1) + F.octet_length(body))
    return df.withColumn(into, F.transform("_bodies", group)).drop("_lines", "_bodies", "_starts")


def pack_spans(files: DataFrame, budget: TokenBudget = TokenBudget()) -> DataFrame:
    """Add `chunks`, budgeted chunks of the ordered `spans` array.

    Spans fill a chunk up to the soft limit; a definition that differs in name
    starts a new one once the chunk is a quarter full; a span above the hard
    limit is cut by lines, trailing lines repeated up to the overlap.
    """
    hard = budget.hard
    df = files.withColumn("_tokens", F.transform("spans", lambda x: budget.count(x["content"])))
    df = df.withColumn("_cut", F.transform("spans", lambda x, i: F.when(
        F.element_at("_tokens", i + 1) > hard, text.lines(x["content"])).otherwise(F.expr("cast(array() as array<string>)"))))
    each_line = lambda count: F.transform("_cut", lambda ls: F.transform(ls, count))
    df = walks.with_walk(
        df, "_plan", walks.pack_walk(hard, budget.soft, budget.overlap), walks.PACK_FIELDS,
        tokens=F.col("_tokens"),
        boundary=F.transform("spans", lambda x: F.coalesce(x["kind"].isin(*BOUNDARY_KINDS), F.lit(False))),
        names=F.transform("spans", lambda x: F.when(x["name"].isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(x["name"]))),
        filled=F.transform("spans", lambda x: x["content"] != ""),
        line_tokens=each_line(lambda line: budget.count(F.concat(line, F.lit("\n")))),
        line_sizes=each_line(lambda line: F.octet_length(line)))

    def chunk(p):
        span = lambda n: F.element_at("spans", p[n].cast("int"))
        first, last = span("first"), span("last")
        part = F.slice("spans", p["first"].cast("int"), (p["last"] - p["first"] + 1).cast("int"))
        lines = F.slice(F.element_at("_cut", p["first"].cast("int")), F.greatest(p["line"], F.lit(1)).cast("int"), p["n_lines"].cast("int"))
        by_line = p["line"] > 0
        start = first["start_line"] + p["start_line"].cast("int")
        from_byte = first["byte_start"] + p["byte_start"]
        rest = p["byte_len"] < 0
        return struct(
            content=F.when(by_line, text.join_lines(lines)).otherwise(text.join_lines(F.transform(part, lambda x: x["content"]))),
            start_line=start,
            end_line=F.when(by_line & ~rest, start + p["n_lines"].cast("int") - 1).otherwise(last["end_line"]),
            byte_start=from_byte,
            byte_end=F.when(by_line & ~rest, from_byte + p["byte_len"]).otherwise(last["byte_end"]),
            kind=span("kind_of")["kind"], name=span("name_of")["name"], token_count=p["tokens"].cast("int"))

    return df.withColumn("chunks", F.transform("_plan", chunk)).drop("_tokens", "_cut", "_plan")


# ------------------------------------------------------ splitting single units

def pieces(content: Column) -> Column:
    """Token-like pieces that join back to the text: a word with the blanks after it."""
    return F.regexp_extract_all(content, F.lit(r"(\S+\s*|\s+)"), F.lit(1))


def _count_list(content: Column) -> Column:
    return let(tokens.class_counts(content), lambda c: F.array(c["word"], c["space"], c["punct"], c["other"]))


def split_large_spans(files: DataFrame, max_tokens: int, tokenize=pieces) -> DataFrame:
    """Add `chunks`: the spans, those above `max_tokens` in parts.

    A class-like span is cut into runs of its body, each behind the header; any
    other into windows of `max_tokens` pieces, or in two halves of lines if it
    has no more pieces than that.  `own` is what a run holds beside the header, null for the others.
    """
    empty = lambda t: F.expr(f"cast(array() as array<{t}>)")
    df = files.withColumn("_tokens", F.transform("spans", lambda x: tokens.token_count(x["content"])))
    large = lambda i: F.element_at("_tokens", i + 1) > max_tokens
    holds = lambda x: F.coalesce(x["kind"].isin(*CONTAINER_KINDS), F.lit(False))
    df = df.withColumn("_cut", F.transform("spans", lambda x, i: F.when(large(i), text.lines(x["content"])).otherwise(empty("string"))))
    df = df.withColumn("_pieces", F.transform("spans", lambda x, i: F.when(
        large(i) & ~holds(x), tokenize(x["content"])).otherwise(empty("string"))))
    opens = lambda line, j: F.when(F.contains(line, F.lit("{")) | ((j > 0) & line.startswith("    ")), j + 1)
    df = df.withColumn("_heads", F.transform("_cut", lambda ls: F.coalesce(F.array_min(F.transform(ls, opens)), F.size(ls))))
    header = lambda i: text.join_lines(F.slice(F.element_at("_cut", i), F.lit(1), F.element_at("_heads", i)))
    of_container = lambda i, value: F.when(large(i) & holds(F.element_at("spans", i + 1)), value)
    df = walks.with_walk(
        df, "_plan", walks.split_walk(max_tokens), walks.SPLIT_FIELDS,
        large=F.transform("_tokens", lambda t: t > max_tokens),
        container=F.transform("spans", holds),
        piece_sizes=F.transform("_pieces", lambda ps: F.transform(ps, lambda p: F.octet_length(p))),
        n_lines=F.transform("_cut", lambda ls: F.size(ls)),
        headers=F.col("_heads"),
        line_sizes=F.transform("_cut", lambda ls: F.transform(ls, lambda line: F.octet_length(line))),
        line_counts=F.transform("_cut", lambda ls, i: F.coalesce(
            of_container(i, F.flatten(F.transform(ls, _count_list))), empty("int"))),
        head_counts=F.transform("_cut", lambda ls, i: F.coalesce(
            of_container(i, _count_list(F.concat(header(i + 1), F.lit("\n" + CONTINUED)))), empty("int"))))

    def chunk(p):
        unit = p["unit"].cast("int")
        span = F.element_at("spans", unit)
        some = lambda array: F.slice(F.element_at(array, unit), F.greatest(p["first"], F.lit(1)).cast("int"), p["n"].cast("int"))
        mode, start = p["mode"], span["start_line"] + p["start"].cast("int")
        content = (
            F.when(mode == walks.WINDOW, F.array_join(some("_pieces"), ""))
            .when(mode == walks.PART, F.concat(header(unit), F.lit("\n" + CONTINUED + "\n"), text.join_lines(some("_cut"))))
            .when(mode == walks.HALF, text.join_lines(some("_cut")))
            .otherwise(span["content"]))
        whole = mode == walks.WHOLE
        suffix = F.when(mode == walks.PART, "_part").otherwise(F.concat(F.lit("_part"), p["part"].cast("string")))
        return let(content, lambda c: struct(
            content=c, start_line=start,
            end_line=F.when(whole, span["end_line"]).when(mode == walks.WINDOW, start + F.size(text.lines(c)))
            .otherwise(span["start_line"] + p["end"].cast("int")),
            byte_start=span["byte_start"] + p["byte_start"],
            byte_end=F.when(whole, span["byte_end"]).otherwise(span["byte_start"] + p["byte_start"] + p["byte_len"]),
            kind=F.when(whole, span["kind"]).otherwise(F.concat(span["kind"], suffix)), name=span["name"],
            own=F.when(mode == walks.PART, text.join_lines(some("_cut"))),
            token_count=F.when(whole, F.element_at("_tokens", unit)).when(mode == walks.WINDOW, p["n"].cast("int"))
            .otherwise(tokens.token_count(c))))

    return df.withColumn("chunks", F.transform("_plan", chunk)).drop("_tokens", "_cut", "_pieces", "_heads", "_plan")


def rows_of(files: DataFrame, array: str, index: str, *keep: str) -> DataFrame:
    """One row per element of an array of structs, with its 0-based position.

    The outer form plus a filter on the position: from a plain explode Spark
    infers a filter on the array, pushes it below and computes the array twice.
    """
    exploded = files.select(*keep, F.posexplode_outer(array).alias(index, "_element"))
    return exploded.filter(F.col(index).isNotNull()).select(*keep, index, "_element.*")


def chunk_rows(files: DataFrame, *keep: str) -> DataFrame:
    """One row per chunk with its 0-based index in the file."""
    return rows_of(files, "chunks", "chunk_index", *keep)
