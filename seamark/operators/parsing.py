"""Source text to spans.

A file is one row and stays one row until its spans are known, so parsing
shuffles nothing and a source with a third of all files is just more rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import languages, scanning, text, tokens, walks
from ..functions.columns import let, struct
from ..session import bounded_batches

MAX_TOKENS = 512

# Words after which a definition's name follows.
NAME_KEYWORDS = ["def", "fn", "function", "func", "class", "struct", "interface", "impl", "trait"]

_NAME = r"(?:^|\s)(?:" + "|".join(NAME_KEYWORDS) + r")\s+(\S+)"


def name_of_line(line: Column) -> Column:
    """Token after the first definition keyword, less trailing `(`, `:`, `{`, `<` in that order."""
    found = F.transform(F.regexp_extract_all(line, F.lit(_NAME), F.lit(1)),
                        lambda x: F.regexp_replace(x, r"<*\{*:*\(*$", ""))
    return F.try_element_at(F.filter(found, lambda x: x != ""), F.lit(1))


def starts_with_any(line: Column, prefixes: Column) -> Column:
    return F.exists(prefixes, lambda p: line.startswith(p))


def _known(files: DataFrame, path: str = "file_path") -> DataFrame:
    return files if "language" in files.columns else files.withColumn("language", languages.language_of(F.col(path)))


def with_lines(files: DataFrame, content: str = "file_content", path: str = "file_path", wanted: Column | None = None) -> DataFrame:
    """Add language, lines, and per line what the line machine and names need; no lines where `wanted` is false."""
    split = text.lines(text.normalize_newlines(F.col(content)))
    df = _known(files, path).withColumn(
        "_lines", split if wanted is None else F.when(wanted, split).otherwise(F.expr("cast(array() as array<string>)")))
    bit = lambda condition, value: F.when(condition, value).otherwise(0)
    signs = struct(fn=languages.function_prefixes(F.col("language")), cl=languages.class_prefixes(F.col("language")), braces=languages.block_style(F.col("language")) == "braces")

    def facts(of):
        """Facts of all lines; `of` is bound once, where a column would be computed again for every line."""
        return F.transform("_lines", lambda line: let(F.regexp_replace(F.regexp_replace(line, r"^\p{IsWhite_Space}+", ""), r"\p{IsWhite_Space}+$", ""), lambda bare: let(
            bit(starts_with_any(bare, of["fn"]), walks.FUNCTION) + bit(starts_with_any(bare, of["cl"]), walks.CLASS),
            lambda opens: struct(
                flags=opens, size=F.octet_length(line), marks=F.when(of["braces"], F.regexp_replace(line, r"[^(){}\[\]]+", "")).otherwise(""),
                name=F.when(opens > 0, name_of_line(bare))))))

    return df.withColumn("_facts", let(signs, facts))


def _line_spans(df: DataFrame, max_tokens: int) -> DataFrame:
    """Add `_walk`, the cuts of the line machine over `_lines`."""
    style = F.coalesce(*[F.when(F.col("_style") == name, number) for name, number in walks.STYLES.items()], F.lit(0))
    df = df.withColumn("_counts", F.transform("_lines", lambda line: tokens.class_counts(line)))
    return walks.with_walk(
        df, "_walk", walks.heuristic_walk(max_tokens), walks.SPAN_FIELDS, style=style, flags=F.col("_facts.flags"), sizes=F.col("_facts.size"),
        marks=F.col("_facts.marks"), words=F.col("_counts.word"), spaces=F.col("_counts.space"), puncts=F.col("_counts.punct"),
        others=F.col("_counts.other"))


def _from_lines(s: Column) -> Column:
    fact = F.try_element_at("_facts", F.when(s["name_line"] > 0, s["name_line"].cast("int")))
    kind = F.when(s["kind"] == walks.FUNCTION, "function").when(s["kind"] == walks.CLASS, "class")
    body = text.join_lines(F.slice("_lines", F.greatest(s["first"], F.lit(1)).cast("int"), s["n"].cast("int")))
    return let(body, lambda content: struct(
        content=content, start_line=s["start_line"].cast("int"), end_line=s["end_line"].cast("int"), byte_start=s["byte_start"],
        byte_end=s["byte_start"] + F.octet_length(content), kind=kind, name=F.when(s["kind"] > 0, fact["name"])))


def _from_bytes(found: Column, raw: Column) -> Column:
    """Spans out of byte ranges; the bytes are bound once, as Spark would copy them for every span."""
    kinds = F.array(*[F.lit(k) for k in scanning.KINDS])

    def span(s, code):
        part = lambda a, b: F.substring(code, a.cast("int") + 1, (b - a).cast("int")).cast("string")
        return struct(
            content=part(s["byte_start"], s["byte_end"]), start_line=s["start_line"].cast("int"), end_line=s["end_line"].cast("int"),
            byte_start=s["byte_start"], byte_end=s["byte_end"], kind=F.nullif(F.get(kinds, s["kind"].cast("int")), F.lit("")),
            name=F.when(s["name_end"] > s["name_start"], part(s["name_start"], s["name_end"])))

    return let(raw, lambda code: F.transform(found, lambda s: span(s, code)))


def parse_spans(files: DataFrame, mode: str = "definitions", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Files with an array of spans in place of helper columns; nothing is shuffled.

    `definitions` captures whole definitions, a class and its methods overlapping, and between them what the file
    holds beside them, as spans without kind or name; only brackets and separators are left out.  A file without
    a definition goes to the line machine.  `heuristic` is the line machine alone: text outside definitions goes in
    front of the next one or, from `max_tokens` on, becomes an unnamed span.  Of markup files the elements are the
    definitions, each with all that is in it, named by their tags.
    """
    if mode not in ("definitions", "heuristic"):
        raise ValueError("mode must be definitions or heuristic")
    bounded_batches(files.sparkSession)
    df = _known(files).withColumn("_style", languages.block_style(F.col("language")))
    if mode == "heuristic":
        return _line_spans(with_lines(df), max_tokens).withColumn("spans", F.transform("_walk", _from_lines)).drop("_lines", "_style", "_facts", "_counts", "_walk")
    df = df.withColumn("_text", text.normalize_newlines(F.col("file_content")))
    df = df.withColumn("_found", scanning.definition_spans(F.col("_text"), F.col("language"), F.col("_style")))
    df = _line_spans(with_lines(df, "_text", wanted=F.size("_found") == 0), max_tokens)
    whole = _from_bytes(F.col("_found"), F.coalesce(F.col("_text"), F.lit("")).cast("binary"))
    return df.withColumn("spans", F.concat(whole, F.transform("_walk", _from_lines))).drop("_lines", "_style", "_facts", "_counts", "_walk", "_text", "_found")


Parser = Callable[[DataFrame], DataFrame]


def parse_composite(files: DataFrame, parsers: list[tuple[set[str], Parser]], fallback: Parser = parse_spans) -> DataFrame:
    """Each file by the first parser that takes its language, else by the fallback.

    Parsers map files to files with `spans`; the languages partition the input,
    so every file is parsed once.
    """
    df = files if "language" in files.columns else files.withColumn("language", languages.language_of(F.col("file_path")))
    taken: set[str] = set()
    out = None
    for wanted, parser in parsers:
        own = wanted - taken
        taken |= own
        part = parser(df.filter(F.col("language").isin(sorted(own))))
        out = part if out is None else out.unionByName(part)
    rest = fallback(df.filter(~F.coalesce(F.col("language").isin(sorted(taken)), F.lit(False))))
    return rest if out is None else out.unionByName(rest)
