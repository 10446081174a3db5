"""Personal data: fixed forms as seeds, then contextual patterns bootstrapped from them; built-in functions only.

Seed entities found by their form lend their kind to the words around them.  A pattern is one to
three such words on one side, or one on each.  Patterns and instances form a graph; in rounds, patterns are
scored by the known instances they surround, unknown instances by the best pattern around them, and those of
high confidence become known, until a round adds none.  Against a pattern counts what is known as another kind
or cannot be of its own; an unknown instance that could be is what the pattern is there to find and counts
neither way.  Everything is an aggregation over distinct (pattern, instance) pairs,
summed on the map side, so a word that stands beside a third of all numbers costs one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import let, running_starts, struct
from .common import Scratch, of_kind

KINDS = ("email", "ip", "card", "phone")

# The forms, written so that the regex engine neither backtracks over long runs nor recurses: possessive
# repeats, and a look behind that starts a run at its first character (\G: or where the last match ended).
_FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# Candidates for contextual extraction: neighbouring words that hold a digit or an at sign.
_WORDY = r"[^\s0-9@]*+[0-9@]\S*+"
_CANDIDATE = rf"(?<!\S){_WORDY}(?:\x20{_WORDY})*+"
_EDGE_LEFT, _EDGE_RIGHT = r"^[^A-Za-z0-9+(]+", r"[^A-Za-z0-9)]+$"
LONG_WORD = 64   # characters from which a context word is named by its hash
_DATE_OR_TIME = r"^(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4})(?:[\x20T]|$)"


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        plain = F.regexp_replace(value, r"[\x20-]", "")
        return F.when(F.length(plain).between(16, 19), F.call_function("luhn_check", plain)).otherwise(False)
    if kind == "phone":
        return _digits(value).between(8, 15)
    return F.lit(True)


def _valid_match(kind: str):
    return lambda match: _valid(kind, match["value"])


def _named(kind: str):
    return lambda span: struct(kind=F.lit(kind), start=span["start"], end=span["end"])


def _first(a: Column, b: Column) -> Column:
    """Order of spans by their start."""
    return F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)


def _fits(kind: str, value: Column) -> Column:
    """What may fill a slot of a kind, if its context says so: the kind's looser forms."""
    n = _digits(value)
    return {"email": value.rlike("[A-Za-z]") & value.rlike(r"^[^@\s]+@[^@\s]+$"),
            "ip": value.rlike(r"^[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){3,7}$") & (n >= 4),
            "card": value.rlike(r"^[0-9][0-9\x20.-]*[0-9]$") & n.between(12, 19),
            "phone": value.rlike(r"^[+(]?[0-9][0-9\x20().-]*[0-9]$") & n.between(7, 15) & ~value.rlike(_DATE_OR_TIME)}[kind]


def located(text: Column, pattern: str, hint: Column | None = None) -> Column:
    """Matches of a pattern with their places: array of (value, start, end, before, after); code points, end exclusive.

    before and after are the pieces of text between matches.
    """
    there = hint if hint is not None else F.lit(True)
    none = F.expr("cast(array() as array<struct<value:string,start:bigint,end:bigint,before:string,after:string>>)")
    values = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))

    def places(found: Column) -> Column:
        def walk(pieces: Column) -> Column:
            sizes = F.flatten(F.transform(found, lambda v, i: F.array(F.char_length(pieces[i]), F.char_length(v))))
            return let(running_starts(sizes), lambda starts: F.transform(found, lambda v, i: struct(
                value=v, start=starts[i * 2 + 1], end=starts[i * 2 + 1] + F.char_length(v), before=pieces[i], after=pieces[i + 1])))
        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), walk)).otherwise(none)

    return let(values, places)


def _base(text: Column) -> list[Column]:
    spans = []
    for kind in KINDS:
        hint = F.contains(text, F.lit(_HINT[kind])) if _HINT[kind] else text.rlike("[0-9]{2}|[0-9][\\x20-][0-9]")
        if kind in ("ip", "card"):
            hint = hint & text.rlike("[0-9]")
        found = F.filter(located(text, _FORMS[kind], hint), _valid_match(kind))
        spans.append(F.transform(found, lambda m: struct(start=m["start"], end=m["end"])).alias(kind))
    return spans


def _words(piece: Column, blanks: int) -> Column:
    """Whole words up to so many blanks from the end (negative) or the start, in reading order, lower case."""
    near = F.filter(F.split(F.lower(F.substring_index(piece, " ", blanks)), r"\s+"), lambda w: w != "")
    return F.transform(near, lambda w: F.when(F.char_length(w) > LONG_WORD, F.sha2(w, 256)).otherwise(w))


def _candidates(text: Column) -> Column:
    """Candidates without the punctuation around them, and up to three lower-case words before and after."""
    def trimmed(m: Column) -> Column:
        value = F.regexp_replace(m["value"], _EDGE_LEFT, "")
        return let(value, lambda v: let(F.regexp_replace(v, _EDGE_RIGHT, ""), lambda core: struct(
            value=core, start=m["end"] - F.char_length(v), end=m["end"] - F.char_length(v) + F.char_length(core),
            left=_words(m["before"], -4), right=_words(m["after"], 4))))
    return F.filter(F.transform(located(text, _CANDIDATE, text.rlike("[0-9@]")), trimmed), lambda c: F.char_length(c["value"]) > 3)


def _patterns(left: Column, right: Column) -> Column:
    """One to three words before, one to three after, and one on each side."""
    before = [F.when(F.size(left) >= n, F.concat(F.lit("before "), F.array_join(F.slice(left, -n, n), " "))) for n in (1, 2, 3)]
    after = [F.when(F.size(right) >= n, F.concat(F.lit("after "), F.array_join(F.slice(right, 1, n), " "))) for n in (1, 2, 3)]
    around = F.when((F.size(left) > 0) & (F.size(right) > 0), F.concat(F.lit("around "), F.element_at(left, -1), F.lit(" "), right[0]))
    return F.array_compact(F.array(*before, *after, around))


@dataclass(frozen=True)
class Bootstrap:
    """When a pattern and an instance are believed."""

    support: int = 5          # known distinct instances a pattern needs
    precision: float = 0.8    # known of a kind, among those, the counter-examples and one more


def _bootstrap(graph: DataFrame, scratch: Scratch, rule: Bootstrap) -> DataFrame:
    """(instance, kind) believed in the end; `graph` has pattern, instance, the seed kind or null, and the kinds it may be, each pair once."""
    learned = None
    while True:
        known = graph if learned is None else graph.join(learned.withColumnRenamed("kind", "new"), "instance", "left").withColumn(
            "kind", F.coalesce("kind", "new")).drop("new")
        known = scratch.keep(known, "known")
        own = [F.count_if(F.col("kind") == kind) for kind in KINDS]
        unfit = [F.count_if(F.col("kind").isNull() & ~F.array_contains("fits", kind)) for kind in KINDS]
        sums = known.groupBy("pattern").agg(F.count("kind").alias("of"), F.array(*[
            struct(guess=F.lit(kind), n=n, unfit=u) for kind, n, u in zip(KINDS, own, unfit)]).alias("kinds"))
        trusted = sums.select("pattern", "of", F.inline("kinds")).withColumn("precision", F.col("n") / (F.col("of") + F.col("unfit") + 1)).filter(
            (F.col("n") >= rule.support) & (F.col("precision") >= rule.precision)).select("pattern", "guess", "precision")
        asked = known.filter(F.col("kind").isNull() & (F.size("fits") > 0)).join(trusted, "pattern").filter(F.array_contains("fits", F.col("guess")))
        more = scratch.keep(asked.groupBy("instance").agg(F.max_by("guess", F.struct("precision", "guess")).alias("kind")), "instances")
        if more.isEmpty():
            return more if learned is None else learned
        learned = more if learned is None else scratch.keep(learned.unionByName(more), "learned")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Bootstrap = Bootstrap()) -> DataFrame:
    """One row per row of `docs`: id, base and added spans (kind, start, end) as arrays, by kind in the order of KINDS, then start.

    base: the forms, leftmost and without overlap within a kind.  added: spans that the bootstrapped
    contexts discover; they never touch a base span.  A null or empty text has none.  Repeated rows and
    ties are judged each by itself; among equals the later kind in alphabetical order wins.  Very long texts are read
    whole, in time that grows with their length.  An empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(spark, "pii")
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = given.select("id", *_base(F.col("text")), _candidates(F.col("text")).alias("candidates"))
    first = scratch.keep(found.withColumn("row", F.monotonically_increasing_id()), "spans")
    seen = F.coalesce(*[F.when(F.exists(kind, lambda s: (s["start"] < F.col("c.end")) & (F.col("c.start") < s["end"])), F.lit(kind)) for kind in KINDS])
    occurrences = first.select("row", *KINDS, F.explode("candidates").alias("c")).select("row", "c.*", seen.alias("kind"))
    may_be = F.array_compact(F.array(*[F.when(_fits(kind, F.col("instance")), F.lit(kind)) for kind in KINDS]))
    pairs = occurrences.select(F.lower("value").alias("instance"), "kind", F.explode(_patterns(F.col("left"), F.col("right"))).alias("pattern"))
    graph = scratch.keep(pairs.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")).withColumn("fits", may_be), "graph")
    learned = _bootstrap(graph, scratch, rule)
    added = occurrences.filter(F.col("kind").isNull()).select("row", F.lower("value").alias("instance"), "start", "end").join(learned, "instance").groupBy("row").agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("more"))   # spans of one text
    base = F.concat(*[F.transform(kind, _named(kind)) for kind in KINDS])
    more = F.coalesce("more", F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)"))
    return first.join(added, "row", "left").select(F.col("id").alias(id_col), base.alias("base"), F.array_sort(more, _first).alias("added"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, hash and list of the spans that `find_pii` found."""
    merged = F.concat(*[F.array_sort(F.filter(F.concat("base", "added"), of_kind(kind)), _first) for kind in KINDS])
    counts = [F.size(F.filter("base", of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select(id_col, *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(merged).alias("spans"), F.size("added").cast("long").alias("n_added"))
