"""Parsing and chunking of whole files.

The SQL side walks the lines or spans one by one in recursive queries, so it
shares nothing with the folds it checks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, text, walks
from ..functions.columns import struct
from ..operators import chunking as C
from ..operators import parsers
from ..operators import parsing as P
from . import corpus as c
from .registry import query
from .text_queries import _P, _S, _W, count_sql

HARD, OVERLAP, PART_TOKENS, WINDOW, FLUSH = 128, 12, 150, 64, 60
SOFT = int(HARD * 0.9)
_RECURSIVE = "/* RECURSIVE */ "
_LS = "CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END"


def _n(column: str, cls: str) -> str:
    return f"len(regexp_extract_all({column}, '{cls}'))"


def _classes(column: str) -> str:
    w, s, p = _n(column, _W), _n(column, _S), _n(column, _P)
    return f"{w} AS w, {s} AS s, {p} AS p, length({column}) - {w} - {s} - {p} AS o"


def _tokens(w: str, s: str, p: str, o: str) -> str:
    return f"ceil((({w})::DOUBLE / 4.0::DOUBLE + ({p}) * 0.8::DOUBLE + ({o}) * 0.9::DOUBLE) + ({s}) * 0.1::DOUBLE)::INTEGER"


@query("chunk_fixed_lines", c.with_sql(c.FILES, c.CHUNKS, select="""
SELECT doc_id, chunk_index, content, start_line, end_line, byte_start, byte_end FROM chunks"""))
def chunk_fixed_lines(spark, folder):
    return c.chunks(spark, folder).select("doc_id", "chunk_index", "content", "start_line", "end_line", "byte_start", "byte_end")


# ------------------------------------------------------------------- packing

_SPANS = f"""spans AS (
  SELECT *, byte_start + strlen(content) AS byte_end, {c._pick_sql('(i - 1) % 4', ['function', 'class', 'comment'])} AS kind,
    nullif(regexp_extract(content, '(\\p{{L}}+)', 1), '') AS name, {count_sql('content')} AS t
  FROM (SELECT doc_id, f // 2 + 1 AS i, array_to_string(ls[f + 1:f + 2], chr(10)) AS content, f + 1 AS start_line, least(f + 2, len(ls)) AS end_line,
      CASE WHEN f = 0 THEN 0 ELSE strlen(array_to_string(ls[1:f], chr(10))) + 1 END AS byte_start
    FROM (SELECT doc_id, ls, unnest(range(0, len(ls), 2)) AS f
          FROM (SELECT doc_id, {_LS} AS ls FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))))"""

def _pack_sql(hard: int, soft: int, kinds: str) -> str:
    """`spans` in order, each with the group it is packed into."""
    return f"""{_RECURSIVE} packed AS (
  SELECT doc_id, 0::BIGINT AS i, 0 AS g, 0 AS tokens, NULL::VARCHAR AS kind, NULL::VARCHAR AS name, false AS filled, false AS big FROM (SELECT DISTINCT doc_id FROM spans)
  UNION ALL
  SELECT doc_id, i, CASE WHEN big OR fresh THEN g + 1 ELSE g END,
    CASE WHEN big THEN 0 WHEN fresh THEN t ELSE tokens + t END,
    CASE WHEN big THEN kind WHEN fresh OR is_def THEN new_kind ELSE kind END,
    CASE WHEN big THEN name WHEN fresh OR is_def THEN new_name ELSE name END,
    NOT big AND (NOT fresh OR content <> ''), big
  FROM (
    SELECT p.doc_id, s.i, p.g, p.tokens, p.kind, p.name, s.t, s.kind AS new_kind, s.name AS new_name, s.content, s.t > {hard} AS big,
      coalesce(s.kind IN ({kinds}), false) AS is_def,
      NOT p.filled OR p.tokens + s.t > {soft} OR (coalesce(s.kind IN ({kinds}) AND p.kind IN ({kinds})
        AND s.name <> p.name, false) AND p.tokens * 4 >= {soft}) AS fresh
    FROM packed p JOIN spans s ON s.doc_id = p.doc_id AND s.i = p.i + 1))"""

_GROUPED = """grouped AS (
  SELECT p.doc_id, p.g, bool_or(p.big) AS big, string_agg(s.content, chr(10) ORDER BY s.i) AS content, arg_min(s.start_line, p.i) AS start_line,
    arg_max(s.end_line, p.i) AS end_line, arg_min(s.byte_start, p.i) AS byte_start, arg_max(s.byte_end, p.i) AS byte_end, min(p.i) AS first_i, arg_max(p.kind, p.i) AS kind,
    arg_max(p.name, p.i) AS name, arg_max(p.tokens, p.i) AS token_count
  FROM packed p JOIN spans s ON s.doc_id = p.doc_id AND s.i = p.i GROUP BY p.doc_id, p.g)"""

# kind and name of an oversized span are the span's own
def _big_sql(hard: int) -> str:
    return f"""big_spans AS (
  SELECT s.doc_id, s.i AS unit, {_LS} AS ls, s.start_line, s.end_line, s.byte_start, s.byte_end, s.kind, s.name
  FROM (SELECT *, string_split(content, chr(10)) AS l FROM spans WHERE t > {hard}) s)"""


def _split_sql(units: str, soft: int, overlap: int) -> str:
    return f"""unit_lines AS (
  SELECT *, list_transform(ls, lambda x: {count_sql('(x || chr(10))')}) AS toks FROM {units}),
{_RECURSIVE} walked AS (
  SELECT doc_id, unit, 0 AS i, 1 AS first, 0 AS tokens, start_line::BIGINT AS start, byte_start::BIGINT AS pos, false AS cut FROM unit_lines
  UNION ALL
  SELECT doc_id, unit, i + 1, CASE WHEN cuts THEN i + 1 - k ELSE first END,
    (CASE WHEN cuts THEN coalesce(list_sum(rev[1:k]), 0) ELSE tokens END + t)::INTEGER, CASE WHEN cuts THEN start + held - k ELSE start END,
    CASE WHEN cuts THEN pos + strlen(array_to_string(ls[first:i], chr(10))) - CASE WHEN k > 0 THEN strlen(array_to_string(ls[i - k + 1:i], chr(10))) ELSE 0 END ELSE pos END,
    cuts
  FROM (SELECT *, len(list_filter(range(1, len(rev) + 1), lambda j: list_sum(rev[1:j]) <= {overlap})) AS k FROM (
    SELECT w.*, u.ls, u.toks[w.i + 1] AS t, w.i - w.first + 1 AS held, w.tokens + u.toks[w.i + 1] > {soft} AND w.i - w.first + 1 > 0 AS cuts,
      list_reverse(u.toks[w.first:w.i]) AS rev
    FROM walked w JOIN unit_lines u ON u.doc_id = w.doc_id AND u.unit = w.unit WHERE w.i < len(u.ls)))),
parts AS (
  SELECT w.doc_id, w.unit, w.i, array_to_string(u.ls[w.first:w.i], chr(10)) AS content, w.start AS start_line,
    CASE WHEN w.i = len(u.ls) THEN u.end_line ELSE w.start + w.i - w.first END AS end_line, w.pos AS byte_start,
    CASE WHEN w.i = len(u.ls) THEN u.byte_end ELSE w.pos + strlen(array_to_string(u.ls[w.first:w.i], chr(10))) END AS byte_end,
    u.kind, u.name, w.tokens AS token_count
  FROM walked w JOIN unit_lines u ON u.doc_id = w.doc_id AND u.unit = w.unit
  LEFT JOIN walked x ON x.doc_id = w.doc_id AND x.unit = w.unit AND x.i = w.i + 1
  WHERE w.i > 0 AND (w.i = len(u.ls) OR x.cut))"""


_CHUNK_COLUMNS = "doc_id, content, start_line, end_line, byte_start, byte_end, kind, name, token_count"
_COLUMNS = ["doc_id", "content", "start_line", "end_line", "byte_start", "byte_end", "kind", "name", "token_count"]


@query("chunk_pack_budget", c.with_sql(_SPANS, _pack_sql(HARD, SOFT, "'function', 'class'"), _GROUPED, _big_sql(HARD), _split_sql("big_spans", SOFT, OVERLAP), select=f"""
SELECT {_CHUNK_COLUMNS} FROM grouped WHERE NOT big AND content <> '' UNION ALL SELECT {_CHUNK_COLUMNS} FROM parts"""))
def chunk_pack_budget(spark, folder):
    """Two-line spans packed into budgeted chunks, oversized ones split with overlap."""
    base = C.with_fixed_groups(c.table(spark, folder, "documents").select("doc_id", "text"), "text", 2, "spans")
    named = base.withColumn("spans", F.transform("spans", lambda x, i: struct(
        content=x["content"], start_line=x["start_line"], end_line=x["end_line"], byte_start=x["byte_start"], byte_end=x["byte_end"],
        kind=c._pick(i % 4, ["function", "class", "comment", None]),
        name=F.nullif(F.regexp_extract(x["content"], r"([\p{IsAlphabetic}]+)", 1), F.lit("")))))
    return C.chunk_rows(C.pack_spans(named, C.TokenBudget(HARD, OVERLAP)), "doc_id").select(*_COLUMNS)


_WHOLE = f"""whole AS (
  SELECT doc_id, 1 AS unit, ls, 1 AS start_line, len(ls) AS end_line, 0 AS byte_start, strlen(text) AS byte_end, 'function' AS kind, NULL::VARCHAR AS name, text
  FROM (SELECT doc_id, text, {_LS} AS ls FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)))"""


def _whole_units(spark, folder, kind="function"):
    """Every document as one span."""
    return c.table(spark, folder, "documents").select("doc_id", "text", struct(
        content=F.col("text"), start_line=F.lit(1), end_line=F.size(text.lines(F.col("text"))), byte_start=F.lit(0).cast("long"),
        byte_end=F.octet_length("text").cast("long"), kind=F.lit(kind), name=F.lit(None).cast("string")).alias("u"))


@query("split_overlap", c.with_sql(_WHOLE, _split_sql("(SELECT * FROM whole WHERE " + count_sql("text") + f" > {HARD})", SOFT, OVERLAP),
                                   select=f"SELECT {_CHUNK_COLUMNS} FROM parts"))
def split_overlap(spark, folder):
    """Documents above the limit, split by lines with overlap."""
    units = _whole_units(spark, folder).withColumn("spans", F.array("u")).drop("u")
    from ..functions import tokens

    large = units.filter(tokens.token_count(F.col("text")) > HARD)
    return C.chunk_rows(C.pack_spans(large, C.TokenBudget(HARD, OVERLAP)), "doc_id").select(*_COLUMNS)


@query("split_by_tokens", f"""
SELECT doc_id, k AS part, array_to_string(parts[k * {WINDOW} + 1:(k + 1) * {WINDOW}], '') AS content,
  (1 + (k * {WINDOW} * nl) // len(parts))::INTEGER AS start_line, len(parts[k * {WINDOW} + 1:(k + 1) * {WINDOW}])::INTEGER AS token_count,
  CASE WHEN k = 0 THEN 0 ELSE strlen(array_to_string(parts[1:k * {WINDOW}], '')) END AS byte_start FROM (
  SELECT doc_id, parts, nl, unnest(range(0, ceil(len(parts) / {WINDOW}::DOUBLE)::BIGINT)) AS k FROM (
    SELECT doc_id, regexp_extract_all(text, '(\\S+\\s*|\\s+)', 1) AS parts, len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS nl
    FROM documents WHERE {count_sql("text")} > {WINDOW}) WHERE len(parts) > {WINDOW})""")
def split_by_tokens(spark, folder):
    """Documents above the limit in windows of pieces."""
    long_ones = _whole_units(spark, folder).filter(F.size(C.pieces(F.col("text"))) > WINDOW)
    units = long_ones.select("doc_id", F.array("u").alias("spans"))
    rows = C.chunk_rows(C.split_large_spans(units, WINDOW), "doc_id").filter(F.col("kind") != "function")
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("part"), "content", "start_line", "token_count", "byte_start")


_HALVED = 100


@query("split_by_lines", c.with_sql(_WHOLE, select=f"""
SELECT doc_id, 'function_part1' AS kind, array_to_string(ls[1:n // 2 + least(10, n // 10)], chr(10)) AS content, 1 AS start_line,
  (1 + n // 2 + least(10, n // 10))::INTEGER AS end_line, 0 AS byte_start FROM (SELECT *, len(ls) AS n FROM whole) WHERE {count_sql("text")} > {_HALVED}
UNION ALL SELECT doc_id, 'function_part2', array_to_string(ls[n // 2 + 1:n], chr(10)), (1 + n // 2)::INTEGER, n::INTEGER,
  CASE WHEN n // 2 = 0 THEN 0 ELSE strlen(array_to_string(ls[1:n // 2], chr(10))) + 1 END FROM (SELECT *, len(ls) AS n FROM whole) WHERE {count_sql("text")} > {_HALVED}"""))
def split_by_lines(spark, folder):
    """The way of units that do not fall into pieces: two overlapping halves."""
    units = _whole_units(spark, folder).withColumn("spans", F.array("u"))
    one_piece = lambda content: F.array(content)
    rows = C.chunk_rows(C.split_large_spans(units, _HALVED, one_piece), "doc_id").filter(F.col("kind") != "function")
    return rows.select("doc_id", "kind", "content", "start_line", "end_line", "byte_start")


def _container_sql(limit: int) -> str:
    """Parts of `code_units` (doc_id, ls) above `limit`: runs of lines behind the header, `runs` (doc_id, r.f, r.t, head)."""
    return f"""headed AS (
  SELECT *, coalesce(list_min(list_filter(range(1, len(ls) + 1), lambda j: contains(ls[j], '{{') OR (j > 1 AND starts_with(ls[j], '    ')))), len(ls)) AS h FROM code_units
  WHERE {count_sql("array_to_string(ls, chr(10))")} > {limit}),
head_counts AS (SELECT *, {_classes("head")} FROM (SELECT *, array_to_string(ls[1:h], chr(10)) || chr(10) || '{C.CONTINUED}' AS head FROM headed)),
{_RECURSIVE} body AS (
  SELECT doc_id, h AS i, h + 1 AS first, 0 AS bw, 0 AS bs, 0 AS bp, 0 AS bo, []::STRUCT(f BIGINT, t BIGINT)[] AS done FROM head_counts
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN full_ THEN i + 2 ELSE first END, CASE WHEN full_ THEN 0 ELSE nw END, CASE WHEN full_ THEN 0 ELSE ns END,
    CASE WHEN full_ THEN 0 ELSE np END, CASE WHEN full_ THEN 0 ELSE no END,
    CASE WHEN full_ THEN list_append(done, {{'f': first, 't': i + 1}}) ELSE done END
  FROM (SELECT *, {_tokens('w + nw', 's + ns', 'p + np', 'o + no')} >= {limit} AS full_ FROM (
    SELECT b.*, u.w, u.s, u.p, u.o, (b.bw + {_n('u.ls[b.i + 1]', _W)})::INTEGER AS nw, (b.bs + {_n('u.ls[b.i + 1]', _S)} + 1)::INTEGER AS ns,
      (b.bp + {_n('u.ls[b.i + 1]', _P)})::INTEGER AS np,
      (b.bo + length(u.ls[b.i + 1]) - {_n('u.ls[b.i + 1]', _W)} - {_n('u.ls[b.i + 1]', _S)} - {_n('u.ls[b.i + 1]', _P)})::INTEGER AS no
    FROM body b JOIN head_counts u ON u.doc_id = b.doc_id WHERE b.i < len(u.ls)))),
runs AS (
  SELECT doc_id, ls, head, unnest(CASE WHEN first <= len(ls) THEN list_append(done, {{'f': first, 't': len(ls)}}) ELSE done END) AS r
  FROM body JOIN head_counts USING (doc_id) WHERE i = len(ls))"""


_CODE_UNITS = "code_units AS (SELECT doc_id, list(code ORDER BY k) AS ls FROM code_lines GROUP BY doc_id)"


@query("split_container", c.with_sql(c.FILES, c.CODE, _CODE_UNITS, _container_sql(PART_TOKENS), select="""
SELECT doc_id, r.f AS start_line, r.t AS end_line, head || chr(10) || array_to_string(ls[r.f:r.t], chr(10)) AS content,
  strlen(array_to_string(ls[1:r.f - 1], chr(10))) + 1 AS byte_start FROM runs"""))
def split_container(spark, folder):
    """Source files taken as one class each: header repeated over runs of its body."""
    from ..functions import tokens

    units = c.code_files(spark, folder).filter(tokens.token_count(F.col("file_content")) > PART_TOKENS).select("doc_id", struct(
        content=F.col("file_content"), start_line=F.lit(1), end_line=F.size(text.lines(F.col("file_content"))),
        byte_start=F.lit(0).cast("long"), byte_end=F.octet_length("file_content").cast("long"), kind=F.lit("class"),
        name=F.lit("c")).alias("u"))
    parts = C.chunk_rows(C.split_large_spans(units.select("doc_id", F.array("u").alias("spans")), PART_TOKENS), "doc_id")
    return parts.filter(F.col("kind") == "class_part").select(
        "doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "content", "byte_start")


# ------------------------------------------------------------------- parsing

_PREFIX = {"rust": "fn |pub fn|pub\\(crate\\) fn|async fn", "python": "def |async def ",
           "javascript": "function |async function |const |let |var ", "go": "func ",
           "java": "public |private |protected |static ", "c": "int |void |char |float |double |static "}
_CLASS = {"rust": "struct |enum |trait |impl ", "python": "class ", "javascript": "class ", "go": "type |struct |interface ",
          "java": "class |interface |enum ", "c": "struct |typedef |enum |union "}


def _starts(prefixes: dict[str, str]) -> str:
    return "(CASE language " + " ".join(f"WHEN '{lang}' THEN regexp_matches(bare, '^({p})')" for lang, p in prefixes.items()) + " END)"


_NAME_SQL = "regexp_replace(regexp_extract(bare, '(?:^|\\s)(?:def|fn|function|func|class|struct|interface|impl|trait)\\s+(\\S+)', 1), '<*\\{*:*\\(*$', '')"

_FACTS = f"""facts AS (
  SELECT *, CASE WHEN fn OR cl THEN nullif({_NAME_SQL}, '') END AS name,
    [len(replace(substr(m, 1, j), '-', '')) - len(replace(substr(m, 1, j), '+', '')) FOR j IN range(1, length(m) + 1) IF substr(m, j, 1) = '-'] AS closers,
    len(replace(m, '-', '')) - len(replace(m, '+', '')) AS delta
  FROM (SELECT *, {_starts(_PREFIX)} AS fn, {_starts(_CLASS)} AS cl,
      CASE WHEN language = 'python' THEN '' ELSE translate(regexp_replace(code, '[^(){{}}\\[\\]]', '', 'g'), '([{{)]}}', '+++---') END AS m
    FROM (SELECT *, k + 1 AS no, trim(code) AS bare, length(code) - length(ltrim(code)) AS ind, strlen(code) AS bytes, {_classes('code')} FROM code_lines)))"""

_S_TYPE = "STRUCT(f BIGINT, n BIGINT, a BIGINT, b BIGINT, kind VARCHAR, name VARCHAR)[]"
_KIND = "CASE WHEN cl THEN 'class' ELSE 'function' END"


def _span_sql(n: str, b: str, kind: str, name: str) -> str:
    return f"{{'f': f, 'n': {n}, 'a': start, 'b': {b}, 'kind': {kind}, 'name': {name}}}"


# One recursion step, inside out: definition start, push, close, flush.
_MACHINE = f"""{_RECURSIVE} machine AS (
  SELECT doc_id, language, 0::BIGINT AS i, 0::BIGINT AS f, 0::BIGINT AS n, 1::BIGINT AS start, 0::BIGINT AS depth, 0::BIGINT AS indent, false AS fn, false AS cl, NULL::VARCHAR AS name,
    0::BIGINT AS w, 0::BIGINT AS s, 0::BIGINT AS p, 0::BIGINT AS o, []::{_S_TYPE} AS out FROM (SELECT DISTINCT doc_id, language FROM code_lines)
  UNION ALL
  SELECT doc_id, language, i, f, CASE WHEN flush THEN 0 ELSE n END, CASE WHEN flush THEN i + 1 ELSE start END, depth, indent, fn, cl, name, w, s, p, o,
    CASE WHEN flush THEN list_append(out, {_span_sql('n', 'i', 'NULL', 'NULL')}) ELSE out END
  FROM (SELECT *, NOT fn AND NOT cl AND n > 0 AND {_tokens('w', 's', 'p', 'o')} >= {FLUSH} AS flush FROM (
    SELECT doc_id, language, i, CASE WHEN dedent THEN i ELSE f END AS f, CASE WHEN hit THEN 0 WHEN dedent THEN 1 ELSE n END AS n,
      CASE WHEN hit THEN i + 1 WHEN dedent THEN i ELSE start END AS start, depth + delta AS depth, indent,
      fn AND NOT hit AND NOT dedent AS fn, cl AND NOT hit AND NOT dedent AS cl, CASE WHEN hit OR dedent THEN NULL ELSE name END AS name,
      CASE WHEN dedent THEN lw ELSE w END AS w, CASE WHEN dedent THEN lsp ELSE s END AS s, CASE WHEN dedent THEN lp ELSE p END AS p, CASE WHEN dedent THEN lo ELSE o END AS o,
      CASE WHEN hit THEN list_append(out, {_span_sql('n', 'i', _KIND, 'name')})
           WHEN dedent THEN list_append(out, {_span_sql('n - 1', 'i - 1', _KIND, 'name')}) ELSE out END AS out
    FROM (SELECT *, (fn OR cl) AND language <> 'python' AND list_contains(closers, -depth) AS hit,
        (fn OR cl) AND language = 'python' AND ind <= indent AND bare <> '' AS dedent FROM (
      SELECT * EXCLUDE (f, n, w, s, p, o), CASE WHEN n = 0 THEN i ELSE f END AS f, n + 1 AS n,
        CASE WHEN n = 0 THEN lw ELSE w + lw END AS w, CASE WHEN n = 0 THEN lsp ELSE s + lsp + 1 END AS s,
        CASE WHEN n = 0 THEN lp ELSE p + lp END AS p, CASE WHEN n = 0 THEN lo ELSE o + lo END AS o
      FROM (SELECT m.doc_id, m.language, x.no AS i, m.f, CASE WHEN (x.fn OR x.cl) AND m.n > 0 AND (m.fn OR m.cl) THEN 0 ELSE m.n END AS n,
          CASE WHEN x.fn OR x.cl THEN x.no ELSE m.start END AS start, CASE WHEN x.fn OR x.cl THEN 0 ELSE m.depth END AS depth,
          CASE WHEN x.fn OR x.cl THEN x.ind ELSE m.indent END AS indent, CASE WHEN x.fn OR x.cl THEN x.fn ELSE m.fn END AS fn,
          CASE WHEN x.fn OR x.cl THEN x.cl ELSE m.cl END AS cl, CASE WHEN x.fn OR x.cl THEN x.name ELSE m.name END AS name,
          m.w, m.s, m.p, m.o, x.w AS lw, x.s AS lsp, x.p AS lp, x.o AS lo, x.delta, x.closers, x.ind, x.bare,
          CASE WHEN (x.fn OR x.cl) AND m.n > 0 AND (m.fn OR m.cl)
            THEN list_append(m.out, {{'f': m.f, 'n': m.n, 'a': m.start, 'b': x.no - 1, 'kind': CASE WHEN m.cl THEN 'class' ELSE 'function' END, 'name': m.name}})
            ELSE m.out END AS out
        FROM machine m JOIN facts x ON x.doc_id = m.doc_id AND x.no = m.i + 1)))))),
ends AS (SELECT doc_id, max(no) AS last_line FROM facts GROUP BY doc_id),
machine_spans AS (
  SELECT doc_id, unnest(CASE WHEN n > 0 THEN list_append(out, {_span_sql('n', 'i', "CASE WHEN fn THEN 'function' WHEN cl THEN 'class' END", 'CASE WHEN fn OR cl THEN name END')}) ELSE out END) AS x
  FROM machine JOIN ends USING (doc_id) WHERE i = last_line),
bodies AS (SELECT doc_id, list(code ORDER BY k) AS ls FROM code_lines GROUP BY doc_id)"""


def _spans(df):
    return C.rows_of(df, "spans", "i", "doc_id").select(
        "doc_id", "kind", "name", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"),
        "content", F.col("byte_start"))


@query("parse_heuristic", c.with_sql(c.FILES, c.CODE, _FACTS, _MACHINE, select="""
SELECT doc_id, x.kind AS kind, x.name AS name, x.a AS start_line, x.b AS end_line,
  CASE WHEN x.n > 0 THEN array_to_string(ls[x.f:x.f + x.n - 1], chr(10)) ELSE '' END AS content,
  CASE WHEN x.f = 1 THEN 0 ELSE strlen(array_to_string(ls[1:x.f - 1], chr(10))) + 1 END AS byte_start
FROM machine_spans JOIN bodies USING (doc_id)"""))
def parse_heuristic(spark, folder):
    """The line machine over every source file."""
    return _spans(P.parse_spans(c.code_files(spark, folder), "heuristic", FLUSH))


# Definitions: strings and comments are cut out as tokens, heads read line by line, ends found by nesting or indentation.
_STRING_SQL = r'"(?:\\.|[^"\\])*"'
_TOKEN_SQL = {
    "python": r'"""(?:\\.|.)*?"""|' + _STRING_SQL + r'|#[^\n]*|[^"#]+|.',
    "rust": r'r#".*?"#|' + _STRING_SQL + r'|//[^\n]*|/\*.*?(?:/\*.*?\*/.*?)?\*/|[^"/r]+|.',
    "javascript": r'`(?:\\.|[^`\\])*`|' + _STRING_SQL + r'|//[^\n]*|/\*.*?\*/|[^"`/]+|.',
    "other": _STRING_SQL + r'|//[^\n]*|/\*.*?\*/|[^"/]+|.',
}
_NAME_OF = r"([\p{L}\p{N}_$]+)"
_HEAD_OF = {
    "rust": rf"^\s*(?:pub |async )*(fn|impl) {_NAME_OF}", "python": rf"^\s*(?:async )?(def|class) {_NAME_OF}",
    "javascript": rf"^\s*(?:export |default |async )*(?:(function|class) )?{_NAME_OF}(?:\(a\))? \{{", "go": rf"^\s*(func|type) {_NAME_OF}",
    "java": rf"^\s*(?:public |static |final |private )*(class|int|void) {_NAME_OF}", "c": rf"^\s*(?:static )?(struct|int) {_NAME_OF}",
}
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _by_language(value, table) -> str:
    return "CASE language " + " ".join(f"WHEN '{lang}' THEN {value(p)}" for lang, p in table.items() if lang != "other") + (
        f" ELSE {value(table['other'])}" if "other" in table else "") + " END"


_BLOCKS = f"""code_text AS MATERIALIZED (SELECT doc_id, language, string_agg(code, chr(10) ORDER BY k) AS code FROM code_lines GROUP BY doc_id, language),
code_masked AS (
  SELECT doc_id, language, code, array_to_string(list_transform({_by_language(lambda p: f"regexp_extract_all(code, '(?s){p}')", _TOKEN_SQL)},
    lambda t: CASE WHEN starts_with(t, '//') OR starts_with(t, '/*') OR (language = 'python' AND starts_with(t, '#')) THEN regexp_replace(t, '[^\n]', ' ', 'g')
      WHEN left(t, 1) IN ('"', '`') OR starts_with(t, 'r#"') THEN '"' || regexp_replace(substr(t, 2), '[^\n]', chr(1), 'g') ELSE t END), '') AS masked
  FROM code_text),
seen AS MATERIALIZED (
  SELECT *, coalesce(sum(strlen(raw) + 1) OVER before_it, 0)::BIGINT AS at_byte, coalesce(sum(length(raw) + 1) OVER before_it, 0)::BIGINT AS at_char,
    length(m) - length(ltrim(m)) AS ind, sum(length(m) - length(replace(m, '{{', '')) - length(m) + length(replace(m, '}}', ''))) OVER (PARTITION BY doc_id ORDER BY no) AS after_,
    {_by_language(lambda p: f"regexp_extract(m, '{p}', 1)", _HEAD_OF)} AS kw, {_by_language(lambda p: f"regexp_extract(m, '{p}', 2)", _HEAD_OF)} AS ident
  FROM (SELECT doc_id, language, unnest(string_split(code, chr(10))) AS raw, unnest(string_split(masked, chr(10))) AS m, unnest(range(1, len(string_split(code, chr(10))) + 1)) AS no FROM code_masked)
  WINDOW before_it AS (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
heads AS (
  SELECT *, kw IN ('impl', 'class', 'type', 'struct') AS holder, coalesce(lag(after_) OVER (PARTITION BY doc_id ORDER BY no), 0) AS before_ FROM seen),
closed AS (
  SELECT d.doc_id, d.no, min(CASE WHEN d.language = 'python' THEN CASE WHEN trim(e.m) <> '' AND left(e.m, 1) <> chr(1) AND e.ind <= d.ind THEN e.no END
    WHEN e.after_ <= d.before_ THEN e.no END) AS stop
  FROM heads d LEFT JOIN seen e ON e.doc_id = d.doc_id AND e.no > d.no WHERE d.ident <> '' GROUP BY d.doc_id, d.no),
ended AS (
  SELECT c.doc_id, c.no, max(e.no) AS last_ FROM closed c JOIN seen e ON e.doc_id = c.doc_id AND e.no >= c.no
    AND CASE WHEN e.language = 'python' THEN e.no < coalesce(c.stop, 1000000000) AND trim(e.m) <> '' ELSE e.no <= coalesce(c.stop, 1000000000) AND trim(e.raw, {_WS}) <> '' END
  GROUP BY c.doc_id, c.no),
blocks AS MATERIALIZED (
  SELECT h.doc_id, h.no, h.kw, h.holder, h.ident, e.last_, h.at_byte + h.ind AS byte_start, l.at_byte + strlen(rtrim(l.raw, {_WS})) AS byte_end,
    h.at_char + h.ind AS char_start, l.at_char + length(rtrim(l.raw, {_WS})) AS char_end
  FROM heads h JOIN ended e ON e.doc_id = h.doc_id AND e.no = h.no JOIN seen l ON l.doc_id = e.doc_id AND l.no = e.last_),
within AS (
  SELECT b.doc_id, b.no, bool_or(o.no IS NOT NULL) AS nested, bool_or(coalesce(o.holder, false)) AS held
  FROM blocks b LEFT JOIN blocks o ON o.doc_id = b.doc_id AND o.no < b.no AND b.no <= o.last_ GROUP BY b.doc_id, b.no),
outer_blocks AS (SELECT b.* FROM blocks b JOIN within w ON w.doc_id = b.doc_id AND w.no = b.no WHERE NOT nested),
gaps AS (
  SELECT doc_id, code, coalesce(lag(char_end) OVER (PARTITION BY doc_id ORDER BY no), 0) AS a, char_start AS b FROM outer_blocks JOIN code_text USING (doc_id)
  UNION ALL SELECT doc_id, any_value(code), max(char_end), any_value(length(code)) FROM outer_blocks JOIN code_text USING (doc_id) GROUP BY doc_id),
gap_texts AS (
  SELECT doc_id, code, trim(part, {_WS}) AS content, a + length(part) - length(ltrim(part, {_WS})) AS c FROM (SELECT *, substr(code, a + 1, b - a) AS part FROM gaps)),
code_spans AS MATERIALIZED (
  SELECT b.doc_id, CASE WHEN holder THEN kw WHEN held THEN 'method' ELSE 'function' END AS kind, ident AS name, b.no::BIGINT AS start_line, last_::BIGINT AS end_line,
    substr(code, char_start + 1, char_end - char_start) AS content, byte_start, byte_end
  FROM blocks b JOIN within w ON w.doc_id = b.doc_id AND w.no = b.no JOIN code_text t ON t.doc_id = b.doc_id
  UNION ALL
  SELECT doc_id, NULL, NULL, 1 + length(left(code, c)) - length(replace(left(code, c), chr(10), '')), 1 + length(left(code, c + length(content))) - length(replace(left(code, c + length(content)), chr(10), '')),
    content, strlen(left(code, c)), strlen(left(code, c + length(content)))
  FROM gap_texts WHERE regexp_matches(content, '[0-9A-Za-z]|[^\\x00-\\x7F]'))"""


@query("parse_definitions", c.with_sql(c.FILES, c.CODE, _BLOCKS, select="SELECT doc_id, kind, name, start_line, end_line, content, byte_start FROM code_spans"))
def parse_definitions(spark, folder):
    """Whole definitions of every source file, and what lies between them."""
    return _spans(P.parse_spans(c.code_files(spark, folder)))


@query("parse_cover", c.with_sql(c.FILES, c.CODE, select="""
SELECT doc_id, length(regexp_replace(string_agg(code, chr(10)), '[^\\p{L}\\p{N}]', '', 'g'))::BIGINT AS told, 0::BIGINT AS lost FROM code_lines GROUP BY doc_id"""))
def parse_cover(spark, folder):
    """Letters and digits of every source file, and how many of them no span holds."""
    known = P.parse_spans(c.code_files(spark, folder)).filter(F.size("spans") > 0)
    part = lambda a, b: F.substring(F.col("_raw"), a.cast("int") + 1, (b - a).cast("int")).cast("string")
    bare = lambda value: F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    # spans by their beginning; what lies between the furthest end so far and the next beginning is in none
    reach = F.aggregate("_spans", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("lost")), lambda acc, s: F.struct(
        F.greatest(acc["at"], s["byte_end"]).alias("at"), F.when(s["byte_start"] > acc["at"], F.concat(acc["lost"], bare(part(acc["at"], s["byte_start"])))).otherwise(acc["lost"]).alias("lost")))
    seen = known.select("doc_id", "file_content", F.col("file_content").cast("binary").alias("_raw"), F.sort_array(F.transform("spans", lambda s: F.struct(
        s["byte_start"].alias("byte_start"), s["byte_end"].alias("byte_end")))).alias("_spans")).withColumn("_reach", reach)
    rest = F.concat(F.col("_reach")["lost"], bare(part(F.col("_reach")["at"], F.octet_length("file_content").cast("long"))))
    return seen.select("doc_id", F.char_length(bare(F.col("file_content"))).cast("long").alias("told"), F.char_length(rest).cast("long").alias("lost"))


@query("definition_names", c.with_sql(c.FILES, c.CODE, _FACTS, select="SELECT doc_id, no AS line, fn AS is_function, cl AS is_class, name FROM facts"))
def definition_names(spark, folder):
    lined = C.rows_of(P.with_lines(c.code_files(spark, folder)), "_facts", "i", "doc_id")
    bit = lambda value: F.col("flags").bitwiseAND(value) > 0
    return lined.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), bit(walks.FUNCTION).alias("is_function"),
                        bit(walks.CLASS).alias("is_class"), "name")


def _paragraphs(content, language, path):
    """Blank lines part spans: a parser as a user might bring one."""
    import re

    code = content.encode()
    for m in re.finditer(rb"[^\n]+(?:\n[^\n]+)*", code):
        yield *m.span(), "paragraph", None


def _lines_of_use(content, language, path):
    at = 0
    for line in content.split("\n"):
        size = len(line.encode())
        if line.startswith("use "):
            yield at, at + size, "import", line[4:].rstrip(";")
        at += size + 1


@query("parse_table_function", c.with_sql(c.FILES, c.CODE, _BLOCKS, select="""
SELECT doc_id, 'fallback' AS parser, kind, name, start_line, end_line, content, byte_start FROM code_spans JOIN code_text USING (doc_id) WHERE language NOT IN ('python', 'go', 'c')
UNION ALL
SELECT doc_id, 'imports', 'import', rtrim(substr(raw, 5), ';'), no, no, raw, at_byte FROM seen WHERE language IN ('go', 'c') AND starts_with(raw, 'use ')
UNION ALL
SELECT doc_id, 'paragraphs', 'paragraph', NULL, min(no), max(no), string_agg(raw, chr(10) ORDER BY no), min(at_byte) FROM (
  SELECT *, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS island FROM seen WHERE language = 'python' AND raw <> '') GROUP BY doc_id, island"""))
def parse_table_function(spark, folder):
    """Every source file once through two parsers of a user's own and the library's for the rest."""
    parsers.register_parsers(spark, "parse_code_files", [("paragraphs", {"python"}, _paragraphs), ("imports", {"go", "c", "python"}, _lines_of_use)])
    rows = parsers.span_rows(c.code_files(spark, folder).select("doc_id", "file_path", "file_content", "language"), "parse_code_files", "doc_id")
    return rows.select("doc_id", "parser", "kind", "name", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "content", "byte_start")


_TAG_SQL = (r"(?is)<!--.*?-->|<[!?][^>]*>|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|</[a-z][\w:.-]*[^>]*>"
            r'''|<[a-z][\w:.-]*(?:"[^"]*"|\''[^\'']*\''|[^<>"\''])*>|[^<]+|<''')
_ELEMENT = "STRUCT(a BIGINT, b BIGINT, name VARCHAR)[]"
_ENDED_SQL = "(CASE open_[-1].name " + " ".join(f"WHEN '{a}' THEN tag IN ({', '.join(repr(b) for b in bs)})" for a, bs in markup.ENDED_BY.items()) + " ELSE false END)"

# Tags one after the other, with the open elements in a list.
_ELEMENTS = f"""page_tokens AS (
  SELECT page_id, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS no FROM (SELECT page_id, regexp_extract_all(html, '{_TAG_SQL}') AS tokens FROM pages)),
page_places AS (
  SELECT *, sum(length(token)) OVER (PARTITION BY page_id ORDER BY no) AS b FROM page_tokens),
page_tags AS MATERIALIZED (
  SELECT page_id, b - length(token) AS a, b, row_number() OVER (PARTITION BY page_id ORDER BY no) AS k, lower(regexp_extract(token, '^</?([A-Za-z][\\w:.-]*)', 1)) AS tag,
    starts_with(token, '</') AS ends FROM page_places WHERE regexp_matches(token, '^</?[A-Za-z]')),
{_RECURSIVE} page_walk AS (
  SELECT page_id, 0::BIGINT AS k, []::{_ELEMENT} AS open_, []::{_ELEMENT} AS done FROM pages
  UNION ALL
  SELECT page_id, k, CASE WHEN ends THEN CASE WHEN hit > 0 THEN open_[:hit - 1] ELSE open_ END WHEN alone THEN kept ELSE list_append(kept, {{'a': a, 'b': NULL::BIGINT, 'name': tag}}) END,
    CASE WHEN ends AND hit > 0 THEN list_concat(done, list_transform(open_[hit:], lambda x, i: {{'a': x.a, 'b': CASE WHEN i = 1 THEN b ELSE a END, 'name': x.name}}))
      WHEN ends THEN done
      ELSE list_concat(done, CASE WHEN ended THEN [{{'a': open_[-1].a, 'b': a, 'name': open_[-1].name}}] ELSE [] END, CASE WHEN alone THEN [{{'a': a, 'b': b, 'name': tag}}] ELSE [] END) END
  FROM (SELECT *, CASE WHEN ended THEN open_[:-2] ELSE open_ END AS kept FROM (
    SELECT w.page_id, t.k, w.open_, w.done, t.a::BIGINT AS a, t.b::BIGINT AS b, t.tag, t.ends, t.tag IN ({', '.join(repr(v) for v in (*markup.VOID, 'script', 'style'))}) AS alone,
      coalesce(list_max(list_filter(range(1, len(w.open_) + 1), lambda i: w.open_[i].name = t.tag)), 0) AS hit, NOT t.ends AND len(w.open_) > 0 AND coalesce({_ENDED_SQL}, false) AS ended
    FROM page_walk w JOIN page_tags t ON t.page_id = w.page_id AND t.k = w.k + 1))),
page_ends AS (SELECT page_id, max(k) AS last_ FROM page_walk GROUP BY page_id),
page_elements AS (
  SELECT page_id, html, unnest(list_concat(done, list_transform(open_, lambda x: {{'a': x.a, 'b': length(html)::BIGINT, 'name': x.name}}))) AS x
  FROM page_walk JOIN page_ends USING (page_id) JOIN pages USING (page_id) WHERE k = last_),
page_outer AS (
  SELECT page_id, html, x.a AS a, max(x.b) OVER (PARTITION BY page_id ORDER BY x.a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM page_elements
  UNION ALL SELECT page_id, any_value(html), any_value(length(html)), max(x.b) FROM page_elements GROUP BY page_id),
page_gaps AS (SELECT page_id, trim(substr(html, coalesce(reach, 0) + 1, a - coalesce(reach, 0)), {_WS}) AS content FROM page_outer WHERE a > coalesce(reach, 0))"""


@query("parse_html", c.with_sql(_ELEMENTS, select="""
SELECT page_id, CASE WHEN x.name IN ('script', 'style') THEN x.name ELSE 'element' END AS kind, x.name AS name, substr(html, x.a + 1, x.b - x.a) AS content, strlen(left(html, x.a)) AS byte_start FROM page_elements
UNION ALL SELECT page_id, NULL, NULL, content, NULL FROM page_gaps WHERE regexp_matches(content, '[0-9A-Za-z]|[^\\x00-\\x7F]')"""))
def parse_html(spark, folder):
    """Elements of every page, nested ones too, and what lies outside of any."""
    pages = c.table(spark, folder, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"), F.col("html").alias("file_content"))
    rows = C.rows_of(P.parse_spans(pages), "spans", "i", "page_id")
    return rows.select("page_id", "kind", F.lower("name").alias("name"), "content", F.when(F.col("kind").isNotNull(), F.col("byte_start")).alias("byte_start"))
