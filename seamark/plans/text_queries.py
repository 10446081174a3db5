"""Hashes, ids, urls, paths, languages, lines, highlights, token counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, languages, paths, ranking, text, tokens
from ..operators import changes, context, payload
from ..operators import search as S
from . import corpus as c
from .registry import query

WORD = "the"


def _docs(spark, folder):
    return c.table(spark, folder, "documents")


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, folder):
    return _docs(spark, folder).select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))


@query("chunk_ids", c.with_sql(c.FILES, c.CHUNKS, select="SELECT doc_id, chunk_index, chunk_id FROM chunks"))
def chunk_ids(spark, folder):
    return c.chunks(spark, folder, with_content=False).select("doc_id", "chunk_index", "chunk_id")


_FORMS = ["https://Git.Example.com/{}/Repo.git", "git@git.example.com:{}/repo.git", "ssh://git@git.example.com/{}/repo.git",
          "https://user:pass@git.example.com/{}/repo.git", "HTTP://GIT.EXAMPLE.COM/{}/REPO", "git://git.example.com/{}/repo.git.git"]


@query("git_url_normalize", f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^(https?://)[^@]*:[^@]*@', '\\1'),
    '^(https://)*(http://)*(git://)*(ssh://)*(git@)*', ''), '^([^:/]*):', '\\1/'), '(\\.git)+$', '') AS repository_id
FROM (SELECT doc_id, replace({c._pick_sql('doc_id % 6', _FORMS)}, '{{}}', source) AS url FROM documents)""")
def git_url_normalize(spark, folder):
    url = F.replace(c._pick(F.col("doc_id") % 6, _FORMS), F.lit("{}"), F.col("source"))
    return _docs(spark, folder).select("doc_id", paths.normalize_git_url(url).alias("repository_id"))


@query("page_url_normalize", """
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^(https?://)[^@]*:[^@]*@', '\\1'),
    '^(https://)*(http://)*(git://)*(ssh://)*(git@)*', ''), '^([^:/]*):', '\\1/'), '(\\.git)+$', '') AS normalized,
  regexp_extract(url, '[^/]*$') AS last_segment FROM pages""")
def page_url_normalize(spark, folder):
    return c.table(spark, folder, "pages").select(
        "page_id", paths.normalize_git_url(F.col("url")).alias("normalized"), paths.repository_name(F.col("url")).alias("last_segment"))


_RAW = ["{}", "/{}", "../{}", "./a//{}", "a/../{}", "a/./b/{}/", "..{}"]
_RAW_SQL = f"replace({c._pick_sql('doc_id % 7', _RAW)}, '{{}}', file_path)"


def _raw_paths(spark, folder):
    return c.files(spark, folder).select("doc_id", F.replace(
        c._pick(F.col("doc_id") % 7, _RAW), F.lit("{}"), F.col("file_path")).alias("p"))


@query("path_sanitize", c.with_sql(c.FILES, select=f"""
SELECT doc_id, array_to_string(list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.', '..')), '/') AS sanitized,
  NOT regexp_matches(p, '^/|(^|/)\\.\\.(/|$)') AS safe FROM (SELECT doc_id, {_RAW_SQL} AS p FROM files)"""))
def path_sanitize(spark, folder):
    return _raw_paths(spark, folder).select(
        "doc_id", paths.sanitize(F.col("p")).alias("sanitized"), paths.is_safe_relative(F.col("p")).alias("safe"))


@query("path_resolve", c.with_sql(c.FILES, select=f"""
SELECT doc_id, CASE WHEN NOT regexp_matches(p, '^/|(^|/)\\.\\.(/|$)')
  THEN '/base/dir/' || array_to_string(list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.')), '/') END AS resolved
FROM (SELECT doc_id, {_RAW_SQL} AS p FROM files)"""))
def path_resolve(spark, folder):
    return _raw_paths(spark, folder).select("doc_id", paths.resolve_within(F.col("p"), "/base/./dir").alias("resolved"))


@query("path_relativize", c.with_sql(c.FILES, select="""
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN replace(file_path, 'doc', 'a/doc') END AS relative, '/repo/' || file_path AS absolute FROM files"""))
def path_relativize(spark, folder):
    root = F.when(F.col("doc_id") % 3 == 0, "/elsewhere/").otherwise("/repo/")
    given = F.concat(root, F.replace(F.col("file_path"), F.lit("doc"), F.lit("a\\doc")))
    return c.files(spark, folder).select(
        "doc_id", paths.relativize(given, "/repo").alias("relative"), paths.absolutize(F.col("file_path"), "/repo/").alias("absolute"))


@query("path_parts", c.with_sql(c.FILES, select="""
SELECT doc_id, regexp_extract(file_path, '[^/]*$') AS base_name, regexp_extract(file_path, '\\.([^.]*)$', 1) AS extension,
  len(list_intersect(string_split(file_path, '/'), ['test','tests','spec','specs','mock','mocks','generated','fixtures'])) > 0 AS is_test FROM files"""))
def path_parts(spark, folder):
    p = F.col("file_path")
    return c.files(spark, folder).select(
        "doc_id", paths.base_name(p).alias("base_name"), paths.extension(p).alias("extension"), paths.is_test_path(p).alias("is_test"))


@query("language_detect", c.with_sql(c.FILES, select=f"""
SELECT doc_id, {c._LANG_SQL} AS language, CASE regexp_extract(file_path, '\\.([^.]*)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python'
  WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'h' THEN 'cpp' END AS excerpt_language FROM files"""))
def language_detect(spark, folder):
    p = F.col("file_path")
    return c.files(spark, folder).select(
        "doc_id", languages.language_of(p).alias("language"), languages.excerpt_language(p).alias("excerpt_language"))


@query("project_id_split", c.with_sql(c.FILES, select="""
SELECT doc_id, repository_id, CASE WHEN doc_id % 4 = 0 THEN 'main' ELSE branch || ':x' END AS branch,
  'local/' || author || '/' || repository_id AS local_id FROM files"""))
def project_id_split(spark, folder):
    project = F.when(F.col("doc_id") % 4 == 0, F.col("repository_id")).otherwise(
        F.concat("repository_id", F.lit(":"), "branch", F.lit(":x")))
    repository, branch = paths.split_project_id(project)
    return c.files(spark, folder).select("doc_id", repository.alias("repository_id"), branch.alias("branch"), paths.local_repository_id(
        F.col("author"), F.col("repository_id")).alias("local_id"))


def _highlight_sql(size: str) -> str:
    return f"""
SELECT doc_id, start, start + {len(WORD)} AS "end" FROM (
  SELECT doc_id, (sum({size}(part)) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * {len(WORD)})::INTEGER AS start, i, n FROM (
    SELECT doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i, len(parts) AS n
    FROM (SELECT doc_id, string_split(lower(text), '{WORD}') AS parts FROM documents))) WHERE i < n"""


@query("highlights", _highlight_sql("strlen"))
def highlights(spark, folder):
    return _docs(spark, folder).select("doc_id", F.inline(text.highlight_ranges(F.col("text"), WORD)))


@query("highlights_chars", _highlight_sql("length"))
def highlights_chars(spark, folder):
    return _docs(spark, folder).select("doc_id", F.inline(text.highlight_char_ranges(F.col("text"), WORD)))


_LINES = "SELECT doc_id, source, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS ls FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)"


@query("context_window", c.with_sql(c.FILES, select="""
SELECT doc_id, CASE WHEN n = 0 THEN '' WHEN n >= 10 THEN array_to_string(ls[7:least(13, n)], chr(10)) ELSE array_to_string(ls, chr(10)) END AS content,
  CASE WHEN n = 0 THEN 0 WHEN n >= 10 THEN 7 ELSE 1 END AS line_start, CASE WHEN n >= 10 THEN least(13, n) ELSE n END AS line_end, 10 AS requested, n AS total, size_bytes
FROM (SELECT *, len(ls) AS n FROM (SELECT doc_id, size_bytes, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS ls
  FROM (SELECT doc_id, size_bytes, string_split(file_content, chr(10)) AS l FROM files)))"""))
def context_window(spark, folder):
    f = c.files(spark, folder)
    cut = context.excerpt(f, line=10, radius=3, keep=("doc_id",))
    return cut.select("doc_id", "content", F.col("lines.start").alias("line_start"), F.col("lines.end").alias("line_end"),
                        F.col("lines.requested").alias("requested"), F.col("lines.total").alias("total"), "size_bytes")


@query("surrounding_lines", f"""
SELECT doc_id, CASE WHEN least(s - 1, len(ls)) >= greatest(s - 3, 1) THEN array_to_string(ls[greatest(s - 3, 1):s - 1], chr(10)) END AS before,
  CASE WHEN len(ls) > e THEN array_to_string(ls[e + 1:e + 3], chr(10)) END AS after
FROM (SELECT *, (1 + doc_id % 6)::INTEGER AS s, (4 + doc_id % 6)::INTEGER AS e FROM ({_LINES}))""")
def surrounding_lines(spark, folder):
    s = (1 + F.col("doc_id") % 6).cast("int")
    lined = _docs(spark, folder).select("doc_id", text.lines(F.col("text")).alias("_l"))
    return lined.select("doc_id", text.surrounding_lines(F.col("_l"), s, s + 3).alias("x")).select("doc_id", "x.before", "x.after")


@query("symbols", c.with_sql(c.POINTS, select="""
SELECT vec_id, concat_ws(' ', name, CASE WHEN kind IS NOT NULL THEN kind || ':' || coalesce(name, 'anonymous') END) AS symbols FROM points"""))
def symbols(spark, folder):
    return c.points(spark, folder).select("vec_id", F.array_join(text.symbols(F.col("name"), F.col("kind")), " ").alias("symbols"))


@query("repo_commit", c.with_sql(c.POINTS, select="""
SELECT vec_id, regexp_extract(repository_url, '[^/]*$') AS repository,
  CASE WHEN commit_sha IS NOT NULL THEN commit_sha || '|' || commit_message || '|' || author || '|' || strftime(commit_date, '%Y-%m-%d %H:%M:%S UTC') END AS "commit"
FROM points"""))
def repo_commit(spark, folder):
    p = c.points(spark, folder)
    repository, commit = S.repo_commit(p)
    return p.select("vec_id", repository.alias("repository"), commit.alias("c")).select(
        "vec_id", "repository", F.when(F.col("c").isNotNull(), F.concat_ws("|", "c.sha", "c.message", "c.author", "c.date")).alias("commit"))


@query("symbol_normalize", c.with_sql(c.POINTS, select="SELECT vec_id, translate(lower(name), '_-', '') AS normalized FROM points"))
def symbol_normalize(spark, folder):
    return c.points(spark, folder).select("vec_id", ranking.normalize_symbol(F.col("name")).alias("normalized"))


_W, _S, _P = r"[\p{L}\p{N}]", r"[\s\p{Z}]", r"[!-/:-@\[-`{-~]"


def count_sql(column: str, ratio: str = "4.0") -> str:
    n = lambda cls: f"len(regexp_extract_all({column}, '{cls}'))"
    other = f"(length({column}) - {n(_W)} - {n(_S)} - {n(_P)})"
    return (f"ceil((({n(_W)}::DOUBLE / {ratio}::DOUBLE + {n(_P)} * 0.8::DOUBLE) + {other} * 0.9::DOUBLE) + {n(_S)} * 0.1::DOUBLE)::INTEGER")


@query("token_count_heuristic", f"SELECT doc_id, {count_sql('text')} AS tokens FROM documents")
def token_count(spark, folder):
    return _docs(spark, folder).select("doc_id", tokens.token_count(F.col("text")).alias("tokens"))


_SAMPLES = {"Hello world": 2, "The quick brown fox": 4, "Token counting is important": 5, "This is a longer sentence with more tokens": 9}
_RATIO = f"({sum(map(len, _SAMPLES))}::DOUBLE / {sum(_SAMPLES.values())})"


@query("token_count_calibrated", f"""
SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 2 ELSE {count_sql('text', _RATIO)} END AS tokens FROM documents""")
def token_count_calibrated(spark, folder):
    """Ratio from texts of known length; such a text returns its own count."""
    content = F.when(F.col("doc_id") % 50 == 0, "Hello world").otherwise(F.col("text"))
    return _docs(spark, folder).select("doc_id", tokens.token_count(content, tokens.calibrated_ratio(_SAMPLES), _SAMPLES).alias("tokens"))


@query("token_budget", f"SELECT doc_id, floor(n * 0.9::DOUBLE)::INTEGER AS soft, tokens > n AS over_hard FROM (SELECT doc_id, 512 AS n, {count_sql('text')} AS tokens FROM documents)")
def token_budget(spark, folder):
    counted = _docs(spark, folder).select("doc_id", tokens.token_count(F.col("text")).alias("t"))
    return counted.select("doc_id", F.lit(tokens.soft_limit(512)).alias("soft"), (F.col("t") > 512).alias("over_hard"))


@query("binary_reject", """
SELECT doc_id, doc_id % 4 = 0 OR contains(text, chr(0)) AS is_binary FROM documents""")
def binary_reject(spark, folder):
    content = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.decode(F.unhex(F.lit("00")), "UTF-8"))).otherwise(F.col("text"))
    return _docs(spark, folder).select("doc_id", text.contains_nul(content).alias("is_binary"))


@query("encoding_detect", """
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'UTF-16LE' ELSE 'UTF-8' END AS encoding,
  CASE WHEN doc_id % 4 = 3 THEN regexp_replace(text, '[\x00-\xFF]', chr(20001), 'g') ELSE text END AS content FROM documents WHERE doc_id % 4 IN (0, 3)""")
def encoding_detect(spark, folder):
    """UTF-8, UTF-16 with NUL bytes, broken UTF-8, UTF-16 without any NUL byte."""
    bom = F.unhex(F.lit("FFFE"))
    d = F.col("doc_id")
    wide = F.regexp_replace("text", r"[\x00-\xFF]", "\u4e21")   # every character in two bytes, neither of them 0
    raw = F.when(d % 4 == 0, F.encode("text", "UTF-8")) \
        .when(d % 4 == 1, F.concat(bom, F.encode("text", "UTF-16LE"))) \
        .when(d % 4 == 2, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))) \
        .otherwise(F.concat(bom, F.encode(wide, "UTF-16LE")))
    return changes.decoded_files(_docs(spark, folder).select("doc_id", raw.alias("content"))).select(
        "doc_id", "encoding", F.col("file_content").alias("content"))


@query("payload_decode", c.with_sql(c.POINTS, select="""
SELECT vec_id, file_path, '' AS content, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE start_line END AS start_line,
  CASE WHEN vec_id % 3 = 0 THEN 0 ELSE byte_end END AS byte_end, CASE WHEN vec_id % 2 = 0 THEN commit_date END AS commit_date, language
FROM points"""))
def payload_decode(spark, folder):
    """JSON payloads, some without line and byte fields, some with a broken date."""
    p = c.points(spark, folder)
    json = payload.to_payload(p)
    json = F.when(F.col("vec_id") % 3 == 0, F.regexp_replace(json, r'"(start_line|byte_end)":\d+,', "")).otherwise(json)
    json = F.when(F.col("vec_id") % 2 == 1, F.regexp_replace(json, r"\+00:00", " o'clock")).otherwise(json)
    rows = payload.from_payload(p.select("vec_id", json.alias("payload")), "payload", "vec_id")
    return rows.select("vec_id", "file_path", "content", "start_line", "byte_end", "commit_date", "language")


@query("definition_reference_flags", f"""
SELECT doc_id, lower(first_word) = '{WORD}' AS is_definition, lower(first_word) <> '{WORD}' AND contains(lower(text), '{WORD}') AS is_reference
FROM (SELECT doc_id, text, regexp_extract(text, '([a-zA-Z]+)', 1) AS first_word FROM documents)""")
def definition_reference_flags(spark, folder):
    name, kind = F.regexp_extract("text", "([a-zA-Z]+)", 1), F.lit("function")
    return _docs(spark, folder).select(
        "doc_id", ranking.is_definition(name, kind, WORD).alias("is_definition"),
        ranking.is_reference(name, kind, F.col("text"), WORD).alias("is_reference"))
