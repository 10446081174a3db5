"""The given tables seen through the index's data model, in Spark and in SQL.

Every view is a projection of a whole table, so whatever runs on it grows with
the table.  The SQL texts state the same formulas for the cross-check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import ids, text
from ..functions.columns import let, struct
from ..functions.languages import language_of
from ..operators.search import pinned

_DIRS = ["src", "tests", "lib", "src/fixtures", "docs"]
_EXTS = ["rs", "py", "js", "go", "java", "h"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str, **options) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them.

    A stream takes a single file only by a pattern; one without other signs fits the table alone.
    """
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")


def _pick(index: Column, values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])[index.cast("int")]


def _pick_sql(index: str, values: list[str]) -> str:
    return "(CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"


def path_of(number: Column, stem: str) -> Column:
    return F.concat(_pick(number % 5, _DIRS), F.lit(f"/{stem}_"), number.cast("string"), F.lit("."),
                    _pick(number % 6, _EXTS))


def path_sql(number: str, stem: str) -> str:
    return f"{_pick_sql(f'({number}) % 5', _DIRS)} || '/{stem}_' || ({number}) || '.' || {_pick_sql(f'({number}) % 6', _EXTS)}"


def _at(base: str, amount: Column, unit: str) -> Column:
    return F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(**{unit: amount.cast("int")})


# ------------------------------------------------------------------- files

def files(spark: SparkSession, folder: str) -> DataFrame:
    """documents as indexed files: four branches hold versions of one path."""
    return files_of(table(spark, folder, "documents"))


def files_of(documents: DataFrame) -> DataFrame:
    """The same of documents however they come, as a table or as a stream."""
    d, group = F.col("doc_id"), F.expr("doc_id div 4")
    return documents.select(
        "doc_id",
        F.concat(F.lit("t"), (group % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("org/repo-"), (group % 25).cast("string")).alias("repository_id"),
        _pick(d % 4, ["main", "master", "dev", "release"]).alias("branch"),
        path_of(group, "doc").alias("file_path"),
        F.col("text").alias("file_content"),
        ids.content_hash(F.col("text")).alias("content_hash"),
        F.lit("UTF-8").alias("encoding"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.lit(1).cast("long").alias("generation"),
        F.when(d % 7 != 0, F.md5(F.concat("source", (d % 5).cast("string")))).alias("commit_sha"),
        F.concat(F.lit("commit "), (d % 5).cast("string")).alias("commit_message"),
        _at("2024-01-01 00:00:00", d % 5, "days").alias("commit_date"),
        F.concat(F.lit("author"), (d % 11).cast("string")).alias("author"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(days=F.expr("cast(doc_id div 1440 as int)"), mins=(d % 1440).cast("int"))).alias("indexed_at"),
        F.concat(F.lit("https://git.example.com/org/"), F.col("source"), F.lit(".git")).alias("repository_url"),
        "source", "lang",
    )


FILES = f"""files AS (
  SELECT doc_id, 't' || ((doc_id // 4) % 3) AS tenant_id, 'org/repo-' || ((doc_id // 4) % 25) AS repository_id,
    {_pick_sql('doc_id % 4', ['main', 'master', 'dev', 'release'])} AS branch,
    {path_sql('doc_id // 4', 'doc')} AS file_path,
    text AS file_content, sha256(text) AS content_hash, 'UTF-8' AS encoding,
    strlen(text)::BIGINT AS size_bytes, 1::BIGINT AS generation,
    CASE WHEN doc_id % 7 <> 0 THEN md5(source || (doc_id % 5)) END AS commit_sha,
    'commit ' || (doc_id % 5) AS commit_message,
    TIMESTAMP '2024-01-01 00:00:00' + to_days((doc_id % 5)::INTEGER) AS commit_date,
    'author' || (doc_id % 11) AS author,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS indexed_at,
    'https://git.example.com/org/' || source || '.git' AS repository_url, source, lang
  FROM documents)"""


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """The same files arriving again; every tenth has changed."""
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat("file_content", F.lit("\n-- changed"))).otherwise(F.col("file_content"))
    return files(spark, folder).withColumn("file_content", changed).withColumn(
        "content_hash", ids.content_hash(F.col("file_content"))).withColumn(
        "size_bytes", F.octet_length("file_content").cast("long"))


INCOMING = """incoming AS (
  SELECT * EXCLUDE (content_hash, size_bytes), sha256(file_content) AS content_hash, strlen(file_content)::BIGINT AS size_bytes
  FROM (SELECT * REPLACE (CASE WHEN doc_id % 10 = 0 THEN file_content || chr(10) || '-- changed' ELSE file_content END AS file_content)
        FROM files))"""


def indexed(spark: SparkSession, folder: str) -> DataFrame:
    """What is in the index before `incoming`: all files but each tenth plus one."""
    return files(spark, folder).filter(F.col("doc_id") % 10 != 1)


INDEXED = "indexed AS (SELECT * FROM files WHERE doc_id % 10 <> 1)"


# ------------------------------------------------------------------ chunks

def chunks(spark: SparkSession, folder: str, with_content: bool = True) -> DataFrame:
    """Five-line chunks of every file."""
    from ..operators.chunking import chunk_rows, with_fixed_groups

    base = files(spark, folder)
    keep = [c for c in base.columns if c not in ("file_content",)]
    rows = chunk_rows(with_fixed_groups(base, "file_content", 5), *keep)
    rows = rows.withColumn("kind", _pick(F.col("chunk_index") % 4, ["function", "class", "comment", None])).withColumn(
        "name", F.nullif(F.regexp_extract("content", r"([\p{IsAlphabetic}]+)", 1), F.lit(""))).withColumn(
        "chunk_id", ids.chunk_id("repository_id", "branch", "file_path", "generation", "byte_start", "byte_end")
    ).withColumn("created_at", F.col("indexed_at"))
    return rows if with_content else rows.drop("content")


_LINES_SQL = "(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END)"

UUID5_SQL = (
    "(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
    "translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"
)


def sha1_sql(name: str) -> str:
    return f"sha1(unhex('{ids.CHUNK_NAMESPACE.replace('-', '')}') || encode({name}))"


_ID_NAME = "repository_id || ':' || branch || ':' || file_path || ':' || generation || ':' || byte_start || ':' || byte_end"

CHUNKS = f"""file_lines AS (
  SELECT * EXCLUDE (l), {_LINES_SQL} AS ls FROM (SELECT *, string_split(file_content, chr(10)) AS l FROM files)),
line_groups AS (
  SELECT * EXCLUDE (ls), i // 5 AS chunk_index, array_to_string(ls[i + 1:i + 5], chr(10)) AS content, i + 1 AS start_line,
    least(i + 5, len(ls)) AS end_line,
    CASE WHEN i = 0 THEN 0 ELSE strlen(array_to_string(ls[1:i], chr(10))) + 1 END AS byte_start
  FROM (SELECT *, unnest(range(0, len(ls), 5)) AS i FROM file_lines)),
chunks AS (
  SELECT * EXCLUDE (h), {UUID5_SQL.format(h='h')} AS chunk_id FROM (
    SELECT *, {sha1_sql(_ID_NAME)} AS h FROM (
      SELECT *, byte_start + strlen(content) AS byte_end,
        {_pick_sql('chunk_index % 4', ['function', 'class', 'comment'])} AS kind,
        nullif(regexp_extract(content, '(\\p{{L}}+)', 1), '') AS name, indexed_at AS created_at
      FROM line_groups)))"""


# ------------------------------------------------------------------ points

_NAMES = ["the", "The-Parser", "and", "_", None]
_KINDS = ["function", "class", "comment", "method", None, "function_item"]


def points(spark: SparkSession, folder: str) -> DataFrame:
    """embeddings as stored points; the text of a point is looked up only for the ones needed."""
    v = F.col("vec_id")
    base = table(spark, folder, "embeddings").select(
        "vec_id", "label", "embedding",
        F.concat(F.lit("t"), (v % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("repo-"), F.col("label").cast("string")).alias("repository_id"),
        _pick(v % 2, ["main", "dev"]).alias("branch"),
        path_of(v, "vec").alias("file_path"),
        F.lit(1).cast("long").alias("generation"),
        (v % 3).cast("int").alias("chunk_index"),
        (1 + 5 * (v % 3)).cast("int").alias("start_line"),
        (5 + 5 * (v % 3)).cast("int").alias("end_line"),
        (100 * (v % 3)).alias("byte_start"),
        (100 * (v % 3) + 100).alias("byte_end"),
        _pick(v % 6, _KINDS).alias("kind"),
        _pick(v % 5, _NAMES).alias("name"),
        F.concat(F.lit("https://git.example.com/org/repo-"), F.col("label").cast("string")).alias("repository_url"),
        F.when(v % 4 != 3, F.md5(v.cast("string"))).alias("commit_sha"),
        F.concat(F.lit("commit "), (v % 5).cast("string")).alias("commit_message"),
        _at("2024-01-01 12:30:00", v % 5, "days").alias("commit_date"),
        F.concat(F.lit("author"), (v % 11).cast("string")).alias("author"),
    )
    return base.withColumn("language", language_of(F.col("file_path"))).withColumn(
        "chunk_id", ids.chunk_id("repository_id", "branch", "file_path", "generation", "byte_start", "byte_end"))


_LANG_SQL = ("(CASE regexp_extract(file_path, '\\.([^.]*)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' "
             "WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'h' THEN 'c' END)")

POINTS = f"""points AS (
  SELECT * EXCLUDE (h), {UUID5_SQL.format(h='h')} AS chunk_id FROM (
    SELECT *, {_LANG_SQL} AS language, {sha1_sql(_ID_NAME)} AS h FROM (
      SELECT vec_id, label, embedding, 't' || (vec_id % 3) AS tenant_id, 'repo-' || label AS repository_id,
        {_pick_sql('vec_id % 2', ['main', 'dev'])} AS branch, {path_sql('vec_id', 'vec')} AS file_path,
        1::BIGINT AS generation, (vec_id % 3)::INTEGER AS chunk_index, (1 + 5 * (vec_id % 3))::INTEGER AS start_line,
        (5 + 5 * (vec_id % 3))::INTEGER AS end_line, 100 * (vec_id % 3) AS byte_start, 100 * (vec_id % 3) + 100 AS byte_end,
        {_pick_sql('vec_id % 6', _KINDS).replace("'None'", "NULL")} AS kind,
        {_pick_sql('vec_id % 5', _NAMES).replace("'None'", "NULL")} AS name,
        'https://git.example.com/org/repo-' || label AS repository_url,
        CASE WHEN vec_id % 4 <> 3 THEN md5(vec_id::VARCHAR) END AS commit_sha, 'commit ' || (vec_id % 5) AS commit_message,
        TIMESTAMP '2024-01-01 12:30:00' + to_days((vec_id % 5)::INTEGER) AS commit_date, 'author' || (vec_id % 11) AS author
      FROM embeddings)))"""


def query_vector(spark: SparkSession, folder: str, vec_id: int = 0) -> list[float]:
    """The stored vector used as request vector; one row."""
    row = table(spark, folder, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row["embedding"]]


def point_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Text files the points were cut from: point n comes from document n."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("vec_id"), text.lines(F.col("text")).alias("_lines"))


def with_point_content(found: DataFrame, sources: DataFrame, context: bool = False, most: int | None = None) -> DataFrame:
    """Text of the given points; points without a source have empty text.

    With `most` the points are a ranked result of that size at most, and only their sources are read.
    """
    if most is not None:
        found, rows = pinned(found, most)
        sources = sources.filter(F.col("vec_id").isin(sorted({row["vec_id"] for row in rows})))
    joined = found.join(sources, "vec_id", "left")
    cut = text.join_lines(F.slice("_lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1))
    out = joined.withColumn("content", F.coalesce(cut, F.lit("")))
    if context:
        out = out.withColumn("context", text.surrounding_lines(F.col("_lines"), F.col("start_line"), F.col("end_line")))
    return out.drop("_lines")


SOURCES = """source_lines AS (
  SELECT vec_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS ls
  FROM (SELECT doc_id AS vec_id, string_split(text, chr(10)) AS l FROM documents))"""

POINT_CONTENT_SQL = "coalesce(array_to_string(ls[start_line:end_line], chr(10)), '')"


def similarity_sql(column: str = "embedding", vec_id: int = 0) -> str:
    return (f"list_cosine_similarity({column}::DOUBLE[], "
            f"(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {vec_id}))")


# ------------------------------------------------------------------ source code

# Per language: head of a function, of a class, of a function inside of one; `@` is the name.
_HEADS = {"rust": ("pub fn @(a)", "impl @", "pub async fn @(a)"), "python": ("def @(a)", "class @", "async def @(a)"),
          "javascript": ("export function @(a)", "export default class @", "async @(a)"), "go": ("func @(a)", "type @ struct", "func @(a)"),
          "java": ("public static int @(a)", "public final class @", "private void @(a)"), "c": ("static int @(a)", "struct @", "int @(a)")}
# What each line of a document becomes, by its number modulo 4, in a function and in a class: lines of code that hold it whole
# (`$` in a string, `%` in a comment) with heads and brackets beside it, some of them in strings and comments.
_WRITTEN = {
    False: [["@F {", "    // %"], ['    s = "} $"'], ["    /* % {", "    } */"], ["}", "use @;", "// %"]],
    True: [["@C {", "    // %"], ["    @M {", '        s = "$"'], ["        // %", "    }"], ["}", "use @;", "// %"]],
}
_RUST = {False: [["@F {", "    // %"], ['    s = r#"} $"#;'], ["    /* % /* { */", "    } */"], ["}", "use @;", "// %"]], True: _WRITTEN[True]}
_SCRIPT = {False: [["@F {", "    // %"], ["    s = `} $`"], ["    /* % {", "    } */"], ["}", "use @;", "// %"]], True: _WRITTEN[True]}
_PYTHON = {
    False: [["@F:", '    """$', "def fake(a):", '    """'], ['    s = "$"'], ["    # %", "    return s"], ["", "import @", "# %"]],
    True: [["@C:", "    # %"], ["    @M:", '        s = "$"'], ["        # %", "        return s"], ["", "import @", "# %"]],
}
_STYLE = {"python": _PYTHON, "rust": _RUST, "javascript": _SCRIPT}


def _templates() -> list[tuple[str, bool, int, list[str]]]:
    """(language, in a class, line modulo 4, lines of code) with the heads put in."""
    return [(lang, inside, k, [t.replace("@F", f).replace("@C", c).replace("@M", m) for t in lines])
            for lang, (f, c, m) in _HEADS.items() for inside, rows in _STYLE.get(lang, _WRITTEN).items() for k, lines in enumerate(rows)]


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """documents written as source code."""
    return code_of(files(spark, folder))


def code_of(base: DataFrame) -> DataFrame:
    """Files as source code: each run of four lines becomes a definition, every third one a class with a method.

    Every line is kept whole, in a string or a comment; there the signs that end it are escaped or parted.
    """
    base = base.withColumn("language", language_of(F.col("file_path")))
    name = lambda line, k: F.concat(let(F.lower(F.regexp_extract(line, r"([\p{IsAlphabetic}]+)", 1)), lambda w: F.when(w == "", "unnamed").otherwise(w)), F.lit("_"), k.cast("string"))
    replaced = lambda value, *pairs: value if not pairs else replaced(F.replace(value, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:])
    quoted = replaced(F.col("file_content"), ("\\", "\\\\"), ('"', '\\"'), ("`", "\\`"), ('"#', '" #'))
    noted = replaced(F.col("file_content"), ("*/", "* /"), ("/*", "/ *"))
    # the marks of the templates as signs that no text holds
    marks = str.maketrans("@$%", "\x01\x02\x03")
    rows: dict[str, list] = {}
    for lang, _, _, lines in _templates():
        rows.setdefault(lang, []).append(F.array(*[F.lit(t.translate(marks)) for t in lines]))
    templates = F.create_map(*[x for lang, all_lines in rows.items() for x in (F.lit(lang), F.array(*all_lines))])

    def written(of):
        """Lines of code of each line; `of` is bound once, where a column would be computed again for every line."""
        def lines(line, k):
            which = F.when((k / 4).cast("int") % 3 == 2, 4).otherwise(0) + k % 4
            return let(name(line, k), lambda named: F.transform(F.get(of["templates"], which), lambda t: F.replace(F.replace(F.replace(
                t, F.lit("\x01"), named), F.lit("\x02"), F.get(of["quoted"], k)), F.lit("\x03"), F.get(of["noted"], k))))
        return F.transform(of["plain"], lines)

    parts = struct(templates=templates[F.col("language")], plain=text.lines(F.col("file_content")), quoted=text.lines(quoted), noted=text.lines(noted))
    code = text.join_lines(F.flatten(let(parts, written)))
    return base.withColumn("file_content", code).withColumn("content_hash", ids.content_hash(F.col("file_content"))).withColumn(
        "size_bytes", F.octet_length("file_content").cast("long"))


_WORD_SQL = "lower(regexp_extract(line, '(\\p{L}+)', 1))"
_NAMED_SQL = f"((CASE WHEN {_WORD_SQL} = '' THEN 'unnamed' ELSE {_WORD_SQL} END) || '_' || n)"


def _filled_sql(template: str) -> str:
    sign = next((s for s in "$%" if s in template), None)
    before, _, after = template.partition(sign) if sign else (template, "", "")
    named = f"replace('{before}', '@', {_NAMED_SQL})"
    return named + (f" || {'quoted' if sign == '$' else 'noted'} || '{after}'" if sign else "")


def _lines_sql() -> str:
    whens = " ".join(f"WHEN language = '{lang}' AND (n // 4 % 3 = 2) = {str(inside).lower()} AND n % 4 = {rest} THEN [{', '.join(_filled_sql(t) for t in lines)}]"
                     for lang, inside, rest, lines in _templates())
    return f"(CASE {whens} END)"


# One row per source line of the code files: doc_id, k (0-based), code line.
CODE = f"""code_files AS (SELECT *, {_LANG_SQL} AS language FROM files),
code_source AS (
  SELECT * EXCLUDE (l), unnest({_LINES_SQL}) AS line, unnest(range(0, len({_LINES_SQL}))) AS n
  FROM (SELECT doc_id, language, string_split(file_content, chr(10)) AS l FROM code_files)),
code_escaped AS (
  SELECT *, replace(replace(replace(replace(line, '\\', '\\\\'), '"', '\\"'), '`', '\\`'), '"#', '" #') AS quoted, replace(replace(line, '*/', '* /'), '/*', '/ *') AS noted FROM code_source),
code_parts AS (SELECT doc_id, language, n, {_lines_sql()} AS parts FROM code_escaped),
code_lines AS (
  SELECT doc_id, language, row_number() OVER (PARTITION BY doc_id ORDER BY n, j) - 1 AS k, code
  FROM (SELECT doc_id, language, n, unnest(parts) AS code, unnest(range(0, len(parts))) AS j FROM code_parts))"""


# ------------------------------------------------------------------ jobs and queues

NOW = "2024-01-20 00:00:00"


def chunk_queue(spark: SparkSession, folder: str) -> DataFrame:
    """events as queue items."""
    e = F.col("event_id")
    status = F.when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "purchase", "completed") \
        .when(F.col("event_type") == "error", "failed").otherwise("queued")
    ts = F.col("ts").cast("timestamp_ntz")
    base = table(spark, folder, "events").select(
        e.cast("string").alias("id"), F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.col("props").alias("chunk_data"), status.alias("status"), ts.alias("created_at"),
        (e % 5).cast("int").alias("retry_count"), F.lit(3).alias("max_retries"), e.alias("event_id"), "value")
    busy, done = F.col("status") == "processing", F.col("status") == "completed"
    later = lambda s: F.col("created_at") + F.make_dt_interval(secs=F.lit(s))
    return base.select(
        "id", "job_id", "chunk_data", "status",
        F.when(busy, F.col("created_at")).alias("claimed_at"),
        F.when(busy, F.concat(F.lit("worker-"), (F.col("event_id") % 8).cast("string"))).alias("claimed_by"),
        F.when(busy | (F.col("event_id") % 6 == 0), later(300)).alias("visible_after"),
        "retry_count", "max_retries", F.when(F.col("status") == "failed", F.lit("boom")).alias("last_error"),
        "created_at", F.when(done, later(60)).alias("completed_at"))


CHUNK_QUEUE = """chunk_queue AS (
  SELECT id, job_id, chunk_data, status,
    CASE WHEN status = 'processing' THEN created_at END AS claimed_at,
    CASE WHEN status = 'processing' THEN 'worker-' || (event_id % 8) END AS claimed_by,
    CASE WHEN status = 'processing' OR event_id % 6 = 0 THEN created_at + INTERVAL 300 SECOND END AS visible_after,
    retry_count, max_retries, CASE WHEN status = 'failed' THEN 'boom' END AS last_error, created_at,
    CASE WHEN status = 'completed' THEN created_at + INTERVAL 60 SECOND END AS completed_at
  FROM (SELECT event_id, event_id::VARCHAR AS id, 'job-' || user_id AS job_id, props AS chunk_data,
      CASE event_type WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status,
      ts AS created_at, (event_id % 5)::INTEGER AS retry_count, 3 AS max_retries FROM events))"""


def file_queue(spark: SparkSession, folder: str) -> DataFrame:
    """events as queued files."""
    q = chunk_queue(spark, folder)
    number = F.col("id").cast("long")
    return q.select(
        "id", "job_id", F.concat(F.lit("t"), (number % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("org/repo-"), (number % 25).cast("string")).alias("repository_id"), F.lit("main").alias("branch"),
        path_of(number, "ev").alias("file_path"), F.col("chunk_data").alias("file_content"),
        ids.content_hash(F.col("chunk_data")).alias("content_hash"), "status", (number % 3).cast("int").alias("priority"),
        "retry_count", F.col("last_error").alias("error_message"), "created_at", F.col("claimed_at").alias("started_at"),
        "completed_at")


FILE_QUEUE = f"""file_queue AS (
  SELECT id, job_id, 't' || (id::BIGINT % 3) AS tenant_id, 'org/repo-' || (id::BIGINT % 25) AS repository_id, 'main' AS branch,
    {path_sql('id::BIGINT', 'ev')} AS file_path, chunk_data AS file_content, sha256(chunk_data) AS content_hash, status,
    (id::BIGINT % 3)::INTEGER AS priority, retry_count, last_error AS error_message, created_at, claimed_at AS started_at, completed_at
  FROM chunk_queue)"""


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """One indexing job per user of the events."""
    u = F.col("user_id")
    ts = F.col("ts").cast("timestamp_ntz")
    status = _pick(u % 5, ["pending", "running", "completed", "failed", "cancelled"])
    grouped = table(spark, folder, "events").groupBy("user_id").agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("_end"), F.count("*").cast("int").alias("files_total"),
        F.count_if(F.col("event_type") == "purchase").cast("int").alias("files_processed"))
    return grouped.select(
        F.concat(F.lit("job-"), u.cast("string")).alias("job_id"), F.concat(F.lit("t"), (u % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("org/repo-"), (u % 25).cast("string")).alias("repository_id"),
        _pick(u % 4, ["main", "master", "dev", "release"]).alias("branch"), status.alias("status"), "files_total",
        "files_processed", F.lit(0).alias("chunks_created"), F.lit("").alias("repository_url"),
        F.concat(F.lit("ns-"), (u % 4).cast("string")).alias("vector_namespace"), "started_at",
        F.when(u % 5 >= 2, F.col("_end")).alias("completed_at"),
        F.when(u % 5 == 3, F.lit("boom")).alias("error_message"))


JOBS = f"""jobs AS (
  SELECT 'job-' || user_id AS job_id, 't' || (user_id % 3) AS tenant_id, 'org/repo-' || (user_id % 25) AS repository_id,
    {_pick_sql('user_id % 4', ['main', 'master', 'dev', 'release'])} AS branch,
    {_pick_sql('user_id % 5', ['pending', 'running', 'completed', 'failed', 'cancelled'])} AS status,
    count(*)::INTEGER AS files_total, (count(*) FILTER (WHERE event_type = 'purchase'))::INTEGER AS files_processed,
    0 AS chunks_created, '' AS repository_url, 'ns-' || (user_id % 4) AS vector_namespace, min(ts) AS started_at,
    CASE WHEN user_id % 5 >= 2 THEN max(ts) END AS completed_at, CASE WHEN user_id % 5 = 3 THEN 'boom' END AS error_message
  FROM events GROUP BY user_id)"""


def branches(spark: SparkSession, folder: str) -> DataFrame:
    """Branches of the indexed files; a third was never completed."""
    known = files(spark, folder).groupBy("tenant_id", "repository_id", "branch").agg(
        F.min("indexed_at").alias("first_seen"), F.max("indexed_at").alias("_last"), F.count("*").alias("_n"))
    return known.select(
        "tenant_id", "repository_id", "branch",
        F.concat(F.lit("https://git.example.com/"), F.col("repository_id")).alias("repository_url"), "first_seen",
        F.when(F.col("branch") != "release", F.col("_last")).alias("last_indexed"))


BRANCHES = """branches AS (
  SELECT tenant_id, repository_id, branch, 'https://git.example.com/' || repository_id AS repository_url,
    min(indexed_at) AS first_seen, CASE WHEN branch <> 'release' THEN max(indexed_at) END AS last_indexed
  FROM files GROUP BY tenant_id, repository_id, branch)"""


def with_sql(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " " + select if any("RECURSIVE" in c for c in ctes) \
        else "WITH " + ", ".join(ctes) + " " + select
