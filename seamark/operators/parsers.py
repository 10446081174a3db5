"""Parsers of one's own as a table function: every file goes once to the first that takes its language."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import languages, scanning

# What a parser yields for (content, language, path): byte_start, byte_end, kind, name.
CodeParser = Callable[[str, str, str], Iterable[tuple[int, int, str | None, str | None]]]

SPAN = T.StructType([
    T.StructField("parser", T.StringType()), T.StructField("span", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()), T.StructField("byte_start", T.LongType()), T.StructField("byte_end", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType())])


def built_in(content: str, language: str, path: str) -> Iterator[tuple[int, int, str | None, str | None]]:
    """The library's definitions; of a file without any, the whole."""
    code = content.encode()
    found = scanning.definitions(code, language, languages.LANGUAGES[language][3] if language in languages.LANGUAGES else "braces")
    for start, end, _, _, kind, a, b in found or [(0, len(code), 0, 0, 0, 0, 0)]:
        yield start, end, scanning.KINDS[kind] or None, code[a:b].decode() if b > a else None


def register_parsers(spark: SparkSession, name: str, parsers: list[tuple[str, set[str], CodeParser]], fallback: CodeParser = built_in) -> None:
    """Register the table function `name`(content, language, path).

    `parsers` are (name, languages, parser), tried in order; a file whose language none takes, or whose parser raises
    NotImplementedError, goes to the fallback.  Rows come in the order the parser yields them, with text and lines cut
    out of the file; a null content gives none.  Arguments that are no strings are refused when the query is analysed.
    """

    class Spans:
        @staticmethod
        def analyze(content: AnalyzeArgument, language: AnalyzeArgument, path: AnalyzeArgument) -> AnalyzeResult:
            for what, given in (("content", content), ("language", language), ("path", path)):
                if given.dataType not in (T.StringType(), T.NullType()):
                    raise ValueError(f"{what} must be a string, not {given.dataType.simpleString()}")
            return AnalyzeResult(SPAN)

        def eval(self, content: str, language: str, path: str):
            if content is None:
                return
            code = content.encode()
            label, parse = next(((label, parse) for label, taken, parse in parsers if language in taken), ("fallback", fallback))
            try:
                found = list(parse(content, language or "", path or ""))
            except NotImplementedError:
                label, found = "fallback", list(fallback(content, language or "", path or ""))
            last, line = 0, 1
            for i, (start, end, kind, of) in enumerate(found):
                line = line + code.count(b"\n", last, start) if start >= last else 1 + code.count(b"\n", 0, start)
                last = start
                yield label, i, code[start:end].decode(errors="replace"), line, line + code.count(b"\n", start, max(start, end - 1)), start, end, kind, of

    spark.udtf.register(name, F.udtf(Spans))


def span_rows(files: DataFrame, function: str, *keep: str, content: str = "file_content", path: str = "file_path") -> DataFrame:
    """One row per span of every file by a registered table function, beside the columns in `keep`; the files are read once."""
    known = files if "language" in files.columns else files.withColumn("language", languages.language_of(F.col(path)))
    kept = "".join(f"f.`{k}`, " for k in keep)
    return files.sparkSession.sql(f"SELECT {kept}f.language, s.* FROM {{files}} f, LATERAL {function}(f.`{content}`, f.language, f.`{path}`) s", files=known)
