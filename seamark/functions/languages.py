"""Registry of source languages: extensions, definition keywords, block style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .paths import extension, file_extension

# Per language the file extensions, the prefixes that open a function
# or a class-like definition, and the block style ("braces", "indent" or "none").
LANGUAGES: dict[str, tuple[list[str], list[str], list[str], str]] = {
    "rust": (["rs"],
             ["fn ", "pub fn", "pub(crate) fn", "async fn"],
             ["struct ", "enum ", "trait ", "impl "], "braces"),
    "python": (["py", "pyi"], ["def ", "async def "], ["class "], "indent"),
    "javascript": (["js", "mjs", "cjs"],
                   ["function ", "async function ", "const ", "let ", "var "], ["class "], "braces"),
    "typescript": (["ts", "mts", "cts"],
                   ["function ", "async function ", "const ", "let ", "var "],
                   ["class ", "interface ", "type ", "enum "], "braces"),
    "tsx": (["tsx"],
            ["function ", "async function ", "const ", "let ", "var "], ["class ", "interface "], "braces"),
    "go": (["go"], ["func "], ["type ", "struct ", "interface "], "braces"),
    "java": (["java"], ["public ", "private ", "protected ", "static "],
             ["class ", "interface ", "enum "], "braces"),
    "c": (["c", "h"], ["int ", "void ", "char ", "float ", "double ", "static "],
          ["struct ", "typedef ", "enum ", "union "], "braces"),
    "cpp": (["cpp", "cxx", "cc", "c++", "hpp", "hxx", "hh", "h++"],
            ["void ", "int ", "bool ", "auto ", "template "],
            ["class ", "struct ", "namespace ", "template "], "braces"),
    "csharp": (["cs", "csx"],
               ["public ", "private ", "protected ", "internal ", "static ", "async ", "override ", "virtual "],
               ["class ", "interface ", "struct ", "enum ", "record "], "braces"),
    "bash": (["sh", "bash", "zsh", "fish", "ksh"], ["function ", "() {"], [], "braces"),
    "html": (["html", "htm", "xhtml"], [], [], "none"),
    "powershell": (["ps1", "psm1", "psd1", "ps1xml", "pssc", "psc1", "cdxml"],
                   ["function ", "filter ", "workflow "], ["class ", "enum "], "braces"),
    "sql": (["sql", "ddl", "dml", "dcl", "pgsql", "plsql", "tsql", "psql"],
            ["CREATE FUNCTION", "CREATE OR REPLACE FUNCTION", "CREATE PROCEDURE", "CREATE OR REPLACE PROCEDURE"],
            ["CREATE TABLE", "CREATE VIEW", "CREATE INDEX", "CREATE TRIGGER"], "none"),
    "json": (["json", "jsonc"], [], [], "braces"),
    "xml": (["xml", "xsd", "xsl", "svg"], [], [], "none"),
    "yaml": (["yaml", "yml"], [], [], "indent"),
}

# Prefixes tried for a language that is not registered.
FALLBACK_FUNCTION_PREFIXES = [
    "fn ", "def ", "function ", "func ", "public ", "private ", "protected ",
    "async fn", "async function", "async def", "pub fn", "pub(crate) fn",
]
FALLBACK_CLASS_PREFIXES = ["class ", "struct ", "enum ", "interface ", "impl ", "trait ", "type "]

# Language names shown with a file excerpt; they differ from the registry.
EXCERPT_LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "go": "go", "java": "java",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "c": "c", "md": "markdown",
    "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
}


def _map(pairs) -> Column:
    return F.create_map(*[x for key, value in pairs for x in (F.lit(key), value)])


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def language_of(path: Column) -> Column:
    """Registered language of a path; an unknown extension is its own language."""
    known = _map((ext, F.lit(lang)) for lang, row in LANGUAGES.items() for ext in row[0])
    ext = extension(path)
    return F.coalesce(F.try_element_at(known, ext), ext)


def excerpt_language(path: Column) -> Column:
    known = _map((ext, F.lit(lang)) for ext, lang in EXCERPT_LANGUAGES.items())
    return F.coalesce(F.try_element_at(known, file_extension(path)), F.lit("unknown"))


def function_prefixes(language: Column) -> Column:
    known = _map((lang, _texts(row[1])) for lang, row in LANGUAGES.items())
    return F.coalesce(F.try_element_at(known, language), _texts(FALLBACK_FUNCTION_PREFIXES))


def class_prefixes(language: Column) -> Column:
    known = _map((lang, _texts(row[2])) for lang, row in LANGUAGES.items())
    return F.coalesce(F.try_element_at(known, language), _texts(FALLBACK_CLASS_PREFIXES))


def block_style(language: Column) -> Column:
    known = _map((lang, F.lit(row[3])) for lang, row in LANGUAGES.items())
    return F.coalesce(F.try_element_at(known, language), F.lit("braces"))


def registry(spark: SparkSession) -> DataFrame:
    """The registry as a relation, one row per language; a fixed 17 rows."""
    rows = [(lang, row[0], row[1], row[2], row[3]) for lang, row in LANGUAGES.items()]
    return spark.createDataFrame(
        rows,
        "language string, extensions array<string>, function_prefixes array<string>, "
        "class_prefixes array<string>, block_style string",
    )
