"""Paths, file names, repository urls."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Path segments and file-name marks of test or generated code.
TEST_SEGMENTS = ["test", "tests", "spec", "specs", "mock", "mocks", "generated", "fixtures"]
TEST_NAME_MARKS = ["_test.", "_spec.", ".test.", ".spec."]


def base_name(path: Column) -> Column:
    name = F.substring_index(F.regexp_replace(path, r"(/\.?)+$", ""), "/", -1)
    return F.when(name.isin("", ".", ".."), F.lit("unknown")).otherwise(F.coalesce(name, F.lit("unknown")))


def extension(path: Column) -> Column:
    """Text after the last dot; the whole path if there is none."""
    return F.substring_index(path, ".", -1)


def file_extension(path: Column) -> Column:
    """Extension of the file name proper: none for `.profile` or a name without a dot."""
    found = F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1)
    return F.when(found != "", found)


def is_test_path(path: Column) -> Column:
    segments = F.split(path, "/", -1)
    last = F.substring_index(path, "/", -1)
    mark = F.lit(False)
    for text in TEST_NAME_MARKS:
        mark = mark | F.contains(last, F.lit(text))
    return F.arrays_overlap(segments, F.array(*[F.lit(s) for s in TEST_SEGMENTS])) | mark


def is_safe_relative(path: Column) -> Column:
    """True unless the path is absolute or climbs with `..`."""
    return ~path.rlike(r"^/|(^|/)\.\.(/|$)")


def sanitize(path: Column) -> Column:
    """Keep only ordinary components."""
    kept = F.filter(F.split(path, "/", -1), lambda x: ~x.isin("", ".", ".."))
    return F.array_join(kept, "/")


def normalize(path: Column) -> Column:
    """Resolve `.` and `..` without touching a file system; `..` never leaves the root."""
    kept = F.aggregate(
        F.split(path, "/", -1),
        F.expr("cast(array() as array<string>)"),
        lambda acc, x: F.when(x.isin("", "."), acc)
        .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def resolve_within(path: Column, base: str) -> Column:
    """Normalised path under `base`, or null where it is unsafe or escapes."""
    root = normalize(F.lit(base))
    full = normalize(F.concat(F.lit(base.rstrip("/") + "/"), path))
    inside = (full == root) | full.startswith(F.concat(root, F.lit("/")))
    return F.when(is_safe_relative(path) & inside, full)


def relativize(path: Column, root: Column | str) -> Column:
    """Path below the repository root with forward slashes, null if it lies outside."""
    root = F.lit(root.rstrip("/")) if isinstance(root, str) else root
    inside = path.startswith(F.concat(root, F.lit("/")))
    return F.when(inside, F.translate(F.substring(path, F.length(root) + 2, F.length(path)), "\\", "/"))


def absolutize(path: Column, root: Column | str) -> Column:
    root = F.lit(root) if isinstance(root, str) else root
    return F.when(path.startswith("/"), path).otherwise(
        F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), path))


def normalize_git_url(url: Column) -> Column:
    """One id per repository, whichever way its url is written."""
    u = F.lower(url)
    u = F.regexp_replace(u, r"^(https?://)[^@]*:[^@]*@", "$1")
    u = F.regexp_replace(u, r"^(https://)*(http://)*(git://)*(ssh://)*(git@)*", "")
    u = F.regexp_replace(u, r"^([^:/]*):", "$1/")
    return F.regexp_replace(u, r"(\.git)+$", "")


def local_repository_id(user: Column, directory: Column) -> Column:
    """Id for a checkout without a remote."""
    return F.concat_ws("/", F.lit("local"), F.coalesce(user, F.lit("local")), F.coalesce(directory, F.lit("unknown")))


def repository_name(url: Column) -> Column:
    """Last segment of a repository url."""
    return F.substring_index(url, "/", -1)


def split_project_id(project_id: Column) -> tuple[Column, Column]:
    """`repository:branch`, split at the first colon; the branch defaults to main."""
    parts = F.split(project_id, ":", 2)
    return parts[0], F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("main"))
