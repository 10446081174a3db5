"""Content hashes and deterministic ids, all as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the namespace every chunk id is derived in.
CHUNK_NAMESPACE = "a8f5c3e2-7b9d-4f2a-9e1c-3d5a7b9f1e3c"
NIL_TENANT = "00000000-0000-0000-0000-000000000000"


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version-5 id of `name`: SHA-1, then version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def chunk_id(repository_id, branch, file_path, generation, byte_start, byte_end) -> Column:
    """Id of a chunk; it depends on the byte range, so it survives a new chunking of other files."""
    parts = [F.col(c) if isinstance(c, str) else c
             for c in (repository_id, branch, file_path, generation, byte_start, byte_end)]
    return uuid5(CHUNK_NAMESPACE, F.concat_ws(":", *[p.cast("string") for p in parts]))
