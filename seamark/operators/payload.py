"""Stored points as one JSON payload, and back with the defaults for what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import VECTORS

_FIELDS = [f for f in VECTORS.fields if f.name != "embedding"]
_SCHEMA = ", ".join(
    f"{f.name} {'string' if f.name == 'commit_date' else f.dataType.simpleString()}" for f in _FIELDS)
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def parse_rfc3339(value: Column) -> Column:
    """UTC timestamp without zone; null if the text is not a full date, time and offset."""
    sound = F.when(value.rlike(_RFC3339), F.upper(value))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"),
                              F.try_to_timestamp(sound).cast("timestamp_ntz"))


def format_rfc3339(value: Column) -> Column:
    return F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def to_payload(points: DataFrame) -> Column:
    present = [f.name for f in _FIELDS if f.name in points.columns]
    return F.to_json(F.struct(*[
        (format_rfc3339(F.col(n)) if n == "commit_date" else F.col(n)).alias(n) for n in present]))


def from_payload(rows: DataFrame, payload: str, *keep: str) -> DataFrame:
    """Typed columns of a payload; texts default to '', numbers to 0, the byte end to the text's length."""
    parsed = rows.withColumn("_p", F.from_json(payload, _SCHEMA, {"mode": "PERMISSIVE"}))
    p = lambda n: F.col("_p")[n]
    content = F.coalesce(p("content"), F.lit(""))
    text = {n: F.coalesce(p(n), F.lit("")) for n in ("file_path", "repository_id", "branch", "language")}
    number = {n: F.coalesce(p(n), F.lit(0)) for n in ("start_line", "end_line", "byte_start")}
    special = {"content": content, "byte_end": F.coalesce(p("byte_end"), F.octet_length(content).cast("long")),
               "commit_date": parse_rfc3339(p("commit_date"))}
    chosen = {**text, **number, **special}
    return parsed.select(*keep, *[chosen.get(f.name, p(f.name)).cast(f.dataType).alias(f.name) for f in _FIELDS])
