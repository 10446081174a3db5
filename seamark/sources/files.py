"""Source files from a folder, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ids, paths
from ..operators.changes import decoded_files

PUSH_SCHEMA = ("project_id string, path string, content string, repository_url string, commit_sha string, commit_message string, "
               "commit_date timestamp_ntz, author string, pushed_at timestamp_ntz")


def read_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Text files below `root`: relative path, content, encoding, size, hash; binary files are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("_path"), "content")
    text = decoded_files(raw)
    return text.select(
        paths.relativize(F.col("_path"), root).alias("file_path"), "file_content", "encoding", "size_bytes",
        ids.content_hash(F.col("file_content")).alias("content_hash"))


def tree_push(spark: SparkSession, root: str, tenant_id: str, repository_id: str, branch: str, glob: str | None = None) -> DataFrame:
    """The files of a tree as a push of one branch."""
    return read_tree(spark, root, glob).select(
        F.lit(tenant_id).alias("tenant_id"), F.lit(repository_id).alias("repository_id"), F.lit(branch).alias("branch"), "*")


def stream_pushes(spark: SparkSession, folder: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Content pushes arriving as JSON files; the bound per trigger is the back-pressure."""
    return spark.readStream.schema(PUSH_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).json(folder)
