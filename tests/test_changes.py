"""File states, merges, queues, jobs; skew; the whole index with batches, stream, clean-up."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from seamark.api import Index
from seamark.errors import InvalidRequest, NotFound
from seamark.functions.embedding import HashedEmbedding
from seamark.operators import catalog, changes, indexing, jobs, queues
from seamark.schemas import ALL
from seamark.sources import files as sources
from seamark.sources.tables import IndexTables
from seamark.streaming.index_stream import start_indexing
from seamark.streaming.queue_stream import apply_operation, current_states, queue_states, start_queue

def at():
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


FILE = "tenant_id string, repository_id string, branch string, file_path string, content_hash string, generation long"


def test_states(spark):
    indexed = spark.createDataFrame([("t", "r", "b", "same", "h", 3), ("t", "r", "b", "changed", "h", 3), ("other", "r", "b", "new", "h", 9)], FILE)
    incoming = spark.createDataFrame([("t", "r", "b", "same", "h"), ("t", "r", "b", "changed", "x"), ("t", "r", "b", "new", "h")], FILE.rsplit(",", 1)[0])
    got = {r.file_path: (r.state, r.old_generation, r.new_generation) for r in changes.file_states(incoming, indexed).collect()}
    assert got == {"same": ("unchanged", None, None), "changed": ("updated", 3, 4), "new": ("new", None, 1)}


def test_generation_overflow_fails(spark):
    indexed = spark.createDataFrame([("t", "r", "b", "f", "h", 2**63 - 1)], FILE)
    incoming = spark.createDataFrame([("t", "r", "b", "f", "x")], FILE.rsplit(",", 1)[0])
    with pytest.raises(Exception, match="overflow"):
        changes.file_states(incoming, indexed).collect()


def test_insert_chunks_guards_both_keys(spark):
    cols = ("chunk_id string, tenant_id string, repository_id string, branch string, file_path string, chunk_index int, generation long, "
            "byte_start long")
    old = spark.createDataFrame([("a", "t", "r", "b", "f", 0, 1, 0)], cols)
    new = spark.createDataFrame([
        ("a", "t", "r", "b", "f", 5, 1, 0), ("b", "t", "r", "b", "f", 0, 1, 9), ("c", "t", "r", "b", "f", 1, 1, 9),
        ("c", "t", "r", "b", "f", 2, 1, 9), ("a", "u", "r", "b", "f", 0, 1, 0)], cols)
    got = sorted((r.tenant_id, r.chunk_id, r.chunk_index) for r in changes.insert_chunks(old, new).collect())
    assert got == [("t", "c", 1), ("u", "a", 0)]


def test_hot_key_keeps_one_row_and_prunes_before_the_shuffle(spark):
    """A third of all rows under one key: results stay whole, the window is limited inside each task."""
    df = spark.range(0, 30000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
    kept = changes.first_per_key(df, ["k"], F.desc("id"))
    assert kept.count() == 20001 - 0 and kept.filter("k = 0").first().id == 29997
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_hot_repository_in_stats(spark):
    files = spark.range(3000).select(
        F.lit("t").alias("tenant_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 50).cast("string"))).alias("repository_id"),
        F.lit("main").alias("branch"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_path"), at().alias("indexed_at"),
        (F.col("id") % 7).cast("string").alias("commit_sha"))
    chunks = files.withColumn("chunk_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat("file_path", i.cast("string")))))
    rows = {r.repository_id: r for r in catalog.index_stats(files, chunks).collect()}
    assert rows["hot"].total_files == 1000 and rows["hot"].total_chunks == 3000 and rows["hot"].unique_commits == 7
    assert sum(r.total_files for r in rows.values()) == 3000


def test_moves(spark):
    cols = "tenant_id string, repository_id string, branch string, file_path string"
    files = spark.createDataFrame([("t", "r", "b", "old"), ("t", "r", "x", "old"), ("t", "r", "b", "done")], cols)
    moves = spark.createDataFrame([
        (1, "t", "r", "b", "old", "newer", datetime.datetime(2024, 1, 2), False), (2, "t", "r", "b", "old", "stale", datetime.datetime(2024, 1, 1), False),
        (3, "t", "r", "b", "done", "no", datetime.datetime(2024, 1, 1), True)], ALL["file_moves"])
    assert sorted(r.file_path for r in changes.apply_moves(files, moves).collect()) == ["done", "newer", "old"]


# -------------------------------------------------------------------- queues

@pytest.fixture
def queue(spark):
    base = datetime.datetime(2024, 1, 1)
    rows = [(str(i), "j", "{}", "queued", None, None, None, i % 5, 3, None, base + datetime.timedelta(seconds=i), None) for i in range(10)]
    return spark.createDataFrame(rows, ALL["chunk_processing_queue"])


def test_claims_are_disjoint_and_oldest_first(queue):
    first = queues.claim_chunks(queue, "w1", "2024-01-01 01:00:00", 3)
    second = queues.claim_chunks(first, "w2", "2024-01-01 01:00:01", 4)
    got = {r.id: r.claimed_by for r in second.filter("status = 'processing'").collect()}
    assert got == {**{str(i): "w1" for i in range(3)}, **{str(i): "w2" for i in range(3, 7)}}


def test_budget_is_tested_before_counting(spark, queue):
    failed = spark.createDataFrame([(str(i), "e") for i in range(5)], "id string, error string")
    got = {r.id: (r.status, r.retry_count) for r in queues.requeue_chunks(queue, failed).collect()}
    assert got["2"] == ("queued", 3) and got["3"] == ("failed", 4) and got["4"] == ("failed", 5) and got["9"] == ("queued", 4)


def test_recovery_after_the_claim_ran_out(queue):
    claimed = queues.claim_chunks(queue, "w", "2024-01-01 01:00:00", 10)
    assert queues.timed_out(claimed, "2024-01-01 01:05:00").count() == 0
    back = queues.recover_timed_out(claimed, "2024-01-01 01:05:01")
    assert back.filter("status = 'queued' and claimed_by is null and visible_after is null").count() == 10


def test_depth_and_completion(spark, queue):
    done = queues.ack_chunks(queue, queue, "2024-01-01 02:00:00")
    assert queues.chunk_queue_depth(done).first().asDict() == {
        "job_id": "j", "queued": 0, "processing": 0, "completed": 10, "failed": 0, "complete": True}
    assert queues.jobs_done(queue.select("job_id", "status"), done.select("job_id", "status")).first().status == "running"


def test_stream_states_follow_the_batch_rules(spark, tmp_path):
    ops = [("a", "enqueue", 0), ("a", "claim", 1), ("a", "fail", 2), ("a", "claim", 3), ("a", "ack", 4), ("b", "enqueue", 0), ("b", "claim", 1),
           ("b", "recover", 400), ("c", "claim", 5)]
    df = spark.createDataFrame([(i, o, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s), "w", "boom") for i, o, s in ops],
                               "id string, op string, at timestamp, worker string, error string")
    df.coalesce(1).write.parquet(str(tmp_path / "ops"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ops"))
    out = queue_states(stream).writeStream.outputMode("update").format("memory").queryName("states").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination()
    got = {r.id: (r.status, r.retry_count, r.last_error) for r in spark.table("states").collect()}
    assert got == {"a": ("completed", 1, "boom"), "b": ("queued", 0, None)}


def test_a_table_of_states_follows_the_operations_batch_by_batch(spark, tmp_path):
    rng, schema = random.Random(5), "id string, op string, at timestamp, worker string, error string"
    begin, items, read = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc), {}, str(tmp_path / "ops")
    for n in range(4):
        ops = [(f"i{rng.randrange(60)}", rng.choice(["enqueue", "claim", "claim", "ack", "fail", "fail", "recover"]), begin + datetime.timedelta(seconds=rng.randrange(900), microseconds=k),
                rng.choice(["w", None]), rng.choice(["e", None])) for k in range(400 if n else 60)]
        for i, op, t, worker, error in sorted(ops, key=lambda o: o[2]):
            items[i] = apply_operation(items.get(i), op, int(t.timestamp()), worker, error, 2, 300)
        spark.createDataFrame(ops, schema).coalesce(1).write.mode("append").parquet(read)
        start_queue(spark.readStream.schema(schema).parquet(read), str(tmp_path / "states"), str(tmp_path / "cp"), 2, 300).awaitTermination()
        got = current_states(spark, str(tmp_path / "states")).select(
            "id", "status", "claimed_by", F.unix_seconds("claimed_at"), F.unix_seconds("visible_after"), "retry_count", "last_error").collect()
        assert sorted(map(tuple, got), key=str) == sorted(((i, *item) for i, item in items.items() if item), key=str)
    assert sorted(f.name for f in (tmp_path / "states").iterdir()) == ["batch=2", "batch=3"]


def test_operations_that_do_not_fit_change_nothing():
    item = apply_operation(None, "enqueue", 0, None, None, 3, 300)
    assert apply_operation(item, "enqueue", 5, None, None, 3, 300) == item
    busy = apply_operation(item, "claim", 10, "w", None, 3, 300)
    assert apply_operation(busy, "claim", 11, "x", None, 3, 300) == busy
    assert apply_operation(busy, "recover", 310, None, None, 3, 300) == busy
    for _ in range(4):
        item = apply_operation(item, "fail", 1, None, "e", 3, 300)
    assert item[0] == "failed" and item[4] == 4


def test_payload_that_does_not_parse_is_dropped(spark, queue):
    rows = queue.withColumn("chunk_data", F.when(F.col("id") == "1", '{"file_path":"f","content":"c"}').otherwise("not json"))
    assert [r.id for r in queues.decoded_chunks(rows).collect()] == ["1"]


def test_invalid_status_is_found(spark):
    df = spark.createDataFrame([("running",), ("odd",), (None,)], "status string")
    assert jobs.invalid_statuses(df).count() == 2


# --------------------------------------------------------------- whole index

RUST = "fn parse_config(path) {\n    read the config file\n}\n\nstruct Config {\n    value: i32,\n}\n"
PYTHON = "def draw_circle(radius):\n    return paint(radius)\n"


def push(spark, *rows):
    return spark.createDataFrame(rows, "project_id string, path string, content string")


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, IndexTables(str(tmp_path / "index")).create(spark), HashedEmbedding(128))


def test_index_search_update_and_clean(spark, index):
    first = push(spark, ("org/a:main", "src/config.rs", RUST), ("org/a:main", "src/draw.py", PYTHON), ("org/a:main", "empty.rs", ""),
                 ("org/a:main", "bin.dat", "a\0b"), ("org/b", "src/draw.py", PYTHON))
    report = {(r.repository_id, r.branch): r for r in index.index(first, "one", "t", at()).collect()}
    assert report["org/a", "main"].files_processed == 3 and report["org/a", "main"].new_files == 3
    assert report["org/a", "main"].chunks_created == 3 and report["org/b", "main"].chunks_created == 1

    hit = index.search("parse_config", "t").first()
    assert (hit.file, hit.name, hit.type) == ("config.rs", "parse_config", "function")
    assert hit.highlights and hit.context.after == "\nstruct Config {\n    value: i32,"
    assert index.search("parse_config", "nobody").count() == 0
    assert {r.path for r in index.search("draw_circle", "t", "org/b").collect()} == {"src/draw.py"}
    assert index.similar("fn parse_config(path) {}", "t", exclude_file="src/config.rs").filter("file = 'src/config.rs'").count() == 0
    assert [r.usage_type for r in index.usages("draw_circle", "t", "org/a").collect()] == ["definition"]

    again = index.index(first, "two", "t", at()).collect()
    assert {(r.unchanged_files, r.chunks_created) for r in again if r.repository_id == "org/a"} == {(3, 0)}

    changed = push(spark, ("org/a:main", "src/config.rs", RUST.replace("parse_config", "load_config")), ("org/a:main", "src/draw.py", PYTHON))
    row = index.index(changed, "three", "t", at()).first()
    assert (row.updated_files, row.unchanged_files, row.chunks_created) == (1, 1, 2)
    names = [r.name for r in index.table("vectors").filter("file_path = 'src/config.rs'").collect()]
    assert sorted(names) == ["Config", "load_config"]
    assert index.table("chunk_metadata").filter("file_path = 'src/config.rs' and generation = 2").count() == 2
    assert index.table("vectors").filter("repository_id = 'org/b'").count() == 1

    excerpt = index.context("src/config.rs", "t", line=1, radius=1).first()
    assert excerpt.content.startswith("fn load_config") and excerpt.lines.end == 2 and excerpt.language == "rust"
    with pytest.raises(NotFound):
        index.context("missing.rs", "t")
    with pytest.raises(InvalidRequest):
        index.context(" ", "t")

    stats = index.stats().first()
    assert (stats.files, stats.chunks, stats.vectors) == (4, 4, 4)
    cleaned, report = index.clean(older_than="1d", now="2024-02-01 00:00:00")
    assert report.first().removed_chunks == 4 and cleaned.stats().first().chunks == 0 and index.stats().first().chunks == 4
    compacted = cleaned.compact()    # of the newest version, whoever asks
    assert compacted.stats().first().asDict() == cleaned.stats().first().asDict()


def test_repeating_a_batch_changes_nothing(spark, index):
    files = push(spark, ("org/a:main", "src/config.rs", RUST))
    index.index(files, "one", "t", at())
    before = sorted(map(str, index.table("vectors").collect()))
    index.index(files, "one", "t", at())
    assert sorted(map(str, index.table("vectors").collect())) == before
    with pytest.raises(InvalidRequest):
        index.index(files.limit(0), "none", "t", at())
    with pytest.raises(NotFound):
        index.job_status("none")
    job = index.jobs("t", "org/a:main").collect()
    assert [(r.status, r.files_total, r.branch) for r in job] == [("completed", 1, "main")]
    assert index.job_status(job[0].job_id).first().progress_percent == 100.0
    index.index(files, "two", "t", at())
    index.index(push(spark, ("org/b:dev", "d.py", PYTHON)), "three", "t", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))
    assert index.jobs("t").count() == 3 and index.jobs("u").count() == 0
    seen = {r.repository_id: (str(r.first_seen)[:10], str(r.last_indexed)[:10]) for r in index.table("project_branches").collect()}
    assert seen == {"org/a": ("2024-01-01", "2024-01-01"), "org/b": ("2024-01-05", "2024-01-05")}
    status = index.status().first()
    assert (status.total_files, status.project_branches, str(status.last_indexed_at)) == (2, 2, "2024-01-05 00:00:00")


def test_tables_exist_and_drop(spark, index):
    assert index.tables.exists(spark) and not index.tables.pinned(spark).next().exists(spark)
    assert index.tables.drop(spark) and not index.tables.exists(spark) and not index.tables.drop(spark)


def test_stream_of_pushes(spark, index, tmp_path):
    push(spark, ("org/a:main", "src/config.rs", RUST)).coalesce(1).write.json(str(tmp_path / "in"))
    push(spark, ("org/a:main", "src/config.rs", RUST + "\nfn more() {\n}\n"), ("org/a:dev", "d.py", PYTHON)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    seen = []
    running = start_indexing(sources.stream_pushes(spark, str(tmp_path / "in"), 1), index.tables, index.provider, str(tmp_path / "cp"), "t", at(),
                             on_report=lambda batch, report: seen.append(sum(r.files_processed for r in report.collect())))
    running.awaitTermination()
    assert sum(seen) == 3 and len(seen) == 2
    assert index.table("indexed_files").count() == 2
    assert {r.generation for r in index.table("vectors").filter("branch = 'main'").collect()} == {2}


def test_read_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.rs").write_text(RUST)
    (tmp_path / "a" / "y.bin").write_bytes(b"\x00\x01")
    rows = sources.read_tree(spark, str(tmp_path)).collect()
    assert [(r.file_path, r.encoding, r.size_bytes) for r in rows] == [("a/x.rs", "UTF-8", len(RUST))]


def test_cascade(spark):
    key = "tenant_id string, repository_id string, branch string"
    tables = {
        "tenants": spark.createDataFrame([("t",)], "tenant_id string"),
        "project_branches": spark.createDataFrame([("t", "r", "b"), ("gone", "r", "b")], key),
        "indexed_files": spark.createDataFrame([("t", "r", "b", "f"), ("gone", "r", "b", "f"), ("t", "other", "b", "f")], key + ", file_path string"),
        "indexing_jobs": spark.createDataFrame([("j1", "t", "r", "b"), ("j2", "gone", "r", "b")], "job_id string, " + key),
        "chunk_processing_queue": spark.createDataFrame([("1", "j1"), ("2", "j2")], "id string, job_id string"),
    }
    kept = changes.cascade(tables)
    assert {n: kept[n].count() for n in kept} == {
        "tenants": 1, "project_branches": 1, "indexed_files": 1, "indexing_jobs": 1, "chunk_processing_queue": 1}


def test_indexing_shuffles_only_for_the_merge(spark):
    """Parse, split, identify and embed are one stage."""
    df = spark.createDataFrame([("t", "r", "b", "a.rs", 1, RUST)], "tenant_id string, repository_id string, branch string, file_path string, generation long, file_content string")
    plan = indexing.embedded(indexing.chunked_files(df), HashedEmbedding(16))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_the_same_file_twice_in_a_push(spark, index):
    files = push(spark, *[("org/a:main", "src/config.rs", RUST)] * 3, ("org/a:main", "src/draw.py", PYTHON), ("org/a:main", "src/draw.py", "x = 1\n"))
    row = index.index(files, "one", "t", at()).first()
    assert (row.files_processed, row.new_files) == (2, 2)
    assert index.table("indexed_files").count() == 2 and index.table("vectors").filter("file_path = 'src/config.rs'").count() == 2


@pytest.mark.parametrize("stage, after", [("vectors", False), ("vectors", True), ("indexed_files", True), ("commit", False)])
def test_a_dead_batch_leaves_the_index_as_it_was(spark, index, monkeypatch, stage, after):
    """It fails before or after each write; what readers see does not change, and doing it again works."""
    index.index(push(spark, ("org/a:main", "src/config.rs", RUST)), "zero", "t", at())
    before = sorted(map(str, index.table("vectors").collect()))
    write, commit = IndexTables.write, IndexTables.commit

    def dies(self, df, name, batch):
        if name == stage and not after:
            raise RuntimeError("lost")
        write(self, df, name, batch)
        if name == stage:
            raise RuntimeError("lost")

    def no_commit(self, spark, base, batch, touched, mark=None):
        if stage == "commit" and "vectors" in touched:
            raise RuntimeError("lost")
        return commit(self, spark, base, batch, touched, mark)

    monkeypatch.setattr(IndexTables, "write", dies)
    monkeypatch.setattr(IndexTables, "commit", no_commit)
    change = push(spark, ("org/a:main", "src/config.rs", "fn only() {\n}\n"))
    with pytest.raises(RuntimeError):
        index.index(change, "one", "t", at())
    monkeypatch.setattr(IndexTables, "write", write)
    monkeypatch.setattr(IndexTables, "commit", commit)
    assert sorted(map(str, index.table("vectors").collect())) == before
    assert {r.status for r in index.jobs("t").filter("correlation_id = 'one'").collect()} == {"failed"}
    index.index(change, "one", "t", at())
    assert [r.name for r in index.table("vectors").collect()] == ["only"]
    assert index.table("chunk_metadata").count() == 1 and index.table("indexed_files").count() == 1
    assert {r.status for r in index.jobs("t").filter("correlation_id = 'one'").collect()} == {"completed"}


def test_no_ghosts_no_lost_files(spark, index):
    """Emptied files leave nothing behind, odd branches keep their files, a clean file can come back."""
    index.index(push(spark, ("q:", "a.rs", RUST), ("q:", "b.py", PYTHON), (":", "c.py", PYTHON), (None, "d.py", PYTHON)), "one", "t", at())
    assert {(r.repository_id, r.branch) for r in index.table("indexed_files").collect()} == {("q", "main"), ("unknown", "main")}
    index.index(push(spark, ("q:", "a.rs", "")), "two", "t", at())
    assert {r.file_path for r in index.table("vectors").filter("repository_id = 'q'").collect()} == {"b.py"}
    assert index.table("indexed_files").filter("repository_id = 'q'").count() == 2
    index.index(push(spark, ("q:", "b.py", "")), "three", "t", at())
    assert index.table("vectors").filter("repository_id = 'q'").count() == 0 and index.table("chunk_metadata").filter("repository_id = 'q'").count() == 0
    for _ in range(2):     # a second clean finds nothing, and empties nothing else
        cleaned, _report = index.clean(older_than="1d", now="2024-02-01 00:00:00")
        assert cleaned.table("vectors").count() == 0 and cleaned.table("indexed_files").count() == 4
        index = cleaned
    again = index.index(push(spark, (":", "c.py", PYTHON)), "four", "t", at()).first()
    assert (again.updated_files, again.chunks_created) == (1, 1)


def test_the_later_push_wins(spark, index):
    df = spark.createDataFrame([("r", "a.py", "def new():\n    pass\n", "2024-01-02 00:00:00", "https://h/o/r.git", "abc"), ("r", "a.py", "def old():\n    pass\n", "2024-01-01 00:00:00", None, None)],
                               "project_id string, path string, content string, pushed_at string, repository_url string, commit_sha string").withColumn("pushed_at", F.col("pushed_at").cast("timestamp_ntz"))
    for i, rows in enumerate((df, df.orderBy("pushed_at"))):
        index.index(rows.withColumn("commit_message", F.lit("m")).withColumn("author", F.lit("me")).withColumn("commit_date", F.col("pushed_at")), f"b{i}", "t", at())
        assert [r.name for r in index.table("vectors").collect()] == ["new"]
    hit = index.search("new", "t").first()
    assert hit.repository == "r.git" and hit.commit.sha == "abc"


def test_two_writers_one_index(spark, index, monkeypatch):
    """The slower one merges again on what the faster one left."""
    commit = IndexTables.commit
    state = {"once": True}

    def late(self, spark, base, batch, touched, mark=None):
        if "vectors" in touched and state.pop("once", None):
            Index(spark, index.tables, index.provider).index(push(spark, ("org/a:main", "b.py", PYTHON)), "fast", "t", at())
        return commit(self, spark, base, batch, touched, mark)

    monkeypatch.setattr(IndexTables, "commit", late)
    index.index(push(spark, ("org/a:main", "a.rs", RUST)), "slow", "t", at())
    assert {r.file_path for r in index.table("vectors").collect()} == {"a.rs", "b.py"}
    assert index.jobs("t", limit=None).count() == 2 and index.jobs("t", limit=1).count() == 1


def test_many_branches_in_a_batch_read_touched_partitions_only(spark, index):
    index.index(push(spark, ("other:main", "z.py", PYTHON)), "zero", "t", at())
    index.index(spark.range(60).select(F.concat(F.lit("org/r"), "id", F.lit(":b")).alias("project_id"), F.lit("a.py").alias("path"), F.lit(PYTHON).alias("content")), "one", "t", at())
    keys = {("t", f"org/r{i}", "b") for i in range(60)}
    some = index.tables.read(spark, "vectors", keys)
    assert some.count() == 60 and not any("other" in f for f in some.inputFiles()) and index.table("vectors").count() == 61


def test_moves_through_the_api(spark, index):
    index.index(push(spark, ("r:main", "a.py", PYTHON), ("r:main", "b.rs", RUST)), "one", "t", at())
    kind = "id long, tenant_id string, repository_id string, branch string, old_path string, new_path string, detected_at timestamp_ntz, processed boolean"
    moment = datetime.datetime(2024, 1, 1)
    index.move(spark.createDataFrame([(1, "t", "r", "main", "a.py", "c.py", moment, False), (2, "t", "r", "main", "b.rs", "c.py", moment, False)], kind))
    # two moves to one path: the later one (by time, then id) counts, the other file stays where it was
    assert {r.file_path for r in index.table("indexed_files").collect()} == {"a.py", "c.py"}
    assert {r.file_path for r in index.table("vectors").collect()} == {"a.py", "c.py"}
