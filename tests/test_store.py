"""Versions of the index: whole or not there, as large as what they change, and freed when nobody needs them."""

import os

import pytest
from pyspark.sql import functions as F

from seamark.api import Index
from seamark.functions.embedding import HashedEmbedding
from seamark.operators import search
from seamark.operators.changes import pushed_files
from seamark.operators.chunking import TokenBudget
from seamark.operators.indexing import chunked_files, index_batch
from seamark.plans import corpus
from seamark.sources import files as sources
from seamark.sources.tables import CHECKPOINT, IndexTables, Version
from seamark.streaming.index_stream import start_indexing, start_watching

PUSH = "project_id string, path string, content string"


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, IndexTables(str(tmp_path / "index")).create(spark), HashedEmbedding(16))


def at():
    return F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")


def push(index, batch, *rows):
    return index.index(index.spark.createDataFrame(rows, PUSH), batch, "t", at()).collect()


def whole(index, *tables):
    return {name: sorted(map(str, index.table(name).drop("started_at", "completed_at").collect())) for name in tables or ("indexed_files", "chunk_metadata", "vectors", "indexing_jobs", "project_branches")}


def versions(index):
    return sorted(f for f in os.listdir(f"{index.tables.root}/versions") if f.isdigit())


@pytest.mark.parametrize("text", ["", "all\n+\tvectors\tp_ten", "parent 1\n+\tvec"])
def test_a_version_cut_off_does_not_lock_the_index(index, text):
    push(index, "one", ("r:main", "a.py", "def one():\n    pass\n"))
    before = whole(index)
    following = f"{index.tables.root}/versions/{int(versions(index)[-1]) + 1:012d}"
    with open(following, "w") as f:
        f.write(text)
    assert whole(index) == before
    push(index, "two", ("r:main", "b.py", "def two():\n    pass\n"))
    assert {r.name for r in index.table("vectors").collect()} == {"one", "two"}


@pytest.mark.parametrize("step", ["create", "write", "rename"])
def test_a_writer_that_dies_inside_the_write(spark, index, monkeypatch, step):
    push(index, "one", ("r:main", "a.py", "def one():\n    pass\n"))
    before = whole(index, "vectors", "indexed_files")
    publish, rename = IndexTables._publish, IndexTables._rename
    state = {"left": 1}

    def dies(self, session, version, parent=None):
        if "vectors" not in {t for t in version.parts if version.parts[t] != (parent.parts if parent else {}).get(t)} or not state["left"]:
            return publish(self, session, version, parent)
        state["left"] = 0
        if step == "write":
            fs, path = self._folder(session, f"{self.root}/versions/draft-dead")
            stream = fs.create(path, False)
            stream.write(bytearray(version.encoded(parent).encode()[:20]))
            stream.close()
        raise RuntimeError("lost")

    def no_rename(self, session, source, target, over=False):
        if state["left"] and "vectors" in open(str(source.toUri().getPath())).read():
            state["left"] = 0
            raise RuntimeError("lost")
        return rename(self, session, source, target, over)

    monkeypatch.setattr(IndexTables, *(("_rename", no_rename) if step == "rename" else ("_publish", dies)))
    with pytest.raises(RuntimeError):
        push(index, "two", ("r:main", "b.py", "def two():\n    pass\n"))
    monkeypatch.undo()
    assert whole(index, "vectors", "indexed_files") == before
    push(index, "two", ("r:main", "b.py", "def two():\n    pass\n"))
    assert {r.name for r in index.table("vectors").collect()} == {"one", "two"}
    assert not os.listdir(f"{index.tables.root}/staging")      # neither batch left its push behind


def test_a_commit_names_what_it_changes(spark, index):
    key = lambda i: ("t", f"r{i}", "main")
    folder = lambda i, b: f"p_tenant_id=kt/p_repository_id=kr{i}/p_branch=kmain/b_batch={b}"
    many = Version(1, {"vectors": {key(i): folder(i, "a") for i in range(500)}})
    index.tables._publish(spark, many, index.tables.current(spark))
    assert index.tables.current(spark).parts == many.parts
    now = many
    for n in range(2, 2 * CHECKPOINT + 3):
        parts = dict(now.parts["vectors"])
        parts[key(n)] = folder(n, f"b{n}")
        del parts[key(499 - n)]
        after = Version(n, {"vectors": parts}, {"s": (n, f"b{n}")})
        assert (len(after.encoded(now).split("\n")) == 5) == (n % CHECKPOINT != 0)
        index.tables._publish(spark, after, now)
        assert index.tables.current(spark) == after
        now = after
    assert IndexTables(index.tables.root, 5).current(spark).number == 5


def test_reclaiming_frees_and_tells(index):
    for i in range(4):
        push(index, f"b{i}", ("r:main", "a.py", f"def f{i}():\n    pass\n" * 50), (f"q{i}:main", "b.py", f"def g{i}():\n    pass\n"))
    index = index.compact()
    before = whole(index)
    young = index.reclaim(keep=2).first()
    assert young.folders > 0 and len(versions(index)) == 2
    report = index.reclaim(keep=1, grace_hours=0).first()
    assert report.size_after < young.size_before and report.size_after == index.tables.size(index.spark)
    assert whole(index) == before and len(versions(index)) == 1
    again = index.reclaim(keep=1, grace_hours=0).first()
    assert (again.folders, again.versions) == (0, 0)
    push(index, "later", ("r:main", "c.py", "def h():\n    pass\n"))
    assert "h" in {r.name for r in index.table("vectors").collect()}
    with pytest.raises(ValueError):
        index.reclaim(keep=0)


def test_a_search_reads_folders_of_its_scope_only(index):
    push(index, "one", ("r:main", "a.py", "def one():\n    pass\n"), ("r:dev", "a.py", "def one():\n    pass\n"), ("s:main", "a.py", "def one():\n    pass\n"))
    files = lambda *scope: {f.split("p_repository_id=k")[1].split("/b_batch")[0] for f in index.table("vectors", *scope).inputFiles()}
    assert files() == {"r/p_branch=kmain", "r/p_branch=kdev", "s/p_branch=kmain"}
    assert files("t", "r") == {"r/p_branch=kmain", "r/p_branch=kdev"} and files("t", None, "main") == {"r/p_branch=kmain", "s/p_branch=kmain"}
    assert index.table("vectors", "nobody").count() == 0
    text = index.search("one", "t", "s", "main")._jdf.queryExecution().analyzed().toString()
    assert index.search("one", "t", "s", "main").count() == 1 and "Relation" in text


def test_a_stream_killed_after_its_commit_changes_nothing_when_it_goes_on(spark, index, tmp_path):
    source = str(tmp_path / "in")
    rows = [("r:main", "a.py", "def one():\n    pass\n"), ("r:main", "b.rs", "pub fn two() {\n}\n")]
    spark.createDataFrame(rows, PUSH).coalesce(1).write.json(source)

    def killed(batch, report):
        raise RuntimeError("killed")

    def run(on_report=None):
        running = start_indexing(sources.stream_pushes(spark, source, 1), index.tables, index.provider, str(tmp_path / "cp"), "t", at(), on_report=on_report)
        running.awaitTermination()

    with pytest.raises(Exception, match="killed"):
        run(killed)
    before, number, seen = whole(index), versions(index), []
    run(lambda batch, report: seen.extend((batch, r.files_processed, r.new_files) for r in report.collect()))
    assert whole(index) == before and versions(index) == number and seen == [(0, 2, 2)]
    spark.createDataFrame([("r:main", "a.py", "def other():\n    pass\n")], PUSH).coalesce(1).write.mode("append").json(source)
    run()
    assert {(r.name, r.generation) for r in index.table("vectors").collect()} == {("other", 2), ("two", 1)}


def files_of(index):
    return sorted((r.file_path, r.name, r.generation) for r in index.table("vectors").collect())


def test_a_tree_is_followed_through_changes_and_deletions(spark, index, tmp_path):
    root, reports = tmp_path / "tree", []
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.py").write_text("def one():\n    pass\n")
    (root / "b.rs").write_text("pub fn two() {\n}\n")
    push(index, "other", ("r:dev", "z.py", "def kept():\n    pass\n"))

    def change(batch, report):
        reports.append([(r.new_files, r.updated_files, r.unchanged_files, r.deleted_files) for r in report.collect()])
        if batch == 0:
            assert files_of(index) == [("b.rs", "two", 1), ("src/a.py", "one", 1), ("z.py", "kept", 1)]
            (root / "src" / "a.py").write_text("def changed():\n    pass\n")
            (root / "c.py").write_text("def three():\n    pass\n")
        elif batch == 1:
            assert files_of(index) == [("b.rs", "two", 1), ("c.py", "three", 1), ("src/a.py", "changed", 2), ("z.py", "kept", 1)]
            (root / "b.rs").unlink()
        elif batch == 2:
            assert files_of(index) == [("c.py", "three", 1), ("src/a.py", "changed", 2), ("z.py", "kept", 1)]
            for path in (root / "src" / "a.py", root / "c.py"):
                path.unlink()
        elif batch == 3:
            raise RuntimeError("enough")

    running = start_watching(spark, str(root), index.tables, index.provider, str(tmp_path / "cp"), "t", "r", "main", at(), on_report=change, processingTime="0 seconds")
    with pytest.raises(Exception, match="enough"):
        running.awaitTermination()
    assert reports == [[(2, 0, 0, 0)], [(1, 1, 1, 0)], [(0, 0, 2, 1)], [(0, 0, 0, 2)]]
    assert files_of(index) == [("z.py", "kept", 1)] and index.table("indexed_files").count() == 1 and index.table("chunk_metadata").count() == 1


def test_sync_of_an_empty_tree(index, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.py").write_text("def x():\n    pass\n")
    assert index.sync(str(tmp_path / "t"), "r", "main", "one", "t", at()).first().new_files == 1
    (tmp_path / "t" / "x.py").unlink()
    row = index.sync(str(tmp_path / "t"), "r", "main", "two", "t", at()).first()
    assert (row.deleted_files, row.files_processed) == (1, 0) and index.table("vectors").count() == 0


def test_an_index_packed_to_a_budget(spark, index):
    code = "".join(f"def f{i}(a):\n    return a + {i}\n\n" for i in range(12))
    words = lambda content: F.size(F.split(F.trim(content), r"\\s+"))
    index.index(spark.createDataFrame([("r:main", "a.py", code)], PUSH), "one", "t", at(), budget=TokenBudget(20, counter=words))
    rows = index.table("vectors").orderBy("chunk_index").collect()
    assert 1 < len(rows) < 12 and all(r.token_count <= 20 for r in rows)
    assert sum(len(r.content.split()) for r in rows) == len(code.split()) and [r.chunk_index for r in rows] == list(range(len(rows)))
    assert index.table("chunk_metadata").count() == len(rows)


def test_chunks_of_one_range_are_both_kept(spark, index):
    """The last part of the class and the second half of its method are the same lines, so their ids are equal."""
    code = f"impl a {{\n    fn b() {{\n        s = {'x' * 60}\n        t = {'y' * 22}\n    }}\n}}\n"
    pushed = pushed_files(spark.createDataFrame([("r:main", "a.rs", code)], PUSH), "t")
    index_batch(spark, index.tables, pushed, index.provider, "one", at(), 20)
    cut = chunked_files(pushed.withColumn("generation", F.lit(1).cast("long")), 20).select("chunk_index", "chunk_id", "kind").collect()
    assert len({r.chunk_id for r in cut}) < len(cut)
    for name in ("vectors", "chunk_metadata"):
        assert sorted(map(tuple, index.table(name).select("chunk_index", "chunk_id", "kind").collect())) == sorted(map(tuple, cut))
    points = index.table("vectors")
    ranged = HashedEmbedding(16).embed(F.expr("cast(substring(encode(code, 'utf-8'), cast(byte_start as int) + 1, cast(byte_end - byte_start as int)) as string)"))
    told = points.withColumn("code", F.lit(code)).withColumn("ranged", ranged).select("kind", "embedding", "ranged").collect()
    assert all(r.embedding == r.ranged for r in told) and "impl_part" in {r.kind for r in told}      # not of the header in front
    found = search.with_content(search.top(points.drop("content").withColumn("similarity", F.lit(1.0)), 10), points)
    assert sorted((r.chunk_index, r.content) for r in found.collect()) == sorted((r.chunk_index, r.content) for r in points.collect())


def test_a_stream_of_a_table_that_is_a_file_or_a_folder(spark, tmp_path):
    folder, own = "/root/testdata/sf0.001", str(tmp_path / "tables")
    corpus.table(spark, folder, "documents").repartition(3).write.parquet(f"{own}/documents.parquet")
    corpus.table(spark, folder, "customer").write.parquet(f"{own}/more_documents.parquet")
    for where in (folder, own):
        seen = []
        corpus.table_stream(spark, where, "documents").writeStream.foreachBatch(lambda batch, _: seen.extend(r.doc_id for r in batch.collect())).option(
            "checkpointLocation", str(tmp_path / f"checkpoint{len(where)}")).trigger(availableNow=True).start().awaitTermination()
        assert sorted(seen) == sorted(r.doc_id for r in corpus.table(spark, where, "documents").collect())
