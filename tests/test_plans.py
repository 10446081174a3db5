"""Physical plans: what is pruned, what is shuffled, what is sent whole."""

import pytest

from seamark.api import Index
from seamark.functions.embedding import HashedEmbedding
from seamark.operators import changes, context
from seamark.operators import search as S
from seamark.plans import QUERIES
from seamark.sources.tables import IndexTables
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    found = Index(spark, IndexTables(str(tmp_path_factory.mktemp("index"))).create(spark), HashedEmbedding(16))
    rows = [("org/a:main", f"src/f{i}.rs", f"fn name_{i}() {{\n}}\n") for i in range(20)] + [("org/b:main", "x.py", "def f():\n    pass\n")]
    found.index(spark.createDataFrame(rows, "project_id string, path string, content string"), "one", "t")
    return found


def test_search_prunes_partitions_and_reads_no_text(index):
    found = S.search(index.table("vectors"), "name", [1.0] * 16, "t", "org/a", "main")
    text = plan(found)
    assert "TakeOrderedAndProject" in text and "Exchange hashpartitioning" not in text
    scan = next(line for line in text.split("\n") if "FileScan" in line)
    assert "tenant_id" in scan.split("PartitionFilters")[1].split("]")[0]
    assert "content" not in scan.split("ReadSchema")[1]


def test_text_of_winners_is_read_by_literal_keys(index):
    vectors = index.table("vectors")
    full = S.with_content(S.search(vectors, "name", [1.0] * 16, "t", limit=3), vectors)
    scan = next(line for line in plan(full).split("\n") if "FileScan" in line)
    assert "In(file_path" in scan and "In(chunk_id" in scan and "embedding" not in scan.split("ReadSchema")[1]


def test_excerpt_filters_reach_the_scan(index):
    found = context.excerpt(context.preferred_file(index.table("indexed_files"), "src/f1.rs", "t", "org/a"), 1)
    scan = next(line for line in plan(found).split("\n") if "FileScan" in line)
    assert "EqualTo(file_path,src/f1.rs)" in scan and "repository_id" in scan.split("PartitionFilters")[1].split("]")[0]


def test_state_check_reads_hashes_only(index):
    files = index.table("indexed_files")
    states = changes.file_states(files.select("tenant_id", "repository_id", "branch", "file_path", "content_hash"), files)
    assert all("file_content" not in line.split("ReadSchema")[1] for line in plan(states).split("\n") if "FileScan" in line)


@pytest.mark.parametrize("name", ["parse_definitions", "parse_heuristic", "chunk_pack_budget", "split_container", "embed_hashed", "highlights",
                                  "token_count_heuristic", "queue_recover", "rerank_scores", "index_chunks"])
def test_row_wise_work_shuffles_nothing(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("name", ["queue_depth", "index_stats", "stats", "job_progress", "context_by_preference"])
def test_aggregates_combine_before_the_shuffle(spark, name):
    assert "partial_" in plan(QUERIES[name](spark, SMALL))


def test_no_query_multiplies_two_tables(spark):
    quiet = {n: q for n, q in QUERIES.items() if not n.startswith(("stream_", "index_incremental", "index_vanished"))}
    for name, run in quiet.items():
        text = plan(run(spark, SMALL))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_a_batch_reads_touched_partitions_only(spark, index):
    """What a batch reads of the index is a list of folders, none of another branch."""
    whole = index.table("vectors")
    touched = index.tables.read(spark, "vectors", {("t", "org/b", "main")})
    assert touched.count() == 1 and whole.count() > 1
    files = touched.inputFiles()
    assert files and all("p_repository_id=korg%25252Fb" in f for f in files) and len(whole.inputFiles()) > len(files)
