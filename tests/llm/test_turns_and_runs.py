"""Periodic runs and conversation repair against brute force; language by held-out labels."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seamark.llm import langid, repair, runs
from seamark.llm.common import read
from tests.conftest import SMALL


def least_edits(symbols):
    """(cost, edits) by a table over all suffixes, whole strings compared."""
    def with_inserts(row):
        for _ in range(3):
            for state in range(4):
                cost, edits = row[repair.WRITES[state]]
                row[state] = min(row[state], (cost + 2, "I" + edits))
        return row

    never = (10**9, "")
    row = with_inserts([(0, ""), never, never, (0, "")])
    for symbol in reversed(symbols):
        row = with_inserts([min((row[to][0] + price, edit + row[to][1]) for edit, price, to in repair.moves(state, symbol)) for state in range(4)])
    return row[0]


@pytest.mark.parametrize("length", range(4))
def test_repair_of_every_short_conversation(length):
    for symbols in itertools.product(range(repair.SYMBOLS), repeat=length):
        assert repair.repair(list(symbols))[:2] == least_edits(symbols)


@pytest.mark.parametrize("seed", range(4))
def test_repair_of_long_conversations(seed):
    rng = random.Random(seed)
    for _ in range(300):
        symbols = [rng.choice([0, 1, 2, 2, 2, 3, 4, 4, 4, 5, 6, 7, 8]) for _ in range(rng.randint(0, 60))]
        cost, audit, left = repair.repair(symbols)
        assert (cost, audit) == least_edits(symbols)
        assert len(left) == len(audit) - audit.count("D") and [row for row, _ in left if row >= 0] == [
            row for row, edit in enumerate(audit.replace("I", "")) if edit != "D"]


def test_block_table_equals_single_steps():
    t = repair.tables()
    assert len(t.block[0]) == repair.SYMBOLS ** repair.BLOCK
    rng = random.Random(5)
    for _ in range(500):
        v = rng.randrange(len(t.vectors))
        symbols = [rng.randrange(repair.SYMBOLS) for _ in range(repair.BLOCK)]
        code, at, rise = 0, v, 0
        for s in symbols:
            code, rise, at = code * repair.SYMBOLS + s, rise + t.rise[at][s], t.step[at][s]
        assert (t.block[v][code], t.block_rise[v][code]) == (at, rise)


TALK = "conv_id long, turn long, role string, text string, turns string"


def test_conversations_with_odd_rows(spark):
    rows = [(1, 0, "system", "Be kind.", "x"), (1, 1, "user", "Hello?", "x"), (1, 1, "user", "Hello?", "x"), (1, 4, "assistant", "Yes", "x"), (1, None, "user", None, "x"),
            (2, 0, "assistant", "Late.", "x"), (3, 0, None, "a" * 200_000 + ".", "x"), (None, 1, "user", "Who?", "x"), (4, 7, "tool", " \t\n", "x")]
    df = spark.createDataFrame(rows, TALK).repartition(3)
    talks = repair.gather(df)
    found = {r.conv_id: r for r in repair.digest(repair.repair_conversations(talks)).collect()}
    one = found[1]
    # turns 0, 1, 1, 4 and a blank one without number in front
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.cost, one.audit) == (2, 1, 1, 1, 2, 7, "DKKDK")
    assert one.repaired_sha256 == hashlib.sha256(b"system:Be kind.\nuser:Hello?\nassistant:Yes").hexdigest()
    assert (found[2].audit, found[2].cost) == ("IK", 2) and found[2].repaired_sha256 == hashlib.sha256(b"user:\nassistant:Late.").hexdigest()
    assert (found[3].audit, found[3].cost) == ("D", 3) and (found[None].audit, found[None].cost) == ("KI", 2)
    assert (found[4].blank, found[4].audit, found[4].repaired_sha256) == (1, "D", hashlib.sha256(b"").hexdigest())


def test_conversations_without_rows(spark):
    empty = spark.createDataFrame([], TALK)
    assert repair.digest(repair.repair_conversations(repair.gather(repair.damaged(empty), F.lit(1)))).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    only = repair.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.", "x")], TALK))
    row = repair.digest(repair.repair_conversations(repair.gather(only, F.col("copies")))).first()
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    talks = repair.gather(spark.createDataFrame([(1, 0, "user", "Hi.", "x")], TALK)).withColumn("kept", F.lit(1))
    kept = repair.repair_conversations(talks)
    assert kept.columns == ["conv_id", "turns", "kept", "repair"] and kept.first()["repair"]["turns"][1].role == "assistant"
    with pytest.raises(ValueError):
        repair.repair_conversations(kept)


# ------------------------------------------------------------------- runs

def plain_runs(words, least=runs.LEAST, times=runs.TIMES):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def odd_words(rng, most, vocabulary):
    n = rng.randint(0, most)
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    if n and rng.random() < 0.7:
        a, p = rng.randrange(n), rng.randint(1, 30)
        words = words[:a] + [words[a + i % min(p, n - a)] for i in range(n - a)]
    return words


@pytest.mark.parametrize("seed", range(3))
def test_lyndon_words_and_runs_of_sequences(seed):
    rng = random.Random(seed)
    for _ in range(300):
        k = rng.randint(1, 3)
        keys = [int(w[1:]) for w in odd_words(rng, 60, k)]
        lengths = []
        for i in range(len(keys)):
            j = i + 1
            while j < len(keys) and keys[i:] < keys[j:]:
                j += 1
            lengths.append(j - i)
        assert runs.lyndon_lengths(keys, k) == lengths
        for least, times in ((24, 3), (2, 2)):
            assert [tuple(r) for r in runs.runs_of(np.array(keys, dtype=np.int64), k, max(1, len(keys)), least, times).tolist()] == plain_runs(keys, least, times)


@pytest.mark.parametrize("seed", range(3))
def test_runs_of_many_texts_at_once(seed):
    rng = random.Random(seed)
    texts = [odd_words(rng, 300, rng.choice([1, 2, 5, 50])) for _ in range(120)]
    for words, found in zip(texts, runs._found(pa.array(texts, pa.list_(pa.string()))).to_pylist()):
        wanted = plain_runs(words)
        assert [tuple(r.values()) for r in found["runs"]] == wanted
        gone = {i for s, n, q in wanted for i in range(s + q, s + n)}
        assert found["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_odd_documents(spark):
    long = "lorem ipsum dolor " * 30_000
    rows = [(1, None, 1), (2, "", 1), (3, "  \n ", 1), (4, "ab " * 24, 1), (5, "ab " * 23, 1), (6, long, 1), (6, long, 1), (None, "é è " * 20, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words_ long").withColumn("words", runs.words_of(F.col("text")))
    found = runs.periodic_runs(docs)
    assert found.columns == [*docs.columns, "periodic"]
    got = {r.doc_id: [tuple(x) for x in r.periodic["runs"]] for r in found.collect()}
    assert got == {1: [], 2: [], 3: [], 4: [(0, 24, 1)], 5: [], 6: [(0, 90_000, 3)], None: [(0, 40, 2)]}
    row = runs.digest(found).filter("doc_id = 6").first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 0, 90_000, 3, 30_000_000)
    assert row.collapsed_sha256 == hashlib.sha256(b"lorem ipsum dolor").hexdigest()
    none = runs.digest(found).filter("doc_id = 1").first()
    assert none.start is None and none.runs_sha256 == none.collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert runs.digest(runs.periodic_runs(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(found)


def test_periodic_ends_follow_the_contract(spark):
    rows = [(i, " ".join(f"w{k % 41}" for k in range(i % 90))) for i in range(200)] + [(1000, None)]
    got = {r.doc_id: r.words for r in runs.repeating(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words = (text or "").split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        assert got[i] == words


# ---------------------------------------------------------------- language

def test_language_of_held_out_documents(spark):
    docs = read(spark, SMALL.replace("0.001", "0.01"), "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.filter(~out))
    assert list(model.dictionaries) == ["de", "en", "es", "fr"]
    found = langid.identify(docs, model).filter(out)
    right = found.agg(F.avg((F.col("language.lang") == F.col("lang")).cast("int")).alias("all"),
                      F.avg(F.when(F.char_length("text") >= 200, F.col("language.lang") == F.col("lang")).cast("int")).alias("long")).first()
    assert right["all"] > 0.97 and right["long"] > 0.985
    assert found.filter("language.score < 0 or language.score > 1").count() == 0


def test_a_passage_that_a_dictionary_holds_does_not_decide(spark):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    known = {letters: [word(letters) for _ in range(120)] for letters in ("abcdefgh", "ijklmnop")}
    text = lambda letters, n: " ".join(rng.choice(known[letters]) for _ in range(n))
    license_line = " ".join(word("qrstuvwxyz") for _ in range(40))
    rows = [(i, "xx", text("abcdefgh", 60)) for i in range(60)] + [(100 + i, "yy", text("ijklmnop", 20) + " " + license_line) for i in range(60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    asked = spark.createDataFrame([(1, text("abcdefgh", 150) + " " + license_line)], "doc_id long, text string")
    assert langid.identify(asked, model).first()["language"]["lang"] == "xx"


def test_language_of_odd_texts(spark):
    rows = [(1, "en", "the cat sat on the mat"), (2, "de", "die Katze sass auf der Matte"), (3, None, "no label"), (4, "en", None), (5, "fr", "1234 5678")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.train(docs)
    assert list(model.dictionaries) == ["de", "en"]      # what has no letter or no text teaches nothing
    asked = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "12 ... 34", 0), (4, "The CAT sat on the mat", 0), (5, "die Katze sass auf der Matte " * 20_000, 0), (5, "x", 0), (5, "x", 0)],
                                  "doc_id long, text string, lang long")
    found = langid.identify(asked, model)
    assert found.columns == ["doc_id", "text", "lang", "language"]
    got = [(r.doc_id, *r.language) for r in found.collect()]
    assert [g[1] for g in got[:5]] == ["und", "und", "und", "en", "de"] and got[0][2:] == (0.0, True) and got[5] == got[6]
    assert langid.identify(asked.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        langid.identify(found, model)
    with pytest.raises(ValueError):
        langid.train(docs.limit(0))
