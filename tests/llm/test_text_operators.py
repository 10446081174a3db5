"""Operators on whole texts against brute force: personal data, secrets, near copies, benchmark text."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seamark.llm import decontam, fmindex, neardup, pii, queries, secrets, textbytes
from seamark.llm.common import Scratch
from tests.llm import brute

CLASH = {"row": "x", "id": "y", "kind": "z", "node": "n", "base": "b", "n": "1", "label": "l", "cid": "c"}


def documents(spark, rows):
    """doc_id, text, and columns that clash with the operators' own names."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items()])


@pytest.fixture(scope="module")
def odd(spark):
    rows = list(enumerate(brute.ODD_TEXTS)) + [(0, brute.ODD_TEXTS[0]), (None, "a@b.cd token=abcdefghijklmnop"), (3, brute.ODD_TEXTS[3])]
    return documents(spark, rows).cache()


def test_words_of_many_texts():
    texts = ["Ab cD\x0b\u00e9", "", None, "x", "ab  ", "AB"]
    (w,) = textbytes.words(pa.array(texts))
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends)] == ["Ab", "cD", "\u00e9", "x", "ab", "AB"]
    assert w.hashes[0] == w.hashes[4] == w.hashes[5] and len(set(w.hashes)) == 4
    many = [f"w{i} " * 50 for i in range(2000)]
    parts = list(textbytes.words(pa.array(many), size=1000))
    assert len(parts) > 100 and sum(len(p.hashes) for p in parts) == 100_000


def test_pii_base_spans(spark, odd):
    got = pii.digest(pii.find_pii(spark, odd)).collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, brute.digest(brute.pii_spans(r.text))) for r in odd.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.base_sha256) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].n_card == sum(k == "card" for k, _, _ in brute.pii_spans(brute.ODD_TEXTS[3]))


@pytest.mark.parametrize("text", ["4" * 200_000, "a." * 100_000 + "@" + "b." * 100_000 + "c", "1." * 100_000, "+1" + " " * 200_000, "f" * 200_000, "a@" * 100_000])
def test_very_long_runs_end(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.find_pii(spark, docs).count() == 1
    assert neardup.near_duplicates(spark, docs).first().kept


def test_pii_bootstrap_finds_unseen(spark):
    rows = [(i, f"please dial +1 ({200 + i}) 555-{1000 + i} now, version {i}.5 is out") for i in range(40)] + [
        (100, "please dial (345) 555-9876 now"), (101, "please dial tomorrow"), (102, "version 345 555 9876 is out"), (103, None)]
    out = {r.doc_id: r for r in pii.digest(pii.find_pii(spark, documents(spark, rows))).collect()}
    assert out[100].spans == "phone:12:26" and out[100].n_phone == 0 and out[100].n_added == 1
    assert all(out[i].n_added == 0 for i in (*range(40), 101, 102, 103))


def test_pii_bootstrap_with_as_many_unseen_as_seeds(spark):
    rows = [(i, f"call me on phone: +1 ({200 + i}) 555-{1000 + i} today") for i in range(200)]
    rows += [(1000 + i, f"write to us or phone: ({200 + i}) 777-{1000 + i} at once") for i in range(200)]
    rows += [(2000 + i, f"it was opened on 2024-03-{10 + i} at noon, order {5000000 + i} was sent") for i in range(15)]
    out = {r.doc_id: r for r in pii.digest(pii.find_pii(spark, documents(spark, rows))).collect()}
    assert all(out[1000 + i].spans == "phone:22:36" for i in range(200))
    assert all(out[i].n_added == 0 for i in (*range(200), *range(2000, 2015)))


def test_pii_second_round_finds_what_the_first_cannot(spark):
    rows = [(i, f"please dial +1 ({200 + i}) 555-{1000 + i}") for i in range(20)]
    rows += [(100 + i, f"please dial (345) 666-{2000 + i}") for i in range(10)]      # learned in the first round
    rows += [(200 + i, f"her mobile (345) 666-{2000 + i}") for i in range(10)]       # and so their other context
    rows += [(300, "her mobile (345) 777-9876"), (301, "her bicycle (345) 777-9877"), (302, None), (303, "")]
    found = pii.find_pii(spark, documents(spark, rows))
    out = {r.doc_id: r.spans for r in pii.digest(found).collect()}
    assert out[300] == "phone:11:25" and out[301] == out[302] == out[303] == ""
    assert pii.find_pii(spark, documents(spark, rows).limit(0)).count() == 0


def test_secret_base_spans_and_learned(spark, odd):
    net = secrets.CharNet(np.zeros((secrets.WIDTH, secrets.SIGNS, secrets.FILTERS)), np.zeros(secrets.FILTERS), np.zeros(2 * secrets.FILTERS), 0.0)
    found = secrets.find_secrets(odd, net)
    got = found.select("text", *queries.spans_digest(found)).collect()
    assert all(r.base_sha256 == brute.digest(brute.secret_spans(r.text)) for r in got) and len(got) == odd.count()
    keen = secrets.find_secrets(spark.createDataFrame([(1, "see Zx9Kq2Lm8Pw4Rt6Yv3 there")], "doc_id long, text string"),
                                secrets.CharNet(net.kernel, net.shift, net.out, 9.0, threshold=0.5))
    assert keen.select("secrets.all").first()[0][0].asDict() == {"kind": "learned", "start": 4, "end": 22}


def test_secret_network_learns(spark):
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(600)]
    plain = [f"{rng.choice(['report', 'figure', 'section'])}-{rng.randint(2000, 2024)}-{rng.randint(1, 12)}-overview-and-summary" for _ in range(600)]
    rows = [(i, f'set key = "{h}" for it') for i, h in enumerate(hexes)] + [(1000 + i, f"read {p} of it") for i, p in enumerate(plain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = secrets.train(docs)
    unseen = ['set key = "9F3kQ0zLw8XmB2vT7cR1" for it', "read report-2023-4-overview-and-more of it"]
    spans = [[(m, *s) for s in secrets.candidates(m)] for m in unseen]
    chance = net.probability(secrets.encode([secrets.window(*s[0]) for s in spans]))
    assert net.threshold <= 1 and chance[0] > chance[1] and chance[1] < net.threshold


def test_secret_threshold_keeps_recall():
    rng = random.Random(5)
    token = lambda: "".join(rng.choice("0123456789abcdefXYZ") for _ in range(32))
    texts = [(f"key {token()} ", 1) for _ in range(300)] + [(f"key report-{rng.randint(1, 99)}-overview-and-summary ", 0) for _ in range(300)]
    texts += [(f"key {token()} ", 0) for _ in range(12)]     # others that look like findings
    rng.shuffle(texts)
    codes = secrets.encode([secrets.window(t, 4, len(t) - 1) for t, _ in texts])
    labels = np.array([float(y) for _, y in texts])
    net = secrets.fit(codes, labels)
    held = np.arange(len(labels)) % 3 == 2
    assert (net.probability(codes[held & (labels == 1)]) >= net.threshold).mean() >= 0.98
    assert net.recall >= 0.98 and net.false_alarms > 0


def test_secrets_without_rule_are_no_counter_examples(spark):
    text = "the service Zx9Kq2/Lm8Pw4+Rt6Yv3Bn1 answers; password=abcdefabcdefzz12 report-2023-4-overview-and-more"
    rows = spark.createDataFrame([(text,)], "text string").select(secrets._labelled("text")).first()[0]
    other = [r.window.replace("\0", "") for r in rows if not r.secret]
    assert not any(w[min(24, text.index("Zx9")):].startswith("Zx9") for w in other)
    assert any("report-2023-4-overview-and-more" in w for w in other)
    bare = [r.window for r in rows if r.secret and "password" not in r.window]
    assert bare and all("abcdefabcdefzz12" in w for w in bare)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a password=abcdefabcdefabcdef12 b"), (2, None), (3, "clean")], "doc_id long, text string")
    net = secrets.fit(np.zeros((0, secrets.BEFORE + secrets.BODY + secrets.AFTER), np.int64), np.zeros(0))
    found = secrets.find_secrets(docs, net)
    out = [r[0] for r in found.orderBy("doc_id").select(secrets.redact(F.col("text"), F.col("secrets.all"))).collect()]
    assert out == ["a [SECRET] b", None, "clean"]


def copies(seed=1):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 4000)}" for _ in range(rng.choice([1, 3, 4, 5, 30, 120]))] for _ in range(40)]
    rows, n = [], 0
    for words in base:
        for _ in range(rng.randint(1, 4)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 50)}"
            rows.append((n, " ".join(copy)))
            n += 1
    group = [f"g{i}" for i in range(150)]
    for _ in range(150):    # one large group, deeper than a small node
        copy = list(group)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(150)] = f"y{rng.randint(0, 9999)}"
        rows.append((n, " ".join(copy)))
        n += 1
    return rows + [(n, ""), (n + 1, None), (n + 2, "  \t "), (n + 3, rows[7][1].upper()), (3, rows[3][1]), (None, rows[9][1])]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    rows = copies()
    got = neardup.near_duplicates(spark, documents(spark, rows), shingle=size).collect()
    sets = [brute.shingles(text, size) for _, text in rows]
    part = brute.components(sets, brute.similar)
    lowest = {}
    for (i, _), root in zip(rows, part):
        lowest[root] = min((x for x in (lowest.get(root), i) if x is not None), default=None)
    want = sorted((str(i), len(s), str(lowest[root]), i == lowest[root]) for (i, _), s, root in zip(rows, sets, part))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == want


def test_near_duplicates_in_a_large_node_without_words_of_their_own(spark):
    # two words for each of 150 places, one of them rare: 0.78 between any two, no word tells copies (one place differs) from the rest
    rng = np.random.default_rng(3)
    rare = rng.random((240, 150)) < 0.066
    rare[1:80:2] = rare[0:80:2]
    rare[np.arange(1, 80, 2), rng.integers(0, 150, 40)] ^= True
    rows = [(i, " ".join(f"w{k}{'r' if x else 'm'}" for k, x in enumerate(line))) for i, line in enumerate(rare)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, documents(spark, rows), shingle=1, percent=95, trees=4).collect()}
    want = brute.components([brute.shingles(t, 1) for _, t in rows], lambda a, b: brute.similar(a, b, 95))
    assert [i for i in got if got[i] != want[i]] == [] and len(set(want)) <= 200


def test_near_duplicates_compares_what_is_left_block_by_block(spark):
    rows = [(i, " ".join([f"c{k}" for k in range(130)] + [f"p{i // 2}x{k}" for k in range(10)] + [f"o{i}x{k}" for k in range(8)])) for i in range(60)]
    scratch = Scratch(spark, "t")
    docs = scratch.keep(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = scratch.keep(docs.select("doc_id", neardup.sketch(docs.text, 1).alias("s")).select("doc_id", "s.*"))
    flat = classes.select("cid", "n", "b1", "b2", "sig", "doc_id").selectExpr("*", "cid label", "cid home", "1L node", "60L size")
    names = {r.cid: r.doc_id for r in classes.collect()}
    found = neardup._pairs_in_blocks(flat, 80, 8).collect()
    assert len(found) == len(set(found))
    pairs = {tuple(sorted((names[r.a], names[r.b]))) for r in found}
    assert {(i, i + 1) for i in range(0, 60, 2)} <= pairs


def test_near_duplicates_make_no_row_for_each_pair(spark):
    # 120 copies, all linked with all: 7,140 pairs
    rows = [(i, " ".join([f"c{k}" for k in range(150)] + [f"o{i}x{k}" for k in range(8)])) for i in range(120)]
    scratch = Scratch(spark, "t")
    classes = scratch.keep(spark.createDataFrame(rows, "doc_id long, text string").select(neardup.sketch(F.col("text"), 1).alias("s")).select("s.*"))
    flat = classes.select("cid", "n", "b1", "b2", "sig").selectExpr("*", "cid label", "1L node", "120L size")
    pairs = [(r.a, r.b) for r in neardup._pairs_in_blocks(flat, 80, 200).collect()]
    assert len(pairs) == 119 and len({c for p in pairs for c in p}) == 120
    sets = scratch.keep(spark.createDataFrame(rows, "doc_id long, text string").select(neardup.shingle_set(F.col("text"), 1).alias("s")).select("s.*"))
    links = [(r.a, r.b) for r in neardup.near_duplicate_links(classes, scratch, 80, lambda wanted: sets.join(wanted, "cid")).collect()]
    assert len(links) <= 16 * 119
    place = {c: k for k, c in enumerate(sorted({c for p in links for c in p}))}
    linked = {frozenset((place[a], place[b])) for a, b in links}
    assert len(place) == 120 and len(set(brute.components(list(range(120)), lambda x, y: frozenset((x, y)) in linked))) == 1


def test_sizes_of_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, top, size).astype(np.uint64)) for top, size in ((3000, 2000), (3000, 1500), (40, 30), (40, 10), (10**15, 700))] + [np.arange(1, dtype=np.uint64)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    for columns, rows in ((512, 256), (7, 2)):
        assert [list(r) for r in neardup._common(sets, columns, rows)] == want


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark, documents(spark, [])).collect() == []


def test_fm_index():
    rng = np.random.default_rng(2)
    for size, alphabet in ((1, 2), (50, 3), (2000, 5), (3000, 700)):
        text = rng.integers(1, alphabet + 1, size)
        index = fmindex.FMIndex(text, step=4)
        patterns = [text[a:a + n] for a, n in ((0, 1), (size // 2, 3), (size // 3, 7)) if a + n <= size] + [np.array([alphabet + 5]), np.array([1, alphabet, 1])]
        matrix = np.zeros((len(patterns), 8), dtype=np.int64)
        for i, p in enumerate(patterns):
            matrix[i, 8 - len(p):] = p
        low, high = index.search(matrix, np.array([len(p) for p in patterns]))
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(size - len(p) + 1) if (text[i:i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_contamination(spark):
    rng = random.Random(5)
    words = [f"b{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 13, 20])))) for i in range(12)] + [(20, None), (21, "..."), (None, "b1 b2 b3"), (3, "b5 b6")]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice([rng.choice(items)[1] or "", " ".join(rng.choice(words + ["q", "r"]) for _ in range(30)), "Zeta, " * 20]))
        rows.append((i, ". ".join(parts).upper() if i % 3 else ", ".join(parts)))
    rows += [(100, None), (101, ""), (5, rows[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(documents(spark, rows), bench).select("doc_id", "text", "contamination.*").collect()
    known = [(i, t) for i, t in items if i is not None]
    for r in got:
        n, hit, names, bad = brute.contamination(r.text, items)
        assert (r.n_words, r.n_hit, r.items, r.contaminated) == (n, hit, brute.contamination(r.text, known)[2], bad)
        assert sum(len(brute.ALNUM.findall(r.text[s.start:s.end])) for s in r.spans) == hit
    assert len(got) == len(rows)
    nothing = decontam.contamination(documents(spark, rows), bench.filter("item_id = 20")).select(F.max("contamination.n_hit")).first()[0]
    assert nothing == 0
    with pytest.raises(ValueError):
        decontam.load_phrases(bench, max_bytes=10)
