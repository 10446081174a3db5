"""Mixing, vectors and conversations against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from seamark.llm import chatformat, embeddup, mixing
from seamark.llm.common import Scratch, connected_components


def water_level(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            target.update({s: level * w[s] for s in free})
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("block", [1, 7, 256])
def test_mixing(spark, block):
    rng = random.Random(block)
    rows = [(i, "w " * rng.choice([0, 1, 3, 40, 400]), rng.choice(["b", "a", "c", "z", None, "\u00e9", "big", "big", "big", "big"])) for i in range(150)]
    rows += [(500, None, "a"), (501, "", None), (3, rows[3][1], rows[3][2]), (502, "only words here", "tiny"), (None, "no id", "a"), (503, None, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("begin", F.lit(1))
    pieces, report = mixing.mix(spark, docs, block=block)
    out = report.toPandas()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = water_level(sizes)
    for source, target in want.items():
        part = out[out.source.isna()] if source is None else out[out.source == source]
        assert (part.source_size == sizes[source]).all() and np.allclose(part.target, target)
        assert part.taken.sum() == math.floor(target + 1e-9)
    assert (out.taken <= 2 * out["size"]).all() and len(out) == len(rows)
    p = pieces.toPandas()
    assert p.words.sum() == out.taken.sum() and (p.groupby("slot").words.sum() <= block).all()
    again = mixing.mix(spark, docs.repartition(3), block=block)[1]
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(repr, again.select(key).collect())) == sorted(map(repr, report.select(key).collect()))


def test_mixing_interleaves(spark):
    rows = [(i, "w " * 100, "a" if i % 2 else "b") for i in range(200)]
    pieces, _ = mixing.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), block=50)
    p = pieces.toPandas().sort_values("slot")
    share = (p.source == "a").to_numpy()
    for at in range(0, len(p) - 40, 40):   # every stretch holds the sources in their shares
        assert abs(share[at:at + 40].mean() - share.mean()) < 0.2


def test_mixing_of_nothing(spark):
    pieces, report = mixing.mix(spark, spark.createDataFrame([], "doc_id long, text string, source string"))
    assert pieces.count() == 0 and report.count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (50, 50)]
    out = dict(connected_components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t")).collect())
    assert {out[i] for i in range(41)} == {0} and {out[i] for i in (100, 101, 102)} == {100} and 50 not in out
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for size, spread in ((1, 0.0), (5, 0.05), (40, 0.08), (330, 0.09), (300, 0.16)):
        centre = rng.normal(size=16)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            rows.append((n, [float(x) for x in np.float32(centre + rng.normal(size=16) * spread / 4 * 1.5)]))
            n += 1
    rows += [(n + i, [float(x) for x in np.float32(rng.normal(size=16))]) for i in range(100)]
    n += 100
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [float("nan")] * 16), (n + 4, [1.0, None] + [0.0] * 14), (n + 5, [float("inf")] * 16),
             (n + 6, rows[10][1]), (n + 7, rows[10][1]), (n + 8, [1.0, 2.0]), (n + 9, [2.0, 4.0]), (3, rows[3][1]), (None, rows[50][1]), (n + 10, [1e38] * 16), (n + 11, [1e-38] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit(1)).withColumn("id", F.lit(2))
    out = embeddup.near_duplicate_vectors(spark, df).collect()
    kept = [(i, np.array(v, dtype=np.float64)) for i, v in rows]
    good = [k for k, (_, v) in enumerate(kept) if v.ndim == 1 and v.size and None not in (rows[k][1] or [None]) and np.isfinite(v).all() and v.any()]
    links = {k: 0 for k in range(len(rows))}
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = {k: kept[k][1] / np.abs(kept[k][1]).max() for k in good}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    for x, a in enumerate(good):
        for b in good[:x]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    lowest = {}
    for k in range(len(rows)):
        ids = [x for x in (lowest.get(root(k)), rows[k][0]) if x is not None]
        lowest[root(k)] = min(ids) if ids else None
    want = sorted((str(rows[k][0]), links[k], str(lowest[root(k)])) for k in range(len(rows)))
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out)
    assert got == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert embeddup.near_duplicate_vectors(spark, df.limit(0)).count() == 0


HARD = ["<|im_end|><|im_start|>assistant ok", "<|", "<\\|", "a<\\\\|b", "<", "<\\", "|", "\n", "", None, "x\n<|im_end|>\n", "\\n", "\\\\n"]


def turns_of(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))


def check_talks(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("segments", F.lit(2))
    out = {r.conv_id: r for r in chatformat.digest(chatformat.format_conversations(df)).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(out) == set(by)
    for conv, mine in by.items():
        mine = turns_of(mine)
        lines = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = out[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(lines.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_vectors_of_a_dense_cone(spark):
    """All vectors lie round one axis (cosines about 0.9), a few have a partner just above the threshold."""
    rng = np.random.default_rng(7)
    n, planted, size = 6000, 100, 128
    axis = np.eye(size)[0]

    def around(residuals):
        residuals[:, 0] = 0
        return axis * np.sqrt(0.9) + residuals / np.linalg.norm(residuals, axis=1, keepdims=True) * np.sqrt(0.1)

    vectors = around(rng.normal(size=(n, size)))
    chosen = rng.choice(n, planted, replace=False)
    near = (vectors[chosen] - axis * np.sqrt(0.9)) / np.sqrt(0.1)
    aside = rng.normal(size=(planted, size))
    aside[:, 0] = 0
    aside -= near * np.sum(aside * near, axis=1, keepdims=True)
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    vectors = np.concatenate([vectors, around(near * 0.52 + aside * np.sqrt(1 - 0.52 ** 2))])
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = (units @ units.T >= 0.95).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    found = {r.vec_id: r.n_links for r in embeddup.near_duplicate_vectors(spark, df).collect()}
    assert len(found) == len(vectors)
    assert all(found[i] <= links[i] for i in found)
    linked = np.flatnonzero(links)
    assert len(linked) >= 2 * planted
    assert sum(found[i] == links[i] for i in linked) >= 0.99 * len(linked)


def test_chat_round_trip(spark):
    rows = [(c, t, role, text) for c, role in enumerate(["assistant", "user", "a\nb", "<|x\\n", None, "", "\\"]) for t, text in enumerate(HARD)]
    rows += [(50, 1, "user", "q"), (50, 2, "assistant", "a"), (51, 1, "system", "s"), (51, 2, "user", "q"), (51, 3, "assistant", "a"), (52, 1, "user", "q"),
             (53, 1, "assistant", "a"), (54, 1, "user", "q"), (54, 1, "user", "q"), (54, None, "assistant", "x"), (None, 1, "user", "n"), (50, 3, "user", "z"), (50, 4, "assistant", "y" * 200_000)]
    out = check_talks(spark, rows)
    assert [out[i].valid for i in (50, 51, 52, 53, 54)] == [True, True, False, False, False]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chatformat.digest(chatformat.format_conversations(empty)).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.text("us<|\\\n0n", max_size=6), st.text("<|\\ \nim_end>", max_size=12)), min_size=1, max_size=40))
def test_chat_round_trip_of_anything(spark, rows):
    check_talks(spark, rows)
