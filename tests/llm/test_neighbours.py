"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlog.llm import neighbours
from weftlog.llm.neighbours import Index, nearest, recall, traverse

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("shard", T.IntegerType()), T.StructField("h1", T.StringType())])


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    def put(rows):
        path = str(tmp_path_factory.mktemp("vectors") / "embeddings.parquet")
        spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return put


def brute(rows, asked, k=10):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[(i, tuple(np.float32(v).tolist()))] = np.array(np.float32(v), np.float64)
    out = []
    for (i, _), q in ok.items():
        if asked(i):
            near = sorted((float(np.sqrt(((x - q) ** 2).sum())), j) for (j, _), x in ok.items() if j != i)[:k]
            out += [(i, n + 1, j, d) for n, (d, j) in enumerate(near)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def same(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert all(math.isclose(x[3], y[3], rel_tol=1e-12, abs_tol=1e-15) for x, y in zip(a, b, strict=True))


def rows_of(n=900, width=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width)) * 3
    return [(i, (centres[i % 12] + rng.standard_normal(width)).astype(np.float32).tolist()) for i in range(n)]


def test_edge_cases_compared_whole(spark, table):
    nan, inf = float("nan"), float("inf")
    rows = rows_of(300) + [(None, [1.0] * 8), (400, None), (500, []), (600, [0.0] * 8), (700, [1.0] * 7 + [nan]), (800, [inf] + [1.0] * 7), (900, [None] + [1.0] * 7)]
    rows += [(1000 + i, [2.0] * 8) for i in range(40)] + [(1100, [2.0] * 8)] * 3 + [(0, rows[0][1])]
    same(got(nearest(table(rows), F.col("vec_id") % 20 == 0)), brute(rows, lambda i: i % 20 == 0))


def test_other_widths_take_no_part(spark, table):
    rows = rows_of(50)
    out = nearest(table([*rows, (100, [1.0, 2.0]), (200, [3.0])]), F.col("vec_id") % 10 == 0)
    same(got(out), brute(rows, lambda i: i % 10 == 0))


@pytest.mark.parametrize("width", [1, 2, 3])
def test_few_rows_of_small_width(spark, table, width):
    rows = [(i, [float(i + 1)] * width) for i in range(4)]
    same(got(nearest(table(rows), F.col("vec_id") >= 0)), brute(rows, lambda i: True))


def test_empty_and_single(spark, table):
    assert got(nearest(table([]), F.col("vec_id") == 0)) == []
    assert got(nearest(table([(1, [1.0, 2.0])]), F.col("vec_id") == 1)) == []
    assert got(nearest(table(rows_of(30)), F.lit(None).cast("boolean"))) == []


def test_recall_and_exact_scores(spark, table, monkeypatch):
    """Small shards, divided cells and copied shards change nothing; recall is above 0.9 where a part is compared."""
    monkeypatch.setattr(neighbours, "LEAST_COMPARED", 20)
    rows = rows_of(900)
    want = brute(rows, lambda i: i % 20 == 0)
    plain = got(nearest(table(rows), F.col("vec_id") % 20 == 0))
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 7)
    monkeypatch.setattr(neighbours, "SLOT_QUERIES", 3)
    monkeypatch.setattr(Index.sharded, "__defaults__", (7,))
    assert got(nearest(table(rows), F.col("vec_id") % 20 == 0)) == plain
    exact = {(q, j): d for q, _, j, d in want}
    hits = [(q, j, d) for q, _, j, d in plain if (q, j) in exact]
    assert 0.9 <= len(hits) / len(want)
    assert all(math.isclose(d, exact[(q, j)], rel_tol=1e-12) for q, j, d in hits)
    frames = [spark.createDataFrame([(q, j) for q, _, j, _ in x], "query_id long, vec_id long") for x in (plain, want)]
    assert recall(*frames) == pytest.approx(len(hits) / len(want))
    # a fiftieth of the entries is less than all, and finds less than all
    few = got(nearest(table(rows), F.col("vec_id") % 20 == 0, share=0.02))
    assert len({(q, j) for q, _, j, _ in few} & set(exact)) < len(want)


def test_traversal_is_in_order_of_summed_distance():
    rng = np.random.default_rng(3)
    one, two, counts = rng.random(9), rng.random(7), rng.integers(0, 4, 63)
    sums = (one[:, None] + two[None]).ravel()
    for wanted in (1, 10, 50, 1000):
        cells = traverse(one, two, counts, wanted)
        order = [c for c in np.argsort(sums, kind="stable") if counts[c]]
        need = np.searchsorted(np.cumsum(counts[order]), wanted) + 1
        assert cells == order[: min(need, len(order))]


def test_shards_hold_every_cell():
    counts = np.array([0, 3, 4, 0, 25, 1, 2, 2, 60, 0, 9, 9])
    index = Index(np.zeros((3, 1)), np.zeros((4, 1)), 1.0).sharded(counts, 10)
    held = {}
    for cell, (shard, pieces, n) in enumerate(zip(index.shard, index.pieces, counts, strict=True)):
        for p in range(pieces):
            held.setdefault(shard + p, []).append((cell, n / pieces))
    assert sorted(held) == list(range(max(held) + 1))
    assert all(sum(n for _, n in x) <= 20 for x in held.values())
    assert all(len(held[s]) == 1 for s, p in zip(index.shard, index.pieces, strict=True) if p > 1)
