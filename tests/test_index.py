"""The neighbour index against brute force: levels, rare presence patterns, many dimensions, and what it visits."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gaugeline.operators import cells


def brute(x, k, targets):
    out = {}
    for i in range(len(x)):
        d = cells.distances(np.repeat(x[i : i + 1], len(x), axis=0), x)
        for t in targets or [-1]:
            if t >= 0 and not np.isnan(x[i, t]):
                continue
            at = np.flatnonzero(~np.isnan(d) & (~np.isnan(x[:, t]) if t >= 0 else True))
            at = at[np.lexsort((at, d[at]))][:k]
            if len(at):
                out[i, t] = [(int(j), float(d[j])) for j in at]
    return out


def searched(spark, x, k, targets=None, **kw):
    names = cells.xcols(x.shape[1])
    rows = [(i, 1, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    base = spark.createDataFrame(rows, "nid bigint, w bigint, " + ", ".join(f"{n} double" for n in names))
    gap = F.lit(targets is None)
    for t in targets or []:
        gap = gap | F.col(names[t]).isNull()
    seen = Observation()
    found = {}
    for r in cells.search(base.filter(gap).select(F.col("nid").alias("qid"), *names), base, x.shape[1], k, targets=targets, observation=seen, **kw).collect():
        found.setdefault((r.qid, r.target), []).append((r.nid, r.dist))
    return {q: sorted(near, key=lambda z: (z[1], z[0])) for q, near in found.items()}, seen


def test_levels(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    x[400:440] = x[400]
    got, _ = searched(spark, x, 5, cell_rows=20, top=8, stretch=200)
    assert got == brute(x, 5, None)


def test_two_thousand_patterns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2600, 15))
    x[rng.random(x.shape) < 0.4] = np.nan
    x[:300, 2:] = rng.normal(size=(300, 13))  # one common pattern, all gaps of it in two columns
    x[:300, :2] = np.nan
    assert len(np.unique(np.isnan(x), axis=0)) >= 2000
    got, seen = searched(spark, x, 4, targets=[0], cell_rows=64)
    assert got == brute(x, 4, [0])
    # No cell is always visited: some queries leave some cells out, and rows of no shared column are never met.
    assert seen.get["visits"] < len(got) * (2600 // 64)


def test_clusters_in_many_dimensions(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 64)) * 3
    x = middle[rng.integers(0, 12, 900)] + rng.normal(size=(900, 64)) * 0.3
    got, seen = searched(spark, x, 5, cell_rows=40)
    assert got == brute(x, 5, None)
    assert seen.get["visits"] < 0.25 * 900 * 900 / 40


def test_few_rows_and_none(spark):
    x = np.random.default_rng(4).normal(size=(6, 3))
    assert searched(spark, x, 9)[0] == brute(x, 9, None)
    assert searched(spark, x[:0], 9)[0] == {}


@pytest.mark.parametrize("gaps", [0.0, 0.3])
def test_products_pick_few_pairs(monkeypatch, gaps):
    """On evenly spread vectors, where nothing can be pruned by bounds, few pairs need their exact distance."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 64)) + 1e5
    x[rng.random(x.shape) < gaps] = np.nan
    pairs, exact = [], cells.distances
    monkeypatch.setattr(cells, "distances", lambda q, b: pairs.append(len(q)) or exact(q, b))
    row, column, dist = cells.nearest(x, x, cells.Filter(x), 6, np.full(700, np.inf))
    assert sum(pairs) < 0.05 * 700 * 700
    for i in range(0, 700, 50):
        d = exact(np.repeat(x[i : i + 1], 700, axis=0), x)
        want = np.lexsort((np.arange(700), d))[:6]
        assert column[row == i].tolist() == want.tolist() and dist[row == i].tolist() == d[want].tolist()


def test_cells_are_bounded():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5000, 6))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:2000] = 1.0
    order = cells.Order.learn(x[:500])
    by = np.lexsort((order.curve(x), order.pattern(x)))
    number = cells.cut_stretch(x[by], order.pattern(x[by]), order.to_pivots(x[by]), 100)
    sizes = np.bincount(number)
    assert sizes.max() <= 100 and sizes.min() > 0 and np.median(sizes) >= 50


def test_runs_of_boxes_lose_no_cell(monkeypatch):
    """Boxes looked at by runs: the same cells within reach, and a start for every query that has one."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 3))
    x[rng.random(x.shape) < 0.1] = np.nan
    order = cells.Order.learn(x[:500])
    number = cells.cut_stretch(x, order.pattern(x), order.to_pivots(x), 40)
    far = order.to_pivots(x)
    boxes = pd.DataFrame([cells.box_of(x[number == c], far[number == c], np.ones((number == c).sum(), np.int64), c) for c in range(number.max() + 1)])
    q, reach = x[:300], {0: np.full(300, 0.3), 1: np.full(300, np.inf)}
    flat = cells.Boxes.of(boxes, order)
    monkeypatch.setattr(cells, "DENSE", 8)
    monkeypatch.setattr(cells, "FAN", 4)
    tree = cells.Boxes.of(boxes, order)
    assert flat.runs is None and tree.runs.runs.runs is not None
    pairs = [set(zip(*(v.tolist() for v in b.within(q, reach)), strict=True)) for b in (flat, tree)]
    assert pairs[0] == pairs[1]
    assert ((tree.best(q, 5, [0]) >= 0) == (flat.best(q, 5, [0]) >= 0)).all()


def test_boxes_within_reach_come_in_pieces(monkeypatch):
    """Queries that reach every box: what is held at once does not grow with the boxes, and nothing is lost or out of order."""
    rng = np.random.default_rng(12)
    low = rng.normal(size=(20_000, 3))
    order = cells.Order.learn(low[:500])
    monkeypatch.setattr(cells, "_PAIRS", 20_000)
    n = np.arange(len(low))
    boxes = cells.Boxes(n, low, low + 0.01, np.ones((len(low), 3), np.int64), np.empty((len(low), 0)), np.empty((len(low), 0)), n * 0 + 1, order.pivots).with_runs()
    q = rng.normal(size=(40, 3))
    q[::2] = 50.0
    reach = {-1: np.where(np.arange(40) % 2, np.inf, 1.0)}
    tracemalloc.start()
    held = [(len(row), row[0], row[-1], (np.diff(row) >= 0).all()) for row, _ in boxes.reached(q, reach) if len(row)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(h[0] for h in held) == 20 * 20_000 and max(h[0] for h in held) <= 20_000
    assert all(h[3] for h in held) and all(a[2] <= b[1] for a, b in zip(held, held[1:], strict=False))
    assert peak < 8e6
    row, node = boxes.within(q, reach)
    assert (row == np.repeat(np.arange(1, 40, 2), 20_000)).all() and (node == np.tile(n, 20)).all()


def test_one_row_a_query_leaves_a_visit():
    """Neighbours leave a block as lists, and lists of one query meet in one."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 2))
    names = cells.xcols(2)
    q = pa.table({"qid": np.arange(60), **dict(zip(names, x.T, strict=True))})
    parts = [pa.table({"nid": np.arange(60)[h], "w": np.ones(30, np.int64), **dict(zip(names, x[h].T, strict=True))}) for h in (slice(0, 30), slice(30, 60))]
    found = [cells.block_best(q, b, 2, 4, None) for b in parts]
    assert [len(f) for f in found] == [60, 60]
    merged = cells.merge_lists(pa.concat_tables(found).sort_by("qid"), 4)
    want = brute(x, 4, None)
    assert len(merged) == 60 and {(r["qid"], -1): list(zip(r["nid"], r["dist"])) for r in merged.to_pylist()} == want


@pytest.mark.parametrize("top", [8, cells.TOP])
def test_a_query_is_sent_once_to_a_group_of_cells(spark, monkeypatch, top):
    """Gaps of several patterns: neighbours as by brute force, and far fewer visits than cells within reach."""
    monkeypatch.setattr(cells, "_GROUPS", 4)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2500, 4))
    x[rng.random(2500) < 0.2, 2] = np.nan
    x[rng.random(2500) < 0.2, 3] = np.nan
    got, seen = searched(spark, x, 4, targets=[2, 3], cell_rows=20, top=top)
    assert got == brute(x, 4, [2, 3])
    queries = len({i for i, _ in got})
    assert seen.get["visits"] < 12 * queries
    monkeypatch.setattr(cells, "_GROUP", 0)
    alone, each = searched(spark, x, 4, targets=[2, 3], cell_rows=20, top=top)
    assert alone == got and each.get["visits"] > 2 * seen.get["visits"]


def test_reach_is_learnt_from_the_whole_group():
    """The k-th distance of all cells of a group, also where the first cell holds farther rows; weights and gaps count."""
    rng = np.random.default_rng(10)
    x, names = rng.normal(size=(90, 2)), cells.xcols(2)
    x[80:, 1] = np.nan
    w = rng.integers(1, 3, 90)
    b = pa.table({"nid": np.arange(90), "w": w, "cell": np.arange(90) // 30, **dict(zip(names, x.T, strict=True))})
    q = pa.table({"qid": np.arange(90), "cell": np.arange(90) % 3, **dict(zip(names, x.T, strict=True))})
    [reach] = cells.block_reach(q, b, 2, 5, None)
    for i in range(90):
        d = cells.distances(np.repeat(x[i : i + 1], 90, axis=0), x)
        by = np.lexsort((np.arange(90), d))
        assert reach[i] == d[by][np.cumsum(w[by]) >= 5][0]
