"""Exact medcouple of whole columns without forming the quadratic set of pairs.

The medcouple is the median of h(a, b) = (a - b) / (a + b) over distances a above and b below
the column median. h falls with b / a, so the pairs up to a threshold t are those with
b >= a (1 - t) / (1 + t), and sorted sides count them by binary search. Both sides are cut into
even value buckets; a small table of bucket totals brackets the median, and only bucket pairs
that straddle the bracket are looked at. Each round counts a grid of thresholds in those pairs
and narrows the bracket, until few enough values remain to be listed. A bucket meets only a
handful of others, so a round moves a small multiple of the column once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, long_form, num
from ..functions.quantiles import medians
from ..functions.session import keep
from .descriptive import bucket_columns
from .missing import df_of_values

GRID = 64
LIST_LIMIT = 50_000
MARGIN = 1e-12
BELOW = -2.0


def medcouple(df: DataFrame, features: Sequence[str], *, list_limit: int = LIST_LIMIT) -> DataFrame:
    """``variable, medcouple`` of every feature (0 below three values)."""
    values = medcouple_values(df, features, list_limit=list_limit)
    return df_of_values(df, {c: (v,) for c, v in values.items()}, ["medcouple"])


def medcouple_values(
    df: DataFrame,
    features: Sequence[str],
    *,
    centers: dict[str, float | None] | None = None,
    list_limit: int = LIST_LIMIT,
) -> dict[str, float]:
    spark = df.sparkSession
    if centers is None:
        centers = medians(df, {c: num(c) for c in features})
    live = [c for c in features if centers[c] is not None]
    if not live:
        return {c: 0.0 for c in features}
    n_rows = df.count()
    n_buckets = int(min(1024, max(16, n_rows // 4096)))
    work, buckets = bucket_columns(df.select(*[col(c) for c in live]), live, n_buckets)
    # Side distances of equal values share one row with their count.
    sides = keep(
        long_form(
            work,
            [],
            {
                str(i): {
                    "d": F.col(f"_x{i}") - F.lit(centers[c]),
                    "bucket": F.col(buckets[i]).cast("int"),
                }
                for i, c in enumerate(live)
            },
        )
        .filter(F.col("d").isNotNull())
        .groupBy(F.col("variable").cast("int").alias("v"), "bucket", "d")
        .agg(F.count("*").alias("w"))
    )
    try:
        summary = (
            sides.groupBy("v", F.signum("d").cast("int").alias("side"), "bucket")
            .agg(
                F.sum("w").alias("w"),
                F.count("*").alias("m"),
                F.min(F.abs("d")).alias("lo"),
                F.max(F.abs("d")).alias("hi"),
            )
            .toPandas()
        )
        searches = {
            i: _Search(part) for i, part in summary.groupby("v") if _Search.needed(part)
        }
        fixed = {i: _Search.trivial(part) for i, part in summary.groupby("v") if i not in searches}
        while any(not s.done for s in searches.values()):
            _round(spark, sides, {i: s for i, s in searches.items() if not s.done}, list_limit)
    finally:
        sides.unpersist()
    result = {c: 0.0 for c in features}
    for i, c in enumerate(live):
        result[c] = searches[i].value() if i in searches else fixed.get(i, 0.0)
    return result


class _Search:
    """Bracket of the two middle ranks of one variable, kept on the driver.

    State is the bucket table only, never rows.
    """

    def __init__(self, part: pd.DataFrame):
        zeros = int(part.loc[part.side == 0, "w"].sum())
        up = part[part.side > 0].sort_values("lo", ignore_index=True)
        down = part[part.side < 0].sort_values("lo", ignore_index=True)
        n_up, n_down = int(up.w.sum()), int(down.w.sum())
        self.minus = zeros * n_down
        self.inner = n_up * n_down
        pairs = self.minus + self.inner + zeros * n_up
        self.ranks = sorted({(pairs - 1) // 2, pairs // 2})
        self.found: dict[int, float] = {}
        for r in self.ranks:
            if r < self.minus:
                self.found[r] = -1.0
            elif r >= self.minus + self.inner:
                self.found[r] = 1.0
        self.up_bucket, self.down_bucket = up.bucket.to_numpy(), down.bucket.to_numpy()
        a_lo, a_hi = up.lo.to_numpy()[:, None], up.hi.to_numpy()[:, None]
        b_lo, b_hi = down.lo.to_numpy()[None, :], down.hi.to_numpy()[None, :]
        if n_up and n_down:
            self.h_lo = (a_lo - b_hi) / (a_lo + b_hi)
            self.h_hi = (a_hi - b_lo) / (a_hi + b_lo)
            self.weight = up.w.to_numpy(float)[:, None] * down.w.to_numpy(float)[None, :]
            self.distinct = up.m.to_numpy(float)[:, None] * down.m.to_numpy(float)[None, :]
            self.exact = [[int(x) for x in up.w], [int(x) for x in down.w]]
            self._start()

    @staticmethod
    def needed(part: pd.DataFrame) -> bool:
        return int(part.w.sum()) >= 3 and bool((part.side != 0).any())

    @staticmethod
    def trivial(part: pd.DataFrame) -> float:
        return 0.0

    def open_ranks(self) -> list[int]:
        return [r - self.minus for r in self.ranks if r not in self.found]

    def _start(self) -> None:
        """First bracket from bucket corners: it contains both middle ranks for certain."""
        wanted = self.open_ranks()
        if not wanted:
            return
        flat = self.weight.ravel()
        slack = 1.0 + self.inner * 1e-12

        def corner(h: np.ndarray, rank: float) -> float:
            order = np.argsort(h, axis=None)
            at = int(np.searchsorted(np.cumsum(flat[order]), rank, side="right"))
            return float(h.ravel()[order[min(at, len(order) - 1)]])

        low = corner(self.h_lo, max(0.0, wanted[0] - slack)) - MARGIN
        high = corner(self.h_hi, wanted[-1] + slack) + MARGIN
        self.low, self.high = max(low, -1.0), min(high, 1.0)

    @property
    def done(self) -> bool:
        return len(self.found) == len(self.ranks)

    def candidates(self) -> np.ndarray:
        """Bucket pairs that may hold a value inside the bracket."""
        return np.argwhere((self.h_hi >= self.low - MARGIN) & (self.h_lo <= self.high + MARGIN))

    def sure_below(self) -> int:
        """Pairs in bucket pairs that lie wholly below the bracket, in exact integers."""
        whole = self.h_hi < self.low - MARGIN
        up, down = self.exact
        return sum(up[i] * sum(down[j] for j in np.flatnonzero(whole[i])) for i in range(len(up)))

    def grid(self) -> np.ndarray:
        return np.linspace(self.low, self.high, GRID + 1)

    def value(self) -> float:
        return float(np.mean([self.found[r] for r in self.ranks]))


def _cut(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """For each a, index of the first sorted b whose pair does not exceed threshold ``t``."""
    if t >= 1.0:
        return np.zeros(len(a), dtype=np.int64)
    if t <= -1.0:
        return np.full(len(a), len(b), dtype=np.int64)
    return np.searchsorted(b, a * ((1.0 - t) / (1.0 + t)), side="left")


def _pairwise(up: DataFrame, down: DataFrame, variables: list[int]):
    up = up.filter(F.col("v").isin(variables))
    down = down.filter(F.col("v").isin(variables))
    # A fixed count keeps small but compute-heavy partitions from being merged into one task.
    n = int(up.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        up.repartition(n, "v", "pair")
        .groupBy("v", "pair")
        .cogroup(down.repartition(n, "v", "pair").groupBy("v", "pair"))
    )


def _round(spark, sides: DataFrame, searches: dict[int, _Search], list_limit: int) -> None:
    """Count the threshold grid of every open search; list the rest where it is short."""
    tasks = []
    for i, s in searches.items():
        for p, (u, d) in enumerate(s.candidates()):
            tasks.append((i, p, int(s.up_bucket[u]), int(s.down_bucket[d])))
    # Rows: searches x candidate bucket pairs, bounded by the bucket table.
    pairs = F.broadcast(spark.createDataFrame(tasks, "v int, pair int, bu int, bd int"))
    up = sides.filter("d > 0").join(
        pairs.select("v", "pair", F.col("bu").alias("bucket")), ["v", "bucket"]
    ).select("v", "pair", "d", "w")
    down = (
        sides.filter("d < 0")
        .join(pairs.select("v", "pair", F.col("bd").alias("bucket")), ["v", "bucket"])
        # Fresh aliases keep the two sides apart in the cogroup.
        .select(
            F.col("v").alias("v"),
            F.col("pair").alias("pair"),
            (-F.col("d")).alias("d"),
            F.col("w").alias("w"),
        )
    )
    # Bucket pairs left out of this round lie below or above the bracket it starts with.
    bases = {i: s.sure_below() for i, s in searches.items()}
    # Where the straddling bucket pairs are few enough, no counting is needed first.
    ready = {
        i for i, s in searches.items()
        if sum(s.distinct[u, d] for u, d in s.candidates()) <= list_limit
    }
    grids = {i: s.grid() for i, s in searches.items() if i not in ready}

    def tally(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"v": [], "g": [], "n": [], "m": []}).astype("int64")
        v = int(left.v.iloc[0])
        # Thresholds in their order look up neighbouring places.
        left = left.iloc[np.argsort(left.d.to_numpy())]
        a, wa = left.d.to_numpy(), left.w.to_numpy()
        order = np.argsort(right.d.to_numpy())
        b = right.d.to_numpy()[order]
        after = np.append(np.cumsum(right.w.to_numpy()[order][::-1])[::-1], 0)
        cuts = [_cut(a, b, t) for t in grids[v]]
        return pd.DataFrame(
            {
                "v": v,
                "g": np.arange(len(cuts)),
                "n": [int((wa * after[cut]).sum()) for cut in cuts],
                "m": [int((len(b) - cut).sum()) for cut in cuts],
            }
        )

    schema = "v int, g int, n bigint, m bigint"
    counted = (
        _pairwise(up, down, list(grids)).applyInPandas(tally, schema)
        .groupBy("v", "g")
        .agg(
            F.sum(F.col("n").cast("decimal(38,0)")).alias("n"),
            F.sum(F.col("m").cast("decimal(38,0)")).alias("m"),
        )
        .collect()
        if grids
        else []
    )
    short = {i: (searches[i].low, searches[i].high) for i in ready}
    for i in grids:
        s = searches[i]
        base = bases[i]
        upto = {r.g: base + int(r.n) for r in counted if r.v == i}
        grid = grids[i]
        wanted = s.open_ranks()
        # Pairs up to grid[g] number upto[g]; rank r needs upto > r.
        left = max((g for g in range(GRID + 1) if upto.get(g, base) <= wanted[0]), default=0)
        right = min((g for g in range(GRID + 1) if upto.get(g, base) > wanted[-1]), default=GRID)
        s.low, s.high = float(grid[left]), float(grid[right])
        distinct = {r.g: int(r.m) for r in counted if r.v == i}
        if distinct.get(right, 0) - distinct.get(left, 0) <= list_limit:
            short[i] = (s.low, s.high)
        elif s.high - s.low < 4e-16:
            # Ties closer than one unit in the last place: the bracket is the value.
            s.found.update(dict.fromkeys((r for r in s.ranks if r not in s.found), s.high))
    if not short:
        return

    def listing(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"v": [], "h": [], "n": []}).astype({"v": "int32", "n": "int64"})
        if left.empty or right.empty:
            return empty
        v = int(left.v.iloc[0])
        low, high = short[v]
        left = left.iloc[np.argsort(left.d.to_numpy())]
        a, wa = left.d.to_numpy(), left.w.to_numpy()
        order = np.argsort(right.d.to_numpy())
        b, wb = right.d.to_numpy()[order], right.w.to_numpy()[order]
        first, last = _cut(a, b, high), _cut(a, b, low)
        size = last - first
        ia = np.repeat(np.arange(len(a)), size)
        ib = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        h = (a[ia] - b[ib]) / (a[ia] + b[ib])
        n = wa[ia] * wb[ib]
        # Pairs up to the bracket travel as one row below every possible value.
        after = np.append(np.cumsum(wb[::-1])[::-1], 0)
        h, n = np.append(h, BELOW), np.append(n, (wa * after[last]).sum())
        return pd.DataFrame({"v": v, "h": h, "n": n}).groupby(["v", "h"], as_index=False).n.sum()

    # Bounded by ``list_limit`` pairs per variable.
    listed = (
        _pairwise(up, down, list(short))
        .applyInPandas(listing, "v int, h double, n bigint")
        .groupBy("v", "h").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        .collect()
    )
    for i in short:
        s = searches[i]
        mine = sorted((r.h, int(r.n)) for r in listed if r.v == i)
        below = bases[i] + sum(n for h, n in mine if h == BELOW)
        part = pd.DataFrame([x for x in mine if x[0] != BELOW], columns=["h", "n"])
        upto = below + np.cumsum(part.n.to_numpy())
        for r in s.ranks:
            if r not in s.found:
                at = int(np.searchsorted(upto, r - s.minus, side="right"))
                s.found[r] = float(part.h.iloc[min(at, len(part) - 1)])
