"""Exact nearest-neighbour search over a hierarchy of cells.

**Order.** Base rows are sorted over the cluster by presence pattern (the columns missing most often decide first) and,
within a pattern, along a space-filling curve over their main directions. Tasks cut their stretch of that order into cells
of at most ``cell_rows`` rows: a pattern with enough rows is cut at medians, rare patterns that follow each other share
cells. A cell knows the box of the columns that *all* its rows have, the columns that *some* have, and the range of its
rows' distances to a few pivots.

**Bounds.** Missing coordinates follow the NaN-aware Euclidean rule: squared differences over the shared coordinates, times
(all coordinates / shared coordinates). A query shares with a row at least the cell's common columns and at most those
that some row has, so gaps over the first, scaled by the number of the second, never exceed a true distance. Where nothing
is missing, the triangle inequality over the pivots bounds a cell as well, which counts where dimensions are many.

**Search.** A query looks into one promising cell for a bound of its k-th distance, which is all that leaves this round. Then
it visits every cell whose bound lies within, and each visit gives one row with lists of what lies within. Cells are numbered
along the order, so runs of numbers form the nodes above them; both walks descend through that hierarchy. The boxes of its
top, ``TOP`` at most, travel inside functions, where runs of ``FAN`` of them are looked at first; all levels below are tables,
joined by node, and no number of cells or patterns is set. Neighbouring cells form groups: a query is sent once to a group,
not to each of its cells, looks there into the cells within its reach and leaves one list. Groups meet their queries in blocks
of fixed size. Inside a cell, matrix products with a certified rounding error pick the pairs whose exact distance is worked out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.session import keep, written

CELL_ROWS = 1024
#: Boxes that travel inside functions at most, and their bytes.
TOP, TOP_BYTES = 65_536, 2**25
#: More boxes than this are looked at by runs of ``FAN``, the best ``BEAM`` runs of each query where one cell is wanted.
DENSE, FAN, BEAM = 512, 32, 4
#: Pairs of query and box bounded at once.
_PAIRS = 500_000
#: Rows of a stretch of the order that a task cuts at a time.
STRETCH = 65_536
#: Rows (smallest id hash) that set the order's directions and the pivots; they have no say in the result.
SAMPLE = 4096
QUERY_BLOCK = 32_768
_SHIFT = 6
#: Groups hold 2 ** ``_GROUP`` cells at most, fewer where there would not be ``_GROUPS`` of them. A node holds whole groups.
_GROUP, _GROUPS = 5, 32
_AXES, _BITS, _PIVOTS, _MANY_DIMS = 8, 7, 16, 12


def xcols(dims: int) -> list[str]:
    return [f"_gx{i}" for i in range(dims)]


# ---- order ----


@dataclass(frozen=True)
class Order:
    """Measures a row is placed by; of fixed size."""

    missing_first: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    cuts: np.ndarray
    pivots: np.ndarray

    @classmethod
    def learn(cls, sample: np.ndarray) -> Order:
        dims = sample.shape[1]
        gaps = np.isnan(sample)
        rate = gaps.mean(axis=0) if len(sample) else np.zeros(dims)
        known = np.maximum((~gaps).sum(axis=0), 1)
        mean = np.where(gaps, 0.0, sample).sum(axis=0) / known
        centred = np.where(gaps, 0.0, sample - mean)
        _, turned = np.linalg.eigh(centred.T @ centred)
        axes = turned[:, ::-1][:, :_AXES]
        along = centred @ axes if len(sample) else np.zeros((1, axes.shape[1]))
        cuts = np.quantile(along, np.arange(1, 2**_BITS) / 2**_BITS, axis=0).T
        whole = sample[~gaps.any(axis=1)]
        pivots = [whole[0]] if len(whole) and dims > _MANY_DIMS else []
        near = np.full(len(whole), np.inf)
        while pivots and len(pivots) < min(_PIVOTS, len(whole)):
            near = np.minimum(near, np.sqrt(((whole - pivots[-1]) ** 2).sum(axis=1)))
            pivots.append(whole[int(near.argmax())])
        return cls(np.argsort(-rate, kind="stable"), mean, axes, cuts, np.array(pivots).reshape(len(pivots), dims))

    def pattern(self, x: np.ndarray) -> np.ndarray:
        """Presence as a text of bits."""
        bits, inverse = np.unique(~np.isnan(x[:, self.missing_first]), axis=0, return_inverse=True)
        return np.array(["".join("1" if b else "0" for b in row) for row in bits], object)[inverse.ravel()]

    def curve(self, x: np.ndarray) -> np.ndarray:
        """Place on the curve: the bits of the places along the axes, interleaved; a missing value counts as the mean."""
        along = np.where(np.isnan(x), 0.0, x - self.mean) @ self.axes
        place = np.stack([np.searchsorted(c, along[:, i]) for i, c in enumerate(self.cuts)], axis=1)
        out = np.zeros(len(x), np.int64)
        for bit in reversed(range(_BITS)):
            for i in range(place.shape[1]):
                out = out << 1 | (place[:, i] >> bit & 1)
        return out

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        """Distances to the pivots; NaN for rows with gaps."""
        return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in self.pivots], axis=1) if len(self.pivots) else np.empty((len(x), 0))


def cut_stretch(x: np.ndarray, pattern: np.ndarray, far: np.ndarray, cell_rows: int) -> np.ndarray:
    """Cell number of each row of a stretch in order; cells hold at most ``cell_rows`` rows."""
    starts = np.flatnonzero(np.append(True, pattern[1:] != pattern[:-1]))
    ends = np.append(starts[1:], len(x))
    groups: list[np.ndarray] = []
    rare: list[np.ndarray] = []
    shared = None

    def close() -> None:
        nonlocal rare, shared
        if rare:
            groups.append(np.concatenate(rare))
        rare, shared = [], None

    for lo, hi in zip(starts, ends, strict=True):
        rows = np.arange(lo, hi)
        if hi - lo >= cell_rows // 2:
            groups.append(rows)
            continue
        has = ~np.isnan(x[lo])
        held = sum(map(len, rare))
        # A group that fills half a cell keeps its shared columns rather than taking in another pattern.
        if held + len(rows) > cell_rows or (2 * held >= cell_rows and (shared & ~has).any()):
            close()
        rare.append(rows)
        shared = has if shared is None else shared & has
    close()
    cell = np.empty(len(x), np.int64)
    number = 0
    while groups:
        rows = groups.pop()
        if len(rows) <= cell_rows:
            cell[rows] = number
            number += 1
            continue
        # Cut at the median of the widest measure that all rows have.
        part = np.concatenate([x[rows], far[rows]], axis=1)
        spread = part.max(axis=0) - part.min(axis=0)
        spread = np.where(np.isnan(spread), -1.0, spread)
        by = np.argsort(part[:, int(spread.argmax())], kind="stable") if spread.max() > 0 else np.arange(len(rows))
        groups += [rows[by[len(rows) // 2 :]], rows[by[: len(rows) // 2]]]
    return cell


# ---- cells and the nodes above them ----

_BOX = "id bigint, low array<double>, high array<double>, have array<bigint>, near array<double>, far array<double>, weight bigint"


def box_of(x: np.ndarray, far: np.ndarray, w: np.ndarray, id: int) -> dict:
    """Box of rows: ends of common columns (NaN elsewhere), weight having each column, ranges of pivot distances."""
    return {
        "id": id, "low": x.min(axis=0), "high": x.max(axis=0), "have": (~np.isnan(x) * w[:, None]).sum(axis=0),
        "near": far.min(axis=0), "far": far.max(axis=0), "weight": int(w.sum()),
    }


def _stack(column: pd.Series, kind=float) -> np.ndarray:
    return np.array([np.asarray(v, kind) for v in column]) if len(column) else np.empty((0, 0), kind)


def fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """One box around several."""
    low, high, near, far = (_stack(pdf[c]) for c in ("low", "high", "near", "far"))
    return pd.DataFrame([{
        "id": pdf["id"].iloc[0], "low": low.min(axis=0), "high": high.max(axis=0), "have": _stack(pdf["have"], np.int64).sum(axis=0),
        "near": near.min(axis=0), "far": far.max(axis=0), "weight": int(pdf["weight"].sum()),
    }])


@dataclass(frozen=True)
class Boxes:
    """Boxes of some nodes as arrays."""

    id: np.ndarray
    low: np.ndarray
    high: np.ndarray
    have: np.ndarray
    near: np.ndarray
    far: np.ndarray
    weight: np.ndarray
    pivots: np.ndarray
    #: Boxes around runs of ``FAN`` boxes, or None where there are few.
    runs: Boxes | None = field(default=None)

    @classmethod
    def of(cls, pdf: pd.DataFrame, order: Order) -> Boxes:
        dims = order.pivots.shape[1]
        pdf = pdf.sort_values("id", kind="stable")
        stacks = [_stack(pdf[c], np.int64 if c == "have" else float).reshape(len(pdf), -1 if len(pdf) else dims) for c in ("low", "high", "have", "near", "far")]
        return cls(pdf["id"].to_numpy(np.int64), *stacks, pdf["weight"].to_numpy(np.int64), order.pivots).with_runs()

    def with_runs(self) -> Boxes:
        if len(self.id) <= DENSE:
            return self
        at = np.arange(0, len(self.id), FAN)
        runs = Boxes(
            np.arange(len(at)), np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), np.add.reduceat(self.have, at),
            np.minimum.reduceat(self.near, at), np.maximum.reduceat(self.far, at), np.add.reduceat(self.weight, at), self.pivots,
        )
        return replace(self, runs=runs.with_runs())

    def bounds(self, q: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Lower bound of the distance from a query to any row of a node, for each pair; infinite where no column is shared."""
        dims = q.shape[1]
        acc, most = np.zeros(len(row)), np.zeros(len(row))
        for d in range(dims):
            x = q[row, d]
            gap = np.maximum(np.maximum(self.low[node, d] - x, x - self.high[node, d]), 0.0)
            acc += np.where(np.isnan(gap), 0.0, gap) ** 2
            most += ~np.isnan(x) & (self.have[node, d] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(most == 0, np.inf, np.sqrt(acc * (dims / most)))
        for j, p in enumerate(self.pivots):
            to = np.sqrt(((q - p) ** 2).sum(axis=1))[row]  # NaN for a query with gaps
            gap = np.maximum(self.near[node, j] - to, to - self.far[node, j]) - 1e-12 * (to + self.far[node, j])
            out = np.maximum(out, np.where(np.isnan(gap), 0.0, gap))
        return out

    def _rating(self, q: np.ndarray, row: np.ndarray, node: np.ndarray, k: int, targets: Sequence[int] | None) -> np.ndarray:
        """How near a node looks; infinite where it holds too few rows."""
        bound = self.bounds(q, row, node)
        gap = np.zeros(len(row))
        for d in range(q.shape[1]):
            off = q[row, d] - (self.low[node, d] + self.high[node, d]) / 2
            gap += np.where(np.isnan(off), 0.0, off) ** 2
        enough = np.isfinite(bound) & (self.weight[node] >= k)
        for t in targets or []:
            enough &= ~np.isnan(q[row, t]) | (self.have[node, t] >= k)
        return np.where(enough, np.where(enough, bound, 0.0) ** 2 + 1e-6 * gap, np.inf)

    def _all(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(n), len(self.id)), np.tile(np.arange(len(self.id)), n)

    def _best(self, q: np.ndarray, k: int, targets: Sequence[int] | None, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the best ``wide`` nodes of each query, best first, and their ratings."""
        if self.runs is None:
            node = np.broadcast_to(np.arange(len(self.id)), (len(q), len(self.id)))
            held = np.ones(node.shape, bool)
        else:
            run, rated = self.runs._best(q, k, targets, BEAM)
            node = (run[:, :, None] * FAN + np.arange(FAN)).reshape(len(q), -1)
            held = np.repeat(np.isfinite(rated), FAN, axis=1) & (node < len(self.id))
        rating = np.full(node.shape, np.inf)
        row, at = np.nonzero(held)
        rating[row, at] = self._rating(q, row, node[row, at], k, targets)
        first = np.argsort(rating, axis=1, kind="stable")[:, :wide]
        return np.take_along_axis(node, first, 1), np.take_along_axis(rating, first, 1)

    def best(self, q: np.ndarray, k: int, targets: Sequence[int] | None) -> np.ndarray:
        """A node for each query that looks near and holds enough rows; -1 where none does."""
        out = np.full(len(q), -1, np.int64)
        step = max(1, _PAIRS // max(FAN * BEAM, min(len(self.id), DENSE)))
        for lo in range(0, len(q), step):
            node, rating = self._best(q[lo : lo + step], k, targets, 1)
            out[lo : lo + step] = np.where(np.isfinite(rating[:, 0]), self.id[node[:, 0]], -1)
        lost = np.flatnonzero(out < 0)
        if self.runs is not None and len(lost):
            # A run may hold enough rows where none of its nodes does: such queries try the nodes that hold most.
            served = np.sum([self.have[:, t] >= k for t in targets or []], axis=0) + (self.weight >= k)
            few = np.sort(np.argsort(-served, kind="stable")[:DENSE])
            for lo in range(0, len(lost), step):
                mine = lost[lo : lo + step]
                row, at = np.divmod(np.arange(len(mine) * len(few)), len(few))
                rating = self._rating(q[mine], row, few[at], k, targets).reshape(len(mine), -1)
                at = rating.argmin(axis=1)
                out[mine] = np.where(np.isfinite(rating[np.arange(len(mine)), at]), self.id[few[at]], -1)
        return out

    def within(self, q: np.ndarray, reach: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Query and place of the nodes that may hold a neighbour within the reach of a target (-1: of the search)."""
        none = np.zeros(0, np.int64)
        row, node = zip((none, none), *self.reached(q, reach), strict=True)
        return np.concatenate(row), np.concatenate(node)

    def reached(self, q: np.ndarray, reach: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What :meth:`within` finds, in its order, in pieces no larger than the pairs bounded at once, however many nodes there are."""
        for row, node in self._pieces(q, reach):
            bound, go = self.bounds(q, row, node), np.zeros(len(row), bool)
            for t, limit in reach.items():
                hit = (bound <= limit[row]) & np.isfinite(bound)
                go |= hit & np.isnan(q[row, t]) & (self.have[node, t] > 0) if t >= 0 else hit
            yield row[go], node[go]

    def _pieces(self, q: np.ndarray, reach: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of query and node to bound: all, or the nodes of the runs within reach."""
        if self.runs is None:
            step = max(1, _PAIRS // max(1, len(self.id)))
            for lo in range(0, len(q), step):
                row, node = self._all(min(step, len(q) - lo))
                yield row + lo, node
            return
        for rows, runs in self.runs.reached(q, reach):
            for lo in range(0, len(rows), _PAIRS // FAN):
                row, node = np.repeat(rows[lo : lo + _PAIRS // FAN], FAN), (runs[lo : lo + _PAIRS // FAN, None] * FAN + np.arange(FAN)).ravel()
                yield row[node < len(self.id)], node[node < len(self.id)]


@dataclass(frozen=True)
class Index:
    """Placed rows and the hierarchy over their cells: the top as arrays, levels below as tables by ``parent``."""

    placed: DataFrame
    order: Order
    cells: int
    top: Boxes
    levels: list[DataFrame]
    kept: list[DataFrame]

    @property
    def shift(self) -> int:
        """Bits of a cell's number that its group's number lacks."""
        return max(0, min(_GROUP, int(math.log2(max(1, self.cells / _GROUPS)))))

    def release(self) -> None:
        for part in self.kept:
            part.unpersist()


def build_index(base: DataFrame, dims: int, cell_rows: int = CELL_ROWS, top: int = TOP, stretch: int = STRETCH) -> Index:
    """Index of ``base (nid, w, x0..)``."""
    names = xcols(dims)
    top = max(1, min(top, TOP_BYTES // (8 * (3 * dims + 2 * _PIVOTS * (dims > _MANY_DIMS) + 2))))
    base = keep(base)
    order = Order.learn(base.orderBy(F.xxhash64("nid"), "nid").limit(SAMPLE).select(*names).toPandas().to_numpy(float).reshape(-1, dims))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = pdf[names].to_numpy(float)
                yield pdf.assign(_pattern=order.pattern(x), _curve=order.curve(x))

    parts = max(1, math.ceil(base.count() / stretch))
    along = ["_pattern", "_curve", "nid"]
    measured = base.mapInPandas(measure, f"{fields}, _pattern string, _curve bigint")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Numbers rise along the order, and near numbers share the nodes above.
        first, held, n = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pd.DataFrame:
            nonlocal first, held, n
            pdf = pd.concat(held, ignore_index=True)
            x = pdf[names].to_numpy(float)
            cell = cut_stretch(x, pdf["_pattern"].to_numpy(), order.to_pivots(x), cell_rows)
            out = pdf.drop(columns=["_pattern", "_curve"]).assign(cell=first + cell)
            first, held, n = first + int(cell.max()) + 1, [], 0
            return out.sort_values("cell", kind="stable")

        for pdf in batches:
            if len(pdf):
                held.append(pdf)
                n += len(pdf)
                if n >= 2 * stretch:
                    yield flush()
        if n:
            yield flush()

    placed = keep(
        measured.repartitionByRange(parts, *along).sortWithinPartitions(*along).mapInPandas(cut, f"{fields}, cell bigint")
    )

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, w, cell = pdf[names].to_numpy(float), pdf["w"].to_numpy(np.int64), pdf["cell"].to_numpy()
                far = order.to_pivots(x)
                starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                yield pd.DataFrame([box_of(x[a:b], far[a:b], w[a:b], cell[a]) for a, b in zip(starts, np.append(starts[1:], len(x)), strict=True)])

    cells = keep(placed.mapInPandas(boxes, _BOX).groupBy("id").applyInPandas(fold, _BOX))
    n_cells = cells.count()
    levels, kept, node, n, shift = [], [base, placed, cells], cells, n_cells, 0
    while n > top:
        # Runs of numbers become nodes, until there are a few times fewer of them.
        for up in range(shift + _SHIFT, 64, _SHIFT):
            fewer = node.select(F.shiftright("id", up - shift)).distinct().count()
            if fewer <= max(top, n // 4) or up + _SHIFT >= 63:
                break
        levels.insert(0, node.withColumn("parent", F.shiftright("id", up - shift)))
        node = keep(node.withColumn("id", F.shiftright("id", up - shift)).groupBy("id").applyInPandas(fold, _BOX))
        kept.append(node)
        n, shift = node.count(), up
    return Index(placed, order, n_cells, Boxes.of(node.toPandas(), order), levels, kept)


# ---- blocks ----


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """NaN-aware Euclidean distances of paired rows, summed in coordinate order."""
    dims = q.shape[1]
    acc, shared = np.zeros(len(q)), np.zeros(len(q))
    for d in range(dims):
        diff = q[:, d] - x[:, d]
        both = ~np.isnan(diff)
        shared += both
        diff = np.where(both, diff, 0.0)
        acc += diff * diff
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.sqrt(acc * (dims / shared))


class Filter:
    """Squared distances of a block by matrix products, each with a bound of its rounding error."""

    def __init__(self, x: np.ndarray):
        known = ~np.isnan(x)
        # Coordinates around the block's own middle keep the products, and so their error, small.
        self.middle = np.where(known, x, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
        self.full = bool(known.all())
        self.value = np.where(known, x - self.middle, 0.0)
        self.known = known.astype(float)
        self.square = self.value**2

    def squares(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = ~np.isnan(q)
        value = np.where(known, q - self.middle, 0.0)
        dims = q.shape[1]
        unit = 2.0**-52 * (4 * dims + 16)
        if self.full and known.all():
            size = (value**2).sum(axis=1)[:, None] + self.square.sum(axis=1)
            return size - 2.0 * (value @ self.value.T), unit * size
        size = (value**2) @ self.known.T + known.astype(float) @ self.square.T
        scale = known.astype(float) @ self.known.T
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = dims / scale  # infinite where nothing is shared; the product is NaN there
            return scale * (size - 2.0 * (value @ self.value.T)), scale * (unit * size)


def nearest(
    q: np.ndarray, x: np.ndarray, picker: Filter, k: int, reach: np.ndarray, allowed: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and distance of the k nearest rows of ``x`` within the reach of each query, ties by column."""
    square, error = picker.squares(q)
    low, high = square - error, square + error
    bad = np.isnan(square)
    if allowed is not None:
        bad |= ~allowed
    low = np.where(bad, np.inf, low)
    limit = reach**2 * (1 + 1e-12)
    fits = (low <= limit[:, None]) & ~bad
    crowded = np.flatnonzero(fits.sum(axis=1) > k)
    if len(crowded):
        ceiling = np.partition(np.where(bad[crowded], np.inf, high[crowded]), k - 1, axis=1)[:, k - 1]
        fits[crowded] &= low[crowded] <= ceiling[:, None]
    row, column = np.nonzero(fits)
    dist = distances(q[row], x[column])
    inside = dist <= reach[row]
    row, column, dist = row[inside], column[inside], dist[inside]
    order = np.lexsort((column, dist, row))
    row, column, dist = row[order], column[order], dist[order]
    best = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[best], column[best], dist[best]


def _columns(t: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.stack([t[c].to_numpy().astype(float) for c in names], axis=1)


class Group:
    """Base rows of a group of cells, by cell; places count along the ids, so ties go to the smaller place."""

    def __init__(self, b: pa.Table, dims: int, k: int, order: Order | None = None):
        b = b.sort_by("nid")
        self.k, self.nid, self.x, self.w = k, b["nid"].combine_chunks(), _columns(b, xcols(dims)), b["w"].to_numpy()
        cell = b["cell"].to_numpy() if "cell" in b.column_names else np.zeros(len(b), np.int64)
        by = np.argsort(cell, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(cell[by]) != 0))
        self.rows = np.split(by, start[1:])
        x, w = self.x[by], self.w[by]
        far, pivots = (order.to_pivots(x), order.pivots) if order else (np.empty((len(x), 0)), np.empty((0, dims)))
        self.boxes = Boxes(
            cell[by][start], np.minimum.reduceat(x, start), np.maximum.reduceat(x, start), np.add.reduceat(~np.isnan(x) * w[:, None], start),
            np.minimum.reduceat(far, start), np.maximum.reduceat(far, start), np.add.reduceat(w, start), pivots,
        )
        self.pickers = [Filter(self.x[rows]) for rows in self.rows]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Lower bound of the distance of each query to each cell."""
        return self.boxes.bounds(q, *self.boxes._all(len(q))).reshape(len(q), -1)

    def near(self, q: np.ndarray, t: int, reach: np.ndarray, go: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query row, base row, distance and weight of nearer rows: the nearest of the cells to ``go`` to, ties by base row.

        Rows beyond a query's reach cannot be among its k nearest and stay out.
        """
        if t >= 0:
            go = go & np.isnan(q[:, t])[:, None] & (self.boxes.have[:, t] > 0)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for c, rows in enumerate(self.rows):
            asked, x, step = np.flatnonzero(go[:, c]), self.x[rows], max(1, 1_000_000 // len(rows))
            for at in range(0, len(asked), step):
                mine = asked[at : at + step]
                allowed = np.broadcast_to(~np.isnan(x[:, t]), (len(mine), len(x))) if t >= 0 else None
                row, column, dist = nearest(q[mine], x, self.pickers[c], self.k, reach[mine], allowed)
                found.append((mine[row], rows[column], dist))
        row, column, dist = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.lexsort((column, dist, row))
        row, column, dist = row[order], column[order], dist[order]
        before = _before(row, self.w[column])
        near = before < self.k
        return row[near], column[near], dist[near], before[near]

    def reach(self, row: np.ndarray, column: np.ndarray, dist: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
        """Distance to the k-th nearest row per query; NaN where fewer were found."""
        out = np.full(n, np.nan)
        last = before + self.w[column] >= self.k
        out[row[last]] = dist[last]
        return out


def _before(group: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weight of the earlier entries of the same group; groups lie together."""
    upto = np.cumsum(w) - w
    return upto - upto[np.searchsorted(group, group, side="left")] if len(w) else upto


def block_reach(q: pa.Table, b: pa.Table, dims: int, k: int, targets: Sequence[int] | None, order: Order | None = None) -> list[np.ndarray]:
    """Distance to the k-th nearest row of the group, per target and query; NaN where it has fewer.

    A query looks into its own cell first, and then into the cells of the group within what it found there.
    """
    group, x, out = Group(b, dims, k, order), _columns(q, xcols(dims)), []
    bound, own = group.bounds(x), q["cell"].to_numpy()[:, None] == group.boxes.id
    for t in [-1] if targets is None else targets:
        first = group.reach(*group.near(x, t, np.full(len(x), np.inf), own), len(x))
        limit = allowance(first)
        out.append(group.reach(*group.near(x, t, limit, (own | (bound <= limit[:, None])) & np.isfinite(bound)), len(x)))
    return out


def block_best(q: pa.Table, b: pa.Table, dims: int, k: int, targets: Sequence[int] | None, order: Order | None = None) -> pa.Table:
    """One row a query and target with the lists of its nearest base rows of the group, ties by base id."""
    group, x = Group(b, dims, k, order), _columns(q, xcols(dims))
    bound = group.bounds(x)
    of, at, size, column, dist, value = ([] for _ in range(6))
    for j, t in enumerate([-1] if targets is None else targets):
        limit = allowance(q[f"r{j}"].to_numpy()) if f"r{j}" in q.column_names else np.full(len(x), np.inf)
        row, col, d, _ = group.near(x, t, limit, (bound <= limit[:, None]) & np.isfinite(bound))
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        of.append(row[start])
        at.append(np.full(len(start), t, np.int32))
        size.append(np.diff(np.append(start, len(row))))
        column.append(col)
        dist.append(d)
        if targets is not None:
            value.append(group.x[col, t])
    of, at, size, column, dist = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (of, at, size, column, dist))
    lists = {"nid": group.nid.take(pa.array(column.astype(np.int64))), "w": pa.array(group.w[column.astype(np.int64)]), "dist": pa.array(dist.astype(float))}
    if targets is not None:
        lists["value"] = pa.array(np.concatenate(value) if value else np.zeros(0))
    return _listed(q["qid"].combine_chunks().take(pa.array(of.astype(np.int64))), pa.array(at.astype(np.int32)), size, lists)


def _listed(qid: pa.Array, target: pa.Array, size: np.ndarray, lists: dict[str, pa.Array]) -> pa.Table:
    offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
    return pa.table({"qid": qid, "target": target, **{c: pa.ListArray.from_arrays(offsets, v) for c, v in lists.items()}})


def merge_lists(t: pa.Table, k: int) -> pa.Table:
    """Lists of equal query and target, which lie together, as one: the nearest rows, ties by id, until their weights reach k."""
    t = t.combine_chunks()
    qid, target = (np.unique(t[c].to_numpy(zero_copy_only=False), return_inverse=True)[1] for c in ("qid", "target"))
    new = np.append(True, (qid[1:] != qid[:-1]) | (target[1:] != target[:-1]))
    lists = {c: t[c].combine_chunks() for c in t.column_names[2:]}
    group = np.repeat(np.cumsum(new) - 1, lists["w"].value_lengths().to_numpy())
    flat = {c: v.flatten() for c, v in lists.items()}
    nid = flat["nid"].to_numpy(zero_copy_only=False)
    nid = nid if nid.dtype.kind in "iu" else np.unique(nid, return_inverse=True)[1]
    order = np.lexsort((nid, flat["dist"].to_numpy(), group))
    group = group[order]
    before = _before(group, flat["w"].to_numpy()[order])
    order, group, before = order[before < k], group[before < k], before[before < k]
    lists = {c: v.take(pa.array(order)) for c, v in flat.items()} | {"before": pa.array(before)}
    start = pa.array(np.flatnonzero(new))
    return _listed(t["qid"].combine_chunks().take(start), t["target"].combine_chunks().take(start), np.bincount(group, minlength=int(new.sum())), lists)


def allowance(reach: pd.Series | np.ndarray) -> np.ndarray:
    """Known reach with room for rounding; unlimited where it is not known yet."""
    r = np.asarray(reach, float)
    return np.where(np.isnan(r), np.inf, r * (1 + 1e-12) + 1e-300)


def _dealt(queries: DataFrame, by: str, few: bool) -> tuple[DataFrame, DataFrame]:
    """Queries in blocks ``qs`` of a node, and the number of blocks of each node."""
    counts = queries.groupBy(by).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("nq"))
    if few:  # one row per box of the top
        counts = F.broadcast(queries.sparkSession.createDataFrame(counts.collect(), counts.schema))
    return queries.join(counts, by).withColumn("qs", F.pmod(F.xxhash64("qid"), F.col("nq")).cast("int")).drop("nq"), counts


def _spread(counts: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """``rows`` once per block of queries of their node."""
    return rows.join(counts, by).withColumn("qs", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).drop("nq")


def _visit(queries: DataFrame, index: Index, dims: int, top: int, meet: Callable[[pa.Table, pa.Table], pa.Table], fields: str) -> DataFrame:
    """Run queries ``(qid, x0.., group)`` against the cells of their groups, block against block."""
    names, keys = xcols(dims), ["group", "qs"]
    left, counts = _dealt(queries, "group", index.cells <= top)
    left = left.select(*keys, *[c for c in queries.columns if c not in ("group", "seen")])
    right = _spread(counts, index.placed.withColumn("group", F.shiftright("cell", index.shift)), "group")
    right = right.select(*[F.col(c).alias(c) for c in (*keys, "cell", "nid", "w", *names)])
    partitions = _partitions(index)

    def best(q: pa.Table, b: pa.Table) -> pa.Table:
        return meet(q, b) if len(q) and len(b) else empty

    empty = _schema(index.placed.sparkSession, fields)
    return (
        left.repartition(partitions, *keys)
        .groupBy(*keys)
        .cogroup(right.repartition(partitions, *keys).groupBy(*keys))
        .applyInArrow(best, fields)
    )


def _partitions(index: Index) -> int:
    return max(int(index.placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(index.cells // 8, 8192))


def _schema(spark: SparkSession, fields: str) -> pa.Table:
    """A table without rows."""
    return to_arrow_schema(spark.createDataFrame([], fields).schema).empty_table()


def _merged(lists: DataFrame, index: Index, k: int, fields: str) -> DataFrame:
    """Lists of all visits of a query as one row."""
    keys = ["qid", "target"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not len(t):
                continue
            # The last query may go on in the next batch.
            rows = t.select(keys).to_pandas()
            others = np.flatnonzero(((rows.qid != rows.qid.iloc[-1]) | (rows.target != rows.target.iloc[-1])).to_numpy())
            whole = int(others[-1]) + 1 if len(others) else 0
            if whole:
                yield from merge_lists(t.slice(0, whole), k).to_batches()
            held = t.slice(whole)
        if held is not None and len(held):
            yield from merge_lists(held, k).to_batches()

    return lists.repartition(_partitions(index), "qid").sortWithinPartitions(*keys).mapInArrow(merge, fields)


def _descend(queries: DataFrame, index: Index, step, fields: str, dims: int, shift: int = 0) -> DataFrame:
    """Queries with the ``cell`` each goes to: ``step`` picks nodes of the top, then children of a node, level by level.

    With ``shift`` cells of a group come as one, under the group's number.
    """
    names = xcols(dims)
    chunk = max(1, 2_000_000 // max(1, min(len(index.top.id), DENSE)))
    order, top, levels = index.order, index.top, len(index.levels)

    def pick(boxes: Boxes, pdf: pd.DataFrame, last: bool) -> Iterator[pd.DataFrame]:
        for at in range(0, len(pdf), chunk):
            part, before = pdf.iloc[at : at + chunk], (-1, -1)
            for row, node in step(boxes, part, part[names].to_numpy(float)):
                if last and shift and len(row):
                    # Rows and numbers rise, so cells of a group follow each other, maybe from one piece to the next.
                    node = node >> shift
                    new = np.append((row[0], node[0]) != before, (row[1:] != row[:-1]) | (node[1:] != node[:-1]))
                    before = row[-1], node[-1]
                    row, node = row[new], node[new]
                if len(row):
                    yield part.iloc[row].assign(cell=node)

    def from_top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from pick(top, pdf, not levels)

    def below(last: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def children_of(q: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
            parts = list(pick(Boxes.of(nodes, order), q, last)) if len(q) and len(nodes) else []
            out = pd.concat(parts, ignore_index=True) if parts else q.iloc[:0].assign(cell=np.empty(0, np.int64))
            return out.drop(columns=["parent", "qs"])

        return children_of

    found = queries.mapInPandas(from_top, fields)
    for depth, level in enumerate(index.levels, 1):
        found = keep(found)
        index.kept.append(found)
        asked, counts = _dealt(found.withColumnRenamed("cell", "parent"), "parent", False)
        children = _spread(counts, level, "parent")
        children = children.select(*[F.col(c).alias(c) for c in children.columns])
        lost = found.filter("cell < 0")  # no node holds enough rows: such a query starts nowhere
        found = (
            asked.groupBy("parent", "qs")
            .cogroup(children.groupBy("parent", "qs"))
            .applyInPandas(below(depth == levels), fields)
            .unionByName(lost)
        )
    return found


def search(
    queries: DataFrame,
    base: DataFrame,
    dims: int,
    k: int,
    *,
    targets: Sequence[int] | None = None,
    cell_rows: int = CELL_ROWS,
    top: int = TOP,
    stretch: int = STRETCH,
    observation: Observation | None = None,
) -> DataFrame:
    """The k nearest of ``base (nid, w, x0..)`` for ``queries (qid, x0..)``.

    Returns ``qid, target, nid, w, dist, value, before``: ``before`` is the weight of nearer
    rows. With ``targets``, each missing target coordinate of a query has its own neighbours,
    taken among rows that have it, and ``value`` is their coordinate. ``observation`` gets ``visits``, the pairs of query
    and group of cells of the second round, the group of the first one left out.
    """
    names = xcols(dims)
    index = build_index(base, dims, cell_rows, top, stretch)
    order = index.order
    id_type, id_n = queries.schema["qid"].dataType.simpleString(), base.schema["nid"].dataType.simpleString()
    wanted = [-1] if targets is None else list(targets)
    points = f"qid {id_type}, " + ", ".join(f"{c} double" for c in names)
    reaches = [f"r{j}" for j in range(len(wanted))]
    more = ", ".join(f"{r} double" for r in reaches)
    lists = f"qid {id_type}, target int, nid array<{id_n}>, w array<bigint>, dist array<double>" + ("" if targets is None else ", value array<double>")

    def start(boxes: Boxes, part: pd.DataFrame, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield np.arange(len(q)), boxes.best(q, k, targets) if len(boxes.id) else np.full(len(q), -1)

    def learn(q: pa.Table, b: pa.Table) -> pa.Table:
        found = block_reach(q, b, dims, k, targets, order)
        out = q.select(["qid", *names, "cell"]).rename_columns(["qid", *names, "seen"])
        for r, reach in zip(reaches, found, strict=True):
            out = out.append_column(r, pa.array(reach, from_pandas=True))
        return out

    def probe(boxes: Boxes, part: pd.DataFrame, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for row, node in boxes.reached(q, {t: allowance(part[r]) for t, r in zip(wanted, reaches, strict=True)}):
            yield row, boxes.id[node]

    if index.cells == 1:
        # One cell holds everything: there is no reach to learn.
        further = queries.select("qid", *names).withColumns({"seen": F.lit(-1).cast("bigint"), "cell": F.lit(int(index.top.id[0])).cast("bigint")})
    else:
        started = keep(_descend(queries.select("qid", *names), index, start, f"{points}, cell bigint", dims))
        grouped = started.withColumn("group", F.shiftright("cell", index.shift))
        asking = _visit(grouped, index, dims, top, learn, f"{points}, seen bigint, {more}")
        lost = started.filter("cell < 0").withColumnRenamed("cell", "seen").withColumns({r: F.lit(None).cast("double") for r in reaches})
        # Written, the rows need no worker beside the one that looks for their groups, and the start is let go.
        asking = written(asking.unionByName(lost))
        started.unpersist()
        further = _descend(asking, index, probe, f"{points}, seen bigint, {more}, cell bigint", dims, index.shift)
    further = further.withColumnRenamed("cell", "group")
    if observation is not None:
        further = further.observe(observation, F.count_if(F.col("group") != F.shiftright("seen", index.shift)).alias("visits"))
    further = keep(further)
    index.kept.append(further)
    found = _visit(further, index, dims, top, lambda q, b: block_best(q, b, dims, k, targets, order), lists)
    out = written(_merged(found, index, k, f"{lists}, before array<bigint>"))
    index.release()
    columns = [c for c in out.columns if c not in ("qid", "target")]
    rows = out.select("qid", "target", F.explode(F.arrays_zip(*columns)).alias("_one")).select("qid", "target", *[F.col(f"_one.{c}").alias(c) for c in columns])
    return rows if targets is not None else rows.withColumn("value", F.lit(float("nan")))
