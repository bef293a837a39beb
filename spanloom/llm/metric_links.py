"""Exact range join of vectors by angle: pivots, boundary copies, cells that join by themselves.

Equal vectors (told apart by two 64-bit hashes) become one with a count. A bounded sample gives pivots, dense places first, and every
vector belongs to the cell of its nearest pivot. If x and y are at most t apart, then x is no farther
from y's pivot than from its own by more than 2 t, and lies within t of the span of distances in
y's cell; x is copied to just such cells, and only towards the cell that holds more, so that a hot
cell's members stay where they are. A cell of more than ``cell_rows`` is cut into blocks.

A cell's core, all within t / 2 of the pivot, is linked throughout without looking at its pairs: it
adds its count, and a star of edges, to its members. Other pairs are met in one cell only, where the
two distances to the pivot accept, refuse or leave them to the cosine. Links are counted by vector
and connected to forests in place; no list of pairs is made. Memory holds a block of members;
what visits a block streams by.

Cosines are taken in double precision; within 1e-12 of the threshold once more from the vectors as
they are. Vectors that are null, empty, zero or hold null or non-finite components link with
nothing, nor do vectors of different widths link. Every row is a vector of its own, also a repeated
one; a component's id is the smallest that is not null (null if there is none), and a row is kept
if that is its own id. Other columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stash
from .common import column_or_null, mix
from .near_dedup import components
from .vectors import hash_sample, is_finite, matrices, units, vector_column

LINK = 0.95
CELL_ROWS = 8192
MOST_PIVOTS = 4096
SAMPLE_ROWS = 8192
SAMPLE_PER_PIVOT = 8
PAIRS_AT_ONCE = 1 << 21
# Angles near zero are known to about 1e-8 from a cosine in double precision.
SLACK = 1e-6
CLOSE = 1e-12

_MEMBER, _OTHER_BLOCK, _VISITOR = 0, 1, 2


def angles(units_a: np.ndarray, units_b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units_a @ units_b.T, -1.0, 1.0))


def choose_pivots(sample: np.ndarray, n: int, reach: float) -> np.ndarray:
    """``n`` rows of a sample of unit vectors: crowded places first, one for each, then any others."""
    crowd = np.concatenate([(angles(sample[i : i + 512], sample) <= reach / 2).sum(axis=1) for i in range(0, len(sample), 512)])
    free, chosen = np.ones(len(sample), bool), []
    for i in np.argsort(-crowd, kind="stable"):
        if len(chosen) == n or crowd[i] < 2:
            break
        if free[i]:
            chosen.append(i)
            free &= angles(sample[i : i + 1], sample)[0] > reach / 2
    rest = np.setdiff1d(np.flatnonzero(free), chosen)
    return sample[np.concatenate([np.array(chosen, int), rest[: n - len(chosen)]])]


@dataclass
class Cell:
    """What all tasks know of one cell."""

    number: int
    rows: int
    near: float
    far: float
    blocks: int
    core_copies: int
    core_least: int | None


class Layout:
    """Pivots and cells of one width; cells are numbered through all widths."""

    def __init__(self, pivots: np.ndarray, first: int):
        self.pivots, self.first = pivots, first
        self.cells: list[Cell | None] = [None] * len(pivots)

    def slices(self, n: int) -> Iterator[slice]:
        """Cuts of ``n`` rows for which the distances to all pivots fit into memory."""
        step = max(64, PAIRS_AT_ONCE // len(self.pivots))
        return (slice(i, min(i + step, n)) for i in range(0, n, step))

    def distances(self, u: np.ndarray) -> np.ndarray:
        return angles(u, self.pivots)


def _layouts(distinct: DataFrame, cell_rows: int, reach: float) -> dict[int, Layout]:
    counts = {r["width"]: r["count"] for r in distinct.groupBy(F.size("v").alias("width")).count().collect()}  # a row per width
    wanted = {w: max(1, min(MOST_PIVOTS, -(-n // cell_rows))) for w, n in counts.items()}
    asked = min(SAMPLE_ROWS, max(512, SAMPLE_PER_PIVOT * sum(wanted.values())))
    sample: dict[int, list] = {}
    for r in sorted(hash_sample(distinct.select("node", "v"), "node", sum(counts.values()), asked), key=lambda r: r["node"]):
        sample.setdefault(len(r["v"]), []).append(r["v"])
    out: dict[int, Layout] = {}
    first = 0
    for width in sorted(counts):
        # Any point may be a pivot; a rare width may lack a row in the sample.
        known = units(np.array(sample.get(width) or [[1.0] * width], float))[1]
        out[width] = Layout(choose_pivots(known, wanted[width], reach), first)
        first += len(out[width].pivots)
    return out


class Block:
    """Members of one block of a cell, asked with those that visit it."""

    def __init__(self, cell: Cell, threshold: float, rows: dict[str, np.ndarray], v: np.ndarray):
        order = np.argsort(rows["far"], kind="stable")
        self.cell, self.threshold, self.reach = cell, threshold, float(np.arccos(threshold))
        self.node, self.copies, self.far = (rows[c][order] for c in ("node", "copies", "far"))
        self.v, self.u = units(v[order])
        self.core = self.far <= self.reach / 2 - SLACK
        self.links = np.zeros(len(order), np.int64)
        self.label = np.arange(len(order))
        if cell.core_copies:
            self.links[self.core] += cell.core_copies - self.copies[self.core]
        self._among_members()

    def _linked(self, v: np.ndarray, u: np.ndarray, far: np.ndarray, part: slice) -> np.ndarray:
        cosine = u @ self.u[part].T
        found = cosine >= self.threshold
        a, b = np.nonzero(np.abs(cosine - self.threshold) <= CLOSE)
        if len(a):
            x, y = v[a], self.v[part][b]
            norms = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
            found[a, b] = (x * y).sum(axis=1) / norms >= self.threshold
        return found

    def _window(self, far: np.ndarray) -> slice:
        low, high = np.searchsorted(self.far, [far.min() - self.reach - SLACK, far.max() + self.reach + SLACK])
        return slice(int(low), int(high))

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect members a and b pairwise."""
        apart = self.label[a] != self.label[b]
        a, b = a[apart], b[apart]
        while len(a):
            low = np.minimum(self.label[a], self.label[b])
            for side in (a, b):
                np.minimum.at(self.label, self.label[side], low)
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up
            apart = self.label[a] != self.label[b]
            a, b = a[apart], b[apart]

    def _among_members(self) -> None:
        other = np.flatnonzero(~self.core)
        step = max(1, PAIRS_AT_ONCE // max(1, len(self.node)))
        for i in range(0, len(other), step):
            rows = other[i : i + step]
            part = self._window(self.far[rows])
            found = self._linked(self.v[rows], self.u[rows], self.far[rows], part)
            members = np.arange(part.start, part.stop)
            # A pair of two outside the core is met from both sides, one with the core from here only.
            found &= rows[:, None] != members[None, :]
            self.links[rows] += found @ self.copies[part]
            in_core = self.core[part]
            self.links[members[in_core]] += self.copies[rows] @ found[:, in_core]
            a, b = np.nonzero(found)
            self._join(rows[a], members[b])

    def visit(self, rows: dict[str, np.ndarray], v: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(node, links, other): links of visitors here, with one member each that they hang on."""
        v, u = units(v)
        step = max(1, PAIRS_AT_ONCE // max(1, len(self.node)))
        for i in range(0, len(u), step):
            own = slice(i, i + step)
            part = self._window(rows["far"][own])
            found = self._linked(v[own], u[own], rows["far"][own], part)
            # Two outside the core in two blocks of one cell are met in the later block.
            once = (rows["role"][own] == _VISITOR) | (rows["block"][own] < block)
            found &= once[:, None] | self.core[part][None, :]
            a, b = np.nonzero(found)
            if not len(a):
                continue
            copies = rows["copies"][own]
            self.links[part] += copies @ found
            asked, first = np.unique(a, return_index=True)
            chosen = b[first]
            hung = np.zeros(len(copies), np.int64)
            hung[asked] = chosen
            self._join(part.start + b, part.start + hung[a])
            yield rows["node"][own][asked], (found @ self.copies[part])[asked], self.node[part][chosen]

    def members(self) -> Iterator[tuple[np.ndarray, ...]]:
        linked = np.flatnonzero(self.links)
        yield self.node[linked], self.links[linked], np.full(len(linked), -1)
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        yield self.node[moved], np.zeros(len(moved), np.int64), self.node[self.label[moved]]
        if self.cell.core_least is not None:
            core = self.node[self.core]
            yield core, np.zeros(len(core), np.int64), np.full(len(core), self.cell.core_least)


def _met(threshold: float, cells: dict[int, Cell]):
    """Function for ``mapInArrow`` over rows in order of (cell, block, role): links and edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found) -> Iterator[pa.RecordBatch]:
            for node, links, other in found:
                if len(node):
                    yield pa.record_batch([pa.array(node), pa.array(links, pa.int64()), pa.array(other, pa.int64())], ["node", "links", "other"])

        key, block, held = None, None, []

        def ready() -> Block | None:
            rows = {c: np.concatenate([h[0][c] for h in held]) for c in held[0][0]}
            return Block(cells[key[0]], threshold, rows, np.concatenate([h[1] for h in held]))

        names = ("cell", "at", "role", "node", "copies", "far", "block")
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            cut = np.flatnonzero((np.diff(columns["cell"]) != 0) | (np.diff(columns["at"]) != 0) | (np.diff(columns["role"] > 0) != 0)) + 1
            for a, b in zip(np.append(0, cut), np.append(cut, batch.num_rows)):
                here = (int(columns["cell"][a]), int(columns["at"][a]))
                if here != key:
                    if key is not None and (block or held):
                        yield from batch_of((block or ready()).members())
                    key, block, held = here, None, []
                rows = {c: columns[c][a:b] for c in names[2:]}
                ((_, v),) = matrices(batch.column("v").slice(a, b - a))  # a cell has one width
                if rows["role"][0] == _MEMBER:
                    held.append((rows, v))
                    continue
                if block is None:
                    if not held:
                        continue  # a block that no member was dealt to
                    block, held = ready(), []
                yield from batch_of(block.visit(rows, v, key[1]))
        if key is not None and (block or held):
            yield from batch_of((block or ready()).members())

    return run


def links(distinct: DataFrame, threshold: float = LINK, cell_rows: int = CELL_ROWS) -> DataFrame:
    """node, links, other: counts of linked vectors in parts, and edges that connect what is linked.

    ``distinct`` has node (unique), v and copies. Rows without an edge have -1 as other.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0, at most 1")
    reach = float(np.arccos(threshold))
    spark = distinct.sparkSession
    layouts = _layouts(distinct, cell_rows, reach)
    plain = spark.sparkContext.broadcast(layouts)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, v in matrices(batch.column("v")):
                layout = plain.value[v.shape[1]]
                for part in layout.slices(len(rows)):
                    every = layout.distances(units(v[part])[1])
                    home = every.argmin(axis=1)
                    kept = batch.take(pa.array(rows[part]))
                    added = pa.array(home + layout.first, pa.int32()), pa.array(every[np.arange(len(home)), home])
                    yield pa.record_batch([*kept.columns, *added], ["node", "v", "copies", "cell", "far"])

    element = distinct.schema["v"].dataType.simpleString()
    # Written, so that all later steps agree to the last digit on who belongs to a core.
    placed = stash(
        distinct.select("node", "v", "copies").mapInArrow(homes, f"node long, v {element}, copies long, cell int, far double"), "metric-placed"
    )
    core = F.col("far") <= reach / 2 - SLACK
    stats = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("far").alias("near"),
        F.max("far").alias("far"),
        F.sum(F.when(core, F.col("copies")).otherwise(0)).alias("core_copies"),
        F.min(F.when(core, F.col("node"))).alias("core_least"),
    )
    cells: dict[int, Cell] = {}
    by_number = {layout.first + i: (layout, i) for layout in layouts.values() for i in range(len(layout.pivots))}
    for r in stats.collect():  # a row per cell
        layout, i = by_number[r["cell"]]
        cell = Cell(r["cell"], r["rows"], r["near"], r["far"], -(-r["rows"] // cell_rows), r["core_copies"], r["core_least"])
        layout.cells[i] = cells[r["cell"]] = cell
    full = spark.sparkContext.broadcast(layouts)

    def sent_of(layout: Layout, every: np.ndarray, home: np.ndarray, far: np.ndarray, own: np.ndarray):
        """(cell, block, row numbers, roles) of all places that rows go to."""
        order = sorted(range(len(layout.cells)), key=lambda i: (c.rows, c.number) if (c := layout.cells[i]) else (0, -1))
        rank = np.empty(len(order), int)
        rank[order] = np.arange(len(order))
        for q, cell in enumerate(layout.cells):
            if cell is None:
                continue
            visits = rank[home] < rank[q]
            visits &= every[:, q] <= np.minimum(far + 2 * reach, cell.far + reach) + SLACK
            visits &= every[:, q] >= cell.near - reach - SLACK
            at_home = home == q
            others = at_home & (far > reach / 2 - SLACK)
            for b in range(cell.blocks):
                role = np.select([at_home & (own == b), others, visits], [_MEMBER, _OTHER_BLOCK, _VISITOR], -1)
                rows = np.flatnonzero(role >= 0)
                if len(rows):
                    yield cell, b, rows, role[rows]

    def copies_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_numpy() for c in ("node", "cell", "far")}
            for rows, v in matrices(batch.column("v")):
                layout = full.value[v.shape[1]]
                blocks = np.array([c.blocks if c else 1 for c in layout.cells])
                for part in layout.slices(len(rows)):
                    at = rows[part]
                    home, far = columns["cell"][at] - layout.first, columns["far"][at]
                    every = layout.distances(units(v[part])[1])
                    every[np.arange(len(home)), home] = far
                    own = mix(columns["node"][at].astype(np.uint64)) % blocks[home].astype(np.uint64)
                    for cell, b, chosen, role in sent_of(layout, every, home, far, own.astype(np.int64)):
                        kept = batch.select(["node", "v", "copies"]).take(pa.array(at[chosen]))
                        numbers = [np.full(len(chosen), cell.number), np.full(len(chosen), b), role, own[chosen].astype(np.int64)]
                        yield pa.record_batch(
                            [*kept.columns, *[pa.array(c, pa.int32()) for c in numbers], pa.array(every[chosen, cell.number - layout.first])],
                            ["node", "v", "copies", "cell", "at", "role", "block", "far"],
                        )

    dealt = placed.mapInArrow(copies_of, f"node long, v {element}, copies long, cell int, at int, role int, block int, far double")
    groups = max(1, sum(cell.blocks for cell in cells.values()))
    ordered = dealt.repartition(groups, "cell", "at").sortWithinPartitions("cell", "at", F.col("role") > 0, "far")
    return ordered.mapInArrow(_met(threshold, cells), "node long, links long, other long")


def near_duplicates(table: DataFrame, threshold: float = LINK, cell_rows: int = CELL_ROWS, vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of the table."""
    v = vector_column(table, vector)
    valid = is_finite(v) & F.exists(v, lambda x: x != 0)
    rows = table.select(column_or_null(table, "vec_id", "long").alias("vec_id"), F.when(valid, v).alias("v"))
    keyed = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})
    grouped = keyed.filter("v is not null").groupBy("k1", "k2").agg(
        F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id")
    )
    distinct = stash(grouped.withColumn("node", F.monotonically_increasing_id()), "metric-distinct")
    found = stash(links(distinct, threshold, cell_rows), "metric-links")
    roots = components(found.filter("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b")), "metric-edges")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = (
        distinct.select("k1", "k2", "node", "copies", "least_id")
        .join(counts, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    done = named.join(ids, "root").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = keyed.filter("v is not null").join(done, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
