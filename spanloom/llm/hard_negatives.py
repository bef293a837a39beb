"""Hard negatives by inner product, found in cover trees over norm-augmented candidates.

Vectors become integers and get one more coordinate that brings all of them to the largest norm; the
larger an inner product with an anchor, the smaller then the distance. The first level of the tree
is fitted on a bounded sample and splits the candidates into regions, of at most ``shard_rows`` rows a
shard. In a shard, every level of the tree halves the radius that a centre covers. Distance to a
centre and covering radius bound the inner products below it: nodes are opened best bound first,
and left out if they lie outside all windows or below what has been found; single points and leaves
are verified exactly. Regions bound inner products likewise, and an anchor only goes to shards
that may hold an answer: for its positives those that can beat the same-label rows of the sample,
for negatives those that reach into one of its windows.

Inner products are exact integers. Rows with a null label, a null or empty vector, or a null or
non-finite component take no part, nor do rows whose integer vector has a squared norm of 2^62 or
more (its scores do not fit a long) or that lack a vec_id. Rows that share a vec_id are one, the smallest by
label and vector. Only vectors of one width meet. Ties go to the smaller vec_id. Other columns play
no part. An empty table, and an anchor without positives or negatives, gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stash
from .common import column_or_null
from .vectors import hash_sample, is_finite, matrices, vector_column

ANCHOR_EVERY = 50
RELABEL_EVERY = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 3
LOWEST, HIGHEST = 50, 95  # window in hundredths of the positive's score
SCALE = 256
SHARD_ROWS = 8192
MOST_REGIONS = 1024
SAMPLE_ROWS = 4096
LEAF = 64
GREEDY_BLOCK = 256
QUERY_BLOCK = 128
_NORM_LIMIT = float(1 << 62) * (1 - 1e-9)
_EXACT = float(1 << 53)


def candidates(table: DataFrame, vector: str = "embedding", relabel: int = RELABEL_EVERY, labels: int = LABELS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v, norm2: rows that take part, as integers."""
    raw = vector_column(table, vector)
    rows = table.select(
        column_or_null(table, "vec_id", "long").alias("vec_id"), column_or_null(table, "label", "long").alias("label"), raw.alias("v")
    ).filter("vec_id is not null and label is not null")
    scaled = F.transform("v", lambda x: x.cast("double") * scale)
    rows = rows.filter(is_finite(F.col("v"))).withColumn("v", scaled).filter(F.forall("v", lambda x: F.abs(x) < float(1 << 31)))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x).cast("long")))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows = rows.withColumn("norm2", size).filter(F.col("norm2") < _NORM_LIMIT)
    label = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    rows = rows.withColumn("label", label)
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v", "norm2")).alias("r"))
    return one.select("vec_id", "r.label", "r.v", "r.norm2")


def lift(x: np.ndarray, most: float) -> np.ndarray:
    """The further coordinate that brings rows to squared norm ``most``."""
    return np.sqrt(np.maximum(most - np.einsum("ij,ij->i", x, x), 0.0))


def spread(x: np.ndarray, rest: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between rows a and b of augmented vectors."""
    xa, xb = x[a], x[b]
    square = (xa * xa).sum(1)[:, None] + (xb * xb).sum(1)[None, :] - 2 * (xa @ xb.T) + (rest[a][:, None] - rest[b][None, :]) ** 2
    return np.sqrt(np.maximum(square, 0.0))


@dataclass
class Node:
    """Children's centres with the radii they cover, and the points of those that are leaves.

    ``leaf`` is the child of each point; points that stand alone have the number after the last one.
    ``children`` is -1 for a leaf.
    """

    rows: np.ndarray
    leaf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    centres: np.ndarray
    middles: np.ndarray
    radii: np.ndarray
    children: np.ndarray


class CoverTree:
    """Cover tree over candidates of a shard; ``most`` is the largest squared norm of the table."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, most: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.whole = ids[order], labels[order], vectors[order]
        self.x, self.most = self.whole.astype(np.float64), most
        self.norm = float(np.sqrt(np.einsum("ij,ij->i", self.x, self.x).max()))
        self.rest = lift(self.x, most)
        self.nodes: list[Node] = []
        todo = [(0, np.arange(len(ids)))]
        self.nodes.append(None)
        while todo:
            at, members = todo.pop()
            alone, leaves, centres, radii, children = [], [], [], [], []
            groups = self._level(members) if len(members) > LEAF else []
            if len(groups) < 2:  # a leaf, or all at one place
                alone = [members]
            for group, radius in groups if len(groups) > 1 else []:
                if len(group) == 1:
                    alone.append(group)
                    continue
                children.append(-1)
                if len(group) > LEAF and radius > 0.0:
                    children[-1] = len(self.nodes)
                    self.nodes.append(None)
                    todo.append((children[-1], group))
                else:
                    leaves.append((group, len(centres)))
                centres.append(group[0])
                radii.append(radius)
            leaves += [(group, len(centres)) for group in alone]
            rows = np.concatenate([group for group, _ in leaves]) if leaves else members[:0]
            leaf = np.repeat(np.array([n for _, n in leaves], int), [len(group) for group, _ in leaves])
            centres = np.array(centres, np.int64)
            self.nodes[at] = Node(
                rows, leaf, self.ids[rows], self.labels[rows], self.x[rows], centres, self.x[centres], np.array(radii, float), np.array(children, int)
            )

    def _level(self, members: np.ndarray) -> list[tuple[np.ndarray, float]]:
        """Groups (centre first) of a node's members at the first level that splits them, with radii."""
        far = spread(self.x, self.rest, members[:1], members)[0]
        if far.max() == 0.0:
            return [(members, 0.0)]
        level = np.exp2(np.ceil(np.log2(far.max())) - 1)
        out = []
        free = np.sort(members)
        centre = members[0]
        while len(free):
            if centre is not None:
                block, centre = np.array([centre]), None
            else:
                block = free[:GREEDY_BLOCK]
            # Centres of this level are more than its radius apart.
            inside = spread(self.x, self.rest, block, block) <= level
            chosen, open_ = [], np.ones(len(block), bool)
            for i in range(len(block)):
                if open_[i]:
                    chosen.append(i)
                    open_ &= ~inside[i]
            centres = block[chosen]
            distance = spread(self.x, self.rest, centres, free)
            distance[np.arange(len(centres)), np.searchsorted(free, centres)] = 0.0
            nearest = distance.argmin(axis=0)
            least = distance[nearest, np.arange(len(free))]
            near = least <= level
            order = np.argsort(nearest[near], kind="stable")
            covered, owner, gap = free[near][order], nearest[near][order], least[near][order]
            cut = np.searchsorted(owner, np.arange(len(centres) + 1))
            for n, c in enumerate(centres):
                own = covered[cut[n] : cut[n + 1]]
                out.append((np.append(c, own[own != c]), float(gap[cut[n] : cut[n + 1]].max(initial=0.0))))
            free = free[~near]
        return out

    def search(self, queries: np.ndarray, asked: list[tuple[list[tuple[int, int]], int, int]], k: int, same: bool) -> Iterator[list[list[tuple[int, int]]]]:
        """For each query, and each of its windows of scores, the best ``k`` as (-score, id).

        ``asked`` has a query's windows, its label and its own id; rows of the same label count, or
        all others.
        """
        root = self.nodes[0]
        for begin in range(0, len(queries), QUERY_BLOCK):
            block = queries[begin : begin + QUERY_BLOCK].astype(np.float64)
            # All queries open the root; from there on each takes its own way.
            points, middles = block @ root.points.T, block @ root.middles.T
            for n, q in enumerate(block):
                windows, label, own = asked[begin + n]
                yield self._descend(queries[begin + n], q, (points[n], middles[n]), windows, k, label, same, own)

    def _descend(self, whole, q, first, windows, k, label, same, own) -> list[list[tuple[int, int]]]:
        q2 = float(q @ q)
        fits = np.sqrt(q2) * self.norm < _EXACT
        margin = 1e-9 * (self.most + q2) + 1e-6
        low, high = (np.array([w[side] for w in windows], float) for side in (0, 1))
        floor = low.copy()
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        heap: list[tuple[float, int]] = [(-np.inf, 0)]
        while heap:
            bound, at = heapq.heappop(heap)
            if (-bound < floor - margin).all():
                break  # no node still waiting may do better
            node = self.nodes[at]
            live = np.ones(len(node.centres) + 1, bool)
            if len(node.centres):
                product = first[1] if at == 0 else node.middles @ q
                gap = np.sqrt(np.maximum(self.most + q2 - 2 * product, 0.0))
                most = (self.most + q2 - np.maximum(gap - node.radii, 0.0) ** 2) / 2
                least = (self.most + q2 - (gap + node.radii) ** 2) / 2
                live[:-1] = ((most[:, None] >= floor - margin) & (least[:, None] <= high + margin)).any(axis=1)
                for i in np.flatnonzero(live[:-1] & (node.children >= 0)):
                    heapq.heappush(heap, (-float(most[i]), int(node.children[i])))
            if len(node.rows):
                if fits:
                    scores = first[0] if at == 0 else node.points @ q
                else:
                    scores = self.whole[node.rows] @ whole
                hit = np.flatnonzero((scores >= floor.min() - margin) & (scores <= high.max() + margin) & live[node.leaf])
                hit = hit[((node.labels[hit] == label) == same) & (node.ids[hit] != own)]
                hit = hit[np.lexsort((node.ids[hit], -scores[hit]))]
                best, ids = -scores[hit].astype(np.int64), node.ids[hit]
                for n, (a, b) in enumerate(windows):
                    at_most = int(np.searchsorted(best, -b))
                    took = [(s, i) for s, i in zip(best[at_most : at_most + k].tolist(), ids[at_most : at_most + k].tolist()) if -s >= a]
                    if took:
                        found[n] = sorted(found[n] + took)[:k]
                        if len(found[n]) == k:
                            floor[n] = max(low[n], -found[n][-1][0])
        return found


class Regions:
    """First level of the tree for one width: centres out of a sample, what they cover, their shards."""

    def __init__(self, width: int, sample: list, most: float, wanted: int, first: int):
        sample = sorted(sample, key=lambda r: r["vec_id"])
        self.ids, self.labels = (np.array([r[c] for r in sample], np.int64) for c in ("vec_id", "label"))
        self.x = np.array([r["v"] for r in sample], float).reshape(len(sample), width)
        self.most, self.first = most, first
        rest = lift(self.x, most)
        if len(sample):
            everyone = np.arange(len(sample))
            chosen, gap = [0], spread(self.x, rest, everyone[:1], everyone)[0]
            while len(chosen) < min(wanted, len(sample)) and gap.max() > 0:
                chosen.append(int(gap.argmax()))  # the farthest from all centres so far
                gap = np.minimum(gap, spread(self.x, rest, everyone[chosen[-1:]], everyone)[0])
            self.centres, self.rest = self.x[chosen], rest[chosen]
        else:  # any point may be a centre; a rare width may lack a row in the sample
            self.centres, self.rest = np.zeros((1, width)), np.array([np.sqrt(most)])
        self.radii = np.full(len(self.centres), -1.0)  # -1: nobody there
        self.begins = np.zeros(len(self.centres), int)
        self.parts = np.zeros(len(self.centres), int)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Region of each row, and its distance to the centre."""
        square = (x * x).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * (x @ self.centres.T) + (lift(x, self.most)[:, None] - self.rest) ** 2
        region = square.argmin(axis=1)
        return region, np.sqrt(np.maximum(square[np.arange(len(x)), region], 0.0))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product that a region may hold, for each query."""
        q2 = (q * q).sum(1)[:, None]
        gap = np.sqrt(np.maximum(self.most + q2 - 2 * (q @ self.centres.T), 0.0))
        margin = 1e-9 * (self.most + q2) + 1e-3
        least = (self.most + q2 - (gap + self.radii) ** 2) / 2 - margin
        most = (self.most + q2 - np.maximum(gap - self.radii, 0.0) ** 2) / 2 + margin
        return np.where(self.radii < 0, np.inf, least), np.where(self.radii < 0, -np.inf, most)

    def shards(self, regions: np.ndarray) -> list[int]:
        return [int(self.begins[r]) + i for r in regions for i in range(int(self.parts[r]))]


def _regions(rows: DataFrame, shard_rows: int) -> dict[int, Regions]:
    stats = rows.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("most")).collect()
    by_width: dict[int, list] = {}
    if stats:  # a row per width
        for r in hash_sample(rows.select("vec_id", "label", "v"), "vec_id", sum(r["n"] for r in stats), SAMPLE_ROWS):
            by_width.setdefault(len(r["v"]), []).append(r)
    out, first = {}, 0
    for r in sorted(stats, key=lambda r: r["width"]):
        wanted = min(MOST_REGIONS, -(-r["n"] // shard_rows))
        out[r["width"]] = Regions(r["width"], by_width.get(r["width"], []), r["most"] * (1 + 1e-12), wanted, first)
        first += len(out[r["width"]].centres)
    return out


_ASKED = "shard int, role int, vec_id long, label long, v array<long>, windows array<struct<positive_id:long,positive_score:long>>"
_FOUND = "anchor_id long, positive_id long, positive_score long, score long, vec_id long"


def _window(score: int) -> tuple[int, int]:
    """Least and largest negative score for a positive's; empty if below zero."""
    return -(-LOWEST * score // 100), HIGHEST * score // 100


def _routes(regions, k: int):
    """Functions for ``mapInArrow``: anchors to the shards that may hold positives, or negatives."""

    def asked(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("positive_id", pa.int64()), ("positive_score", pa.int64())]))]
        names = [part.split()[0] for part in ("shard", "role", "vec_id", "label", "v", "windows")]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch], negatives: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = (batch.column(c).to_pylist() for c in ("vec_id", "label"))
            windows = batch.column("windows").to_pylist() if negatives else None
            for rows, v in matrices(batch.column("v")):
                own = regions.value[v.shape[1]]
                least, most = own.bounds(v)
                out = []
                for n, row in enumerate(rows.tolist()):
                    if negatives:
                        spans = [_window(w["positive_score"]) for w in windows[row]]
                        hit = np.zeros(len(own.centres), bool)
                        for a, b in spans:
                            if a <= b:
                                hit |= (most[n] >= a) & (least[n] <= b)
                        said = windows[row]
                    else:
                        alike = (own.labels == labels[row]) & (own.ids != ids[row])
                        known = np.sort(own.x[alike] @ v[n])[::-1]
                        hit = most[n] >= (known[k - 1] if len(known) >= k else -np.inf)
                        hit &= own.radii >= 0
                        said = []
                    whole = v[n].astype(np.int64).tolist()
                    out += [(s, 1, ids[row], labels[row], whole, said) for s in own.shards(np.flatnonzero(hit))]
                    if len(out) >= 4096:
                        yield asked(out)
                        out = []
                if out:
                    yield asked(out)

    return (lambda batches: run(batches, False)), (lambda batches: run(batches, True))


def _searched(most: dict[int, float], k: int, same: bool):
    """Function for ``mapInArrow`` over rows in order of (shard, role): what each shard finds."""
    everything = [(-(1 << 62), 1 << 62)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, held = None, None, []
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "role", "vec_id", "label")}
            cut = np.flatnonzero((np.diff(columns["shard"]) != 0) | (np.diff(columns["role"]) != 0)) + 1
            for a, b in zip(np.append(0, cut), np.append(cut, batch.num_rows)):
                if columns["shard"][a] != shard:
                    shard, tree, held = columns["shard"][a], None, []
                ((_, v),) = matrices(batch.column("v").slice(a, b - a))  # a shard has one width
                v = v.astype(np.int64)
                if columns["role"][a] == 0:
                    held.append((columns["vec_id"][a:b], columns["label"][a:b], v))
                    continue
                if tree is None:
                    if not held:
                        continue  # a shard that no row was dealt to
                    tree = CoverTree(*(np.concatenate(c) for c in zip(*held)), most[v.shape[1]])
                    held = []
                asked = batch.column("windows").slice(a, b - a).to_pylist()
                rows: list[tuple] = []
                own, labels = (columns[c][a:b].tolist() for c in ("vec_id", "label"))
                if same:
                    wanted = [(everything, label, i) for label, i in zip(labels, own)]
                    for anchor, (found,) in zip(own, tree.search(v, wanted, k, True)):
                        rows += [(anchor, None, None, -s, i) for s, i in found]
                else:
                    spans = [[(w["positive_id"], w["positive_score"], *_window(w["positive_score"])) for w in said] for said in asked]
                    spans = [[w for w in said if w[2] <= w[3]] for said in spans]
                    wanted = [([w[2:] for w in said], label, i) for said, label, i in zip(spans, labels, own)]
                    for anchor, said, found in zip(own, spans, tree.search(v, wanted, k, False)):
                        rows += [(anchor, w[0], w[1], -s, i) for w, best in zip(said, found) for s, i in best]
                if rows:
                    names = ["anchor_id", "positive_id", "positive_score", "score", "vec_id"]
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return run


def mine(
    table: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, anchor_every: int = ANCHOR_EVERY, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = table.sparkSession
    rows = stash(candidates(table), "negatives-rows")
    regions = _regions(rows, shard_rows)
    plain = spark.sparkContext.broadcast(regions)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in matrices(batch.column("v")):
                own = plain.value[v.shape[1]]
                home, gap = own.home(v)
                kept = batch.take(pa.array(at))
                yield pa.record_batch([*kept.columns, pa.array(home + own.first, pa.int32()), pa.array(gap)], ["vec_id", "label", "v", "region", "gap"])

    placed = stash(
        rows.select("vec_id", "label", "v").mapInArrow(homes, "vec_id long, label long, v array<long>, region int, gap double"), "negatives-placed"
    )
    by_number = {own.first + i: (own, i) for own in regions.values() for i in range(len(own.centres))}
    dealt, begin = [], 0
    stats = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("gap")).collect()  # a row per region
    for r in sorted(stats, key=lambda r: r["region"]):
        own, i = by_number[r["region"]]
        # Distances of far vectors are known to about this.
        own.radii[i], own.begins[i], own.parts[i] = r["gap"] * (1 + 1e-9) + 1e-3 + 1e-7 * np.sqrt(own.most), begin, -(-r["n"] // shard_rows)
        dealt.append((r["region"], begin, int(own.parts[i])))
        begin += int(own.parts[i])
    places = F.broadcast(spark.createDataFrame(dealt, "region int, begin int, parts int"))
    shard = (F.col("begin") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")
    none = F.lit(None).cast("array<struct<positive_id:long,positive_score:long>>")
    members = placed.join(places, "region").select(shard.alias("shard"), F.lit(0).alias("role"), "vec_id", "label", "v", none.alias("windows"))
    to_positives, to_negatives = _routes(spark.sparkContext.broadcast(regions), positives)
    most = {width: own.most for width, own in regions.items()}

    def found(asked: DataFrame, k: int, same: bool) -> DataFrame:
        both = members.unionByName(asked).repartition(max(1, begin), "shard").sortWithinPartitions("shard", "role", "vec_id")
        return both.mapInArrow(_searched(most, k, same), _FOUND)

    def first(rows: DataFrame, k: int, *group: str) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    anchors = placed.filter(F.col("vec_id") % anchor_every == 0).select("vec_id", "label", "v")
    best = first(found(anchors.mapInArrow(to_positives, _ASKED), positives, True), positives, "anchor_id")
    windows = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct(F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))).alias("windows")
    )
    asked = stash(anchors.join(windows, "vec_id"), "negatives-windows").mapInArrow(to_negatives, _ASKED)
    hard = first(found(asked, negatives, False), negatives, "anchor_id", "positive_id")
    return hard.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
