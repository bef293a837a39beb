"""Nearest neighbours by inner product: a vantage-point tree per shard.

Vectors are lengthened to one norm by a further coordinate, so that the largest inner product is the
smallest Euclidean distance. A node keeps a vantage point and, for each of its two children, the
smallest and largest distance of its members to it. A child is left out for a query if the triangle
inequality puts all its members beyond the query's k-th best distance times ``factor``: one is
exact, less prunes more and may miss neighbours.

Shards are the leaves of the upper levels of such a tree, fitted on a bounded sample and broadcast;
what falls into one place beyond ``shard_rows`` is dealt by id to several shards. A query goes to the
shards that may hold a vector nearer than its k-th best of the sample. A shard's tree is built in
one task and asked with the queries as they stream by; the best of each shard are merged. Nothing
but the sample is collected or broadcast.

Scores are the inner products in double precision; matrix products only preselect, with a margin.
For that, vectors are scaled by one power of two.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, nor do rows without an id. Rows that share an id are one vector, the smallest by value.
Equal scores go to the smaller id. Empty tables give empty results. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stash
from .common import column_or_null, mix
from .vectors import hash_sample

K = 20
QUERY_EVERY = 20
SHARD_ROWS = 8192
MOST_SHARDS = 1024
SAMPLE_ROWS = 4096
LEAF = 128
# Distances are compared with this part of the k-th best; see the README for measured recall.
FACTOR = 0.95
# What rounding may change in a product of vectors of length one.
ROUNDING = 1e-12


def _lengthened(vectors: np.ndarray, most: float) -> np.ndarray:
    """The further coordinate that brings vectors to squared norm ``most``."""
    return np.sqrt(np.maximum(most - np.einsum("ij,ij->i", vectors, vectors), 0.0))


class VantageTree:
    """Tree over vectors of one shard, asked with blocks of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.most = float(np.einsum("ij,ij->i", self.vectors, self.vectors).max())
        self.rest = _lengthened(self.vectors, self.most)
        # node: members, or (vantage point, [(child, nearest, farthest), ...])
        self.nodes: list = [np.arange(len(ids))]
        todo = [0]
        while todo:
            at = todo.pop()
            members = self.nodes[at]
            if len(members) <= leaf:
                continue
            # The member farthest from the first parts the others best.
            far = self._distance(members, members[0]).argmax()
            point = members[far]
            distance = self._distance(members, point)
            middle = np.argsort(distance, kind="stable")
            halves = np.split(middle, [len(middle) // 2])
            if distance[halves[0]].max() == distance[halves[1]].min() == distance.max() == distance.min():
                continue  # all at one place: a larger leaf
            children = []
            for half in halves:
                children.append((len(self.nodes), float(distance[half].min()), float(distance[half].max())))
                todo.append(len(self.nodes))
                self.nodes.append(np.sort(members[half]))
            self.nodes[at] = (point, children)

    def _distance(self, rows: np.ndarray, point: int) -> np.ndarray:
        gap = self.vectors[rows] - self.vectors[point]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap) + (self.rest[rows] - self.rest[point]) ** 2)

    def search(self, names: np.ndarray, queries: np.ndarray, k: int = K, factor: float = FACTOR):
        """Scores and ids of the best ``k`` members of each query; a score of -inf fills up."""
        n = len(names)
        scores, ids = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        own = np.einsum("ij,ij->i", queries, queries)
        squares, margin = own + self.most, ROUNDING * np.sqrt(own * self.most)

        def leaf(members: np.ndarray, asked: np.ndarray) -> None:
            for begin in range(0, len(members), 4 * LEAF):
                part = members[begin : begin + 4 * LEAF]
                about = queries[asked] @ self.vectors[part].T
                row, column = np.nonzero(about >= (scores[asked, -1] - margin[asked])[:, None])
                q, m = asked[row], part[column]
                other = names[q] != self.ids[m]
                q, m = q[other], m[other]
                if not len(q):
                    continue
                exact = (queries[q] * self.vectors[m]).sum(axis=1)
                touched = np.unique(q)
                every_q = np.concatenate([np.repeat(touched, k), q])
                every_s = np.concatenate([scores[touched].ravel(), exact])
                every_i = np.concatenate([ids[touched].ravel(), self.ids[m]])
                order = np.lexsort((every_i, -every_s, every_q))
                every_q, every_s, every_i = every_q[order], every_s[order], every_i[order]
                first = np.searchsorted(every_q, touched)[:, None] + np.arange(k)  # k rows each at least
                scores[touched], ids[touched] = every_s[first], every_i[first]

        def distances(point: int, asked: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(squares[asked] - 2 * (queries[asked] @ self.vectors[point]), 0.0))

        # First down to the nearest leaf for a bound, then through all that the bound leaves.
        home = np.zeros(n, np.int64)
        todo = [(0, np.arange(n))]
        while todo:
            at, asked = todo.pop()
            node = self.nodes[at]
            if isinstance(node, np.ndarray):
                home[asked] = at
                leaf(node, asked)
                continue
            point, ((near, _, edge), (far, _, _)) = node
            inside = distances(point, asked) <= edge
            todo += [(child, part) for child, part in ((near, asked[inside]), (far, asked[~inside])) if len(part)]
        slack = 1e-6 * np.sqrt(squares)
        todo = [(0, np.arange(n))]
        while todo:
            at, asked = todo.pop()
            node = self.nodes[at]
            if isinstance(node, np.ndarray):
                asked = asked[home[asked] != at]
                if len(asked):
                    leaf(node, asked)
                continue
            point, children = node
            distance = distances(point, asked)
            kth = scores[asked, -1]
            bound = factor * np.sqrt(np.maximum(squares[asked] - 2 * kth, 0.0)) + slack[asked]
            bound[np.isneginf(kth)] = np.inf
            for child, nearest, farthest in children:
                part = asked[(distance - farthest <= bound) & (nearest - distance <= bound)]
                if len(part):
                    todo.append((child, part))
        return scores, ids


class UpperTree:
    """Upper levels of a vantage-point tree, fitted on a sample; its leaves are places for shards."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, most: float, places: int):
        self.ids, self.sample, self.most = ids, sample, most
        self.rest = _lengthened(sample, most)
        self.nodes: list = [np.arange(len(ids))]  # members, or (vantage point, edge, inner, outer)
        while sum(isinstance(node, np.ndarray) for node in self.nodes) < places:
            at = max(range(len(self.nodes)), key=lambda i: len(self.nodes[i]) if isinstance(self.nodes[i], np.ndarray) else -1)
            members = self.nodes[at]
            if len(members) < 4:
                break
            point = members[self._distance(sample[members], self.rest[members], members[0]).argmax()]
            distance = self._distance(sample[members], self.rest[members], point)
            edge = float(np.median(distance))
            inside = distance <= edge
            if inside.all():
                break  # the largest place holds copies only
            self.nodes[at] = (point, edge, len(self.nodes), len(self.nodes) + 1)
            self.nodes += [members[inside], members[~inside]]

    def _distance(self, x: np.ndarray, rest: np.ndarray, point: int) -> np.ndarray:
        gap = x - self.sample[point]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap) + (rest - self.rest[point]) ** 2)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The place of each vector."""
        rest, out = _lengthened(x, self.most), np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if isinstance(self.nodes[at], np.ndarray):
                out[rows] = at
                continue
            point, edge, inner, outer = self.nodes[at]
            inside = self._distance(x[rows], rest[rows], point) <= edge
            todo += [(inner, rows[inside]), (outer, rows[~inside])]
        return out

    def near(self, names: np.ndarray, queries: np.ndarray, k: int, factor: float) -> list[tuple[int, np.ndarray]]:
        """(place, query positions): where a query's ``k`` best may be, by its ``k``-th best of the sample."""
        about = queries @ self.sample.T
        about[names[:, None] == self.ids[None, :]] = -np.inf
        own = np.einsum("ij,ij->i", queries, queries)
        squares = own + self.most
        kth = np.sort(about, axis=1)[:, -k] if about.shape[1] >= k else np.full(len(names), -np.inf)
        bound = factor * np.sqrt(np.maximum(squares - 2 * kth, 0.0)) + 1e-6 * np.sqrt(squares)
        bound[np.isneginf(kth)] = np.inf
        out, todo = [], [(0, np.arange(len(names)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            if isinstance(self.nodes[at], np.ndarray):
                out.append((at, rows))
                continue
            point, edge, inner, outer = self.nodes[at]
            distance = np.sqrt(np.maximum(squares[rows] - 2 * (queries[rows] @ self.sample[point]), 0.0))
            todo += [(inner, rows[distance - edge <= bound[rows]]), (outer, rows[edge - distance <= bound[rows]])]
        return out


def valid_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles, one per id."""
    own = column_or_null(table, "vec_id", "long").alias("vec_id"), column_or_null(table, vector, "array<double>").alias("v")
    rows = table.select(*own).filter("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _rows_of(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return np.ldexp(flat.reshape(batch.num_rows, -1), -scale)


_DEALT = "shard int, kind int, vec_id long, v array<double>"


def nearest(
    table: DataFrame, queries: Column | None = None, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query row (a condition on vec_id)."""
    spark = table.sparkSession
    vectors = stash(valid_vectors(table), "neighbour-vectors")
    size = F.array_max(F.transform("v", F.abs))
    widths = vectors.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("most"))
    width = widths.orderBy(F.desc("n"), "width").first()
    if width is None:
        return vectors.select(
            F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")
        ).limit(0)
    vectors = vectors.filter(F.size("v") == width["width"])
    scale = int(np.frexp(width["most"])[1])
    down = F.lit(float(np.ldexp(1.0, -scale // 2))), F.lit(float(np.ldexp(1.0, -scale - (-scale // 2))))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x * down[0] * down[1]) * (x * down[0] * down[1]))
    most = vectors.agg(F.max(norm2)).first()[0] * (1 + 1e-9)
    sample = sorted(hash_sample(vectors, "vec_id", width["n"], SAMPLE_ROWS), key=lambda r: r["vec_id"])
    ids = np.array([r["vec_id"] for r in sample], np.int64)
    known = np.ldexp(np.array([r["v"] for r in sample], float).reshape(len(sample), width["width"]), -scale)
    upper = spark.sparkContext.broadcast(UpperTree(ids, known, most, min(MOST_SHARDS, -(-width["n"] // shard_rows))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("place", pa.array(upper.value.home(_rows_of(batch, scale)), pa.int32()))

    placed = stash(vectors.mapInArrow(place, "vec_id long, v array<double>, place int"), "neighbour-places")
    parts, shards = {}, 0  # of each place: its first shard and their number; one row a place
    for r in sorted(placed.groupBy("place").count().collect(), key=lambda r: r["place"]):
        n = -(-r["count"] // shard_rows)
        parts[r["place"]] = shards, n
        shards += n

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, names = batch.column("place").to_pylist(), batch.column("vec_id").to_numpy()
            first, n = np.array([parts[p] for p in where], np.int64).reshape(-1, 2).T
            shard = first + (mix(names.astype(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
            columns = [pa.array(shard, pa.int32()), pa.array(np.zeros(len(names)), pa.int32()), batch.column("vec_id"), batch.column("v")]
            yield pa.record_batch(columns, ["shard", "kind", "vec_id", "v"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, x = batch.column("vec_id").to_numpy(), _rows_of(batch, scale)
            for begin in range(0, len(names), 512):
                own = slice(begin, begin + 512)
                for at, rows in upper.value.near(names[own], x[own], k, factor):
                    took = batch.select(["vec_id", "v"]).take(pa.array(rows + begin))
                    first, n = parts.get(at, (0, 0))
                    for shard in range(first, first + n):
                        numbers = pa.array(np.full(len(rows), shard), pa.int32()), pa.array(np.ones(len(rows)), pa.int32())
                        yield pa.record_batch([*numbers, *took.columns], ["shard", "kind", "vec_id", "v"])

    is_query = F.pmod(F.col("vec_id"), F.lit(QUERY_EVERY)) == 0 if queries is None else queries
    sent = placed.filter(is_query).drop("place").mapInArrow(asked, _DEALT)
    dealt = placed.mapInArrow(members, _DEALT).unionByName(sent)
    dealt = dealt.repartition(max(shards, 1), "shard").sortWithinPartitions("shard", "kind", "vec_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = -1, None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = _rows_of(batch, scale)
            names = batch.column("vec_id").to_numpy()
            where, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            change = np.flatnonzero((np.diff(where) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip(np.append(0, change), np.append(change, len(names))):
                if where[a] != shard:
                    shard, tree, held = where[a], None, []
                if kind[a] == 0:
                    held.append((names[a:b], flat[a:b]))
                    continue
                if tree is None and held:
                    tree = VantageTree(*(np.concatenate(c) for c in zip(*held)))
                    held = []
                for i in range(a, b if tree else a, 1024):
                    j = min(i + 1024, b)
                    scores, found = tree.search(names[i:j], flat[i:j], k, factor)
                    row, column = np.nonzero(scores > -np.inf)  # ids may be negative
                    if len(row):
                        columns = [pa.array(names[i:j][row]), pa.array(found[row, column]), pa.array(scores[row, column])]
                        yield pa.record_batch(columns, ["query_id", "vec_id", "scaled"])

    found = dealt.mapInArrow(search, "query_id long, vec_id long, scaled double")
    order = Window.partitionBy("query_id").orderBy(F.desc("scaled"), "vec_id")
    up = [F.lit(float(np.ldexp(1.0, p))) for p in (scale // 2, scale - scale // 2)]  # twice each, in steps that fit a double
    score = F.col("scaled") * up[0] * up[0] * up[1] * up[1]
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
