"""Exact top-k inner-product search with cover trees of rows and of queries.

A net of centres, far apart from each other, splits the rows into cells; a cell
of more than `row_block` rows has several parts.  Each part is one cover tree,
built once for all queries that reach it, and queries come to it in batches
that are cover trees as well.  Two trees are walked together: a pair of nodes
with centres q and r and covering radii s and t holds no product above

    <q, r> + s |r| + t |q| + s t

and is pruned when that is below the worst k-th score of the query node's
queries.  The same bound, with s = 0, prunes whole cells before anything moves:

1. Every query meets one part each of the few cells that promise most: its k-th
   best score there is what any other row has to reach.
2. It meets the parts of all other cells whose bound reaches that.

The net is fitted to a bounded sample (`sample` rows, those of smallest hash);
all rows are in cells.  Vectors of a norm of 2**26 and more after scaling, whose
products a double may not hold, are parts of their own, and are multiplied as
integers; so is all that meets such a query.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows without id; an empty vector scores 0 with all.
Shorter vectors count as padded with zeros.  Rows with the query's own id are no
candidates for it; other repeated rows are candidates each.  Ties go to the
smaller id.  A score that a long does not hold counts as the nearest long.
Empty tables give no rows.  Other columns may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Ratio of the separation of neighbouring levels of a tree, points in a leaf at most, and points for each one of the finest net.
BASE, LEAF, SHARE = 1.3, 64, 32
#: Norm from which a vector's products are computed as integers.
WIDE = float(1 << 26)
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Centres of the net at most, and cells that a query meets first.
CELLS, FIRST = 4096, 4


def farthest_first(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `most` of a farthest-first order of the rows of x, and how far each is from those before it; copies end it."""
    sq = (x * x).sum(1)
    left = np.full(len(x), np.inf)
    order, gaps, at = [], [], 0
    for _ in range(min(most, len(x))):
        order.append(at)
        gaps.append(left[at])
        left = np.minimum(left, np.maximum(sq + sq[at] - 2 * (x @ x[at]), 0))
        left[at] = 0
        at = int(left.argmax())
        if left[at] <= 0:
            break
    return np.array(order, int), np.sqrt(gaps)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Number of the nearest center to each row of x."""
    out = np.empty(len(x), int)
    sq = (centers * centers).sum(1)
    for k in range(0, len(x), 1024):
        out[k : k + 1024] = (sq[None] - 2 * x[k : k + 1024] @ centers.T).argmin(1)
    return out


class Tree:
    """Cover tree over the rows of x, as arrays by node number.

    A farthest-first order gives nested nets: the points inserted at a distance
    above BASE**i are BASE**i apart and cover all others within it.  Each net's
    points hang below the nearest point of the next coarser net; all points
    hang below the nearest one of the finest net, packed into leaves.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.norm = x, np.sqrt((x * x).sum(1))
        self.center: list[int] = []
        self.radius: list[float] = []
        self.below: list[list[int]] = []
        self.points: list[np.ndarray] = []
        self.root = self._build()

    def _node(self, center: int, below: list[int], points: np.ndarray) -> int:
        self.center.append(center)
        self.below.append(below)
        self.points.append(points)
        diff = self.x[points] - self.x[center]
        self.radius.append(float(np.sqrt((diff * diff).sum(1).max())) * (1 + 1e-12))
        return len(self.center) - 1

    def _leaves(self, center: int, points: np.ndarray) -> list[int]:
        """Leaves of at most LEAF points, the nearest to the centre first."""
        diff = self.x[points] - self.x[center]
        points = points[np.argsort((diff * diff).sum(1), kind="stable")]
        return [self._node(center, [], points[k : k + LEAF]) for k in range(0, len(points), LEAF)]

    def _build(self) -> int:
        order, gaps = farthest_first(self.x, max(1, len(self.x) // SHARE))
        sizes = []  # of the nets, from coarse to fine
        gap = gaps[1] if len(order) > 1 else 0.0
        while gap > 0 and (m := int((gaps > gap).sum())) < len(order):
            if m and (not sizes or m > sizes[-1]):
                sizes.append(m)
            gap /= BASE
        sizes.append(len(order))
        own = order[nearest(self.x, self.x[order])]
        own[order] = order
        nodes: dict[int, list[int]] = {}
        held: dict[int, np.ndarray] = {}
        by = np.argsort(own, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(own[by])) + 1):
            c = int(own[some[0]])
            held[c], nodes[c] = some, self._leaves(c, some)
        for m in [*reversed(sizes[:-1]), 1]:
            coarse = order[:m]
            fine = np.array(sorted(nodes), int)
            up = coarse[nearest(self.x[fine], self.x[coarse])]
            up[np.isin(fine, coarse)] = fine[np.isin(fine, coarse)]
            merged: dict[int, list[int]] = {}
            whole: dict[int, list[np.ndarray]] = {}
            for c, parent in zip(fine.tolist(), up.tolist(), strict=True):
                one = nodes[c] if len(nodes[c]) == 1 else [self._node(c, nodes[c], held[c])]
                merged.setdefault(parent, []).extend(one)
                whole.setdefault(parent, []).append(held[c])
            nodes, held = merged, {c: np.concatenate(p) for c, p in whole.items()}
        (center,) = nodes
        return self._node(center, nodes[center], held[center])


def scaled(x: float, scale: int) -> int:
    """floor(scale * x) of a finite x, exactly."""
    top, bottom = float(x).as_integer_ratio()
    return scale * top // bottom


class Found:
    """The k best rows of each query so far, as pairs of score and id; rows reach `least` at least."""

    def __init__(self, n: int, k: int, least: np.ndarray, exact: bool):
        self.k, self.exact = k, exact
        self.score = np.full((n, k), -np.inf, object if exact else float)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        #: What a row has to reach to matter, by query.
        self.worst = np.array(least, float)

    def add(self, at: np.ndarray, new: np.ndarray, row_ids: np.ndarray) -> None:
        """new: scores of the rows for the queries `at`; -inf is none."""
        some = np.flatnonzero((new >= self.worst[at][:, None]).any(1))
        if not len(some):
            return
        at, new = at[some], new[some]
        s = np.concatenate([self.score[at], new], 1)
        i = np.concatenate([self.ids[at], np.broadcast_to(row_ids, new.shape)], 1)
        if self.exact:
            o = np.array([sorted(range(s.shape[1]), key=lambda j, r=r: (-s[r, j], i[r, j]))[: self.k] for r in range(len(s))])
        else:
            o = np.lexsort((i, -s))[:, : self.k]
        self.score[at], self.ids[at] = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)
        last = self.score[at, -1].astype(float)
        self.worst[at] = np.maximum(self.worst[at], last - np.where(np.isfinite(last), 1e-12 * np.abs(last) if self.exact else 0.0, 0.0))


def meet(queries: Tree, query_ids: np.ndarray, rows: Tree, row_ids: np.ndarray, k: int, least: np.ndarray, integers=None) -> Found:
    """The k best rows of each query, walking both trees.  integers: rows of Python integers of both sides, where doubles don't do."""
    q, r = queries, rows
    out = Found(len(query_ids), k, least, integers is not None)

    def bounds(a: int, others: list[int]) -> np.ndarray:
        c, s = q.center[a], q.radius[a]
        centers, t = [r.center[b] for b in others], np.array([r.radius[b] for b in others])
        with np.errstate(all="ignore"):
            inner, rest = r.x[centers] @ q.x[c], s * r.norm[centers] + t * q.norm[c] + s * t
            top = inner + rest + 1e-9 * (1 + r.norm[centers] * q.norm[c] + rest)
        return np.where(np.isnan(top), np.inf, top)

    def compare(a: int, b: int) -> None:
        at, to = q.points[a], r.points[b]
        if integers is None:
            new = q.x[at] @ r.x[to].T
        else:
            new = np.minimum(np.maximum(integers[0][at].dot(integers[1][to].T), LOWEST), HIGHEST)
        new[query_ids[at][:, None] == row_ids[to][None]] = -np.inf
        out.add(at, new, row_ids[to])

    def walk(a: int, others: list[int]) -> None:
        """Pairs of the query node a with row nodes, the most promising first."""
        top = bounds(a, others)
        for j in np.argsort(-top, kind="stable").tolist():
            if top[j] < out.worst[q.points[a]].min():
                return  # all that follow are bounded lower still
            b = others[j]
            if q.below[a] and (not r.below[b] or q.radius[a] >= r.radius[b]):
                for x in q.below[a]:
                    walk(x, [b])
            elif r.below[b]:
                walk(a, r.below[b])
            else:
                compare(a, b)

    walk(q.root, [r.root])
    return out


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of numbers as rows, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy()
    flat, n = column.values.to_numpy()[at[0] : at[-1]], np.diff(at)
    x = np.zeros((len(n), int(n.max(initial=0)) if width is None else width))
    x[np.arange(x.shape[1])[None] < n[:, None]] = flat
    return x


def _scaled(x: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -1e150, 1e150)  # squares stay finite; such rows are multiplied as integers


def _assigned(net: np.ndarray, scale: int):
    """Cell of each vector, its norm, and how far it is from the cell's centre; cell -1 is that of the wide ones."""

    @common.tidy
    def run(batches):
        for b in batches:
            x = _scaled(_matrix(b.column("v")), scale)
            norm = np.sqrt((x * x).sum(1))
            both = max(x.shape[1], net.shape[1])
            y, c = np.pad(x, ((0, 0), (0, both - x.shape[1]))), np.pad(net, ((0, 0), (0, both - net.shape[1])))
            cell = nearest(y, c) if len(c) else np.zeros(len(y), int)
            apart = np.sqrt(((y - c[cell]) ** 2).sum(1)) if len(c) else norm
            wide = norm >= WIDE
            cell = np.where(wide, -1, cell)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(norm), pa.array(np.where(wide, norm, apart))], names=["vec_id", "v", "cell", "norm", "apart"])

    return run


def _aimed(cells: list[tuple[int, int, float, int]], net: np.ndarray, scale: int, first: bool, k: int):
    """A row for each part of a cell that a query goes to.

    cells: number, parts, radius (of the wide cell -1, its largest norm), rows.
    On the first way it goes to one part of each of the FIRST cells whose centres
    are best, of those with rows enough; on the second to all others whose bound
    reaches `least`.
    """
    number, parts, radius, size = (np.array(c) for c in zip(*cells, strict=True))
    enough = (number >= 0) & (size >= min(4 * k, size.max()))

    @common.tidy
    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                b = whole.slice(low, 512)
                x = _scaled(_matrix(b.column("v")), scale)
                ids, home = b.column("vec_id").to_numpy(zero_copy_only=False), b.column("part").to_numpy(zero_copy_only=False)
                both = max(x.shape[1], net.shape[1])
                y, c = np.pad(x, ((0, 0), (0, both - x.shape[1]))), np.pad(net, ((0, 0), (0, both - net.shape[1])))
                c = np.concatenate([c, np.zeros((1, both))])[number]  # -1: the wide cell lies around the origin
                norm = np.sqrt((y * y).sum(1))
                with np.errstate(all="ignore"):
                    inner = y @ c.T
                    top = inner + norm[:, None] * radius[None]
                    top = top + 1e-9 * (1 + norm[:, None] * (radius + np.sqrt((c * c).sum(1)))[None])
                top = np.where(np.isnan(top), np.inf, top)
                way = home[:, None] % parts[None]
                best = np.argsort(np.where(enough, -inner, np.inf), axis=1, kind="stable")[:, : max(1, min(FIRST, int(enough.sum())))]
                if first:
                    row, at = np.repeat(np.arange(len(ids)), best.shape[1]), best.ravel()
                    part, least = way[row, at], np.full(len(row), -np.inf)
                else:
                    met = np.full(top.shape, -1)
                    np.put_along_axis(met, best, np.take_along_axis(way, best, 1), 1)
                    own = b.column("least").to_numpy(zero_copy_only=False)
                    row, at = np.nonzero(top >= own[:, None])
                    n = parts[at]
                    row, at = np.repeat(row, n), np.repeat(at, n)
                    part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    new = met[row, at] != part
                    row, at, part = row[new], at[new], part[new]
                    least = own[row]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(number[at].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.ones(len(row), bool)), pa.array(ids[row]), b.column("v").take(take), pa.array(least)], names=["cell", "part", "asks", "vec_id", "v", "least"])

    return run


PART = "cell int, part int, asks boolean, vec_id long, v array<double>, least double"


def _met(k: int, scale: int, batch: int):
    """The k best rows of queries within each part; rows come sorted by part, the part's rows before its queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def answers(rows: list, tree: Tree | None, asked: list):
        ids, q_ids, least = np.concatenate([r[0] for r in rows]), np.concatenate([a[0] for a in asked]), np.concatenate([a[2] for a in asked])
        both = [pa.concat_arrays([x[1] for x in side]) for side in (rows, asked)]
        width = max(int(np.diff(x.offsets.to_numpy()).max(initial=0)) for x in both)
        raw = [_matrix(x, width) for x in both]
        if tree is None or tree.x.shape[1] != width:
            tree = Tree(_scaled(raw[0], scale))
        asks = Tree(_scaled(raw[1], scale))
        exact = tree.norm.max(initial=0) * asks.norm.max(initial=0) >= float(1 << 52)
        whole = [np.array([[scaled(c, scale) for c in row] for row in m], object).reshape(m.shape) for m in (raw[1], raw[0])] if exact else None
        found = meet(asks, q_ids, tree, ids, k, least, whole)
        some = (found.score > -np.inf).astype(bool)
        scores = [int(s) for s in found.score[some]]
        return tree, pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, some.sum(1))), pa.array(found.ids[some]), pa.array(scores, pa.int64())], schema=schema)

    @common.tidy
    def run(batches):
        key, rows, tree, asked, held = None, [], None, [], 0
        for b in batches:
            names = list(zip(b.column("cell").to_pylist(), b.column("part").to_pylist(), b.column("asks").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                some, (cell, part, asks) = b.slice(i, j - i), names[i]
                if (cell, part) != key:
                    if asked and rows:
                        yield answers(rows, tree, asked)[1]
                    key, rows, tree, asked, held = (cell, part), [], None, [], 0
                ids, v = some.column("vec_id").to_numpy(zero_copy_only=False), some.column("v")
                if not asks:
                    rows.append((ids, v))
                    continue
                asked.append((ids, v, some.column("least").to_numpy(zero_copy_only=False)))
                held += len(ids)
                if held >= batch and rows:
                    tree, out = answers(rows, tree, asked)
                    yield out
                    asked, held = [], 0
        if asked and rows:
            yield answers(rows, tree, asked)[1]

    return run


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, row_block: int = 4096, query_block: int = 4096, sample: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best integer inner products.

    vectors(vec_id, embedding): components become floor(scale * x).  The
    queries are the rows whose vec_id is divisible by `every`.
    """
    spark = vectors.sparkSession
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    v = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    h = F.xxhash64("vec_id", "v")
    got = v.orderBy(h, "vec_id").limit(sample).select("v").toArrow()
    pilot = _scaled(_matrix(got["v"]), scale) if got.num_rows else np.zeros((0, 0))
    pilot = pilot[np.sqrt((pilot * pilot).sum(1)) < WIDE]
    n = v.count()
    net = pilot[farthest_first(pilot, min(CELLS, math.ceil(2 * n / row_block)))[0]] if len(pilot) else pilot[:0]
    rows = common.stored(v.mapInArrow(_assigned(net, scale), "vec_id long, v array<double>, cell int, norm double, apart double"), "rows")
    # at most CELLS + 1 rows
    cells = [(r["cell"], math.ceil(r["n"] / row_block), r["far"], r["n"]) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("far")).orderBy("cell").collect()]
    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    split = dict((c[:2]) for c in cells)
    parts = F.element_at(F.array(*[F.lit(split.get(i, 1)) for i in range(-1, len(net) + 1)]), F.col("cell") + 2)
    salt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(1 << 30))
    own = rows.select("cell", (salt % parts).cast("int").alias("part"), F.lit(False).alias("asks"), "vec_id", "v", F.lit(0.0).alias("least"))
    asks = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)).alias("part"))

    def met(aimed: DataFrame) -> DataFrame:
        both = own.unionByName(aimed).repartition("cell", "part").sortWithinPartitions("cell", "part", "asks")
        return common.stored(both.mapInArrow(_met(k, scale, query_block), "query_id long, vec_id long, score long"), "met")

    one = met(asks.mapInArrow(_aimed(cells, net, scale, True, k), PART))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    # the k-th best score so far of each query id, where a double holds it
    worst = one.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").cast("double").alias("s"))
    least = F.when(F.col("s").isNull(), float("-inf")).when(F.abs("s") < float(1 << 53), F.col("s")).otherwise(float("-inf"))
    asks = asks.join(worst, F.col("q") == F.col("vec_id"), "left").select("vec_id", "v", "part", least.alias("least"))
    two = met(asks.mapInArrow(_aimed(cells, net, scale, False, k), PART))
    return one.unionByName(two).select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
