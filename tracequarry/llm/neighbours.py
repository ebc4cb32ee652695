"""Most similar pictures for every picture (problem 6).

Similarity is ``0.7 * equal bits / 64 + 0.3 * sum of the smaller histogram values``, so 1 - similarity is
``0.7 * differing bits / 64 + 0.15 * |h1 - h2|`` for histograms that sum to 1.

Method: stable projections with a kd-tree and a chi-square stopping test. A vector (scaled bits, scaled square
roots of the histogram) has a squared Euclidean distance D not above 1 - similarity (the Hellinger bound).
A Gaussian projection to ``DIMS`` dimensions turns D into D times a chi-square variable. Neighbours are taken
in order of projected distance, leaf by leaf of a kd-tree, and verified with the true similarity; a query stops
when the next leaf is farther than ``quantile(CONFIDENCE) * bound``, where bound is the least of its k-th true
distance so far and 1 - ``least``: a closer neighbour would be that far with probability below 1 - CONFIDENCE.

Equal vectors are one class with its smallest ids; a class of any size costs as one vector.

Plan: classes are staged once; split planes come from a kd-tree of a bounded sample (``SAMPLE`` classes) and
only route, every class is indexed; a query class goes to the cells its stopping radius reaches, in blocks of
fixed size that are numbered within each cell, so memory of a task is fixed and a member is sent to as many tasks as its own
cell has query blocks; the best k+1 rows of each class are merged by a window with a group
limit before the shuffle.

Defined results: rows with a null, short, long or holed vector take no part; a histogram that does not sum to 1
is compared as it is (recall is then not guaranteed); ties go to the smaller id; ids must be unique; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.session import staged

BITS, BINS = 64, 24
BIT_WEIGHT, HIST_WEIGHT = 0.7, 0.3
DIMS = 24
CONFIDENCE = 0.99
SAMPLE = 20_000
CELL = 65_536
QUERIES = 65_536
LEAF = 256
#: Queries that are searched together.
GROUP = 256
#: Leaves verified between two stopping tests.
STEP = 128


def chi_square_quantile(p: float, k: int) -> float:
    """Wilson-Hilferty approximation."""
    a = 2 / (9 * k)
    return k * (1 - a + NormalDist().inv_cdf(p) * math.sqrt(a)) ** 3


def projection() -> np.ndarray:
    """The Gaussian matrix, the same everywhere."""
    return np.random.Generator(np.random.PCG64(20240607)).standard_normal((BITS + BINS, DIMS))


def project(bits: np.ndarray, hist: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Projected scaled vectors; squared distances are about DIMS * D."""
    ones = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64) * math.sqrt(BIT_WEIGHT / BITS)
    roots = np.sqrt(np.maximum(hist, 0)) * math.sqrt(HIST_WEIGHT / 2)
    return np.concatenate([ones, roots], axis=1) @ matrix


def differing(b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Number of differing bits (counted on unsigned values: numpy counts the bits of the absolute value else)."""
    return np.bitwise_count((b1 ^ b2).astype(np.int64).view(np.uint64)).astype(np.float64)


def similarity(b1: np.ndarray, h1: np.ndarray, b2: np.ndarray, h2: np.ndarray) -> np.ndarray:
    equal = BITS - differing(b1, b2)
    return np.round(BIT_WEIGHT * (equal / BITS) + HIST_WEIGHT * np.minimum(h1, h2).sum(axis=1), 9)


def sparse_nonzero(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a contiguous mask with few true values: eight of them are tested at once."""
    flat = mask.ravel()
    whole = flat.size // 8 * 8
    at = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (at[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])
    return np.divmod(at, mask.shape[1])


class KdTree:
    """Balanced kd-tree: points reordered by leaf, a bounding box per leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.bounds: list[tuple[int, int]] = []
        stack = [(0, len(points))]
        while stack:
            a, b = stack.pop()
            if b - a <= leaf:
                if b > a:
                    self.bounds.append((a, b))
                continue
            own = points[self.order[a:b]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
            stack += [(a, a + mid), (a + mid, b)]
        self.points = points[self.order]
        self.low = np.array([self.points[a:b].min(axis=0) for a, b in self.bounds]).reshape(-1, points.shape[1])
        self.high = np.array([self.points[a:b].max(axis=0) for a, b in self.bounds]).reshape(-1, points.shape[1])

    def box_distance(self, q: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Squared distance of each query to the boxes of some leaves."""
        low, high, q = self.low[leaves].astype(np.float32), self.high[leaves].astype(np.float32), q.astype(np.float32)
        out = np.zeros((len(q), leaves.size), np.float32)
        for d in range(q.shape[1]):
            gap = np.maximum(low[:, d] - q[:, d, None], q[:, d, None] - high[:, d])
            np.maximum(gap, 0, out=gap)
            gap *= gap
            out += gap
        return out


def search(q_bits, q_hist, bits, hist, ids: list[np.ndarray], k: int, least: float, confidence: float = CONFIDENCE):
    """For each query the best k+1 rows (similarity, id) among the members, similarity at least ``least``.

    Returns (query number, similarity, id) arrays. Members are classes with their smallest ids.
    """
    matrix = projection()
    tree = KdTree(project(bits, hist, matrix))
    bits, hist = bits[tree.order], hist[tree.order]
    sizes = np.fromiter((len(ids[i]) for i in tree.order), dtype=np.int64, count=len(tree.order))
    flat = np.concatenate([ids[i] for i in tree.order]) if len(ids) else np.zeros(0, np.int64)
    begin = np.cumsum(sizes) - sizes
    factor = chi_square_quantile(confidence, DIMS)
    # [q, 1] . [-2 m, |m|^2] = |q - m|^2 - |q|^2: one product gives the distances
    member = np.concatenate([-2 * tree.points, (tree.points**2).sum(axis=1)[:, None]], axis=1).astype(np.float32)
    points = project(q_bits, q_hist, matrix)
    groups = KdTree(points, GROUP)  # queries close to each other go together
    first_leaf = np.array([x for x, _ in tree.bounds])
    leaf_size = np.array([y - x for x, y in tree.bounds])
    worst = 1 - least + 1e-9
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    keep = k + 1
    for g, (a, b) in enumerate(groups.bounds):
        own = groups.order[a:b]
        # boxes of the leaves against the box of the group, then against the queries
        gap = np.maximum(np.maximum(tree.low - groups.high[g], groups.low[g] - tree.high), 0)
        near = np.flatnonzero((gap**2).sum(axis=1) <= factor * worst)
        if not near.size:
            continue
        p, qb, qh = points[own], q_bits[own], q_hist[own]
        bound = np.full(own.size, worst)
        best_s, best_i = np.full((own.size, keep), -1.0), np.full((own.size, keep), np.iinfo(np.int64).max)
        far = tree.box_distance(p, near)
        sequence = np.argsort(far.min(axis=0), kind="stable")
        q32 = np.concatenate([p, np.ones((own.size, 1))], axis=1).astype(np.float32)
        p2 = (p**2).sum(axis=1)
        for at in range(0, sequence.size, STEP):
            step = sequence[at : at + STEP]
            live = np.flatnonzero((far[:, step] <= (factor * bound)[:, None]).any(axis=1))
            if not live.size:
                if far[:, step[0]].min() > factor * bound.max():
                    break  # all leaves that follow are farther
                continue
            leaves = near[step]
            column = np.repeat(first_leaf[leaves], leaf_size[leaves]) + np.arange(leaf_size[leaves].sum()) - np.repeat(np.cumsum(leaf_size[leaves]) - leaf_size[leaves], leaf_size[leaves])
            limit = (factor * bound[live] - p2[live] + 1e-4).astype(np.float32)
            r, c = sparse_nonzero(q32[live] @ member[column].T <= limit[:, None])
            if not r.size:
                continue
            r, c = live[r], column[c]
            close = BIT_WEIGHT * differing(qb[r], bits[c]) / BITS <= worst
            r, c = r[close], c[close]
            s = similarity(qb[r], qh[r], bits[c], hist[c])
            ok = s >= least
            r, c, s = r[ok], c[ok], s[ok]
            if not r.size:
                continue
            of = np.repeat(np.arange(r.size), sizes[c])
            row_ids = flat[np.repeat(begin[c], sizes[c]) + np.arange(of.size) - np.repeat(np.cumsum(sizes[c]) - sizes[c], sizes[c])]
            r, s = r[of], s[of]
            touched = np.unique(r)
            all_r = np.concatenate([np.repeat(touched, keep), r])
            all_s, all_i = np.concatenate([best_s[touched].ravel(), s]), np.concatenate([best_i[touched].ravel(), row_ids])
            order = np.lexsort((all_i, -all_s, all_r))
            all_r, all_s, all_i = all_r[order], all_s[order], all_i[order]
            first = np.searchsorted(all_r, touched)
            take = first[:, None] + np.arange(keep)
            best_s[touched], best_i[touched] = all_s[take], all_i[take]
            bound[touched] = np.minimum(worst, np.where(best_s[touched, -1] < 0, worst, 1 - best_s[touched, -1] + 1e-9))
        n, j = np.nonzero(best_s >= least)
        out.append((own[n], best_s[n, j], best_i[n, j]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


class Cells:
    """Split planes of a sample; tells a point's cell and the cells a ball reaches."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.at = {}, {}
        parts = {1: sample}
        for node in range(1, 2**depth):
            own = parts.pop(node)
            axis = int(np.argmax(own.var(axis=0))) if len(own) else 0
            at = float(np.median(own[:, axis])) if len(own) else 0.0
            self.axis[node], self.at[node] = axis, at
            parts[2 * node], parts[2 * node + 1] = own[own[:, axis] < at], own[own[:, axis] >= at]

    def cell(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), dtype=np.int64)
        for _ in range(self.depth):
            axis = np.array([self.axis[n] for n in node], dtype=np.int64)
            at = np.array([self.at[n] for n in node])
            node = 2 * node + (p[np.arange(len(p)), axis] >= at)
        return node

    def reached(self, p: np.ndarray, radius2: float) -> tuple[np.ndarray, np.ndarray]:
        """(point number, cell) of every cell within the radius."""
        found = []
        stack = [(1, np.arange(len(p)), np.zeros((len(p), p.shape[1])))]
        while stack:
            node, own, gap = stack.pop()
            if not own.size:
                continue
            if node >= 2**self.depth:
                found.append((own, np.full(own.size, node)))
                continue
            axis, away = self.axis[node], p[own, self.axis[node]] - self.at[node]
            for side in (0, 1):
                g = gap.copy()
                across = np.where((away >= 0) == bool(side), 0.0, np.abs(away))
                g[:, axis] = np.maximum(g[:, axis], across)
                ok = (g**2).sum(axis=1) <= radius2
                stack.append((2 * node + side, own[ok], g[ok]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _hist(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f8").reshape(-1, BINS)


def packed_vectors(df: DataFrame, id_col: str, bits_col: str, hist_col: str) -> DataFrame:
    """(id, bits, hist) of the rows whose vectors are whole."""
    whole = (F.size(bits_col) == BITS) & (F.size(hist_col) == BINS) & ~F.exists(bits_col, lambda x: x.isNull()) & ~F.exists(hist_col, lambda x: x.isNull() | F.isnan(x.cast("double")))
    src = df.where(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(bits_col).cast("array<int>").alias("b"), F.col(hist_col).cast("array<double>").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            bits = np.packbits(np.asarray(batch.column(1).flatten()).reshape(n, BITS) != 0, axis=1).view(np.int64).ravel()
            hist = np.asarray(batch.column(2).flatten(), dtype="<f8").reshape(n, BINS) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits), pa.array([h.tobytes() for h in hist], type=pa.binary())], names=["id", "bits", "hist"])

    return src.mapInArrow(run, "id bigint, bits bigint, hist binary")


def nearest_rows(df: DataFrame, id_col: str, bits_col: str, hist_col: str, k: int = 5, least: float = 0.9) -> DataFrame:
    """(id, other, sim): the k most similar other rows of every row, as far as they reach ``least``."""
    spark = df.sparkSession
    rows = packed_vectors(df, id_col, bits_col, hist_col)
    small = Window.partitionBy("bits", "hist").orderBy("id")
    first = rows.withColumn("rn", F.row_number().over(small)).where(F.col("rn") <= k + 1)
    classes = staged(first.groupBy("bits", "hist").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    n = classes.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / CELL)))
    matrix = projection()
    sample = classes.select("bits", "hist").sample(fraction=min(1.0, 1.2 * SAMPLE / max(1, n)), seed=7).limit(SAMPLE).toPandas() if depth else pd.DataFrame({"bits": [], "hist": []})
    cells = Cells(project(sample["bits"].to_numpy(), _hist(sample["hist"]), matrix), depth) if len(sample) else Cells(np.zeros((0, DIMS)), 0)
    radius2 = chi_square_quantile(CONFIDENCE, DIMS) * (1 - least + 1e-9)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, hist = batch.column("bits").to_numpy(), np.frombuffer(b"".join(batch.column("hist").to_pylist()), dtype="<f8").reshape(-1, BINS)
            p = project(bits, hist, matrix)
            number, cell = cells.reached(p, radius2)
            order = np.argsort(number, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(p)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("bits"), batch.column("hist"), batch.column("ids"), pa.array(cells.cell(p).astype(np.int32)), lists], names=["bits", "hist", "ids", "cell", "to"])

    # a class is named by its first id: ids are unique
    routed = staged(classes.mapInArrow(route, "bits bigint, hist binary, ids array<bigint>, cell int, to array<int>").withColumn("c", F.col("ids")[0]))
    reach = {r["cell"]: r["n"] for r in routed.select(F.explode("to").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a cell
    blocks = {cell: math.ceil(m / QUERIES) for cell, m in reach.items()}
    of_cell = spark.createDataFrame(sorted(blocks.items()), "cell int, blocks int")
    members = routed.select("cell", F.col("bits").alias("bits"), F.col("hist").alias("hist"), F.col("ids").alias("ids")).join(of_cell, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "bits", "hist", "ids")
    queries = routed.select(F.explode("to").alias("cell"), "c", F.col("bits").alias("q_bits"), F.col("hist").alias("q_hist"))
    queries = queries.join(of_cell, "cell").select("cell", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int").alias("block"), "c", "q_bits", "q_hist")
    spread = 2 * max(1, sum(blocks.values()))

    def match(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(m):
            return pd.DataFrame({"c": np.zeros(0, np.int64), "sim": np.zeros(0), "other": np.zeros(0, np.int64)})
        number, sim, other = search(q["q_bits"].to_numpy(), _hist(q["q_hist"]), m["bits"].to_numpy(), _hist(m["hist"]), [np.asarray(x, dtype=np.int64) for x in m["ids"]], k, least)
        return pd.DataFrame({"c": q["c"].to_numpy()[number], "sim": sim, "other": other})

    keys = ["cell", "block"]
    found = queries.repartition(spread, *keys).groupBy(*keys).cogroup(members.repartition(spread, *keys).groupBy(*keys)).applyInPandas(match, "c bigint, sim double, other bigint")
    best = Window.partitionBy("c").orderBy(F.desc("sim"), "other")
    top = found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("rn", "other", "sim"))).alias("near"))
    # a class is met by its vector, all of it
    near = classes.select("bits", "hist", F.col("ids")[0].alias("c")).join(top, "c").select("bits", "hist", "near")
    own = rows.join(near, ["bits", "hist"]).select("id", F.explode(F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)).alias("x"))
    return own.select("id", "x.other", "x.sim")


def similar_pairs(df: DataFrame, id_col: str = "odoc_id", bits_col: str = "image_dhash", hist_col: str = "image_hist", k: int = 5, least: float = 0.9) -> DataFrame:
    """(id_a, id_b), smaller first: one row is among the k most similar of the other and they reach ``least``."""
    near = nearest_rows(df, id_col, bits_col, hist_col, k, least)
    return near.select(F.least("id", "other").alias(f"{id_col}_a"), F.greatest("id", "other").alias(f"{id_col}_b")).distinct()
