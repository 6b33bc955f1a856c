"""All pairs of embeddings with a cosine of 0.95 or more, by PCA-ordered tiles.

Unit vectors are turned to their principal axes, so the leading dimensions hold most of a product. Tiles are the cells
of a k-d partition of the leading dimensions; two tiles whose boxes or balls are too far apart are skipped, and two
that lie wholly within reach of each other are linked at once, row by row, without a product. In between, a tile pair
takes the product of the leading dimensions, with the rest bounded by the product of the suffix norms (one more
column), and goes on with more dimensions only for the pairs whose bound still reaches the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, map_batches, stash, table
from .vectors import packed, rows, unpacked, usable

LEAD, NEXT = 16, 32
TILE = 4096
CHUNK = 512


def principal_axes(vectors: DataFrame) -> np.ndarray:
    """Columns are axes, the widest first; from the second moments of all unit vectors, summed where the rows are."""

    def moments(batch):
        x = unit(rows(batch.column("embedding")))
        return {"m": [(x.T @ x).ravel()]}

    m = map_batches(vectors.select("embedding"), moments, "m array<double>")
    sums = m.select(F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()  # dimensions squared
    side = int(np.sqrt(len(sums)))
    return np.linalg.eigh(np.array([r["s"] for r in sums]).reshape(side, side))[1][:, ::-1]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Cells:
    """A k-d partition: at each inner node the widest dimension is cut at its median."""

    nodes: list[tuple[int, float, int, int]]  # dimension, cut, children; a negative child is a leaf

    @classmethod
    def fit(cls, x: np.ndarray, leaves: int) -> Cells:
        nodes: list = []
        count = 0

        def grow(part: np.ndarray, want: int) -> int:
            nonlocal count
            if want > 1 and len(part) > 1:
                j = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                cut = float(np.median(part[:, j]))
                low = part[:, j] < cut
                if low.any() and not low.all():
                    at = len(nodes)
                    nodes.append(None)
                    nodes[at] = (j, cut, grow(part[low], want // 2), grow(part[~low], want - want // 2))
                    return at
            count += 1
            return -count

        grow(x, leaves)
        return cls(nodes)

    def place(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), int)
        open_ = [(0, np.arange(len(x)))] if self.nodes else []
        while open_:
            node, at = open_.pop()
            j, cut, below, above = self.nodes[node]
            low = x[at, j] < cut
            for child, part in ((below, at[low]), (above, at[~low])):
                if child < 0:
                    out[part] = -1 - child
                else:
                    open_.append((child, part))
        return out


def star(i: np.ndarray, j: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For links i-j between n and m things: a label for each, equal for things that the links join."""
    a, b = np.arange(n), np.full(m, n + m)
    while True:
        before = a.copy(), b.copy()
        np.minimum.at(b, j, a[i])
        np.minimum.at(a, i, b[j])
        if (a == before[0]).all() and (b == before[1]).all():
            return a, b


def compare(own: np.ndarray, other: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Links of each row of two tiles with the other tile, and stars (of own rows, of other rows) that join what is linked."""
    ua, ub = unit(own), unit(other)
    a, b = ua @ axes, ub @ axes
    rest = lambda x, k: np.sqrt(np.maximum((x[:, k:] ** 2).sum(axis=1), 0))
    bound = lambda x: np.hstack([x[:, :LEAD], rest(x, LEAD)[:, None]]).astype("f4")
    a1, b1, ra, rb = bound(a), bound(b), rest(a, NEXT), rest(b, NEXT)
    of_a, of_b, joins = np.zeros(len(a), int), np.zeros(len(b), int), []
    for at in range(0, len(a), CHUNK):
        i, j = np.nonzero(a1[at : at + CHUNK] @ b1.T >= threshold - 1e-4)
        if same:
            keep = i + at < j
            i, j = i[keep], j[keep]
        if len(i) > 0.02 * CHUNK * len(b):  # dense: whole products cost less than picking rows
            value = (ua[at : at + CHUNK] @ ub.T)[i, j]
        elif len(i):
            lead = np.einsum("ij,ij->i", a[at + i, :NEXT], b[j, :NEXT])
            keep = lead + ra[at + i] * rb[j] >= threshold - 1e-9
            i, j, lead = i[keep], j[keep], lead[keep]
            value = lead + np.einsum("ij,ij->i", a[at + i, NEXT:], b[j, NEXT:])
        else:
            continue
        edge = np.flatnonzero(np.abs(value - threshold) < 1e-9)  # by the measure itself on the original vectors
        if len(edge):
            x, y = own[at + i[edge]], other[j[edge]]
            value[edge] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
        i, j = i[value >= threshold], j[value >= threshold]
        if not len(i):
            continue
        of_a[at : at + CHUNK] += np.bincount(i, minlength=CHUNK)[: len(of_a[at : at + CHUNK])]
        of_b += np.bincount(j, minlength=len(b))
        la, lb = star(i, j, CHUNK, len(b))
        linked = np.flatnonzero(np.bincount(j, minlength=len(b)))
        joins.append((at + lb[linked], linked))
        rows_ = np.unique(i)
        joins.append((at + rows_, -1 - (at + la[rows_])))  # of own rows among themselves
    return of_a, of_b, joins


def links(vectors: DataFrame, threshold: float = 0.95, sample: int = 20_000, most_tiles: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding).

    n_links counts the other vectors with a cosine of ``threshold`` or more; component_id is the smallest vec_id that
    links reach, itself included; kept is vec_id = component_id. Vectors that are null, zero, of another length than
    most, or hold null or non-finite components link with nothing. A vec_id that several rows share counts as one
    vector, the smallest in order; a row without vec_id has 0 links, no component, and is kept. ``sample`` bounds the
    vectors (by a hash of vec_id) that the partition is fitted on; where there are more than TILE rows a cell, cells
    are dealt in blocks. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    good = stash(usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    n = good.count()
    everyone = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    if n:
        counts, edges = linked(spark, good, n, threshold, sample, most_tiles)
        joined = components(edges)
    else:
        counts, joined = (spark.createDataFrame([], s) for s in ("vec_id long, n_links long", "id long, component_id long"))
    out = everyone.join(counts, "vec_id", "left").join(joined.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def linked(spark: SparkSession, good: DataFrame, n: int, threshold: float, sample: int, most_tiles: int) -> tuple[DataFrame, DataFrame]:
    axes = principal_axes(good)
    picked = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    lead = min(8, axes.shape[0])
    cells = Cells.fit(unit(np.array([r["embedding"] for r in picked])) @ axes[:, :lead], min(most_tiles, -(-n // TILE) * 2))

    def place(batch):
        x = rows(batch.column("embedding"))
        return {"cell": cells.place(unit(x) @ axes[:, :lead]), "vec_id": batch.column("vec_id"), "x": packed(x)}

    placed = stash(map_batches(good, place, "cell int, vec_id long, x binary"))

    def extent(batch):  # sums, extremes and the least id of each cell in a batch
        cell, ids, x = batch.column("cell").to_numpy(), batch.column("vec_id").to_numpy(), unit(unpacked(batch.column("x").to_pylist())) @ axes
        made = [(int(c), int((cell == c).sum()), int(ids[cell == c].min()), x[cell == c].sum(axis=0).tolist(), x[cell == c].min(axis=0).tolist(), x[cell == c].max(axis=0).tolist()) for c in np.unique(cell)]
        return dict(zip(("cell", "n", "first", "total", "low", "high"), zip(*made, strict=True), strict=True))

    parts = map_batches(placed, extent, "cell int, n long, first long, total array<double>, low array<double>, high array<double>")
    each = parts.select("cell", "n", "first", F.posexplode(F.arrays_zip("total", "low", "high")))
    by_axis = each.groupBy("cell", "pos").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("col.total").alias("total"), F.min("col.low").alias("low"), F.max("col.high").alias("high"))
    stats = by_axis.groupBy("cell").agg(F.min("n").alias("n"), F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "total", "low", "high"))).alias("axes")).orderBy("cell").collect()  # one row for each cell
    number = [s["cell"] for s in stats]
    size, first = {s["cell"]: s["n"] for s in stats}, {s["cell"]: s["first"] for s in stats}
    get = lambda name: np.array([[a[name] for a in s["axes"]] for s in stats])
    centre, low, high = get("total") / np.array([s["n"] for s in stats])[:, None], get("low"), get("high")
    where = {c: k for k, c in enumerate(number)}

    def radius(batch):
        cell = batch.column("cell").to_numpy()
        d = np.sqrt((((unit(unpacked(batch.column("x").to_pylist())) @ axes) - centre[[where[c] for c in cell]]) ** 2).sum(axis=1))
        return {"cell": np.unique(cell), "r": [d[cell == c].max() for c in np.unique(cell)]}

    ball = {r["cell"]: r["r"] for r in map_batches(placed, radius, "cell int, r double").groupBy("cell").agg(F.max("r").alias("r")).collect()}
    r = np.array([ball[c] for c in number])
    reach = np.sqrt(2 * (1 - threshold))  # unit vectors at the threshold are so far apart
    whole, pairs = [], []
    for k, c in enumerate(number):
        gap = np.sqrt((np.maximum(0, np.maximum(low[k:] - high[k], low[k] - high[k:])) ** 2).sum(axis=1))
        apart = np.sqrt(((centre[k:] - centre[k]) ** 2).sum(axis=1))
        near = (gap <= reach + 1e-6) & (apart - r[k:] - r[k] <= reach + 1e-6)
        inside = apart + r[k:] + r[k] <= reach - 1e-6
        whole += [(c, number[k + j]) for j in np.flatnonzero(inside)]
        pairs += [(c, number[k + j]) for j in np.flatnonzero(near & ~inside)]
    blocks = {c: -(-size[c] // TILE) for c in number}
    # cells that lie within reach of each other: every row links with every row
    bulk, star_to = {}, {}
    for c, d in whole:
        bulk[c] = bulk.get(c, 0) + size[d] - (c == d)
        star_to.setdefault(c, []).append(first[d])
        if c != d:
            bulk[d] = bulk.get(d, 0) + size[c]
            star_to.setdefault(d, []).append(first[c])
    tasks: dict[tuple[int, int], list[tuple[int, bool]]] = {}
    made = 0
    for c, d in pairs:
        for p in range(blocks[c]):
            for q in range(p if c == d else 0, blocks[d]):
                tasks.setdefault((c, p), []).append((made, False))
                tasks.setdefault((d, q), []).append((made, True))
                made += 1

    def deal(batch):
        out = []
        for k, (c, i) in enumerate(zip(batch.column("cell").to_pylist(), batch.column("vec_id").to_pylist(), strict=True)):
            out += [(task, second, k) for task, second in tasks.get((c, i * 2654435761 % 2**31 % blocks[c]), [])]
        task, second, at = zip(*out, strict=True) if out else ((), (), ())
        at = np.array(at, "int32")
        import pyarrow as pa

        return {"task": task, "second": second, "vec_id": batch.column("vec_id").take(pa.array(at)), "x": batch.column("x").take(pa.array(at))}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        one, two = part[~part["second"]].sort_values("vec_id"), part[part["second"]].sort_values("vec_id")
        out = [np.zeros((0, 3), "int64")]
        if len(one) and len(two):
            ia, ib = one["vec_id"].to_numpy(), two["vec_id"].to_numpy()
            same = len(ia) == len(ib) and (ia == ib).all()
            na, nb, joins = compare(unpacked(one["x"]), unpacked(two["x"]), axes, threshold, same)
            none = lambda x: np.full(len(x), -1, "int64")
            for ids, counts in ((ia, na), (ib, nb)):
                has = counts > 0
                out.append(np.stack([ids[has], counts[has], none(ids[has])], axis=1))
            for left, right in joins:
                other = np.where(right >= 0, ib[np.maximum(right, 0)], ia[np.maximum(-1 - right, 0)])
                edge = np.unique(np.stack([ia[left], none(left), other], axis=1), axis=0)
                out.append(edge[edge[:, 0] != edge[:, 2]])
        return pd.DataFrame(np.concatenate(out), columns=["vec_id", "n", "other"])

    def at_once(batch):
        cell, ids = batch.column("cell").to_pylist(), batch.column("vec_id").to_pylist()
        counts = [(i, bulk[c], -1) for c, i in zip(cell, ids, strict=True) if bulk.get(c)]
        edges = [(i, -1, o) for c, i in zip(cell, ids, strict=True) for o in star_to.get(c, []) if o != i]
        vec_id, n_, other = zip(*(counts + edges), strict=True) if counts or edges else ((), (), ())
        return {"vec_id": vec_id, "n": n_, "other": other}

    schema = "vec_id long, n long, other long"
    dealt = map_batches(placed, deal, "task int, second boolean, vec_id long, x binary")
    found = stash(dealt.groupBy("task").applyInPandas(run, schema).unionByName(map_batches(placed, at_once, schema)))
    counts = found.where("n > 0").groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    return counts, found.where("n < 0").select(F.col("vec_id").alias("a"), F.col("other").alias("b"))


def op9_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"))
