"""Exact similarity join of vectors over a partitioned metric space.

The largest Euclidean distance of a pair that can reach the least dot product is known. So:

1. Some rows, of bounded number, are pivots. A row's home is the cell of its nearest pivot.
2. A cell is cut to slices by distance to its pivot, at most ``SLICES``. A slice is a unit.
3. Every row meets those of its own unit. It visits another unit only if, by the triangle inequality,
   its distance to that unit's pivot leaves room for a partner, and if the plane half-way between the
   two pivots is near enough. Of two units the rows of one visit the other, never both.
4. A unit with more than a block of residents or visitors is dealt to parts by hash, and parts meet
   in pairs; so a group holds about two blocks, however many rows a cell has.
5. In a group rows are sorted by distance to the pivot, and blocks of them are multiplied with the
   window of rows that are near enough.

How often a row travels depends on how far the data fall into clusters; travel() measures it. Where
it would be more often than with blocks against blocks (some rows tell), all are one unit of few parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.storage import materialize

from .similarity import blocks_of, near_pairs

#: Most pivots, and slices of a cell: their product bounds the table of units that tasks hold.
MOST_PIVOTS, SLICES = 2048, 8
_SLACK = 1e-6  # rounding of distances
#: Rows, those with the smallest hashes, that tell how often rows will travel; any way gives all pairs.
TRIED = 2000


def unit_vectors(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id, v`` with rows of length 1; without null vectors and those of length 0, which are like nothing."""
    picked = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    return picked.withColumn("norm", norm).filter("norm > 0").select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


class _Space:
    """Pivots and units: unit ``cell * SLICES + slice``, with the range of distances of its residents."""

    def __init__(self, pivots: np.ndarray, radius: float):
        self.pivots, self.radius = pivots, radius + _SLACK
        self.between = np.maximum(_distances(pivots, pivots), 1e-6)
        self.cuts = np.full((len(pivots), SLICES - 1), np.inf)
        self.low = np.full((len(pivots), SLICES), np.inf)
        self.high = np.full((len(pivots), SLICES), -np.inf)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = _distances(x, self.pivots)
        cell = d.argmin(1)
        return d, cell, d[np.arange(len(x)), cell]

    def units(self, cell: np.ndarray, own: np.ndarray) -> np.ndarray:
        return cell * SLICES + (own[:, None] > self.cuts[cell]).sum(1)

    def visits(self, d: np.ndarray, cell: np.ndarray, own: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, unit) of all visits."""
        plane = (d * d - (own * own)[:, None]) / (2 * self.between[cell]) <= self.radius
        plane[np.arange(len(d)), cell] = True
        row, other = np.nonzero(plane)
        far = d[row, other][:, None]
        near = (far >= self.low[other] - self.radius) & (far <= self.high[other] + self.radius)
        k, s = np.nonzero(near)
        row, target = row[k], other[k] * SLICES + s
        first = unit[row] < target  # of two units, the one with the lower number visits if their sum is even
        goes = (unit[row] != target) & (first == ((unit[row] + target) % 2 == 0))
        return row[goes], target[goes]


def _placed(rows: DataFrame, radius: float, block: int) -> tuple[DataFrame, _Space, int] | None:
    """(``id, v, unit, own, visits`` and what else ``rows`` has, the space, rows of a part); rows are written once for it."""
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return None
    many = min(MOST_PIVOTS, max(1, -(-n // block)))
    chosen = np.array([r.v for r in rows.select("v").orderBy(F.xxhash64("v"), F.xxhash64("id")).limit(max(many, TRIED)).collect()], np.float64)
    space = _Space(np.unique(chosen[:many], axis=0), radius)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, cell, own = space.home(_matrix(b.column("v"), b.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(own)], names=["cell", "own"])

    shares = [(s + 1) / SLICES for s in range(SLICES - 1)]
    stats = rows.mapInArrow(homes, "cell int, own double").groupBy("cell").agg(F.percentile_approx("own", shares, 1000).alias("cuts"), F.count(F.lit(1)).alias("n"))
    for r in stats.collect():  # a row for each pivot
        if r.n > block:
            space.cuts[r.cell] = r.cuts
    ranges = rows.mapInArrow(_with_units(space, False), f"{_ddl(rows)}, unit int, own double").groupBy("unit").agg(F.min("own").alias("low"), F.max("own").alias("high"))
    for r in ranges.collect():
        space.low[r.unit // SLICES, r.unit % SLICES], space.high[r.unit // SLICES, r.unit % SLICES] = r.low, r.high
    d, cell, own = space.home(chosen)
    blocks = blocks_of(n, width, block)
    if len(space.visits(d, cell, own, space.units(cell, own))[0]) / len(chosen) + 1 > blocks:
        space, block = _Space(space.pivots[:1], radius), -(-n // blocks)
    return materialize(rows.mapInArrow(_with_units(space, True), f"{_ddl(rows)}, unit int, own double, visits array<int>"), "placed"), space, block


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in rows.dtypes)


def _with_units(space: _Space, visits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                d, cell, own = space.home(_matrix(part.column("v"), part.num_rows))
                unit = space.units(cell, own)
                cols, names = [*part.columns, pa.array(unit, pa.int32()), pa.array(own)], [*part.schema.names, "unit", "own"]
                if visits:
                    row, target = space.visits(d, cell, own, unit)
                    ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                    cols, names = [*cols, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(target, pa.int32()))], [*names, "visits"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _dealt(placed: DataFrame, space: _Space, block: int) -> DataFrame:
    """``unit, p, q, left, right, near`` and the row, once for each group that it goes to.

    Residents have parts 0 to m-1 of a unit, visitors the numbers from m on; group (unit, p, q) joins
    the rows of part p, on its left, with the residents of part q <= p, on its right.
    """
    m, mv = np.zeros(space.low.size, np.int64), np.zeros(space.low.size, np.int64)
    for r in placed.groupBy("unit").count().collect():
        m[r.unit] = -(-r["count"] // block)
    for r in placed.select(F.explode("visits").alias("unit")).groupBy("unit").count().collect():
        mv[r.unit] = -(-r["count"] // block)
    keep = [c for c in placed.columns if c not in ("unit", "own", "visits", "part")]
    kinds = dict(placed.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                if not part.num_rows:
                    continue
                x = _matrix(part.column("v"), part.num_rows)
                own, hashed = part.column("own").to_numpy(), part.column("part").to_numpy()
                out = []  # row, unit, p, q, left, right, near
                for i, (unit, goes) in enumerate(zip(part.column("unit").to_pylist(), part.column("visits").to_pylist())):
                    mine = int(hashed[i] % m[unit])
                    out += [(i, unit, mine, q, True, q == mine, own[i]) for q in range(mine + 1)]
                    out += [(i, unit, p, mine, False, True, own[i]) for p in range(mine + 1, m[unit] + mv[unit])]
                    if goes:
                        near = _distances(x[i : i + 1], space.pivots[np.array(goes) // SLICES])[0]
                        for u, d in zip(goes, near.tolist()):
                            out += [(i, u, int(m[u] + hashed[i] % mv[u]), q, True, False, d) for q in range(m[u])]
                row, *cols = zip(*out)
                kind = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.float64()]
                moved = [part.column(c).take(pa.array(row)) for c in keep]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kind)), *moved], names=["unit", "p", "q", "left", "right", "near", *keep])

    hashed = placed.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 40)))
    return hashed.mapInArrow(run, "unit int, p int, q int, left boolean, right boolean, near double, " + ", ".join(f"{c} {kinds[c]}" for c in keep))


def _meetings(t: pa.Table, radius: float, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, rows, dot products) of the pairs that reach ``least``: blocks of the left by windows of the right.

    With ``same`` left and right are the same rows, and of two of them the pair counts once.
    """
    x, near = _matrix(t["v"], t.num_rows), t["near"].to_numpy()
    left, right = (np.flatnonzero(t[c].to_numpy(zero_copy_only=False)) for c in ("left", "right"))
    left, right = left[np.argsort(near[left], kind="stable")], right[np.argsort(near[right], kind="stable")]
    for s in range(0, len(left), 256):
        a = left[s : s + 256]
        low = s if same else np.searchsorted(near[right], near[a[0]] - radius, "left")
        high = np.searchsorted(near[right], near[a[-1]] + radius, "right")
        for w in range(low, high, 4096):
            b = right[w : min(w + 4096, high)]
            i, j, dot = near_pairs(x[a], x[b], least)
            if same:
                once = s + i < w + j
                i, j, dot = i[once], j[once], dot[once]
            if len(i):
                yield a[i], b[j], dot


def similar_pairs(vectors: DataFrame, id_col: str, vector: str, least: float, block: int = 2048) -> DataFrame:
    """``a, b, cosine`` with a < b for all pairs whose cosine reaches ``least``, which must be above 0.

    The pairs of similarity.cosine_edges(), without every block meeting every block. Vectors are of
    one size; null ones and those of length 0 are in no pair. Repeated ids give a pair once, and none
    with themselves. Without rows the result is empty.
    """
    if not 0 < least <= 1:
        raise ValueError("the least cosine must be above 0 and at most 1")
    rows, kind = unit_vectors(vectors, id_col, vector), dict(vectors.dtypes)[id_col]
    radius = float(np.sqrt(2 - 2 * least))
    placed = _placed(rows, radius, block)
    if placed is None:
        return vectors.sparkSession.createDataFrame([], f"a {kind}, b {kind}, cosine double")

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        ids = t["id"].combine_chunks()
        for a, b, dot in _meetings(t, radius + 2 * _SLACK, key[1] == key[2], least):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(dot)], names=["a", "b", "cosine"])

    found = _dealt(*placed).groupBy("unit", "p", "q").applyInArrow(join, f"a {kind}, b {kind}, cosine double").filter("a != b")
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")
    # Two rows meet once, so only repeated ids give a pair again.
    return found.dropDuplicates(["a", "b"]) if placed[0].groupBy("id").count().filter("count > 1").head(1) else found


def nearest(rows: DataFrame, least: float, block: int = 2048) -> DataFrame:
    """``id, best, dot``: of the rows (``id, v`` and a number ``g``) each one's partner with the largest dot product.

    Vectors have at most length 1. Partners are of the same ``g`` and have a dot product of ``least``
    or more, above 0; a row without one is left out. Of equally good pairs that with the smaller ids
    counts, so the best pair of all is each other's. A group gives a row an id at most.
    """
    kind, radius = dict(rows.dtypes)["id"], float(np.sqrt(2 - 2 * least))
    schema = f"id {kind}, best {kind}, dot double"
    placed = _placed(rows, radius, block)
    if placed is None:
        return rows.sparkSession.createDataFrame([], schema)

    def join(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(np.argsort(np.array(t["id"].to_pylist())))  # ids as numbers
        g, ids, n = t["g"].to_numpy(), t["id"], t.num_rows
        best, partner = np.full(n, -np.inf), np.full(n, -1)
        for a, b, dot in _meetings(t, radius + 2 * _SLACK, key[1] == key[2], least):
            own = g[a] == g[b]
            a, b, dot = a[own], b[own], dot[own]
            to, other, dot = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([dot, dot])
            rank = np.lexsort((order[other], -dot, to))
            first = rank[np.flatnonzero(np.diff(to[rank], prepend=-1))]  # each row's best of these
            to, other, dot = to[first], other[first], dot[first]
            better = (dot > best[to]) | ((dot == best[to]) & (order[other] < order[partner[to]]))
            best[to[better]], partner[to[better]] = dot[better], other[better]
        has = np.flatnonzero(partner >= 0)
        return pa.table({"id": ids.take(pa.array(has)), "best": ids.take(pa.array(partner[has])), "dot": pa.array(best[has])})

    found = _dealt(*placed).groupBy("unit", "p", "q").applyInArrow(join, schema)
    # The smaller partner of equally good ones: pairs (least, greatest) then compare like partners do.
    return found.groupBy("id").agg(F.max("dot").alias("dot"), F.min_by("best", F.struct(-F.col("dot"), F.col("best"))).alias("best")).select("id", "best", "dot")


def travel(vectors: DataFrame, id_col: str, vector: str, least: float, block: int = 2048) -> float:
    """How many times a row travels in similar_pairs(), on average; the blocked join sends it once for each block."""
    rows = unit_vectors(vectors, id_col, vector)
    placed = _placed(rows, float(np.sqrt(2 - 2 * least)), block)
    return 0.0 if placed is None else _dealt(*placed).count() / rows.count()
