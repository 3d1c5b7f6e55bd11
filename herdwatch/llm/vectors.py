"""Embedding near-duplicates with an inverted multi-index.

Vectors are scaled to length one and cut in halves; each half has its own codebook (k-means on a bounded sample), and
the pairs of nearest centroids form a grid of k x k cells per label. A vector is stored in its own cell, and its
query visits cells by multi-sequence traversal: both halves' centroids are sorted by how far the vector is from
their Voronoi cell, and a heap walks the two lists in the order of the sum. Cosine >= c means a distance of at
most sqrt(2 - 2c), and no vector that near lies in a cell whose bound is larger: with a target recall of 1 the
walk stops there, and nothing is missed. A lower target stops at the bound that holds this share of the links
among the sample. Visited cells compare vectors in blocks, in double precision.

Only vectors of equal length have a cosine: each length has codebooks and cells of its own. A length of which no
label has more than a cell's worth of vectors is one cell per label.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import components, in_blocks

COSINE = 0.98
# The index is fitted on this many rows at most; a cell should hold about this many.
SAMPLE, PER_CELL, MOST_CENTROIDS = 20_000, 64, 256
BLOCK = 2048


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; the largest component is made one first, so that no square over- or underflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids, started from evenly spaced points of a random order."""
    rng = np.random.default_rng(7)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
        for j in range(len(centres)):
            if (near == j).any():
                centres[j] = points[near == j].mean(axis=0)
    return np.unique(centres, axis=0)


def bounds(half: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and the squared distance to every centroid's Voronoi cell from below."""
    d2 = np.maximum((half**2).sum(1)[:, None] - 2 * half @ centres.T + (centres**2).sum(1), 0)
    own = d2.argmin(axis=1)
    apart = np.sqrt(np.maximum((centres**2).sum(1)[:, None] - 2 * centres @ centres.T + (centres**2).sum(1), 0))
    gap = d2 - d2[np.arange(len(half)), own][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.where(gap > 0, gap / (2 * apart[own]), 0.0)
    return own, h * h


def traverse(first: np.ndarray, second: np.ndarray, stop: float):
    """Cells (i, j) in the order of first[i] + second[j], up to ``stop``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, n, m = [(first[a[0]] + second[b[0]], 0, 0)], len(a), len(b)
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > stop:
            return
        yield int(a[i]), int(b[j])
        # Each place of the grid is reached once: along a row, and down the first column.
        if j + 1 < m:
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < n:
            heapq.heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))


def fit(sample: np.ndarray, k: int, cosine: float, target_recall: float):
    """(codebooks, squared radius of the traversal) from sample vectors of length one."""
    half = sample.shape[1] // 2
    books = [codebook(sample[:, :half], k), codebook(sample[:, half:], k)]
    exact = 2 - 2 * cosine + 1e-9
    if target_recall >= 1:
        return books, exact
    cells = [bounds(part, book) for part, book in zip((sample[:, :half], sample[:, half:]), books, strict=True)]
    need = []
    for start in range(0, len(sample), BLOCK):
        x, y = np.nonzero(sample[start : start + BLOCK] @ sample.T >= cosine)
        x = x + start
        need.append((cells[0][1][x, cells[0][0][y]] + cells[1][1][x, cells[1][0][y]])[x != y])
    need = np.concatenate(need)
    return books, float(min(exact, np.quantile(need, target_recall))) if len(need) else exact


def block_links(ids: np.ndarray, role: np.ndarray, blk: np.ndarray, vectors: np.ndarray, same: bool, cosine: float):
    """(id, links, root) of the vectors of a block with a link; root is the least id reached inside the block.

    Stored vectors (role 0) meet each other, visitors (role 1) meet stored ones.
    """
    home, guest = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    rows = np.concatenate([home, guest])
    linked = unit(vectors[rows]) @ unit(vectors[home]).T >= cosine
    linked &= ids[rows][:, None] != ids[home][None, :]
    if not same:
        linked &= blk[rows][:, None] != blk[home][None, :]
    full = np.zeros((len(rows), len(rows)), bool)
    full[:, : len(home)] = linked
    full |= full.T
    count = full.sum(axis=1)
    names, root = ids[rows], np.full(len(rows), -1)
    for at in np.argsort(names, kind="stable"):
        if root[at] >= 0 or not count[at]:
            continue
        seen = frontier = full[at].copy()
        seen[at] = True
        while frontier.any():
            frontier = full[frontier].any(axis=0) & ~seen
            seen = seen | frontier
        root[seen] = at
    has = count > 0
    return names[has], count[has], names[root[has]]


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, target_recall: float = 1.0, sample: int = SAMPLE,
) -> DataFrame:
    """Rows (id_col, n_links, component_id, kept), one per row of the input.

    Vectors link if their labels are equal and not null and their cosine is at least ``cosine``. Vectors that
    are null, empty, zero, or hold null or non-finite components link with nothing, as do rows without label
    or id (component_id is then the id); vectors of different lengths don't link with each other. Rows that share an id count as
    one vector, the least (label, vector) of them. An empty table gives no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where("id is not null and label is not null and v is not null").where(finite).where(F.exists("v", lambda x: x != 0))
    index = good.groupBy("id").agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v")

    per_label = good.groupBy(F.size("v").alias("dim"), "label").count()
    sizes = per_label.groupBy("dim").agg(F.max("count").alias("largest"), F.sum("count").alias("n")).where("largest > 1").collect()
    links = None
    if sizes:
        books = fit_lengths(good, {r["dim"]: (r["largest"], r["n"]) for r in sizes}, sample, cosine, target_recall)
        placed = materialize(placements(index, books))
        links = materialize(compare(placed, cosine))
    else:
        links = spark.createDataFrame([], "id long, links long, root long")
    roots = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("id").agg(F.sum("links").alias("n_links"))
    known = counts.join(roots, "id", "left").select(F.col("id").alias("_id"), "n_links", "root")
    out = rows.select("id").join(known, F.col("id") == F.col("_id"), "left")
    component = F.coalesce("root", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def fit_lengths(good: DataFrame, sizes: dict[int, tuple[int, int]], sample: int, cosine: float, target_recall: float) -> dict:
    """What ``fit`` gives, by length, for those with more than a cell's worth of vectors in a label.

    ``sizes`` has by length the largest label's number of vectors and that of all. About ``sample`` vectors of all
    lengths are drawn by hash of the id, but at least about four per centroid.
    """
    ks = {dim: int(np.clip(np.ceil(np.sqrt(largest / PER_CELL)), 1, MOST_CENTROIDS)) for dim, (largest, _) in sizes.items()}
    ks = {dim: k for dim, k in ks.items() if k > 1 and dim > 1}
    if not ks:
        return {}
    share = sample / sum(sizes[dim][1] for dim in ks)
    rates = good.sparkSession.createDataFrame(
        [(dim, float(max(share, 4 * k / sizes[dim][1]))) for dim, k in ks.items()], "dim int, rate double"
    )
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)
    drawn = good.withColumn("dim", F.size("v")).join(F.broadcast(rates), "dim").where(u < F.col("rate"))
    # One vector per id, in a fixed order.
    drawn = drawn.groupBy("dim", "id").agg(F.min("v").alias("v")).toArrow()
    dims, ids = (drawn.column(c).to_numpy() for c in ("dim", "id"))
    vectors = drawn.column("v")
    out = {}
    for dim, k in ks.items():
        at = np.flatnonzero(dims == dim)
        at = at[np.argsort(ids[at])]
        if len(at):
            points = vectors.take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            out[dim] = fit(unit(points.astype(np.float64).reshape(len(at), dim)), k, cosine, target_recall)
    return out


def placements(index: DataFrame, books: dict) -> DataFrame:
    """Rows (label, dim, cell, id, role, v): role 0 in the own cell, role 1 in visited cells of a higher number.

    If two vectors of different cells link, each visits the other's cell; the higher cell's row is enough. A length
    without codebooks is one cell.
    """

    def place(batches):
        for batch in batches:
            lengths = np.diff(batch.column("v").offsets.to_numpy())
            for dim in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                row, cell, role = cells_of(part.column("v"), int(dim))
                taken = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("label").take(taken), pa.array(np.full(len(row), dim), pa.int32()), pa.array(cell, pa.int64()),
                        part.column("id").take(taken), pa.array(role, pa.int32()), part.column("v").take(taken),
                    ],
                    names=["label", "dim", "cell", "id", "role", "v"],
                )

    def cells_of(v, dim: int) -> tuple[list[int], list[int], list[int]]:
        if dim not in books:
            return list(range(len(v))), [0] * len(v), [0] * len(v)
        (first, second), stop = books[dim]
        half, width = first.shape[1], len(second)
        u = unit(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), dim))
        own1, h1 = bounds(u[:, :half], first)
        own2, h2 = bounds(u[:, half:], second)
        row, cell, role = [], [], []
        for i in range(len(u)):
            own = int(own1[i]) * width + int(own2[i])
            row.append(i), cell.append(own), role.append(0)
            for a, b in traverse(h1[i], h2[i], stop):
                if a * width + b > own:
                    row.append(i), cell.append(a * width + b), role.append(1)
        return row, cell, role

    return index.mapInArrow(place, f"label string, dim int, cell long, id long, role int, v {dict(index.dtypes)['v']}")


def compare(placed: DataFrame, cosine: float) -> DataFrame:
    """Rows (id, links, root) per block of a cell."""
    crowd = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.min("role").alias("least"))
    busy = placed.join(crowd.where("n > 1 and least = 0").select("label", "dim", "cell"), ["label", "dim", "cell"])
    blocks = in_blocks(busy, ["label", "dim", "cell"], "id", BLOCK)

    def link(key, table):
        table = table.combine_chunks()
        v = table.column("v").combine_chunks()
        v = (v.chunk(0) if isinstance(v, pa.ChunkedArray) else v).flatten().to_numpy(zero_copy_only=False)
        cols = [table.column(c).to_numpy() for c in ("id", "role", "blk")]
        found = block_links(*cols, v.astype(np.float64).reshape(table.num_rows, -1), key[0].as_py() == key[1].as_py(), cosine)
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["id", "links", "root"])

    # A block in one task; the number of blocks follows the data.
    return blocks.groupBy("lo", "hi", "label", "dim", "cell").applyInArrow(link, "id long, links long, root long")
