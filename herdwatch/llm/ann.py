"""Approximate nearest neighbours by inner product: balanced posting lists behind an in-memory graph of centroids.

Vectors that are equal are one class with its least ids, so that no number of copies makes a list longer. Classes get one
more coordinate that makes them equally long, which turns the largest inner product into the least distance.

Lists are made by splitting a bounded sample until each part stands for about ``PER_LIST`` vectors; every class is
then stored in its nearest centroid's list, and a class near a border in further lists as well (a list is left
out if a list that has the class already is nearer to it than the class is). A query walks a graph that links each
centroid to its nearest ones, and reads the lists whose centroid is not much farther than the first; the ratio
is set so that some of the table's queries, which may lie elsewhere than its other rows, find the target share of their
neighbours among all rows; those far from every centroid have a ratio of their own. Lists and their queries meet in blocks, products are computed in double precision on the stored vectors. A query reads its nearest
lists first; from the others it takes only what is at least as good as the last of the nearest it has by then.

The sample grows with the table up to ``MOST_LISTS`` lists; beyond that lists get longer and are read in more blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import small

NEAREST, EVERY = 20, 20
PER_LIST, MOST_LISTS, PER_CENTROID, SAMPLE = 1_024, 8_192, 8, 20_000
# Further lists of a class: how much farther than its nearest centroid, and how many.
BORDER, COPIES = 0.1, 8
LINKS, BEAM, RECALL, TRIALS = 16, 64, 0.95, 400
# Queries are told apart by how far their first centroid is, in so many kinds with a ratio each.
KINDS = 5
# Lists that a query reads before the others.
FIRST = 2
POSTINGS, QUERIES = 4_096, 1_024
BROADCAST_ANSWERS, BROADCAST_BOUNDS = 50_000, 1_000_000


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1), 0))


def split(points: np.ndarray, cap: int) -> list[np.ndarray]:
    """Means of parts of at most ``cap`` points; parts are cut by k-means, or in halves where that gives no balance."""
    out, todo, rng = [], [points], np.random.default_rng(7)
    while todo:
        part = todo.pop()
        if len(part) <= cap:
            out.append(part.mean(axis=0))
            continue
        k = min(8, -(-len(part) // cap))
        centres = part[rng.permutation(len(part))[:k]]
        for _ in range(8):
            near = distances(part, centres).argmin(axis=1)
            centres = np.stack([part[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(k)])
        if np.bincount(near).max() > 0.8 * len(part):
            # Halves along the direction of the largest spread.
            middle = part - part.mean(axis=0)
            order = np.argsort(middle @ np.linalg.svd(middle[:: max(1, len(part) // 500)], full_matrices=False)[2][0], kind="stable")
            near = np.empty(len(part), int)
            near[order] = np.arange(len(part)) * 2 // len(part)
        todo += [part[near == j] for j in np.unique(near)]
    return out


@dataclass
class Index:
    """Lists of one length of vectors."""

    centres: np.ndarray
    links: np.ndarray  # centroid x its nearest centroids
    starts: np.ndarray
    scale: float
    longest: float
    ratios: np.ndarray = field(default_factory=lambda: np.ones(1))
    ends: np.ndarray = field(default_factory=lambda: np.empty(0))  # between the kinds of queries
    beam: int = BEAM
    held: np.ndarray | None = None  # classes by nearest centroid

    def stored(self, vectors: np.ndarray) -> np.ndarray:
        """Scaled vectors with the coordinate that makes them equally long."""
        u = vectors / self.scale
        return np.concatenate([u, np.sqrt(np.maximum(self.longest**2 - (u**2).sum(1), 0))[:, None]], axis=1)

    def asked(self, vectors: np.ndarray) -> np.ndarray:
        """Queries of the same length as the stored vectors; the length of a query changes no order."""
        u = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        u *= self.longest / np.sqrt((u**2).sum(1))[:, None]
        return np.concatenate([u, np.zeros((len(u), 1))], axis=1)

    def place(self, points: np.ndarray) -> list[np.ndarray]:
        """The lists of each point, its nearest first."""
        d = distances(points, self.centres)
        out = []
        for row in d:
            near = np.argpartition(row, COPIES - 1)[:COPIES] if len(row) > COPIES else np.arange(len(row))
            near = near[np.argsort(row[near], kind="stable")]
            near = near[row[near] <= (1 + BORDER) * row[near[0]]]
            chosen = [near[0]]
            for j in near[1:]:
                if (np.linalg.norm(self.centres[chosen] - self.centres[j], axis=1) > row[j]).all():
                    chosen.append(j)
            out.append(np.array(chosen))
        return out

    def walk(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) by point, nearest first: a beam over the graph, all points at once; -1 fills up."""
        n, width = len(points), self.beam
        every = np.arange(n)
        seen = np.zeros((n, len(self.centres)), bool)
        seen[:, self.starts] = True
        names = np.tile(self.starts, (n, 1))
        d = distances(points, self.centres[self.starts])
        done = np.zeros(d.shape, bool)

        def best(names, d, done):
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            return tuple(np.take_along_axis(x, order, axis=1) for x in (names, d, done))

        names, d, done = best(names, d, done)
        while not done.all():
            rows = every[~done.all(axis=1)]
            at = np.argmin(done[rows], axis=1)
            done[rows, at] = True
            to = self.links[names[rows, at]]
            fresh = ~seen[rows[:, None], to]
            seen[rows[:, None], to] = True
            apart = np.linalg.norm(self.centres[to] - points[rows][:, None, :], axis=2)
            more = np.full((n, to.shape[1]), -1), np.full((n, to.shape[1]), np.inf), np.ones((n, to.shape[1]), bool)
            more[0][rows], more[1][rows], more[2][rows] = np.where(fresh, to, -1), np.where(fresh, apart, np.inf), ~fresh
            names, d, done = best(*(np.concatenate(x, axis=1) for x in zip((names, d, done), more, strict=True)))
        return names, d

    def choose(self, points: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists to read for each point: by ratio, and more until they hold ``least`` classes."""
        names, d = self.walk(points)
        out = []
        for i, (row, far) in enumerate(zip(names, d, strict=True)):
            row, far = row[row >= 0], far[row >= 0]
            n = int((far <= self.ratios[np.searchsorted(self.ends, far[0])] * far[0]).sum())
            filled = np.cumsum(self.held[row])
            if filled[n - 1] < least and filled[-1] < least:
                row = np.argsort(distances(points[i : i + 1], self.centres)[0], kind="stable")
                filled = np.cumsum(self.held[row])
            out.append(row[: max(n, int(np.searchsorted(filled, least)) + 1)])
        return out


def graph(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroids of each, starts): from the starts, links lead to every centroid."""
    k = min(LINKS, len(centres) - 1)
    if not k:
        return np.zeros((1, 1), int), np.zeros(1, int)
    links = np.empty((len(centres), k), int)
    for i in range(0, len(centres), 1024):
        d = distances(centres[i : i + 1024], centres)
        d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
        links[i : i + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    spread = np.linspace(0, len(centres) - 1, min(len(centres), 32)).astype(int)
    # Links have a direction, and a far centroid may be near to none: what no walk would meet is a start as well.
    met, starts = np.zeros(len(centres), bool), spread.tolist()
    asked = np.bincount(links.ravel(), minlength=len(centres))
    for j in [None, *np.argsort(asked, kind="stable").tolist()]:
        if j is None:
            edge = spread
        elif met[j]:
            continue
        else:
            starts.append(j)
            edge = np.array([j])
        while len(edge):
            met[edge] = True
            edge = np.unique(links[edge])
            edge = edge[~met[edge]]
    return links, np.unique(starts)


def fit(
    sample: np.ndarray, n: int, scale: float, longest: float, nearest: int, recall: float,
    asked: np.ndarray | None = None, of: np.ndarray | None = None, near: np.ndarray | None = None,
) -> Index:
    """An index for ``n`` vectors from a sample of them.

    ``asked`` are the queries to try, and ``near`` the vectors to be found, each by the query in ``of``. Without
    them sampled rows are tried, which are to find their neighbours in the sample.
    """
    index = Index(np.empty((0, 0)), np.empty((0, 0)), np.empty(0), scale, longest)
    points = index.stored(sample)
    index.centres = np.stack(split(points, max(PER_CENTROID, round(PER_LIST * len(points) / n))))
    index.links, index.starts = graph(index.centres)
    # How much farther than the first centroid the lists of true neighbours are.
    if asked is None:
        trial = np.linspace(0, len(sample) - 1, min(len(sample), TRIALS)).astype(int)
        asked = sample[trial]
        products = asked @ sample.T
        products[np.arange(len(trial)), trial] = -np.inf
        k = min(nearest, len(sample) - 1)
        of, near = np.repeat(np.arange(len(trial)), k), sample[np.argpartition(-products, k - 1, axis=1)[:, :k].ravel()]
    unlike, at = np.unique(near, axis=0, return_inverse=True)
    lists = index.place(index.stored(unlike))
    while True:
        names, d = index.walk(index.asked(asked))
        away = [dict(zip(row.tolist(), (far / max(far[0], 1e-300)).tolist(), strict=True)) for row, far in zip(names, d, strict=True)]
        need = np.array([min(away[q].get(j, np.inf) for j in lists[x].tolist()) for q, x in zip(of.tolist(), at.ravel().tolist(), strict=True)])
        index.ends = np.unique(np.quantile(d[:, 0], np.arange(1, KINDS) / KINDS))
        kind = np.searchsorted(index.ends, d[of, 0])
        parts = [need[kind == j] for j in range(len(index.ends) + 1)]
        index.ratios = np.array([np.quantile(part if len(part) else need, recall, method="higher") for part in parts])
        if np.isfinite(index.ratios).all() or index.beam >= len(index.centres):
            return index
        index.beam *= 2


def classes_of(rows: DataFrame, least: int) -> DataFrame:
    """Rows (cid, ids, asks, v): vectors, their least id, the ``least`` least ids, and whether a query has this vector.

    A hot vector sends at most ``least`` rows per task.
    """
    order = Window.partitionBy("v").orderBy("id")
    few = rows.select("id", "v").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= least)
    ids = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asks = rows.groupBy("v").agg(F.max("asks").alias("asks"))
    return ids.join(asks, "v").select(F.col("ids")[0].alias("cid"), "ids", "asks", "v")


def matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def by_length(batch: pa.RecordBatch):
    """(length, rows) for each length of vectors in the column v."""
    lengths = np.diff(batch.column("v").offsets.to_numpy())
    for dim in np.unique(lengths):
        yield int(dim), batch.take(pa.array(np.flatnonzero(lengths == dim)))


def spread(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)


def postings(classes: DataFrame, books: dict[int, Index]) -> DataFrame:
    """Rows (dim, list, first, cid, ids, v): every class in its lists; first marks the nearest one."""

    def run(batches):
        for batch in batches:
            for dim, part in by_length(batch):
                lists = books[dim].place(books[dim].stored(matrix(part.column("v"), dim))) if dim in books else [np.zeros(1, int)] * len(part)
                row, where = spread(lists)
                first = np.concatenate([[True], row[1:] != row[:-1]])
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), dim), pa.int32()), pa.array(where, pa.int64()), pa.array(first), *taken.columns],
                    names=["dim", "list", "first", "cid", "ids", "v"],
                )

    return classes.mapInArrow(run, f"dim int, list long, first boolean, cid long, ids array<bigint>, v {dict(classes.dtypes)['v']}")


def probes(asking: DataFrame, books: dict[int, Index], least: int) -> DataFrame:
    """Rows (dim, list, turn, cid, v): the lists each query's vector reads, its nearest ones with turn 0, the others with 1."""

    def run(batches):
        for batch in batches:
            for dim, part in by_length(batch):
                for start in range(0, len(part), 512):
                    some = part.slice(start, 512)
                    lists = [np.zeros(1, int)] * len(some)
                    if dim in books:
                        lists = books[dim].choose(books[dim].asked(matrix(some.column("v"), dim)), least)
                    row, where = spread(lists)
                    later = np.concatenate([np.arange(len(x)) >= FIRST for x in lists])
                    taken = some.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), dim), pa.int32()), pa.array(where, pa.int64()), pa.array(later.astype(np.int32)), *taken.columns],
                        names=["dim", "list", "turn", "cid", "v"],
                    )

    return asking.mapInArrow(run, f"dim int, list long, turn int, cid long, v {dict(asking.dtypes)['v']}")


def best_of(stored: np.ndarray, asked: np.ndarray, keep: int, least: np.ndarray):
    """(query, stored row, product) of each query's ``keep`` best rows of at least ``least``, and of rows about as good."""
    rough = asked @ stored.T
    # A matrix product may round differently by place: the exact products decide.
    near = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
    good = ~(rough < (least - near)[:, None])
    for i in np.flatnonzero(good.sum(axis=1) > keep):
        row = np.where(good[i], rough[i], -np.inf)
        last = np.partition(row, len(row) - keep)[len(row) - keep]
        good[i] &= ~(row < last - 1e-9 * (1 + abs(last)))
    query, at = np.nonzero(good)
    score = (stored[at] * asked[query]).sum(axis=1)
    good = ~(score < least[query])
    return query[good], at[good], score[good]


def answers(stored: DataFrame, asked: DataFrame, keep: int) -> DataFrame:
    """Rows (qid, cid, ids, score): the best of each block of a list for each query that reads it.

    ``asked`` has the columns dim, list, cid, v and least, the product below which a query wants nothing (null: it wants all).
    """
    key = ["dim", "list"]

    def blocks(rows: DataFrame, own: str, other: str) -> DataFrame:
        cut = rows.withColumn(own, F.pmod(F.xxhash64("cid"), F.col(f"n_{own}")))
        return cut.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))

    def parts(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy(*key).agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    # Lists that nobody reads take no part.
    plan = materialize(parts(stored, POSTINGS, "n_p").join(parts(asked, QUERIES, "n_q"), key))
    plan = small(plan, 200_000)
    none = F.lit(None).cast("array<bigint>")
    left = blocks(stored.join(plan, key), "p", "q").select(*key, "p", "q", F.lit(0).alias("role"), "cid", "ids", "v", F.lit(None).cast("double").alias("least"))
    right = blocks(asked.join(plan, key), "q", "p").select(*key, "p", "q", F.lit(1).alias("role"), "cid", none.alias("ids"), "v", "least")

    def run(group, table):
        table = table.combine_chunks()
        role = table.column("role").to_numpy()
        home, guest = (table.take(pa.array(np.flatnonzero(role == r))).combine_chunks() for r in (0, 1))
        schema = pa.schema([("qid", pa.int64()), ("cid", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
        if not len(home) or not len(guest):
            return schema.empty_table()
        dim = group[0].as_py()
        least = guest.column("least").fill_null(-np.inf).to_numpy()
        q, at, score = best_of(matrix(home.column("v").combine_chunks(), dim), matrix(guest.column("v").combine_chunks(), dim), keep, least)
        rows = pa.array(at)
        return pa.table([pa.array(guest.column("cid").to_numpy()[q]), home.column("cid").take(rows), home.column("ids").take(rows), pa.array(score)], schema=schema)

    return left.unionByName(right).groupBy(*key, "p", "q").applyInArrow(run, "qid long, cid long, ids array<bigint>, score double")


def nearest_of(classes: DataFrame, tried: dict[int, tuple[np.ndarray, np.ndarray]], nearest: int) -> DataFrame:
    """Rows (dim, q, v, score): by length, the nearest of all classes to each of a few queries (ids, vectors), its own left out."""

    def run(batches):
        best = {}
        for batch in batches:
            for dim, part in by_length(batch):
                if dim not in tried:
                    continue
                ids, asked = tried[dim]
                cids, v = part.column("cid").to_numpy(), matrix(part.column("v"), dim)
                score = np.where(ids[:, None] == cids, -np.inf, asked @ v.T)
                v = np.broadcast_to(v, (len(ids), *v.shape))
                k = min(nearest, len(cids))
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                new = np.take_along_axis(score, top, axis=1), np.take_along_axis(v, top[:, :, None], axis=1)
                if dim in best:
                    new = tuple(np.concatenate(x, axis=1) for x in zip(best[dim], new, strict=True))
                    top = np.argsort(-new[0], axis=1, kind="stable")[:, :nearest]
                    new = np.take_along_axis(new[0], top, axis=1), np.take_along_axis(new[1], top[:, :, None], axis=1)
                best[dim] = new
        for dim, (score, v) in best.items():
            q, at = np.nonzero(np.isfinite(score))
            values = pa.array(v[q, at].ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * dim, pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), dim), pa.int32()), pa.array(q, pa.int32()), lists, pa.array(score[q, at])], names=["dim", "q", "v", "score"]
            )

    found = classes.mapInArrow(run, "dim int, q int, v array<double>, score double")
    order = Window.partitionBy("dim", "q").orderBy(F.desc("score"), "v")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= nearest).drop("_r")


def fit_lengths(classes: DataFrame, nearest: int, recall: float, sample: int) -> dict[int, Index]:
    """An index by length, for lengths of more vectors than a list should hold."""
    top = F.array_max(F.transform("v", F.abs)).cast("double")
    sizes = classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(top).alias("scale")).where(F.col("n") > PER_LIST)
    sizes = {r["dim"]: (r["n"], r["scale"]) for r in sizes.collect()}
    if not sizes:
        return {}
    spark, every = classes.sparkSession, sum(n for n, _ in sizes.values())
    lists = {dim: min(MOST_LISTS, -(-n // PER_LIST)) for dim, (n, _) in sizes.items()}
    rates = [(dim, float(max(sample / every, PER_CENTROID * lists[dim] / n)), scale) for dim, (n, scale) in sizes.items()]
    known = classes.withColumn("dim", F.size("v")).join(F.broadcast(spark.createDataFrame(rates, "dim int, rate double, scale double")), "dim")
    scaled = F.transform("v", lambda x: x.cast("double") / F.col("scale"))
    known = known.withColumn("len", F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda total, x: total + x * x)))
    longest = {r["dim"]: r["len"] for r in known.groupBy("dim").agg(F.max("len").alias("len")).collect()}
    u = F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) / (1 << 30)
    drawn = known.where(u < F.col("rate")).select("dim", "cid", "v").toArrow().sort_by("cid")
    dims = drawn.column("dim").to_numpy()
    # Queries to try, by a hash of their own.
    first = Window.partitionBy("dim").orderBy(F.xxhash64("cid", F.lit(1)), "cid")
    tried = known.where("asks").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= TRIALS)
    tried = tried.select("dim", "cid", "v").toArrow().sort_by("cid")
    tried_dims, books = tried.column("dim").to_numpy(), {}
    for dim in sizes:
        at = np.flatnonzero(tried_dims == dim)
        if len(at):
            books[dim] = tried.column("cid").to_numpy()[at], matrix(tried.column("v").take(pa.array(at)).combine_chunks(), dim)
    found = nearest_of(known.select("cid", "v"), books, nearest).toArrow()
    found_dims = found.column("dim").to_numpy()
    out = {}
    for dim, (n, scale) in sizes.items():
        at = np.flatnonzero(dims == dim)
        if len(at) > 1:
            points = matrix(drawn.column("v").take(pa.array(at)).combine_chunks(), dim)
            some = np.flatnonzero(found_dims == dim)
            tries = ()
            if len(some):
                near = matrix(found.column("v").take(pa.array(some)).combine_chunks(), dim)
                tries = books[dim][1], found.column("q").to_numpy()[some], near
            out[dim] = fit(points, n, scale, longest[dim], nearest, recall, *tries)
    return out


def nearest_by_product(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST, every: int = EVERY,
    recall: float = RECALL, sample: int = SAMPLE,
) -> DataFrame:
    """Rows (query_id, rank, id_col, score): for each row whose id is divisible by ``every`` its ``nearest`` others.

    score is the inner product in double precision; larger ones come first, ties go to the smaller id. Vectors that are
    null, empty, zero, or hold null or non-finite components take no part, nor do rows without id; only vectors of
    equal length meet. Rows that share an id count as one vector, the least of them. A query gets all candidates if
    there are fewer than ``nearest``, no row if there is none. Other columns are not looked at. ``recall`` is the
    share of true neighbours that sampled queries are to find among a sample (about ``sample`` rows, or eight per list).
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where("id is not null and v is not null").where(finite).where(F.exists("v", lambda x: x != 0))
    # One zero, so that equal vectors are one key.
    good = good.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x)))
    good = materialize(good.groupBy("id").agg(F.min("v").alias("v")).withColumn("asks", F.col("id") % every == 0))
    classes = materialize(classes_of(good, nearest + 1))

    books = fit_lengths(classes, nearest, recall, sample)
    stored = materialize(postings(classes.select("cid", "ids", "v"), books))
    if books:
        held = stored.where("first").where(F.col("dim").isin(list(books))).groupBy("dim", "list").count().collect()
        for index in books.values():
            index.held = np.zeros(len(index.centres), np.int64)
        for r in held:
            books[r["dim"]].held[r["list"]] = r["count"]
    asked = materialize(probes(classes.where("asks").select("cid", "v"), books, nearest + 1))
    stored, keep = stored.drop("first"), nearest + 1
    first = materialize(answers(stored, asked.where("turn = 0").withColumn("least", F.lit(None).cast("double")), keep))
    # The last product of those that are full; a list in several blocks gives more than enough rows.
    last = Window.partitionBy("qid").orderBy(F.desc("score"))
    # A class that both lists have counts once.
    bounds = first.groupBy("qid", "cid").agg(F.max("score").alias("score")).withColumn("_r", F.row_number().over(last))
    bounds = bounds.where(F.col("_r") == keep).select(F.col("qid").alias("cid"), F.col("score").alias("least"))
    rest = asked.where("turn = 1").join(small(materialize(bounds), BROADCAST_BOUNDS), "cid", "left")
    found = first.unionByName(answers(stored, rest, keep))

    # A class may come from several lists; of its ids the least ones are enough.
    found = found.groupBy("qid", "cid").agg(F.max("score").alias("score"), F.min("ids").alias("ids"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    found = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= nearest + 1)
    near = F.sort_array(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id"))))))
    near = found.groupBy("qid").agg(F.slice(near, 1, nearest + 1).alias("near"))
    near = near.join(classes.where("asks").select(F.col("cid").alias("qid"), "v"), "qid").select("v", "near")
    near = small(materialize(near), BROADCAST_ANSWERS)

    # Queries of one vector share the answer, each without itself.
    out = good.where("asks").join(near, "v").select(
        F.col("id").alias("query_id"), F.filter("near", lambda x: x["id"] != F.col("id")).alias("near")
    )
    out = out.select("query_id", F.posexplode(F.slice("near", 1, nearest)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.s")).alias("score"))
