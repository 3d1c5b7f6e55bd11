"""MinHash near-duplicates: fast similarity sketches, banding, exact check of every link.

A document's set holds the hashes of its distinct shingles. Its sketch has ``COORDS`` coordinates, filled by
rounds of hashed bin placement: in round i every shingle falls into one bin with a value that grows with i, a
bin keeps its least value, and after at most 2 x COORDS rounds (the last COORDS place every shingle into one
given bin) no bin is empty. Two sketches agree in a coordinate with the sets' similarity, as concentrated
as with independent permutations, at the cost of a few passes over the set.

Links between documents with equal sets need no sketch: they are one class. Classes that agree in one of the
bands of four coordinates are candidates; a pair of similarity s = 0.75 shares no band with a probability of
(1 - s^4)^32 = 5e-6. To keep a large group linear, candidates are tried in three steps. First, each class is checked
against one member of each of its buckets, the best eight by sketch. The members are picked by one hash of the class,
so that buckets of one group mostly pick the same few. Second, the sketches of all members of a bucket whose
components still differ are compared, in blocks, and a tree of the likely links of each block is checked; components
are then complete for ordinary groups. Third, all pairs of a bucket whose components differ even then and that agree
enough are checked (698 of 1024 equal bytes; a pair of 0.75 lies 5 standard deviations above). A link counts only
after the full sets were compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped_afterwards, materialize, result_of, short_batches
from .common import BLANKS, components, give_back, in_blocks, only_ids, with_shingles

COORDS, BANDS, BAND = 1024, 32, 4
# Equal bytes of two sketches for a pair that is checked, and for one that is likely a link.
LEAST_EQUAL, LIKELY = 698, 770
SHINGLE, PERCENT = 5, 75

# Candidates of a class that are checked in the first step.
BEST = 8
# Members of one bucket that are compared in one piece.
BLOCK = 1024

# Shingles, and documents, that are sketched at a time.
CHUNK, ROWS = 200_000, 1_024
MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sketches(values: np.ndarray, lengths: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Sketches (documents x coords) of sets given as one array of hashes and the set sizes."""
    out = np.full(len(lengths) * coords, MAX)
    left = np.where(lengths > 0, coords, 0)
    where = np.repeat(np.arange(len(lengths)), lengths)
    shift, low, turn = np.uint64(64 - int(np.log2(coords))), np.uint64((1 << 48) - 1), np.uint64(0x9E3779B97F4A7C15)
    some, at = values, where
    for i in range(coords):
        h = mix(some + np.uint64(i + 1) * turn)
        cell = at * coords + (h >> shift).astype(np.int64)
        # Later rounds have larger values: a bin that is full keeps what it has.
        fresh = out[cell] == MAX
        cell = cell[fresh]
        np.minimum.at(out, cell, (h[fresh] & low) | np.uint64(i << 48))
        left -= np.bincount(np.unique(cell) // coords, minlength=len(left))
        if not left.any():
            return out.reshape(-1, coords)
        more = left[at] > 0
        if not more.all():
            some, at = some[more], at[more]
    # The last rounds place every shingle into one given bin: only bins that are still empty need them.
    starts = np.cumsum(lengths) - lengths
    empty = np.flatnonzero(out == MAX)
    empty = empty[lengths[empty // coords] > 0]
    n = lengths[empty // coords]
    for part in np.array_split(np.arange(len(empty)), 1 + int(n.sum()) // CHUNK):
        if len(part):
            cell, size = empty[part], n[part]
            ends = np.cumsum(size)
            member = np.arange(ends[-1]) + np.repeat(starts[cell // coords] - (ends - size), size)
            place = np.repeat((cell % coords).astype(np.uint64), size) + np.uint64(coords)
            h = mix(values[member] + (place + np.uint64(1)) * turn)
            out[cell] = np.minimum.reduceat((h & low) | (place << np.uint64(48)), ends - size)
    return out.reshape(-1, coords)


def signatures(batches):
    """Per row of (id, set): size, two order-free sums that name the set, band keys, sketch bytes."""
    names = np.arange(BANDS, dtype=np.uint64)
    for batch in batches:
        ids, sets = batch.column(0), batch.column(1)
        lengths = np.diff(sets.offsets.to_numpy())
        ends = np.cumsum(lengths)
        start = 0
        while start < len(ids):
            base = ends[start - 1] if start else 0
            stop = min(start + ROWS, max(start + 1, int(np.searchsorted(ends, base + CHUNK, "right"))))
            part = lengths[start:stop]
            values = sets.slice(start, stop - start).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sums = []
            for seed in (1, 2):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values * np.uint64(2) + np.uint64(seed)))])
                to = np.concatenate([[0], np.cumsum(part)])
                sums.append((total[to[1:]] - total[to[:-1]]).view(np.int64))
            found = sketches(values, part)
            keys = np.zeros((len(part), BANDS), np.uint64)
            for column in np.moveaxis(found[:, : BANDS * BAND].reshape(len(part), BANDS, BAND), 2, 0):
                keys = mix(keys * np.uint64(31) + column)
            keys = mix(keys + names)
            small = (mix(found) >> np.uint64(56)).astype(np.uint8)
            # Sets of one or two shingles are similar to equal sets only.
            offsets = np.concatenate([[0], np.cumsum(np.where(part > 2, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(start, stop - start),
                    pa.array(part.astype(np.int64)),
                    pa.array(sums[0]),
                    pa.array(sums[1]),
                    pa.ListArray.from_arrays(offsets, keys[part > 2].view(np.int64).ravel()),
                    pa.ListArray.from_arrays(
                        np.arange(0, len(part) * COORDS // 8 + 1, COORDS // 8, dtype=np.int32), small.view(np.int64).ravel()
                    ),
                ],
                names=["id", "n", "s1", "s2", "bands", "sketch"],
            )
            start = stop
    give_back()


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, set): distinct hashes of the words' runs of five."""
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))
    df = with_shingles(df, "_text", BLANKS, SHINGLE, "_all", "_n_words")
    return df.select("id", F.array_distinct("_all").alias("set"))


def check_pairs(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))
    sets = materialize(shingle_sets(only_ids(rows, ids, "id"), "id", "_text"))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("_a")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("set").alias("_b")), "b"
    )
    both = both.withColumn("_i", F.size(F.array_intersect("_a", "_b")))
    union = F.size("_a") + F.size("_b") - F.col("_i")
    return both.where(100 * F.col("_i").cast("long") >= PERCENT * union.cast("long")).select("a", "b")


def sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, equal) whose sketches agree often enough; equal counts the same bytes of the sketches."""
    a = nodes.select(F.col("rep").alias("a"), F.col("sketch").alias("_a"))
    b = nodes.select(F.col("rep").alias("b"), F.col("sketch").alias("_b"))

    def differing(x, y):
        # The lowest bit of each byte becomes the "or" of the byte's bits.
        bits = x.bitwiseXOR(y)
        for by in (4, 2, 1):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, by))
        return F.bit_count(bits.bitwiseAND(F.lit(0x0101010101010101)))

    same = COORDS - F.aggregate(F.zip_with("_a", "_b", differing), F.lit(0), lambda total, x: total + x)
    return pairs.join(a, "a").join(b, "b").withColumn("equal", same).where(F.col("equal") >= LEAST_EQUAL).select("a", "b", "equal")


def alike(tree: bool):
    """Pairs (a, b) of a block's rows that differ in component, fit in size and agree in enough sketch bytes.

    With ``tree``, only likely links (LIKELY), the best of each component, and none between rows that earlier ones
    of the block join already: fewer than the block has rows. Otherwise a pair comes from the first bucket it shares.
    """

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            rows = lists.values
            reps, sizes, named, blks = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("rep", "n", "c", "blk"))
            found = [], []
            for key, start, stop in zip(keys, ends[:-1], ends[1:], strict=True):
                bytes_ = rows.field("sketch").slice(start, stop - start).flatten().to_numpy().view(np.uint8).reshape(-1, COORDS)
                bands = rows.field("bands").slice(start, stop - start).flatten().to_numpy().reshape(-1, BANDS)
                rep, n, c, blk = reps[start:stop], sizes[start:stop], named[start:stop].copy(), blks[start:stop]
                one = blk.min() == blk.max()
                for i in range(len(rep) - 1):
                    to = slice(i + 1, None)
                    ok = (c[to] != c[i]) & (100 * np.minimum(n[to], n[i]) >= PERCENT * np.maximum(n[to], n[i]))
                    if not one:
                        ok &= blk[to] != blk[i]
                    at = np.flatnonzero(ok) + i + 1
                    equal = np.count_nonzero(bytes_[at] == bytes_[i], axis=1)
                    enough = equal >= (LIKELY if tree else LEAST_EQUAL)
                    at, equal = at[enough], equal[enough]
                    if tree and len(at):
                        at = at[np.argsort(-equal, kind="stable")]
                        joined, first = np.unique(c[at], return_index=True)
                        at = at[first]
                        c[np.isin(c, joined)] = c[i]
                    elif len(at):
                        at = at[bands[i][np.argmax(bands[at] == bands[i], axis=1)] == key]
                    found[0].append(np.minimum(rep[at], rep[i]))
                    found[1].append(np.maximum(rep[at], rep[i]))
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def fits(a: str, b: str):
    """Sizes alone allow the similarity."""
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b))


def still_open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (key, rep, n, c) of the buckets whose rows are in several components c so far."""
    named = members.join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    named = materialize(named.select("key", "rep", "n", F.coalesce("root", "rep").alias("c")))
    keys = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    return materialize(named.join(keys, "key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_shingles, component_id, kept), one per row of ``docs``; other columns are not looked at.

    Documents link when 100 * |intersection| >= 75 * |union| of their sets of distinct 5-word shingles (fewer
    words: the whole sequence is the one shingle). component_id is the least id reachable by links, kept
    says that a document is that one. A text that is null or without words has an empty set, links with
    nothing and is kept. Rows without an id get component_id null, link with nothing and are kept. Rows that
    share an id count as one document; each gets its own row. An empty table gives no rows. The result is stored, the
    tables on the way to it are dropped.
    """
    short_batches(docs.sparkSession)
    with dropped_afterwards(docs.sparkSession):
        return result_of(_near_duplicates(docs, id_col, text_col))


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = materialize(
        shingle_sets(docs, id_col, text_col).mapInArrow(
            signatures, "id long, n long, s1 long, s2 long, bands array<bigint>, sketch array<bigint>"
        )
    )
    name = ["s1", "s2", "n"]
    real = t.where("n > 0 and id is not null")
    nodes = materialize(
        real.groupBy(*name).agg(F.min(F.struct("id", "bands", "sketch")).alias("_m"))
        .select(*name, F.col("_m.id").alias("rep"), "_m.bands", "_m.sketch")
    )
    placed = nodes.select("rep", "n", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").count().where("count > 1").select("key")
    members = materialize(placed.join(shared, "key"))

    # First, each class against one picked member of each of its buckets, the best by sketch.
    picked = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep").alias("o"), "rep", "n")).alias("_c"))
    star = (
        members.join(picked, "key").where(F.col("rep") != F.col("_c.rep")).where(fits("n", "_c.n"))
        .select(F.col("rep").alias("a"), F.col("_c.rep").alias("b")).distinct()
    )
    # At most one row per band and class to choose from.
    best = sketched(star, nodes).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("equal", "b")), False).alias("_m"))
    best = best.select("a", F.explode(F.slice("_m", 1, BEST)).alias("_x")).select("a", "_x.b")
    linked = materialize(check_pairs(materialize(best), docs, id_col, text_col))
    roots = components(linked)

    # Then the buckets that these links have not joined: a tree of the likely links, and all pairs that are left.
    for tree in (True, False):
        rest = still_open(members, roots).join(nodes.select("rep", "sketch", "bands"), "rep")
        blocks = in_blocks(materialize(rest), ["key"], "rep", BLOCK).groupBy("key", "lo", "hi").agg(
            F.collect_list(F.struct("rep", "n", "c", "blk", "sketch", "bands")).alias("rows")
        )
        pairs = blocks.select("key", "rows").mapInArrow(alike(tree), "a long, b long").distinct()
        linked = materialize(linked.unionByName(check_pairs(materialize(pairs), docs, id_col, text_col)))
        roots = components(linked)

    classes = nodes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(
        *name, F.coalesce("root", "rep").alias("_root")
    )
    # A row without an id finds no class.
    keyed = t.select("id", *name, *[F.when(F.col("id").isNotNull(), F.col(c)).alias(f"_{c}") for c in name])
    classes = classes.select("_root", *[F.col(c).alias(f"_{c}") for c in name])
    out = keyed.join(classes, [f"_{c}" for c in name], "left")
    component = F.coalesce("_root", "id")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
