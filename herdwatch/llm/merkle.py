"""A manifest of a dataset as a Merkle tree, with persistent versions by path copying.

Rows are leaves, in the order of their ids within a source. Every ``FAN`` consecutive nodes are hashed to one, until
one is left: the source's subroot; subroots in the order of their sources make the root in the same way.

The tree is cut into aligned blocks of ``FAN ** DEEP`` leaves. A block is one row of the stored table: its leaves, its
inner nodes by level and, for each leaf that was tampered with, the version that leaf makes: new nodes for its
ancestors in the block, everything else shared. Block tops, one row for 4,096 leaves, go on as nodes of the upper
tree, one grouping per level. A version continues there as well: from its new block top over the block's
way up, of which it copies one node per level.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, new_folder
from .common import ascii_lower, small
from .ranks import numbered

FAN, DEEP = 16, 3
BLOCK = FAN**DEEP
# Ways from a subroot to the root take about 1 KB per level.
BROADCAST_SOURCES = 10_000

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<place:int,nodes:array<string>>"


def part(value: Column) -> Column:
    """A value as its number of bytes, a colon and its text; null as a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[part(v) for v in values]), 256)


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def every_fifth(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def subtree(leaves: list[str], height: int) -> list[list[str]]:
    """Nodes by level, leaves first; ``height`` levels above them."""
    levels = [leaves]
    for _ in range(height):
        below = levels[-1]
        levels.append([digest(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return levels


def copied(levels: list[list[str]], at: int, changed: str) -> list[str]:
    """The nodes a version needs when leaf ``at`` changes: one per level above the leaves; all others are shared."""
    out, node = [], changed
    for nodes in levels[:-1]:
        start = at - at % FAN
        node = digest(nodes[start:at] + [node] + nodes[at + 1 : start + FAN])
        out.append(node)
        at //= FAN
    return out


def blocks_of(rows: DataFrame) -> DataFrame:
    """Rows (source, block, n, members, nodes, top, copies) from numbered leaves; n counts the source's leaves."""
    block = F.floor(F.col("place") / BLOCK).alias("block")
    members = F.sort_array(F.collect_list(F.struct("place", "id", "leaf", "changed"))).alias("members")
    grouped = rows.groupBy("source", block).agg(F.max("n").alias("n"), members)
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        for batch in batches:
            nodes, tops, copies = [], [], []
            for n, held in zip(batch.column("n").to_pylist(), batch.column("members"), strict=True):
                fields = held.values
                leaves, changed = fields.field("leaf").to_pylist(), fields.field("changed").to_pylist()
                # A source of several blocks uses the full height of each.
                height = 0
                while height < DEEP and FAN**height < n:
                    height += 1
                levels = subtree(leaves, height)
                nodes.append(levels[1:])
                tops.append(levels[-1][0])
                copies.append([None if c is None else copied(levels, i, c) for i, c in enumerate(changed)])
            made = (pa.array(nodes, pa.list_(pa.list_(pa.string()))), pa.array(tops, pa.string()), pa.array(copies, pa.list_(pa.list_(pa.string()))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "nodes", "top", "copies"])

    schema = (
        f"source string, block long, n long, members array<struct<place:long,id:{kind},leaf:string,changed:string>>, "
        "nodes array<array<string>>, top string, copies array<array<string>>"
    )
    return grouped.mapInArrow(run, schema)


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the lowest nodes (tree, place, node, many) of upper trees: (top nodes, way up of each lowest node).

    ``many`` counts the tree's nodes. Tops are rows (tree, node). Ways are rows (tree, place, way): for each level the
    node's place in its run and the run's nodes. Runs have at most ``FAN`` nodes, so no group grows with the data.
    """
    level, runs, tops = nodes, [], []
    while True:
        tops.append(level.where("many = 1").select("tree", "node"))
        run = materialize(
            level.where("many > 1").groupBy("tree", F.floor(F.col("place") / FAN).alias("run"))
            .agg(F.max("many").alias("many"), F.sort_array(F.collect_list(F.struct("place", "node"))).getField("node").alias("nodes"))
        )
        if run.isEmpty():
            break
        runs.append(run)
        level = run.select(
            "tree", F.col("run").alias("place"), F.sha2(F.concat_ws("", "nodes"), 256).alias("node"), F.ceil(F.col("many") / FAN).alias("many")
        )
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)

    # From the top down: a node's way is its own run and its parent's way.
    way = None
    for run in reversed(runs):
        each = run.select("tree", "run", "nodes", F.posexplode("nodes").alias("at", "_"))
        own = F.array(F.struct(F.col("at").alias("place"), "nodes")).cast(f"array<{STEP}>")
        if way is None:
            found = each.withColumn("way", own)
        else:
            above = way.select(F.col("tree").alias("_t"), F.col("place").alias("_p"), F.col("way").alias("_way"))
            found = each.join(above, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("run") == F.col("_p")), "left")
            found = found.withColumn("way", F.concat(own, F.coalesce("_way", F.array().cast(f"array<{STEP}>"))))
        way = materialize(found.select("tree", (F.col("run") * FAN + F.col("at")).alias("place"), "way"))
    if way is None:
        way = nodes.select("tree", "place", F.array().cast(f"array<{STEP}>").alias("way")).limit(0)
    return top, way


def write_manifest(
    docs: DataFrame, path: str, columns: tuple[str, ...] = COLUMNS, tampered: Column | None = None, tampered_text: Column | None = None,
) -> None:
    """Writes the tree over ``docs`` and a version per tampered row to ``path``: tables ``blocks`` and ``ways``.

    ``columns`` names the columns of a leaf: id, source, and what follows, the last one being the text. ``tampered``
    says which rows change, by default those whose id's crc32 is divisible by five; ``tampered_text`` is their new
    text, by default A-Z in lower case. A null value is hashed as a dash; a null source is a source and
    comes first; rows without an id come first in their source and are not tampered with. Repeated rows are
    leaves of their own. An empty table writes empty tables. Other columns are not looked at.
    """
    id_, source, *middle, text = (F.col(f"`{c}`") for c in columns)
    tampered = every_fifth(id_) if tampered is None else tampered
    changed = leaf(id_, source, *middle, ascii_lower(text) if tampered_text is None else tampered_text)
    slim = docs.select(
        id_.alias("id"), source.cast("string").alias("source"), leaf(id_, source, *middle, text).alias("leaf"),
        F.when(tampered, changed).alias("changed"),
    )
    blocks_of(numbered(slim, "source", ["id", "leaf"], "place", "n")).write.parquet(f"{path}/blocks")
    blocks = docs.sparkSession.read.parquet(f"{path}/blocks")

    subroots, way = climb(
        blocks.select(F.col("source").alias("tree"), F.col("block").alias("place"), F.col("top").alias("node"), F.ceil(F.col("n") / BLOCK).alias("many"))
    )
    named = numbered(subroots.select(F.col("tree").alias("source"), F.col("node").alias("subroot"), F.lit(0).alias("tree")), "tree", ["source"], "place", "many")
    root, up = climb(named.select("tree", "place", F.col("subroot").alias("node"), "many"))
    # One row per source: subroot, its way to the root, the root.
    named = named.select("source", "subroot", F.col("place").alias("_place"))
    none = F.array().cast(f"array<{STEP}>")
    per_source = named.join(up.drop("tree"), F.col("_place") == F.col("place"), "left").select(
        F.col("source").alias("_s"), "subroot", F.coalesce("way", none).alias("_up")
    )
    per_source = small(materialize(per_source.withColumn("root", root.select("node").scalar())), BROADCAST_SOURCES)
    tops = blocks.select("source", "block").join(
        way.select(F.col("tree").alias("_t"), F.col("place").alias("_b"), "way"),
        F.col("source").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b")), "left",
    )
    tops.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "block", "subroot", "root", F.concat(F.coalesce("way", none), "_up").alias("way")
    ).write.parquet(f"{path}/ways")


def read_versions(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Rows (id_col, source, leaf, subroot, root, proof_sha256, folded_root, verified, n_copied) from a manifest.

    proof_sha256 is the digest of a leaf's siblings on its way up, level by level, left to right. folded_root is the
    root that the leaf's version has: from the new leaf, or the stored one where nothing changed, with the stored
    siblings. n_copied counts the nodes that a version does not share (0 without a version).
    """
    blocks = spark.read.parquet(f"{path}/blocks").drop("n")
    ways = spark.read.parquet(f"{path}/ways").select(F.col("source").alias("_s"), F.col("block").alias("_b"), "subroot", "root", "way")
    both = blocks.join(ways, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    kind = blocks.schema["members"].dataType.elementType["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                yield verified({c: batch.column(c)[row] for c in batch.schema.names})

    schema = f"{id_col} {kind}, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_copied int"
    names = [f.strip().split(" ")[0] for f in schema.split(", ")]

    def verified(row) -> pa.RecordBatch:
        fields = row["members"].values
        leaves, copies, way, root = fields.field("leaf").to_pylist(), row["copies"].as_py(), row["way"].as_py(), row["root"].as_py()
        levels = [leaves, *row["nodes"].as_py()]
        upper = "".join("".join(s["nodes"][: s["place"]] + s["nodes"][s["place"] + 1 :]) for s in way).encode()
        roots: dict[str, str] = {}

        def fold(top: str) -> str:
            if top not in roots:
                node = top
                for step in way:
                    node = digest(step["nodes"][: step["place"]] + [node] + step["nodes"][step["place"] + 1 :])
                roots[top] = node
            return roots[top]

        proofs, folded, n_copied = [], [], []
        for i, node in enumerate(leaves):
            at, proof = i, hashlib.sha256()
            for nodes in levels[:-1]:
                start = at - at % FAN
                left, right = nodes[start:at], nodes[at + 1 : start + FAN]
                proof.update("".join(left + right).encode())
                if copies[i] is None:
                    node = digest(left + [node] + right)
                at //= FAN
            proof.update(upper)
            proofs.append(proof.hexdigest())
            if copies[i] is not None:
                # A block without inner nodes is its one leaf.
                node = copies[i][-1] if copies[i] else fields.field("changed")[i].as_py()
            folded.append(fold(node))
            n_copied.append(0 if copies[i] is None else len(copies[i]) + len(way))
        n = len(leaves)
        same = [pa.array([row[c].as_py()] * n, pa.string()) for c in ("source", "subroot", "root")]
        columns = [
            fields.field("id"), same[0], fields.field("leaf"), same[1], same[2], pa.array(proofs, pa.string()), pa.array(folded, pa.string()),
            pa.array([f == root for f in folded], pa.bool_()), pa.array(n_copied, pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(run, schema)


def manifest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Writes the manifest of ``docs`` to a new folder below the shared one and reads its versions back."""
    path = new_folder(docs.sparkSession, "manifest")
    write_manifest(docs, path, (id_col, *COLUMNS[1:]))
    return read_versions(docs.sparkSession, path, id_col)
