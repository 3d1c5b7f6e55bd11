"""Nearest neighbours, Merkle manifests and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("herdwatch.llm")

from herdwatch.llm import ann, merkle, ranks, resample  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, place int, node string, n int, key string, rank string, weight int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def odd_rows():
    """Nulls in any column, empty and long texts, repeated rows, rows without id, clashing columns."""
    rng = random.Random(4)
    words = [f"Word{i}" for i in range(50)] + ["É", "İx", "ab", "AB"]
    texts = [None, "", " .,! ", "One", "A" * 30_000, " ".join(rng.choices(words, k=300_000))]
    texts += [" ".join(rng.choices(words, k=rng.randint(0, 120))) for _ in range(60)]
    rows = [
        (i, t, ["en", None][i % 2], ["a", "é", None, "", "Z"][i % 5], [i, None][i % 3 == 0], "x", 1, "y", 2, "k", "r", 3)
        for i, t in enumerate(texts)
    ]
    return rows + [rows[8], rows[8], rows[1], (None, "No id", "en", "a", 1, *rows[0][5:]), (None, None, None, None, None, *rows[0][5:]), (-5, "Minus", "en", "a", 1, *rows[0][5:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


# --- Merkle manifest ---------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_leaf(row, text):
    return sha("".join(map(part, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))))


def brute_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def brute_fold(levels, at, node):
    """(root with ``node`` at place ``at``, siblings on the way)."""
    proof = []
    for nodes in levels[:-1]:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        own = at % 16
        proof += run[:own] + run[own + 1 :]
        node = sha("".join(run[:own] + [node] + run[own + 1 :]))
        at //= 16
    return node, proof


def brute_manifest(rows):
    """Sorted (doc_id as text, leaf, subroot, root, proof, folded root, verified)."""
    trees = {}
    for r in rows:
        trees.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r, r["text"]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: brute_levels([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    top = brute_levels([own[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            new = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                new = brute_leaf(r, lower(r["text"]))
            node, proof = brute_fold(own[s], at, new)
            folded, more = brute_fold(top, place, node)
            out.append((str(r["doc_id"]), leaf, own[s][-1][0], top[-1][0], sha("".join(proof + more)), folded, folded == top[-1][0]))
    return sorted(out)


MERKLE = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def merkle_rows(df):
    return sorted((str(r["doc_id"]), *(r[c] for c in MERKLE)) for r in df.collect())


def test_manifest_matches_brute_force(docs):
    want = brute_manifest(docs.collect())
    got = merkle_rows(merkle.manifest(docs))
    assert got == want and {r[-1] for r in got} == {True, False}


def test_manifest_of_several_blocks_and_many_sources(spark):
    """A source of two blocks, the last one with a single leaf; more sources than one node holds."""
    rows = [(i, f"T{i}", "en", "big", 1) for i in range(4097)] + [(10_000 + i, f"U{i}", None, f"s{i % 290}", 1) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = merkle.manifest(df).cache()
    assert merkle_rows(out) == brute_manifest(df.collect())
    # Copies are the ancestors: three in the block, one above it, and three from the subroot to the root.
    copied = {(r["source"] == "big", r["n_copied"]) for r in out.where("n_copied > 0").collect()}
    assert (True, 7) in copied and {n for big, n in copied if big} == {7}
    assert out.where("n_copied > 0").count() == sum(zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows)


def test_versions_share_untouched_nodes():
    levels = merkle.subtree([sha(str(i)) for i in range(300)], 3)
    new = merkle.copied(levels, 17, sha("changed"))
    again = merkle.subtree([sha("changed") if i == 17 else x for i, x in enumerate(levels[0])], 3)
    assert [new[0], new[1], new[2]] == [again[1][1], again[2][0], again[3][0]]
    differing = sum(a != b for x, y in zip(levels, again, strict=True) for a, b in zip(x, y, strict=True))
    assert differing == 1 + len(new)


def test_manifest_of_small_tables(spark, docs):
    assert merkle.manifest(docs.limit(0)).count() == 0
    one = merkle.manifest(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["proof_sha256"] == sha("")


def test_manifest_with_own_columns_and_change(spark, docs, tmp_path):
    merkle.write_manifest(docs, str(tmp_path / "m"), ("doc_id", "lang", "text"), F.col("doc_id") == 7, F.lit("new"))
    out = merkle.read_versions(spark, str(tmp_path / "m")).collect()
    assert [r["doc_id"] for r in out if not r["verified"]] == [7]


# --- resampling -----------------------------------------------------------------------------------------------


def brute_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute_resample(rows, target, percent=25):
    """By row: (id, n_features, weight, score), and the drawn ones in order."""
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    found = [brute_features(text) for _, text in rows]
    for _, f in found:
        np.add.at(s, f, 1)
    for text in target:
        np.add.at(t, brute_features(text)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s.tolist(), t.tolist())]
    out = []
    for (i, _), (n, f) in zip(rows, found, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((-x[4], x[0] is None, x[0] or 0) for x in out if x[1] >= 20)
    return out, may[: percent * len(may) // 100]


@pytest.mark.parametrize("percent", [0, 25, 100])
def test_resampling_matches_brute_force(spark, docs, percent):
    target = ["One word12 word13 AB ab", None, "", "word1 " * 40]
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, id int")
    out = resample.resample(docs, bench, percent=percent).collect()
    want, drawn = brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], target, percent)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_features"], r["weight"], r["score"]) for r in out)
    assert got == sorted((str(i), *rest) for i, *rest in want)
    ranked = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in out if r["rank"] is not None)
    assert ranked == [(i + 1, *key) for i, key in enumerate(drawn)]


def test_resampling_of_empty_tables(spark, docs):
    bench = spark.createDataFrame([("x",)], "text string")
    assert resample.resample(docs.limit(0), bench).count() == 0
    assert resample.resample(docs, bench.limit(0)).count() == docs.count()


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = odd_rows()[5][1].encode()
    whole = [np.concatenate([f for _, f in resample.features(text)]), sum(n for n, _ in resample.features(text))]
    monkeypatch.setattr(resample, "PIECE", 100)
    parts = list(resample.features(text))
    assert len(parts) > 100 and sum(n for n, _ in parts) == whole[1]
    assert sorted(np.concatenate([f for _, f in parts]).tolist()) == sorted(whole[0].tolist())


def test_kth_key_with_ties(spark):
    rng = random.Random(1)
    values = [(rng.randint(0, 5), rng.randint(0, 9)) for _ in range(400)]
    rows = spark.createDataFrame(values, "a long, b int").select(F.struct("a", "b").alias("key")).cache()
    for k in (1, 2, 57, 399, 400):
        assert tuple(ranks.kth_key(rows, "key", k, pivots=3)) == sorted(values)[k - 1]
    assert ranks.kth_key(rows, "key", 0) is None and ranks.kth_key(rows, "key", 401) is None


def test_numbers_of_hot_and_null_groups(spark):
    rows = [(["hot", None, "b"][0 if i % 3 else i % 9 // 3], i * 7 % 100) for i in range(500)]
    out = ranks.numbered(spark.createDataFrame(rows, "g string, v int"), "g", ["v"], "at", "n").collect()
    for g in ("hot", None, "b"):
        mine = sorted((r["at"], r["v"]) for r in out if r["g"] == g)
        assert [a for a, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)
        assert {r["n"] for r in out if r["g"] == g} == {len(mine)}


# --- nearest neighbours ---------------------------------------------------------------------------------------


VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("rank", T.StringType()), T.StructField("cid", T.IntegerType()),
])


def frame(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "r", 2) for i, v in vectors]
    return spark.createDataFrame(rows, VECTORS)


def brute_nearest(vectors, every=20, nearest=20):
    """{query: [(id, score)]} among usable vectors of the same length."""
    good = {i: np.array(v, np.float32).astype(float) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good.items():
        if q % every == 0:
            score = [(float((w * v).sum()), i) for i, w in good.items() if i != q and len(w) == len(v)]
            out[q] = [(i, s) for s, i in sorted(score, key=lambda x: (-x[0], x[1]))[:nearest]]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_nearest_of_odd_vectors(spark):
    """Few vectors are one list, so the result is exact."""
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=4).round(1) * (1 + i % 7)) for i in range(1, 200)]
    same = vectors[19][1]
    vectors = [(i, v.tolist()) for i, v in vectors] + [(1000 + i, same.tolist()) for i in range(60)]
    vectors += [(0, None), (2000, []), (2020, [0.0, 0, 0, 0]), (2040, [1.0, None, 0, 0]), (2060, [float("nan"), 1, 1, 1]), (2080, [float("inf"), 1, 1, 1])]
    vectors += [(3000, [1.0, 2.0]), (3001, [0.5, 0.5]), (3020, [-1.0, 0.0]), (4000, [1.0]), (None, [1.0, 1, 1, 1]), (-20, [-0.0, 1, 0, 0]), (-21, [0.0, 1, 0, 0])]
    got = by_query(ann.nearest_by_product(frame(spark, [*vectors, vectors[30]])))
    want = {q: x for q, x in brute_nearest(vectors).items() if x}
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a - b) < 1e-9 for q in got for (_, a), (_, b) in zip(got[q], want[q], strict=True))
    assert len(got[3000]) == 2 and 4000 not in got


def test_nearest_of_no_vectors(spark):
    assert ann.nearest_by_product(frame(spark, [])).count() == 0
    assert ann.nearest_by_product(frame(spark, [(0, None), (20, [1.0])])).count() == 0


def clustered(n, dim, rng, sizes=False):
    centres = rng.normal(size=(30, dim))
    v = centres[rng.integers(0, 30, n)] + 0.5 * rng.normal(size=(n, dim))
    return v * rng.uniform(0.2, 3, (n, 1)) if sizes else v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("sizes", [False, True])
def test_recall_of_lists(spark, sizes):
    """Several lists, a third of all rows equal, vectors of length one and of any length."""
    v = clustered(3000, 16, np.random.default_rng(5), sizes)
    v[2000:] = v[2000]
    vectors = [(i, x.tolist()) for i, x in enumerate(v)]
    got, want = by_query(ann.nearest_by_product(frame(spark, vectors))), brute_nearest(vectors)
    assert got.keys() == want.keys() and {len(x) for x in got.values()} == {20}
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    exact = {(q, i): s for q, x in brute_nearest(vectors, nearest=3000).items() for i, s in x}
    assert all(abs(exact[q, i] - s) < 1e-9 for q, x in got.items() for i, s in x)
    assert all(x == sorted(x, key=lambda p: (-p[1], p[0])) for x in got.values())


def test_lists_are_balanced_and_cover_every_vector():
    rng = np.random.default_rng(3)
    points = np.concatenate([clustered(2000, 8, rng), np.tile(rng.normal(size=8), (500, 1)) + 1e-6 * rng.normal(size=(500, 8))])
    longest = float(np.linalg.norm(points, axis=1).max())
    index = ann.fit(points, 10 * len(points), 1.0, longest, 20, 0.95)
    assert len(index.centres) >= 10 * len(points) / ann.PER_LIST
    lists = index.place(index.stored(points))
    assert all(1 <= len(x) <= ann.COPIES and len(set(x.tolist())) == len(x) for x in lists)
    d = ann.distances(index.stored(points), index.centres)
    assert all(x[0] == row.argmin() or row[x[0]] == row.min() for x, row in zip(lists, d, strict=True))
    assert any(len(x) > 1 for x in lists)


def test_the_walk_finds_the_nearest_centroids():
    centres = clustered(600, 8, np.random.default_rng(8))
    index = ann.Index(centres, *ann.graph(centres), 1.0, 1.0)
    points = clustered(100, 8, np.random.default_rng(9))
    names, d = index.walk(points)
    true = np.argsort(ann.distances(points, centres), axis=1)
    assert np.mean([len(set(a[:10].tolist()) & set(b[:10].tolist())) / 10 for a, b in zip(names, true, strict=True)]) > 0.97
    assert (np.diff(d, axis=1)[np.isfinite(d[:, 1:])] >= 0).all()


def test_large_lists_meet_in_blocks(spark, monkeypatch):
    vectors = [(i, x.tolist()) for i, x in enumerate(clustered(200, 4, np.random.default_rng(1)))]
    want = by_query(ann.nearest_by_product(frame(spark, vectors)))
    monkeypatch.setattr(ann, "POSTINGS", 30)
    monkeypatch.setattr(ann, "QUERIES", 3)
    monkeypatch.setattr(ann, "BROADCAST_ANSWERS", 0)
    assert by_query(ann.nearest_by_product(frame(spark, vectors))) == want == {q: x for q, x in by_query(ann.nearest_by_product(frame(spark, vectors))).items()}


def of_many_sizes(n, dim, rng):
    v = rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True) * np.exp(rng.normal(size=(n, 1)))


def elsewhere(n, dim, rng):
    """Narrow groups, but queries anywhere."""
    v = 3 * rng.normal(size=(60, dim))[rng.integers(0, 60, n)] + 0.1 * rng.normal(size=(n, dim))
    v[::20] = rng.normal(size=(len(v[::20]), dim))
    return v


@pytest.mark.parametrize("make", [of_many_sizes, elsewhere])
def test_recall_among_many_lists(spark, monkeypatch, make):
    monkeypatch.setattr(ann, "PER_LIST", 40)
    vectors = [(i, x.tolist()) for i, x in enumerate(make(6000, 32, np.random.default_rng(6)))]
    got, want = by_query(ann.nearest_by_product(frame(spark, vectors))), brute_nearest(vectors)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_links_lead_to_every_centroid():
    """The longest ones are near to no other."""
    links, starts = ann.graph(of_many_sizes(600, 32, np.random.default_rng(4)))
    met = set(starts.tolist())
    edge = list(met)
    while edge:
        edge = [j for j in set(links[edge].ravel().tolist()) if j not in met]
        met |= set(edge)
    assert len(met) == 600
