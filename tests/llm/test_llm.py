"""The operators of the llm subpackage against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("herdwatch.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from herdwatch.llm import (  # noqa: E402
    chat, common, decontam, langid, linedup, mixing, neardup, queries, tokenbin, tokencount, toxicity, vectors,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, id int, n string, key long, start int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def token_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def texts():
    """Ordinary, empty, blank, short, very long, copied, near and odd texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(40)]
    near = []
    for text in base[:15]:
        for _ in range(3):
            parts = text.split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            near.append(" ".join(parts))
    long = " ".join(rng.choices(words, k=20_000))
    return [None, "", " \n ", "one", "One", "ÀÉ İ ß", "a  b\tc\n", long, long + " end", *base, *base[:10], *near]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts in rows with clashing columns, a repeated row and rows without an id."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "é"][i % 4 if i % 5 else 0], 1, 2, 3, "4", 5, 6) for i, t in enumerate(texts())]
    rows += [rows[12], rows[1], (None, "one", "en", "a", 1, 2, 3, "4", 5, 6), (None, None, None, None, 1, 2, 3, "4", 5, 6)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


# --- near-duplicates ---------------------------------------------------------------------------------------


def brute_components(rows):
    """Least reachable id by exact similarity of shingle sets; rows (id, text)."""
    sets = {}
    for i, text in rows:
        w = plain_words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                u, v = find(parent, a), find(parent, b)
                parent[max(u, v)] = min(u, v)
    return sets, {i: find(parent, i) for i in sets}


def test_near_duplicates_match_brute_force(docs):
    out = neardup.near_duplicates(docs).collect()
    sets, want = brute_components([(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()])
    assert len(out) == docs.count()
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], len(sets[r["doc_id"]]), want[r["doc_id"]] == r["doc_id"])
    assert len({want[i] for i in want}) < len(want)


def test_near_duplicates_of_blocks_and_chains(spark, monkeypatch):
    """A bucket larger than a block, and a chain whose ends are not similar."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    words = [f"x{i}" for i in range(120)]
    rows = []
    for step in range(12):
        for k in range(5):
            changed = [f"y{i}" if i < 3 * step else w for i, w in enumerate(words)]
            changed[60 + k] = f"z{k}"
            rows.append((step * 5 + k, " ".join(changed)))
    out = by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    _, want = brute_components(rows)
    assert {i: r["component_id"] for i, r in out.items()} == want


def test_sketch_coordinates_agree_like_the_sets():
    rng = np.random.default_rng(3)
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (300, 50, 50))
    values = np.concatenate([shared, a, shared, b])
    one, two = neardup.sketches(values, np.array([350, 350]), 1024)
    assert (one != neardup.MAX).all() and abs((one == two).mean() - 0.75) < 0.05
    single = neardup.sketches(values[:1], np.array([1, 0]), 64)
    assert (single[0] != neardup.MAX).all() and (single[1] == neardup.MAX).all()


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 300), (7, 7)]
    got = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100}


# --- decontamination ---------------------------------------------------------------------------------------


def brute_contamination(text, items):
    w = token_words(text)
    hit, found = set(), []
    for item, item_text in items:
        iw = token_words(item_text)
        n = min(13, len(iw))
        at = [
            s for k in range(max(len(iw) - 12, 1)) if iw for s in range(len(w) - n + 1) if w[s : s + n] == iw[k : k + n]
        ]
        if at:
            found.append(str(item))
            hit.update(p for s in at for p in range(s, s + n))
    found.sort()
    return len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(2)
    words = [f"b{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([1, 2, 4, 5, 12, 13, 14, 40, 40])]
    items += [(20, items[8][1]), (21, None), (22, "  ."), (23, "Same same same same same same"), (24, "İİ É")]
    rows = [(0, None), (1, ""), (2, "b3"), (3, "same " * 40), (4, "İİ É"), (5, "ii é")]
    for i in range(6, 60):
        own = rng.choices(words, k=rng.randint(0, 30))
        piece = token_words(rng.choice(items)[1])
        rows.append((i, " ".join([*own, *piece[rng.randint(0, 3) :], *rng.choices(words + ["zz"], k=rng.randint(0, 300))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", common.F.lit(1)).withColumn("pos", common.F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("win", common.F.lit(0))
    out = by_id(decontam.decontaminate(df, bench))
    for i, text in rows:
        r = out[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute_contamination(text, items), i
    assert sum(r["contaminated"] for r in out.values()) > 10


def test_decontamination_of_odd_tables(spark, docs, empty):
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    out = decontam.decontaminate(docs, bench).collect()
    assert len(out) == docs.select("doc_id").distinct().count()
    nameless = [r for r in out if r["doc_id"] is None]
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in nameless] == [(1, 1, True)]
    assert decontam.decontaminate(empty, bench).count() == 0
    clean = decontam.decontaminate(docs, bench.limit(0)).collect()
    assert len(clean) == len(out) and not any(r["n_hit"] for r in clean)


def test_decontamination_without_broadcast(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, "one"), (2, texts()[12])], "item_id long, text string")
    want = sorted(map(str, decontam.decontaminate(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_SHINGLES", 0)
    assert sorted(map(str, decontam.decontaminate(docs, bench).collect())) == want


# --- chat ----------------------------------------------------------------------------------------------------


ODD = ["", "\\", "</turn>\n", "<turn user>\nx</turn>\n", "\\### Assistant: </turn> ok", "a<b", "\\l", "\n", "\\\\<<turn"]


@pytest.mark.parametrize("text", ODD)
def test_tagged_template_is_reversible(text):
    turns = [("user", text), ("a>b\n<", text), ("assistant", text)]
    formatted, spans, rewritten = chat.locate(turns, chat.tagged)
    assert chat.read_tagged(formatted) == turns and rewritten == -1
    assert [chat.unescape(formatted[s[1] : s[2]]) for s in spans] == [text] * 3


def test_templates_that_rewrite_history_are_found():
    def last_only(turns):
        return "".join(f"[{r}]{t if k == len(turns) - 1 else ''}" for k, (r, t) in enumerate(turns))

    assert chat.locate([("u", "a"), ("v", "b")], last_only)[1:] == ([None, None], 1)
    assert chat.locate([("u", "a")], last_only)[1:] == ([(0, 3, 4, 4)], -1)
    assert chat.locate([], chat.tagged) == ("", [], -1)


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (None, None, None, "x"), (2, 0, "assistant", "y" * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, formatted string")
    made = chat.format_conversations(df)
    out = by_id(chat.digests(made), "conv_id")
    assert (out[1]["n_turns"], out[1]["loss_chars"], out[1]["loss_sha256"]) == (4, 3, hashlib.sha256(b"abb").hexdigest())
    assert out[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert out[None]["n_turns"] == 1 and out[2]["loss_chars"] == 100_000
    assert chat.format_conversations(df.limit(0)).count() == 0


# --- vectors -------------------------------------------------------------------------------------------------


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "PER_CELL", 6)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    rows = []
    for i in range(300):
        v = base[i % 30] * rng.uniform(0.5, 3) + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.3])
        rows.append((i, [float(x) for x in v], int(i % 30 < 20)))
    rows += [(300 + i, rows[0][1], 1) for i in range(60)]
    bad = [(400, None, 1), (401, [0.0] * 16, 1), (402, [None] * 16, 1), (403, [float("nan")] * 16, 1), (404, [float("inf")] * 16, 1), (405, rows[0][1], None), (406, [], 1), (407, rows[0][1][:4], 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows + bad + rows[:1]], "vec_id long, embedding array<double>, label int, cell string, id int")
    out = vectors.near_vectors(df).collect()
    unit = np.stack([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    parent = {r[0]: r[0] for r in rows}
    for a, b in zip(*np.nonzero(linked), strict=True):
        u, v = find(parent, rows[a][0]), find(parent, rows[b][0])
        parent[max(u, v)] = min(u, v)
    want = {r[0]: (int(linked[k].sum()), find(parent, r[0])) for k, r in enumerate(rows)}
    assert len(out) == len(rows) + len(bad) + 1 and linked.sum() > 5_000
    for r in out:
        assert (r["n_links"], r["component_id"]) == want.get(r["vec_id"], (0, r["vec_id"]))
        assert r["kept"] == (r["vec_id"] == r["component_id"] if r["vec_id"] is not None else True)
    assert vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("per_cell", [6, 1000])
def test_vectors_of_several_lengths(spark, monkeypatch, per_cell):
    """Each length's links are those of brute force, whichever row is drawn first."""
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "PER_CELL", per_cell)
    rng = np.random.default_rng(8)
    rows = []
    for dim, many in ((16, 150), (7, 80), (1, 20), (24, 2), (5, 1)):
        base = rng.normal(size=(max(many // 8, 1), dim))
        for _ in range(many):
            v = base[len(rows) % len(base)] * rng.uniform(0.5, 3) + rng.normal(size=dim) * 0.02
            rows.append((len(rows), [float(x) for x in v], len(rows) % 2 if many > 2 else 1))
    out = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    links, parent = collections.Counter(), {r[0]: r[0] for r in rows}
    for i, x, a in rows:
        for j, y, b in rows:
            if i < j and a == b and len(x) == len(y) and np.dot(x, y) >= 0.98 * np.linalg.norm(x) * np.linalg.norm(y):
                links[i] += 1
                links[j] += 1
                u, v = find(parent, i), find(parent, j)
                parent[max(u, v)] = min(u, v)
    assert {len(rows[i][1]) for i in links} == {16, 7, 1, 24} and len(out) == len(rows)
    for r in out:
        assert (r["n_links"], r["component_id"]) == (links[r["vec_id"]], find(parent, r["vec_id"]))


def test_traversal_is_in_order_and_complete():
    rng = np.random.default_rng(1)
    a, b = rng.uniform(size=7), rng.uniform(size=5)
    cells = list(vectors.traverse(a, b, 0.9))
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and set(cells) == {(i, j) for i in range(7) for j in range(5) if a[i] + b[j] <= 0.9}


def test_lower_recall_target_is_met_on_the_sample():
    rng = np.random.default_rng(2)
    x = vectors.unit(np.repeat(rng.normal(size=(40, 8)), 10, axis=0) + rng.normal(size=(400, 8)) * 0.03)
    books, stop = vectors.fit(x, 6, 0.98, 0.9)
    (own1, h1), (own2, h2) = vectors.bounds(x[:, :4], books[0]), vectors.bounds(x[:, 4:], books[1])
    i, j = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    assert (h1[i, own1[j]] + h2[i, own2[j]] <= stop + 1e-12).mean() >= 0.88


# --- token ids and counts ------------------------------------------------------------------------------------


def test_blocks_decode_from_any_checkpoint():
    rng = np.random.default_rng(9)
    for n in (0, 1, 255, 300_000):
        ids = np.minimum(rng.zipf(1.2, n), 50_000)
        coder = tokenbin.Coder(tokenbin.frequencies(np.bincount(ids, minlength=50_001)))
        lanes, payload, marks = coder.encode(ids)
        assert (coder.decode(n, lanes, payload, marks) == ids).all()
        for begin in (0, n // 3, 2 * n // 3):
            assert (coder.decode(n, lanes, payload, marks, begin, begin + 77) == ids[begin : begin + 77]).all()


def library_ids(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows]


def test_token_files_hold_the_librarys_ids(spark, docs, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenbin, "BLOCK", 3_000)
    path, file = str(tmp_path / "tokens"), public_tokenizers.path("byte_bpe_50k.json")
    tokenbin.write_tokens(docs, path, file)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in tokenbin.read_tokens(spark, path, with_ids=True).collect()), key=lambda x: x[0])
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1] or "")))
    at = 0
    for (doc_id, _), ids, found in zip(rows, library_ids(rows), got, strict=True):
        assert found == (at, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    tokenbin.write_tokens(empty, f"{path}-none", file)
    assert tokenbin.read_tokens(spark, f"{path}-none").count() == 0


def odd_texts(n):
    rng = random.Random(8)
    parts = ["a", "b", " ", "  ", "\n", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "é", "汉", "😀", "\x00", "\x1c", "'s", "'re", " the", " ", "\t", ".", ",", "1", "²", "́", "▁", "ﬁ", "aaa"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_pieces_give_the_ids_of_whole_texts():
    encode = tokenbin.Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode
    rows = [(0, t) for t in odd_texts(3_000)]
    for (_, text), ids in zip(rows, library_ids(rows), strict=True):
        assert encode(text) == np.array(ids[:-1], "<u4").tobytes(), text


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = tokenbin.Encoder(file), Tokenizer.from_file(file)
    assert not encoder.by_piece
    for text in odd_texts(200):
        assert encoder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_token_counts_match_the_library(docs, empty):
    counter = tokencount.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    for text in odd_texts(3_000):
        assert counter.count(text) == len(counter.model.encode(text)), text
    out = tokencount.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(counter.model.encode(r["text"] or "")), n > 4096) for r in docs.collect())
    assert collections.Counter(map(tuple, out)) == want
    assert tokencount.count_tokens(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_merging_stays_right_when_memory_is_short(monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 3)
    counter = tokencount.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    for text in odd_texts(200):
        assert counter.count(text) == len(counter.model.encode(text))


# --- toxicity and language -------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score_toxicity(rows, labels).where("held_out").join(labels, "doc_id").select("toxic", "score", "predicted").toPandas()
    rank = out["score"].rank()
    toxic = out["toxic"] == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.97 and out["score"].between(0, 1).all()
    assert out.loc[~toxic, "predicted"].mean() < 0.01 and out.loc[toxic, "predicted"].mean() > 0.8


def test_toxicity_of_odd_tables(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, labels).count() == 0


def plain_ratios(rows, asked):
    """log P_toxic - log P_ordinary of each asked word, from the counts of all rows (text, toxic), by the module's formulas."""
    d = toxicity.DISCOUNT
    counts = [collections.Counter(w for text, toxic in rows if toxic == c for w in token_words(text)) for c in (1, 0)]
    stems = [collections.Counter() for _ in counts]
    held = [collections.Counter() for _ in counts]
    for c, count in enumerate(counts):
        for w, n in count.items():
            stems[c][w[:4]] += n
            held[c][w[:4]] += min(n, d)
    known = counts[0].keys() | counts[1].keys()
    endings = collections.Counter(w[4:] for w in known)
    total = [sum(c.values()) for c in counts]
    out = {}
    for w in asked:
        log = []
        p_stem = (stems[0][w[:4]] + stems[1][w[:4]] + 0.5) / (sum(total) + 1)
        p_rest = (endings[w[4:]] + 0.5) / (len(known) + 1)
        for c in (0, 1):
            s = stems[c][w[:4]]
            first = (max(s - d, 0) + (sum(min(n, d) for n in stems[c].values()) + 1) * p_stem) / (total[c] + 1)
            second = (max(counts[c][w] - d, 0) + held[c][w[:4]] * p_rest) / s if s else p_rest
            log.append(np.log(first) + np.log(second))
        out[w] = log[0] - log[1]
    return out


@pytest.mark.parametrize("bounds", [(300_000, 100_000), (40, 20), (0, 0)])
def test_every_counted_word_is_scored(spark, monkeypatch, bounds):
    """However few entries are broadcast, each word has the score of its full counts."""
    monkeypatch.setattr(toxicity, "MOST_WORDS", bounds[0])
    monkeypatch.setattr(toxicity, "MOST_STEMS", bounds[1])
    rng = random.Random(9)
    names = ["".join(rng.choices("abc", k=rng.randint(1, 5))) + rng.choice(["", "ing", "er", "x"]) for _ in range(300)]
    rows = [(" ".join(rng.choices(names, [1 / (i + 1) for i in range(300)], k=30)), int(i % 4 == 0)) for i in range(80)]
    asked = sorted({*names, "zzzz", "abcazz", "a"})
    want = plain_ratios(rows, asked)
    made = toxicity.count_model(spark.createDataFrame(rows, "_text string, toxic int"))
    model, rest = made if isinstance(made, tuple) else (made, ())
    texts = [(w, w) for w in [*asked, *asked[:3]]] + [("", ""), (None, None)]
    docs = spark.createDataFrame(texts, "id string, _text string")
    # A text of one word has that word's ratio as its first feature.
    got = (toxicity.featured(docs, model, rest, "id") if rest != () else toxicity.featured(docs, model, "id")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["f0"] == pytest.approx(want[r["id"]] if r["id"] else 0, abs=1e-9), r["id"]


def test_language_on_held_out_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(rows).join(rows.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.98
    assert np.mean([r["rejected"] for r in out]) < 0.01
    assert langid.identify(rows).where("lang_pred = 'fr'").count() > 100


def test_language_sample_is_bounded_in_bytes(spark, monkeypatch):
    """What the driver gets of a very long text is one count per bucket; a repeated id counts once."""
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(20_000))
    rows = [(i, long if i < 3 else f"some text {i}", "en" if i % 2 else "fr") for i in range(40)] + [(4, f"again {i}", "fr") for i in range(500)]
    seen = []
    monkeypatch.setattr(langid, "train", lambda bags, *_: seen.extend(bags))
    langid.fit_on(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    free = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(40))
    assert len(seen) == free and all(np.size(b) <= 2 * langid.BUCKETS for b in seen)


def test_language_of_odd_tables(spark, docs, empty):
    out = langid.identify(docs).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    assert len(out) == docs.count()
    for r in out:
        if r["doc_id"] is not None:
            bare = not re.search(r"[^\W\d_]", text[r["doc_id"]] or "")
            assert (r["lang_pred"] == "und") == bare and (not bare or r["rejected"])
            assert r["lang_pred"] in ("en", "fr", "und")
    assert langid.identify(empty).count() == 0
    unlabelled = langid.identify(docs.withColumn("lang", common.F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


# --- lines and mixing --------------------------------------------------------------------------------------------


def test_boilerplate_lines(spark, empty):
    rows = [(i, f" Cookie notice \nown line {i}\n\n  \nshared by {i % 4}\n", f"site{i % 7}") for i in range(40)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "Cookie notice", None), (None, "Cookie notice\nleft", "y"), rows[0]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, pos int")
    sites = collections.defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip() and site:
                sites[line.strip()].add(site)
    boiler = {k for k, v in sites.items() if len(v) >= 5}
    assert "Cookie notice" in boiler and any(5 <= len(v) <= 8 for v in sites.values())
    got = collections.Counter((r["doc_id"], r["n_lines"], r["n_boiler"], r["text"]) for r in linedup.drop_boilerplate(df).collect())
    want = collections.Counter()
    for i, text, _ in rows:
        lines = [] if text is None else text.split("\n")
        rest = [line for line in lines if line.strip() not in boiler]
        want[i, len(lines), len(lines) - len(rest), None if text is None else "\n".join(rest)] += 1
    assert got == want
    assert linedup.drop_boilerplate(empty).count() == 0


def water(sizes, weights, share, most):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(full.values())
        part = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if part[s] > most * sizes[s]]
        if not over:
            return {**full, **part}
        full.update({s: most * sizes[s] for s in over})


def test_mix_meets_its_targets(docs, empty):
    out = mixing.mix(docs).collect()
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    source = {r["doc_id"]: r["source"] for r in docs.where("doc_id is not null").collect()}
    rows = docs.collect()
    for r in rows:
        sizes[r["source"]] += len(plain_words(r["text"]))
    want = water(sizes, (3, 1, 2), 1.5, 2)
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is not None:
            s = source[r["doc_id"]]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
            assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2
            taken[s] += r["taken"]
            largest[s] = max(largest[s], r["size"])
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(largest[s], 1) * 2 + 2
    assert collections.Counter(map(tuple, mixing.mix(docs.repartition(7)).collect())) == collections.Counter(map(tuple, out))
    assert mixing.mix(empty).count() == 0


def test_mixed_rows_follow_the_counts(docs):
    counts = collections.Counter()
    for r in mixing.mix(docs).collect():
        counts[r["doc_id"]] += r["copies"]
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in got.collect()) == +counts


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages_against_brute_force(spark, data):
    now = spark.read.parquet(f"{data}/documents.parquet")
    columns, got = now.columns, {}
    rows = {r["doc_id"]: r["text"] for r in now.collect()}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.write_and_read(stage(spark, now, data), "test")
        got[name] = now.collect()
        if name != "token_binary":
            assert now.columns == columns
    known = {r["doc_id"] for r in got["language_id"]}
    bare = {i for i, t in rows.items() if not re.search(r"[^\W\d_]", t or "")}
    assert known <= set(rows) - bare and len(known) >= 0.99 * (len(rows) - len(bare))
    _, component = brute_components([(i, rows[i]) for i in known])
    unique = {i for i in known if component[i] == i}
    assert {r["doc_id"] for r in got["minhash_dedup"]} == unique
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = {i for i in unique if not brute_contamination(rows[i], items)[4]}
    assert {r["doc_id"] for r in got["decontaminate"]} == clean
    mixture = [(r["doc_id"], r["text"]) for r in got["mix_sources"]]
    assert {i for i, _ in mixture} <= clean and max(collections.Counter(i for i, _ in mixture).values()) <= 2
    at, want = 0, collections.Counter()
    mixture.sort(key=lambda r: r[0])
    for (i, _), ids in zip(mixture, library_ids(mixture), strict=True):
        want[i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    assert collections.Counter(map(tuple, got["token_binary"])) == want


def test_pipeline_of_odd_tables(spark, docs, empty, data):
    for rows in (docs, empty):
        now = rows
        for _, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.write_and_read(stage(spark, now, data), "test")
        assert (now.count() > 0) == (rows is docs)


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
