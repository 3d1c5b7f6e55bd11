"""Long conversations in ranges, vectors of extreme size, columns with the names of working columns."""

import math
import random

import pytest

pytest.importorskip("herdwatch.llm")

from herdwatch.llm import chat, mixing, vectors  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def templates():
    """By name; made inside a function, so that they travel to the workers."""

    def rewriting(turns):
        # Keeps only the last three turns: rewrites history from the fourth on.
        return chat.tagged(turns[-3:])

    def closing(turns):
        # The output ends with a mark that the next turn moves.
        return chat.tagged(turns) + ("END" if len(turns) > 7 else "")

    return {"tagged": chat.tagged, "rewriting": rewriting, "closing": closing}


@pytest.mark.parametrize("name", ["tagged", "rewriting", "closing"])
def test_long_conversations_are_rendered_in_ranges(spark, monkeypatch, name):
    template = templates()[name]
    rng = random.Random(3)
    rows = []
    for conv, n in ((1, 3), (2, 4), (3, 5), (4, 23), (5, 40), (None, 17)):
        rows += [(conv, i, ["user", "assistant"][i % 2], "".join(rng.choices("ab\\<turn >\n", k=rng.randint(0, 9)))) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    plain = {r["conv_id"]: r for r in chat.format_conversations(df, template).collect()}
    monkeypatch.setattr(chat, "TURNS", 4)
    cut = {r["conv_id"]: r for r in chat.format_conversations(df, template).collect()}
    assert cut.keys() == plain.keys()
    for conv, r in plain.items():
        assert (cut[conv]["formatted"], cut[conv]["spans"], cut[conv]["loss"], cut[conv]["rewritten"]) == (r["formatted"], r["spans"], r["loss"], r["rewritten"]), conv
    if name == "tagged":
        digest = {r["conv_id"]: r["n_turns"] for r in chat.digests(chat.format_conversations(df)).collect()}
        assert digest == {1: 3, 2: 4, 3: 5, 4: 23, 5: 40, None: 17}


def test_ranges_say_what_the_whole_says():
    turns = [("user", f"t{i}") for i in range(9)]
    for template in templates().values():
        output, spans, rewritten = chat.compare(turns, template, 0, 9)
        parts = [chat.compare(turns[:b], template, a, b) for a, b in ((0, 4), (4, 8), (8, 9))]
        assert parts[-1][0] == output and [s for p in parts for s in p[1]] == spans
        assert min([p[2] for p in parts if p[2] >= 0], default=-1) == rewritten


def test_vectors_of_extreme_size(spark):
    """Cosines do not depend on lengths, however large or small."""
    items = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1e-200, 1e-201]), (4, [5e-324, 5e-324]), (5, [1e300, -1e300]), (6, [1.0, 1.0]), (7, [3.0, 0.3])]
    df = spark.createDataFrame([(i, v, 1) for i, v in items], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()}
    unit = {i: [x / max(map(abs, v)) for x in v] for i, v in items}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    for i in unit:
        near = [j for j in unit if j != i and cosine(unit[i], unit[j]) >= 0.98]
        assert got[i] == (len(near), min([i, *near])), i
    assert got[1] == (3, 1) and got[3] == (1, 3)


def test_columns_named_like_working_columns_come_back(spark):
    names = ("_mix_bin", "_mix_copies", "_mix_id", "_mix_source", "_mix_key", "_in_0", "_mix_each", "a.b")
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2], *[str(77 + i)] * len(names)) for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"`{n}` string" for n in names]]))
    out = mixing.mixed(df)
    assert out.columns == df.columns
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    got = out.collect()
    assert len(got) == sum(taken.values()) and len(got) > 60
    for r in got:
        assert {r[n] for n in names} == {str(77 + r["doc_id"])}
    weighed = mixing.mixed(df, quality=F.col("doc_id") + 1.0)
    assert weighed.columns == df.columns and weighed.count() > 60
