"""Chat formatting by incremental black-box rendering.

A template is any function from turns (role, text) to a string. The formatter knows nothing about it: it renders
the first turn, the first two turns and so on. If an output starts with the one before, the rest is the new turn's
span; if not, the template has rewritten history, and from there on no span can be given. Inside a span the text
is found by a second rendering with a probe instead of the text: what stands before and after the probe is the
turn's frame.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Template = Callable[[list[tuple[str, str]]], str]

# Turns of a conversation that are rendered in one task.
TURNS = 200

PROBE = "\ue000probe\ue001"

# Fixed values of the tagged template: its control strings and their escapes inside texts and roles.
OPEN, HEAD_END, CLOSE = "<turn ", ">\n", "</turn>\n"
ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g", "\n": "\\n"}


def escape(text: str) -> str:
    """Takes the control strings out of a text: a backslash is doubled, "<" before turn or /turn becomes \\l."""
    return re.sub(r"\\|<(?=/?turn)", lambda m: ESCAPES[m[0]], text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\<>\n]", lambda m: ESCAPES[m[0]], role)


def unescape(text: str) -> str:
    back = {v[1]: k for k, v in ESCAPES.items()}
    return re.sub(r"\\(.)", lambda m: back[m[1]], text, flags=re.S)


def tagged(turns: list[tuple[str, str]]) -> str:
    """<turn role>, the escaped text, </turn>: the template of the query."""
    return "".join(f"{OPEN}{escape_role(role)}{HEAD_END}{escape(text)}{CLOSE}" for role, text in turns)


def read_tagged(formatted: str) -> list[tuple[str, str]]:
    """The turns of a tagged text."""
    found = re.findall(r"<turn ([^>]*)>\n(.*?)</turn>\n", formatted, flags=re.S)
    return [(unescape(role), unescape(text)) for role, text in found]


Span = tuple[int, int, int, int] | None


def compare(turns: list[tuple[str, str]], template: Template, first: int, last: int) -> tuple[str, list[Span], int]:
    """The output of the first ``last`` turns, the spans of turns ``first`` to ``last``, and the first that rewrote history.

    Each output is compared with the one before it; the work on one turn does not depend on the others.
    """
    spans: list[Span] = []
    before, rewritten = template(turns[:first]) if turns else "", -1
    for i in range(first + 1, last + 1):
        output = template(turns[:i])
        if not output.startswith(before):
            rewritten = i - 1 if rewritten < 0 else rewritten
            spans.append(None)
        else:
            probed = template([*turns[: i - 1], (turns[i - 1][0], PROBE)])
            at = probed.find(PROBE, len(before))
            tail = len(probed) - at - len(PROBE)
            same = at >= 0 and output[:at] == probed[:at] and (not tail or output.endswith(probed[-tail:])) and at + tail <= len(output)
            spans.append((len(before), at, len(output) - tail, len(output)) if same else None)
        before = output
    return before, spans, rewritten


def settled(output: str, spans: list[Span], rewritten: int, at_rewriting: str | None) -> list[Span]:
    """The spans that hold in the final output: none from the first rewriting turn on.

    If the output no longer starts with what the turns before it gave (``at_rewriting``), none holds.
    """
    if rewritten < 0:
        return spans
    if not output.startswith(at_rewriting):
        return [None] * len(spans)
    return spans[:rewritten] + [None] * (len(spans) - rewritten)


def locate(turns: list[tuple[str, str]], template: Template) -> tuple[str, list[Span], int]:
    """The output, each turn's (start, text start, text end, end), and the first turn that rewrote history (or -1).

    Spans count code points of the final output. From the first rewriting turn on they are None, and so are
    the earlier ones if the final output no longer starts with what they describe.
    """
    output, spans, rewritten = compare(turns, template, 0, len(turns))
    return output, settled(output, spans, rewritten, template(turns[:rewritten]) if rewritten >= 0 else None), rewritten


def format_conversations(
    rows: DataFrame, template: Template = tagged, learn: str = "assistant",
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Rows (id_col, formatted, spans, loss, rewritten), one per conversation.

    Turns are ordered by turn number, ties by role and then text; a null number comes first, a null role or text
    is empty, rows with a null id are one conversation, repeated rows are repeated turns. spans has (role, start,
    text_start, text_end, end) per turn, null where the template rewrote history; loss has (start, end) of the
    texts of ``learn`` turns; rewritten is the first turn at which history changed, or -1. Positions are code
    points. An empty table gives no rows, other columns are not looked at.

    Rendering every prefix takes time with the square of the turns: a conversation of more than ``TURNS`` is cut into
    ranges of turns that are rendered in tasks of their own, and only what they found is put together in one row.
    """
    turns = rows.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    kind = dict(grouped.dtypes)["id"]
    spans_type = "array<struct<role:string,start:long,text_start:long,text_end:long,end:long>>"
    schema = f"`{id_col}` {kind}, formatted string, spans {spans_type}, loss array<struct<start:long,end:long>>, rewritten long"

    def columns(formatted: str, roles: list[str], spans: list[Span], rewritten: int) -> dict:
        names = ("role", "start", "text_start", "text_end", "end")
        return {
            "formatted": formatted, "rewritten": rewritten,
            "spans": [None if s is None else dict(zip(names, (role, *s), strict=True)) for role, s in zip(roles, spans, strict=True)],
            "loss": [{"start": s[1], "end": s[2]} for role, s in zip(roles, spans, strict=True) if s and role == learn],
        }

    def said(turns) -> list[tuple[str, str]]:
        return [(t["role"], t["text"]) for t in turns]

    def whole(batches):
        for pdf in batches:
            out = []
            for turns in map(said, pdf["turns"]):
                formatted, spans, rewritten = locate(turns, template)
                out.append(columns(formatted, [role for role, _ in turns], spans, rewritten))
            yield pdf[["id"]].assign(**{c: [r[c] for r in out] for c in ("formatted", "spans", "loss", "rewritten")}).rename(columns={"id": id_col})

    def in_range(batches):
        """One range of a conversation's turns; the last one gives the output, a rewriting one what stood before it."""
        for pdf in batches:
            out = {"last": [], "found": [], "rewritten": [], "roles": [], "before": []}
            for turns, first, n in zip(map(said, pdf["turns"]), pdf["first"], pdf["n"], strict=True):
                output, spans, rewritten = compare(turns, template, int(first), len(turns))
                out["last"].append(output if len(turns) == n else None)
                out["found"].append([None if s is None else list(s) for s in spans])
                out["rewritten"].append(rewritten)
                out["roles"].append([role for role, _ in turns[int(first) :]])
                out["before"].append(template(turns[:rewritten]) if rewritten >= 0 else None)
            yield pdf[["id", "first"]].assign(**out)

    def together(batches):
        for pdf in batches:
            out = []
            for parts in pdf["parts"]:
                spans = [None if s is None else tuple(s) for p in parts for s in p["found"]]
                broken = [p for p in parts if p["rewritten"] >= 0]
                formatted, rewritten = parts[-1]["last"], broken[0]["rewritten"] if broken else -1
                spans = settled(formatted, spans, rewritten, broken[0]["before"] if broken else None)
                out.append(columns(formatted, [r for p in parts for r in p["roles"]], spans, rewritten))
            yield pdf[["id"]].assign(**{c: [r[c] for r in out] for c in ("formatted", "spans", "loss", "rewritten")}).rename(columns={"id": id_col})

    short = grouped.where(F.size("turns") <= TURNS).mapInPandas(whole, schema)
    long = grouped.where(F.size("turns") > TURNS).withColumn("n", F.size("turns"))
    ranges = long.select("id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(TURNS))).alias("first"), "turns")
    # A range needs the turns up to its end.
    ranges = ranges.withColumn("turns", F.slice("turns", 1, F.col("first") + TURNS)).repartition("id", "first")
    found = ranges.mapInPandas(
        in_range, f"id {kind}, first int, last string, found array<array<long>>, rewritten long, roles array<string>, before string"
    )
    parts = F.sort_array(F.collect_list(F.struct("first", "last", "found", "rewritten", "roles", "before"))).alias("parts")
    return short.unionByName(found.groupBy("id").agg(parts).mapInPandas(together, schema))


def digests(formatted: DataFrame, read: Callable[[str], list[tuple[str, str]]] = read_tagged, id_col: str = "conv_id") -> DataFrame:
    """What can be read back from formatted conversations: turns, texts under the loss mask, length."""

    def back(batches):
        for pdf in batches:
            out = {"n_turns": [], "turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
            for text, loss in zip(pdf["formatted"], pdf["loss"], strict=True):
                turns = read(text)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(learnt))
                out["loss_sha256"].append(hashlib.sha256(learnt.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            yield pdf[[id_col]].assign(**out)

    kind = dict(formatted.dtypes)[id_col]
    return formatted.select(id_col, "formatted", "loss").mapInPandas(
        back, f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
