"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

# Words of op1 and op3 in DuckDB; A-Z lower-cased only.
LOWERED = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TOKENS = "regexp_extract_all(" + LOWERED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
PLAIN = "regexp_extract_all(" + LOWERED + r", '[^\x20\x09-\x0D]+')"

DECONTAMINATE = f"""
WITH dw AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents),
iw AS (SELECT item_id, {TOKENS.format('text')} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, w[s:s + 12] AS win FROM (
    SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM wins),
keyed AS (SELECT DISTINCT win, len(win) AS n, array_to_string(win, ' ') AS k FROM wins),
runs AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lens WHERE len(w) >= n)),
occ AS (SELECT r.doc_id, r.s, r.n, k.win FROM runs r JOIN keyed k ON r.k = k.k AND r.n = k.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
    SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (
    SELECT DISTINCT o.doc_id, CAST(w.item_id AS VARCHAR) AS item FROM occ o JOIN wins w ON o.win = w.win) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       coalesce(i.sha, sha256('')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN hit h USING (doc_id) LEFT JOIN its i USING (doc_id)
"""

# Shingles of a document as one text each; words hold no blanks.
NEAR_DUPLICATES = f"""
WITH RECURSIVE dw AS (SELECT doc_id, {PLAIN.format('text')} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS k FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM dw WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (
  SELECT doc_id, doc_id AS other FROM dw
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM dw d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

DROP_BOILERPLATE = r"""
WITH l AS (
  SELECT doc_id, source, p, ls[p] AS line, trim(ls[p], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS k FROM (
    SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS p FROM (
      SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
b AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 5),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM b)) AS n_boiler,
  string_agg(line, chr(10) ORDER BY p) FILTER (WHERE k NOT IN (SELECT k FROM b)) AS rest FROM l GROUP BY doc_id)
SELECT o.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_boiler, 0) AS n_boiler,
       length(CASE WHEN o.text IS NOT NULL THEN coalesce(rest, '') END) AS kept_chars,
       sha256(CASE WHEN o.text IS NOT NULL THEN coalesce(rest, '') END) AS kept_sha256
FROM documents o LEFT JOIN d USING (doc_id)
"""

# Water level as in the operator; keys from the same digest, prefix sums over whole sources.
MIX = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    -ln((CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 1) / 4503599627370496.0e0)
    / (CASE WHEN length(text) > 0 THEN 0.25e0 + 0.75e0 * CAST(length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) AS DOUBLE) / length(text) ELSE 0.25e0 END) AS k
  FROM documents),
t AS (SELECT source, sum(size) AS source_size FROM s GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM t),
l AS (
  SELECT *, row_number() OVER o AS r, 2 * source_size AS cap,
    (1.5e0 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w WINDOW o AS (ORDER BY 2 * source_size / CAST(w AS DOUBLE), source NULLS LAST)),
f AS (SELECT min(r) AS r, arg_min(level, r) AS level FROM l WHERE cap > level * w),
g AS (
  SELECT source, source_size, CAST(CASE WHEN l.r < coalesce(f.r, 2147483647) THEN cap ELSE f.level * w END AS DOUBLE) AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
c AS (
  SELECT s.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN e ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST((epochs + CASE WHEN epochs < 2 AND before + size / 2.0e0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c
"""

FORMAT_CHAT = r"""
WITH x AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM x),
u AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '</?turn'))
    + length(role) + len(regexp_extract_all(role, '[\\<>\n]')) + length('<turn >' || chr(10) || '</turn>' || chr(10)) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(CAST(sum(length(text)) FILTER (WHERE role = 'assistant') AS BIGINT), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""


def _crc_step(n: int) -> int:
    for _ in range(4):
        n = n >> 1 ^ 0xEDB88320 * (n & 1)
    return n


def crc32_of(text: str) -> str:
    """crc32 of a text expression's UTF-8 bytes, four bits at a time, low ones first."""
    digits = f"hex(encode({text}))"
    bits = f"list_transform(range(0, length({digits})), lambda i: CAST(instr('0123456789ABCDEF', substr({digits}, (i // 2) * 2 + 2 - i % 2, 1)) - 1 AS BIGINT))"
    steps = "[" + ", ".join(str(_crc_step(n)) for n in range(16)) + "]"
    return (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), "
        f"lambda c, n: xor(c >> 4, CAST({steps}[(xor(c, n) & 15) + 1] AS BIGINT))), 4294967295)"
    )


RESAMPLE = f"""
WITH dw AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents),
bw AS (SELECT {TOKENS.format('text')} AS w FROM benchmark),
df AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS k FROM dw),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS k FROM bw),
kinds AS (SELECT k, {crc32_of('k')} % 10000 AS b FROM (SELECT DISTINCT k FROM (SELECT k FROM df UNION ALL SELECT k FROM bf))),
s AS (SELECT b, count(*) AS s FROM df JOIN kinds USING (k) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bf JOIN kinds USING (k) GROUP BY b),
both_ AS (SELECT r.b, CAST(coalesce(s, 0) AS DOUBLE) AS s, CAST(coalesce(t, 0) AS DOUBLE) AS t
  FROM (SELECT unnest(range(0, 10000)) AS b) r LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
gain AS (SELECT b, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM both_) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM both_) + 10000)))) AS gain FROM both_),
m AS (SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*)) AS weight FROM df JOIN kinds USING (k) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(m.n, 0) AS n_features, CAST(coalesce(m.weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(m.weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM dw d LEFT JOIN m USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r.rank <= 25 * (SELECT count(*) FROM ranked) // 100 THEN r.rank END AS rank
FROM scored s LEFT JOIN ranked r USING (doc_id)
"""


def merkle_sql(levels: int = 6, upper: int = 4) -> str:
    """One step per level: sources of up to 16 ** ``levels`` rows, up to 16 ** ``upper`` sources."""

    def part(column: str) -> str:
        text = f"CAST({column} AS VARCHAR)"
        return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"""l AS (
  SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc32_of("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(low)} END AS changed FROM documents),
n0 AS (SELECT *, source AS tree, leaf AS node, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
  count(*) OVER (PARTITION BY source) AS many FROM l),
f0 AS (SELECT doc_id, source, leaf, tree, p, coalesce(changed, leaf) AS fold, '' AS proof FROM n0)"""]

    def climb(k: int) -> None:
        left, right = "array_to_string(r.nodes[1:f.p % 16], '')", "array_to_string(r.nodes[f.p % 16 + 2:], '')"
        steps.append(f"""r{k} AS (SELECT tree, p // 16 AS p, list(node ORDER BY p) AS nodes, max(many) AS many FROM n{k} GROUP BY ALL),
n{k + 1} AS (SELECT tree, p, CASE WHEN many > 1 THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS node, (many + 15) // 16 AS many FROM r{k}),
f{k + 1} AS (SELECT f.* REPLACE (f.p // 16 AS p, CASE WHEN r.many > 1 THEN sha256({left} || f.fold || {right}) ELSE f.fold END AS fold,
  f.proof || {left} || {right} AS proof) FROM f{k} f JOIN r{k} r ON f.tree IS NOT DISTINCT FROM r.tree AND f.p // 16 = r.p)""")

    for k in range(levels):
        climb(k)
    k = levels + 1
    steps.append(f"""s AS (SELECT tree AS source, node AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS p, count(*) OVER () AS many FROM n{levels}),
n{k} AS (SELECT 0 AS tree, p, subroot AS node, many FROM s),
f{k} AS (SELECT f.doc_id, f.source, f.leaf, s.subroot, 0 AS tree, s.p, f.fold, f.proof FROM f{levels} f JOIN s ON f.source IS NOT DISTINCT FROM s.source)""")
    for j in range(k, k + upper):
        climb(j)
    k += upper
    steps.append(f"root AS (SELECT node AS root FROM n{k})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM f{k}, root
"""


MERKLE = merkle_sql()
