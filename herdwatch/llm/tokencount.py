"""Token counts by heap-and-linked-list byte-pair merging, without identifiers.

The vocabulary of a sentencepiece BPE model is a rank per piece. A text's symbols form a linked list, adjacent
pairs that make a piece lie on a heap by (rank, position); the lowest is popped and merged until none is left. The
number of tokens is the number of initial symbols minus the merges, plus, for each symbol that is in no piece, its
UTF-8 bytes less one.

No merge crosses two characters that stand next to each other in no piece, so texts are cut at such pairs
before a blank that follows another character, and each worker remembers the counts of recent cuts.
"""

from __future__ import annotations

import heapq
import sys
import types

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "\u2581"
# Counts that a worker remembers, in two generations.
REMEMBERED = 400_000


def merges(symbols: str, ranks: dict[str, float]) -> tuple[int, list[str]]:
    """(number of merges, symbols left that were never merged)."""
    n = len(symbols)
    piece: list[str | None] = list(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := symbols[i : i + 2]) in ranks]
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, p = heapq.heappop(heap)
        j = after[i]
        # A pair is stale once either side has changed.
        if piece[i] is None or j >= n or piece[j] is None or piece[i] + piece[j] != p:
            continue
        done += 1
        piece[i], piece[j] = p, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (q := p + piece[k]) in ranks:
                heapq.heappush(heap, (ranks[q], i, q))
        h = before[i]
        if h >= 0 and (q := piece[h] + p) in ranks:
            heapq.heappush(heap, (ranks[q], h, q))
    return done, [p for p in piece if p is not None and len(p) == 1]


class Counter:
    """Counts tokens with the ranks of a sentencepiece BPE model."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        m, size = self.model, self.model.vocab_size()
        normal = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        # The best score is the lowest rank.
        self.ranks = {m.id_to_piece(i): -m.get_score(i) for i in normal}
        # Whether blanks may be followed by a cut: no piece has a blank after another character.
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in self.ranks)
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def count_symbols(self, symbols: str) -> int:
        done, single = merges(symbols, self.ranks)
        return len(symbols) - done + sum(len(c.encode()) - 1 for c in single if c not in self.ranks)

    def remembered(self, symbols: str) -> int:
        found = self.recent.get(symbols)
        if found is None:
            found = self.older.get(symbols)
            if found is None:
                found = self.count_symbols(symbols)
            if len(self.recent) >= REMEMBERED:
                self.older, self.recent = self.recent, {}
            self.recent[symbols] = found
        return found

    def count(self, text: str) -> int:
        normal = self.model.normalize(text)
        if not normal:
            return 0
        if not self.cuts:
            return self.count_symbols(normal)
        parts = normal.split(BLANK)
        total, blanks, known = 0, "", self.remembered
        # A run of blanks stays with the characters behind it.
        for k, part in enumerate(parts):
            if k:
                blanks += BLANK
            if part:
                total += known(blanks + part)
                blanks = ""
        return total + (known(blanks) if blanks else 0)


def worker_state() -> types.ModuleType:
    """A place that lives as long as the Python worker, for what its tasks can share."""
    return sys.modules.setdefault("herdwatch_worker_state", types.ModuleType("herdwatch_worker_state"))


def counter(model_file: str) -> Counter:
    state = worker_state()
    held = getattr(state, "counters", None)
    if held is None:
        held = state.counters = {}
    if model_file not in held:
        held[model_file] = Counter(model_file)
    return held[model_file]


def count_tokens(
    docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (id_col, n_bytes, n_tokens, over_limit), one per row, null texts as empty ones (0 tokens).

    ``model_file`` must be readable on the executors. Repeated rows each get a row, a null id stays null, an empty
    table gives no rows, other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        count = counter(model_file).count
        for batch in batches:
            counts = [count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    counted = rows.select("id", "text", F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(
        run, f"id {kind}, n_bytes long, n_tokens long"
    )
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
