"""Exact token counts at every prefix, by dynamic programming over merge-based pieces.

Let ``last(i)`` be the final token of the encoding of the first ``i`` characters. It is the
one piece ``t`` ending at ``i`` that leaves ``last(i - |t|)`` as it is when the two stand
together, so ``count(i) = count(i - |t|) + 1``. No piece reaches over the start of a word,
so the table of a text is made of its words' tables, each shifted by the count before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Recent, shared, slices

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"
#: Word tables that a worker keeps, in each of two generations, and checked pairs.
KEPT_WORDS = 300_000
KEPT_PAIRS = 1_000_000


class PieceTable:
    """Vocabulary and merges of a merge-based piece model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.names = ["", *(model.id_to_piece(i) for i in plain)]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("pieces of this model reach over the start of a word")
        # by character: the number of the piece that ends there, if any, and what may follow
        self.tree: dict[str, list] = {}
        for number, piece in enumerate(self.names):
            below, node = self.tree, None
            for c in piece:
                node = below.setdefault(c, [None, {}])
                below = node[1]
            if node is not None:
                node[0] = number
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The encoding of a short string: the best pair merges first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, where = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, k
            if best is None:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def stands(self, left: int, right: int) -> bool:
        """Whether two pieces stay apart; number 0 on the left asks for the right one alone."""
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        pair = [self.names[left], self.names[right]] if left else [self.names[right]]
        known = self.pairs[left * len(self.names) + right] = self.merged("".join(pair)) == pair
        return known

    def table(self, word: str) -> list[int]:
        """Token counts of the prefixes of a word, from none to all of its characters.

        A character outside the vocabulary merges with nothing and counts its bytes.
        """
        n, scores, pairs, width = len(word), self.scores, self.pairs, len(self.names)
        counts, last = [0] * (n + 1), [0] + [-1] * n
        for i in range(n):
            if word[i] not in scores:
                counts[i + 1], last[i + 1] = counts[i] + len(word[i].encode("utf-8")), 0
                continue
            left, below, j = last[i], self.tree, i
            while j < n:
                node = below.get(word[j])
                if node is None:
                    break
                j += 1
                piece, below = node
                if piece is None or last[j] >= 0:
                    continue
                apart = pairs.get(left * width + piece)
                if apart is None:
                    apart = self.stands(left, piece)
                if apart:
                    last[j], counts[j] = piece, counts[i] + 1
        return counts


def words_of(text: str) -> list[str]:
    """A text as the model sees it, cut before each run of marks; empty text has no word."""
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return [MARK + p for p in parts]
    words, marks = [], ""
    for part in parts:
        marks += MARK
        if part:
            words.append(marks + part)
            marks = ""
    return [*words, marks] if marks else words


class PrefixCounter:
    def __init__(self, path: str):
        self.pieces = PieceTable(path)
        self.known = Recent(self.pieces.table, KEPT_WORDS)

    def tables(self, text: str) -> list[list[int]]:
        return self.known.all(words_of(text))

    def every_prefix(self, text: str) -> list[int]:
        """Counts of all prefixes, by number of characters from 0 to the whole text."""
        out, before = [], 0
        for table in self.tables(text):
            out += [before + c for c in table[1:]]
            before += table[-1]
        return [0, *out[1:]]

    def fitting(self, tables: list[list[int]], ends: np.ndarray, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        whole = int(np.searchsorted(ends, budget, side="right"))
        chars = sum(len(t) - 1 for t in tables[:whole])
        if whole < len(tables):
            before = int(ends[whole - 1]) if whole else 0
            chars += max(k for k, c in enumerate(tables[whole]) if before + c <= budget)
        return max(0, chars - 1)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fitting_chars`` of each row.

    fitting_chars: characters of the longest prefix of at most ``limit`` tokens, so the text
    can be cut without encoding it again. A null text counts as empty: no bytes, no tokens.
    """
    path = path or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared(PrefixCounter, path)
        for batch in batches:
            for rows in slices(batch, "text"):
                sizes, totals, fits = [], [], []
                for text in rows.column("text").to_pylist():
                    text = text or ""
                    tables = counter.tables(text)
                    counts = [t[-1] for t in tables]
                    total = sum(counts)
                    sizes.append(len(text.encode("utf-8")))
                    totals.append(total)
                    fits.append(len(text) if total <= limit else counter.fitting(tables, np.cumsum(counts), limit))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array(sizes, pa.int64()),
                        pa.array(totals, pa.int64()),
                        pa.array([t > limit for t in totals], pa.bool_()),
                        pa.array(fits, pa.int64()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long"
    return plain.mapInArrow(run, schema)


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, counts``: the count at every prefix, one number for each 0 <= i <= length."""
    path = path or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(path)
        for batch in batches:
            for rows in slices(batch, "text", 1 << 20):
                counts = [counter.every_prefix(t or "") for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "counts"]
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, counts array<int>")
