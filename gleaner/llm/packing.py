"""Concatenate and cut: token totals of partitions give global offsets, then fixed windows.

Pass one encodes every document and writes its ids with its place inside its partition.
The prefix sums of the partition totals then place every document in one endless row of
tokens. Pass two cuts that row every ``length`` tokens; each boundary inside a document
gives it one more piece. Only the last sequence is short.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import KEPT_LENGTH, shared, slices
from gleaner.session import cut_lineage

LENGTH = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
#: Runs whose ids a worker keeps from task to task, in each of two generations.
KEPT_RUNS = 400_000
#: A space before more white space, or at the end: no boundary of the pre-tokenizer.
_UNCUT = re.compile(r" (?:\s|[\x1c-\x1f]|\Z)")


def _joined(parts: list[str]) -> list[str]:
    """Parts of a text split at spaces, with those put back where the text may not be cut."""
    out = parts[:1]
    for part in parts[1:]:
        if part and not part[0].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    return out


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Byte strings with their ids, if the ids of a byte-level vocabulary follow its merges."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}
    added = {t["content"] for t in spec["added_tokens"]}
    vocabulary = spec["model"]["vocab"]
    pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
    order = [vocabulary[a + b] for a, b in pairs]
    if order != sorted(set(order)):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in added}


class RunEncoder:
    """Ids of texts as the tokenizer file gives them, with those of repeated runs kept.

    The byte-level pre-tokenizer always cuts before a space that a visible character
    follows, so a text's ids are those of its space-led runs, one after the other. Runs are
    merged by tiktoken from the ranks in the file, which spares the offsets that the
    tokenizers library works out; texts that hold a special string go through the latter.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = _ranks(spec)
        self.merge = self._by_library
        if ranks is not None:
            pattern = public_tokenizers.PATTERN
            self.merge = tiktoken.Encoding(
                "runs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
            ).encode_ordinary
        self.letter = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.once: list[tuple[dict[str, bytes], str]] = []
        self.new: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def _by_library(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def _learn(self, place: int, runs: set[str], lead: str) -> dict[str, bytes]:
        """The store of first (0) or space-led (1) runs, with these in it."""
        known, older, merge, pack = self.new[place], self.old[place], self.merge, self.pack
        for run in runs:
            if run not in known:
                kept = older.get(run)
                known[run] = pack(merge(lead + run)) if kept is None else kept
                if len(run) > KEPT_LENGTH:
                    self.once.append((known, run))
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.new[0]) + len(self.new[1]) > KEPT_RUNS:
            self.new, self.old = ({}, {}), self.new
        whole = {k: self.pack(self._by_library(x)) for k, x in enumerate(texts) if any(s in x for s in self.special)}
        split = [
            [""] if k in whole else x.split(" ") if not _UNCUT.search(x) else _joined(x.split(" "))
            for k, x in enumerate(texts)
        ]
        first = self._learn(0, {x[0] for x in split}, "")
        later = self._learn(1, set().union(*[x[1:] for x in split]), " ")
        get = later.__getitem__
        out = [whole[k] if k in whole else first[x[0]] + b"".join(map(get, x[1:])) for k, x in enumerate(split)]
        for store, run in self.once:  # text without spaces is one run however long
            del store[run]
        self.once = []
        return out


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, part, before, n, ids``: ids with the end id, and tokens before it in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(RunEncoder, path)
        end = encoder.pack([end_id])
        width = len(end)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text"):
                ids = [x + end for x in encoder.encode([t or "" for t in rows.column("text").to_pylist()])]
                sizes = np.array([len(x) // width for x in ids], np.int64)
                ends = before + np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(ends - sizes),
                        pa.array(sizes),
                        pa.array(np.full(len(ids), width, np.int32)),
                        pa.array(ids, pa.binary()),
                    ],
                    ["doc_id", "part", "before", "n", "width", "ids"],
                )
                before = int(ends[-1])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, part int, before long, n long, width int, ids binary")


def pack(
    docs: DataFrame,
    path: str | None = None,
    length: int = LENGTH,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are those of its text (null: empty) and the end id; each lies in
    exactly one piece. Sequences hold ``length`` tokens but for the last, and offsets run
    from 0 without gaps. Rows with equal or no ids are documents like any other.
    ``with_ids`` adds ``ids array<int>``.
    """
    tokens = cut_lineage(encoded(docs, path or public_tokenizers.path(TOKENIZER), end_id), "encoded")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task of pass one
    places = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("origin"))
    placed = tokens.join(F.broadcast(places), "part").withColumn("origin", F.col("origin") + F.col("before"))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, origin, width, data in zip(*[batch.column(c) for c in ("doc_id", "origin", "width", "ids")], strict=True):
                kind = np.uint16 if width.as_py() == 2 else np.uint32
                ids = np.frombuffer(data.as_buffer(), kind).astype("<u4")
                at, begin, doc_id = origin.as_py(), 0, doc.as_py()
                while begin < len(ids):
                    size = min(length - at % length, len(ids) - begin)
                    piece = ids[begin : begin + size]
                    row = (doc_id, begin, size, zlib.crc32(piece.tobytes()), len(ids), at // length, at % length)
                    rows.append((*row, piece) if with_ids else row)
                    begin, at = begin + size, at + size
                if len(rows) >= 2000:
                    yield table_of(rows)
                    rows = []
            if rows:
                yield table_of(rows)

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in columns[: len(names)]]
        if with_ids:
            arrays.append(pa.array(columns[-1], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, [*names, "ids"][: len(arrays)])

    fields = [T.StructField(n, T.LongType()) for n in names]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return placed.select("doc_id", "origin", "width", "ids").mapInArrow(cut, T.StructType(fields))
