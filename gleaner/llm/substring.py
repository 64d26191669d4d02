"""Substring dedup: winnowed anchors as seeds, extension both ways, maximal repeats.

A window is ``WINDOW`` consecutive words. Its anchor is the n-gram of smallest hash inside
it, so equal windows have equal anchors. The windows that share one anchor form a block,
which reaches from the first of them to the end of the last: the anchor extended both ways.

1. Documents are joined on anchors: only those found in two documents go on.
2. Where all blocks of an anchor are equal, the extension holds as a whole, and the
   block is a repeat in every document but the first.
3. Elsewhere a match ends inside the block. Its windows are compared one by one, each with
   the first document that has it.
4. Neighbouring repeats are merged into maximal spans.

Nothing pairs the members of a group: each is held against the first document only, so
work is linear in the text, however often a passage occurs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import (
    mix,
    quoted,
    release,
    slices,
    split_words,
    starts_of,
    word_hashes,
)
from gleaner.session import cut_lineage

WINDOW = 13
#: Words in an anchor. Any window then holds WINDOW - GRAM + 1 candidates.
GRAM = 5

_ODD = np.random.default_rng(20).integers(1 << 62, (1 << 63) - 1, GRAM + 2, dtype=np.uint64) | np.uint64(1)
_OTHER = np.uint64(0x9E3779B97F4A7C15)
#: Documents without an id come last.
NO_ID = (1 << 63) - 1
_PIECE = re.compile(r"[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*")


@dataclass
class Blocks:
    """Blocks of a run of texts. Positions count the words of all texts."""

    words: pa.Array
    counts: np.ndarray
    first_word: np.ndarray
    doc: np.ndarray
    number: np.ndarray
    anchor: np.ndarray
    begin: np.ndarray
    last: np.ndarray
    hashes: np.ndarray


class _Ranges:
    """Hashes of word ranges from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        powers = np.ones(n + 1, np.uint64)
        powers[1:] = np.uint64(base)
        self.inverse = np.ones(n + 1, np.uint64)
        self.inverse[1:] = np.uint64(pow(base, -1, 1 << 64))
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        inner = (self.sums[end] - self.sums[begin]) * self.inverse[begin]
        return mix(inner + (end - begin).astype(np.uint64) * _OTHER)


def find_blocks(texts: pa.Array) -> Blocks:
    words, counts = split_words(texts)
    hashes = word_hashes(words)
    first = starts_of(counts)
    none = np.zeros(0, np.int64)
    if len(hashes) < WINDOW:
        return Blocks(words, counts, first, none, none, np.zeros(0, np.uint64), none, none, hashes)
    size = len(hashes) - GRAM + 1
    grams = np.zeros(size, np.uint64)
    for k in range(GRAM):
        grams += hashes[k : k + size] * _ODD[k]
    grams = mix(grams)
    views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)
    at = np.arange(len(views))
    anchor = at + views.argmin(axis=1)
    doc = np.repeat(np.arange(len(counts)), counts)[: len(views)]
    inside = at + WINDOW <= first[doc + 1]
    at, anchor, doc = at[inside], anchor[inside], doc[inside]
    new = np.ones(len(at), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    starts = np.flatnonzero(new)
    begin, last = at[starts], at[np.append(starts[1:], len(at)) - 1] if len(at) else none
    doc = doc[starts]
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    return Blocks(words, counts, first, doc, number, grams[anchor[starts]], begin, last, hashes)


def _id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def _take(column: pa.Array, rows: np.ndarray) -> pa.Array:
    return column.take(pa.array(rows))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchors(docs: DataFrame) -> DataFrame:
    """``anchor, block, doc, key, number`` of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = find_blocks(part.column("text"))
                content = _Ranges(x.hashes, int(_ODD[GRAM])).of(x.begin, x.last + WINDOW)
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(x.anchor),
                        _signed(content),
                        _take(part.column("doc"), x.doc),
                        _take(part.column("key"), x.doc),
                        pa.array(x.number.astype(np.int32)),
                    ],
                    ["anchor", "block", "doc", "key", "number"],
                )

    return docs.select("doc", "key", "text").mapInArrow(
        run, "anchor long, block long, doc long, key long, number int"
    )


def _open_windows(docs: DataFrame) -> DataFrame:
    """``h1, h2, doc, key, at`` of each window of the blocks in ``open``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = find_blocks(part.column("text"))
                chosen = np.zeros(len(x.doc), bool)
                of_doc = np.searchsorted(x.doc, np.arange(len(x.counts)))
                for k, numbers in enumerate(part.column("open")):
                    chosen[of_doc[k] + np.array(numbers.values, np.int64)] = True
                begin, sizes = x.begin[chosen], (x.last - x.begin + 1)[chosen]
                firsts = starts_of(sizes)
                at = np.repeat(begin - firsts[:-1], sizes) + np.arange(firsts[-1])
                rows = np.repeat(x.doc[chosen], sizes)
                one = _Ranges(x.hashes, int(_ODD[GRAM])).of(at, at + WINDOW)
                two = _Ranges(mix(x.hashes ^ _OTHER), int(_ODD[GRAM + 1])).of(at, at + WINDOW)
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(one),
                        _signed(two),
                        _take(part.column("doc"), rows),
                        _take(part.column("key"), rows),
                        pa.array((at - x.first_word[rows]).astype(np.int32)),
                    ],
                    ["h1", "h2", "doc", "key", "at"],
                )

    return docs.select("doc", "key", "text", "open").mapInArrow(
        run, "h1 long, h2 long, doc long, key long, at int"
    )


def _join_pieces(text: str, keep: np.ndarray) -> str:
    pieces = _PIECE.findall(text)
    return "".join(p for p, k in zip(pieces, keep.tolist(), strict=True) if k).rstrip(" \t\n\x0b\x0c\r")


def _listed(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and the value of each entry of a column of lists; null counts as empty."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    return np.repeat(np.arange(len(lists)), sizes), np.asarray(lists.flatten()).astype(np.int64)


def _digests(words: pa.Array, first_word: np.ndarray, covered: np.ndarray) -> list[str]:
    """SHA-256 of each text's words that are not covered, joined by one space."""
    nothing, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    spaced = pc.binary_join_element_wise(words.filter(pa.array(~covered)), nothing, space)
    bounds = np.frombuffer(spaced.buffers()[1], np.int64) if len(spaced) else np.zeros(1, np.int64)
    ends = bounds[starts_of(~covered)[first_word]].tolist()
    data = memoryview(spaced.buffers()[2] or b"")
    return [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]


def _spans(first_word: np.ndarray, covered: np.ndarray) -> pa.Array:
    """The maximal runs of covered words of each text, their places counted from its first word."""
    edge = np.zeros(len(covered) + 1, bool)
    edge[first_word] = True
    begin = np.flatnonzero(covered & (edge[:-1] | ~np.append(False, covered[:-1])))
    end = np.flatnonzero(covered & (edge[1:] | ~np.append(covered[1:], False))) + 1
    bounds = np.searchsorted(begin, first_word)
    first = np.repeat(first_word[:-1], np.diff(bounds))
    spans = pa.StructArray.from_arrays([pa.array(begin - first), pa.array(end - first)], ["begin", "end"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans)


def _verdicts(docs: DataFrame, with_text: bool) -> DataFrame:
    """One row per row of ``docs``, which has ``whole`` block numbers and ``hit`` windows."""
    made = "n_words long, n_removed long, kept_sha256 string, spans array<struct<begin:int,end:int>>"
    if with_text:
        made += ", kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = find_blocks(part.column("text"))
                of_doc = np.searchsorted(x.doc, np.arange(len(x.counts)))
                rows, whole = _listed(part.column("whole"))
                blocks = of_doc[rows] + whole
                rows, hit = _listed(part.column("hit"))
                at = x.first_word[rows] + hit
                begin, end = np.append(x.begin[blocks], at), np.append(x.last[blocks], at) + WINDOW
                size = len(x.words) + 1
                covered = np.cumsum(np.bincount(begin, minlength=size) - np.bincount(end, minlength=size))[:-1] > 0
                kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
                columns = [
                    pa.array(x.counts.astype(np.int64)),
                    pa.array(np.diff(starts_of(covered)[x.first_word])),
                    pa.array(_digests(x.words, x.first_word, covered)),
                    _spans(x.first_word, covered).cast(kind),
                ]
                names = ["n_words", "n_removed", "kept_sha256", "spans"]
                if with_text:
                    texts = part.column("text").to_pylist()
                    for k in np.flatnonzero(np.asarray(columns[1])).tolist():
                        texts[k] = _join_pieces(texts[k], ~covered[x.first_word[k] : x.first_word[k + 1]])
                    columns.append(pa.array(texts, pa.string()))
                    names.append("kept_text")
                others = [c for c in part.schema.names if c not in ("text", "whole", "hit")]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in others], *columns], [*others, *names]
                )

    passed = [f for f in docs.schema if f.name not in ("text", "whole", "hit")]
    return docs.mapInArrow(run, T.StructType([*passed, *T.StructType.fromDDL(made)]))


def repeats(docs: DataFrame, extra: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, spans.

    A word is removed if a window that covers it also starts in a document of smaller
    doc_id; windows are judged on the input. ``spans`` are the maximal runs of removed words
    (end exclusive), ``with_text`` adds ``kept_text``: the text without them, other white
    space as it was. Null texts have no words. Rows without an id count as the last ones and
    not as earlier than each other; rows of equal id neither. ``extra`` columns come along
    inside a struct ``extra``.
    """
    spark = docs.sparkSession
    base = docs.select(
        _id().alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"),
        "text",
        *([F.struct(*[F.col(quoted(c)) for c in extra]).alias("extra")] if extra else []),
        F.col("doc_id").alias("doc_id"),
    )
    found = _anchors(base)
    shared = (
        found.groupBy("anchor")
        .agg(
            F.min("doc").alias("first"),
            F.max("doc").alias("final"),
            (F.min("block") == F.max("block")).alias("whole"),
        )
        .filter("first < final")
        .select("anchor", "first", "whole")
    )
    shared = cut_lineage(shared, "shared-anchors")
    release(spark)
    seeds = found.select("anchor", "doc", "key", "number").join(shared, "anchor").filter("not whole or first < doc")
    seeds = seeds.groupBy("doc", "key").agg(
        F.collect_set(F.when(F.col("whole"), F.col("number"))).alias("whole"),
        F.collect_set(F.when(~F.col("whole"), F.col("number"))).alias("open"),
    )
    seeds = cut_lineage(seeds, "seeds")
    release(spark)
    unsettled = base.select("doc", "key", "text").join(
        seeds.filter(F.size("open") > 0).select("doc", "key", "open"), ["doc", "key"]
    )
    windows = cut_lineage(_open_windows(unsettled), "windows")
    release(spark)
    earliest = windows.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("final"))
    earliest = cut_lineage(earliest.filter("first < final").select("h1", "h2", "first"), "first-windows")
    hits = windows.join(earliest, ["h1", "h2"]).filter("first < doc")
    hits = hits.groupBy("doc", "key").agg(F.collect_set("at").alias("hit"))
    marks = seeds.select("doc", "key", "whole").join(hits, ["doc", "key"], "full_outer")
    marks = cut_lineage(marks, "marks")
    release(spark)
    ready = base.join(marks, ["doc", "key"], "left").drop("doc", "key")
    return _verdicts(ready, with_text)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; columns and rows stay, n_chars follows."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = repeats(docs, extra=others, with_text=True)
    values = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    for c in others:
        old = F.col("extra").getField(c)
        values[c] = old
        if c == "n_chars":
            values[c] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(old).cast(docs.schema[c].dataType)
    return out.select(*[values[c].alias(c) for c in docs.columns])
