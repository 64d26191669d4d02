"""Suffix-array dedup: repeated byte strings by a distributed difference-cover algorithm.

A difference cover modulo ``m`` is a set of residues whose differences are all residues. For
any two suffixes there is then a shift below ``m`` that takes both to sampled places. Two equal
strings of ``length`` bytes thus hold, at equal distance from their starts, two sampled places
with the same next ``length - m`` bytes.

1. **Sorted samples.** Every sampled place gets a name for its next ``length - m`` bytes, in
   place of the triple of letters that a cover modulo 3 would give. Spark sorts the names into
   its partitions; a name that occurs once settles its place as unique.
2. **Recursion on names.** A place with a repeated name stands for the ``m`` strings that hold it
   at its shift. Such a range of strings has a core, the bytes that all of them share, and a
   hull, all bytes that any of them has. A core that occurs once settles the range as unique,
   a hull that occurs again as repeated; a range that is neither lies where a repeat begins or
   ends, is cut into ``PARTS`` ranges, and those get names again.
3. **Merge of the remaining suffixes.** In the ranges that are still open all suffixes, sampled
   or not, are brought together by their first ``length`` bytes, and equal prefixes that meet
   are repeats.

On every level one representative of each distinct content goes on, and only where some member
of its group is open. A name is a fingerprint, so it needs no rank of a neighbour to be formed.
Groups are counted before they shuffle and never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import mix, quoted, release, remove, slices, starts_of, written
from gleaner.session import cut_lineage

LENGTH = 400
#: Ranges into which an open range is cut before its suffixes are merged one by one.
PARTS = 6
#: Bytes hashed at once; a longer text is hashed in pieces that overlap.
CHUNK = 1 << 20

# Perfect difference sets, one for each modulus.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
    183: (0, 2, 3, 10, 26, 39, 43, 61, 109, 121, 130, 136, 141, 155),
    273: (1, 2, 4, 8, 16, 32, 64, 91, 117, 128, 137, 182, 195, 205, 234, 239, 256),
}
#: Shortest string that can be asked for: a name needs eight bytes.
LEAST = 15
#: Documents without an id.
NO_ID = (1 << 63) - 1

_KEYS = np.random.default_rng(31).integers(1 << 62, (1 << 63) - 1, 8, dtype=np.uint64) | np.uint64(1)


def modulus_for(length: int) -> int:
    """The largest modulus that leaves a quarter of the length, and eight bytes, to names."""
    if length < LEAST:
        raise ValueError(f"strings must have {LEAST} bytes at least")
    return max(m for m in COVERS if m <= min(3 * length // 4, length - 8))


class _Powers:
    """Powers of two odd bases and of their inverses modulo 2**64, as far as they were needed."""

    def __init__(self) -> None:
        self.bases = [int(_KEYS[0]), int(_KEYS[1])]
        self.known = [self._make(0, 1 << 12), self._make(1, 1 << 12)]

    def _make(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for base in (self.bases[which], pow(self.bases[which], -1, 1 << 64)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        return out[0], out[1]

    def get(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known[which][0]) < n:
            self.known[which] = self._make(which, 2 * n)
        powers, inverses = self.known[which]
        return powers[:n], inverses[:n]


_powers: list[_Powers] = []


class Hashes:
    """64-bit names of ranges of a buffer, from prefix sums over its eight-byte words."""

    def __init__(self, data: np.ndarray, which: int):
        if not _powers:
            _powers.append(_Powers())
        n = max(len(data) - 7, 0)
        words = np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)) if n else np.zeros(0, np.uint64)
        powers, self.inverses = _powers[0].get(which, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words ^ _KEYS[2 + which]) * powers[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """The name of ``size`` (8 or more) bytes from each place."""
        return mix((self.sums[begin + (size - 7)] - self.sums[begin]) * self.inverses[begin])


@dataclass
class Pieces:
    """Parts of texts in one buffer: ``row`` of the slice, ``first`` byte in the buffer, ``base``
    of that byte in its text, the ``size`` of the text, and the places ``low <= s < high`` to look at."""

    data: np.ndarray
    row: np.ndarray
    first: np.ndarray
    base: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray


def pieces(texts: pa.Array, length: int) -> Iterator[Pieces]:
    """The texts of a slice in buffers of some ``CHUNK`` bytes, with the bytes around each place."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    if offsets[-1] - offsets[0] <= 4 * CHUNK or len(texts) > 1:
        rows = np.arange(len(texts))
        zero = np.zeros(len(texts), np.int64)
        yield Pieces(data[offsets[0] : offsets[-1]], rows, offsets[:-1] - offsets[0], zero, sizes, zero, sizes)
        return
    whole, one = data[offsets[0] : offsets[1]], np.zeros(1, np.int64)
    for low in range(0, len(whole), CHUNK):
        high = min(low + CHUNK, len(whole))
        base = max(0, low - length)
        yield Pieces(whole[base : high + 2 * length], one, one, one + base, sizes, one + low, one + high)


@dataclass
class Samples:
    """Sampled places that some string of ``length`` bytes covers: piece, place in the text."""

    piece: np.ndarray
    at: np.ndarray


def samples(x: Pieces, length: int) -> Samples:
    m = modulus_for(length)
    reach = int(x.high.max(initial=0))
    pattern = (np.arange(reach // m + 1)[:, None] * m + np.array(COVERS[m])).ravel()
    # some string of this length begins at most m - 1 before the place, and ends inside the text
    high = np.where(x.size >= length, np.minimum(x.high, x.size - (length - m)), 0)
    begin = np.searchsorted(pattern, x.low)
    count = np.maximum(np.searchsorted(pattern, high) - begin, 0)
    piece = np.repeat(np.arange(len(x.row)), count)
    inner = np.arange(len(piece)) - np.repeat(starts_of(count)[:-1], count)
    return Samples(piece, pattern[begin[piece] + inner])


def _names(x: Pieces, s: Samples, hashes: Hashes, length: int) -> np.ndarray:
    return hashes.of(x.first[s.piece] + s.at - x.base[s.piece], length - modulus_for(length))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sampled_names(docs: DataFrame, length: int) -> DataFrame:
    """``name`` of each sampled place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                for x in pieces(part.column("text"), length):
                    names = _names(x, samples(x, length), Hashes(x.data, 0), length)
                    yield pa.RecordBatch.from_arrays([_signed(names)], ["name"])

    return docs.select("text").mapInArrow(run, "name long")


_ROWS = "core long, hull long, doc long, key long, at int"


def _sampled_places(docs: DataFrame, length: int) -> DataFrame:
    """``name, doc, key, at`` of each sampled place, by the first of the strings that it stands for
    (before the text begins, where the place is among its first)."""
    m = modulus_for(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                for x in pieces(part.column("text"), length):
                    s = samples(x, length)
                    rows = pa.array(x.row[s.piece])
                    columns = [_signed(_names(x, s, Hashes(x.data, 0), length)), part.column("doc").take(rows), part.column("key").take(rows)]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array((s.at - m + 1).astype(np.int32))], ["name", "doc", "key", "at"]
                    )

    return docs.select("doc", "key", "text").mapInArrow(run, "name long, doc long, key long, at int")


def _inner_ranges(docs: DataFrame, length: int, outer: int, width: int) -> DataFrame:
    """``core, hull, doc, key, at`` of the ranges of ``width`` strings inside those of ``outer`` in ``open``.

    With a width of one both names are those of the string itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = np.arange(0, outer, width)
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                starts = [np.unique(np.array(v.values, np.int64)[:, None] + inside) for v in part.column("open")]
                for x in pieces(part.column("text"), length):
                    counts = np.array([len(starts[r]) for r in x.row.tolist()], np.int64)
                    at = np.concatenate([starts[r] for r in x.row.tolist()])
                    piece = np.repeat(np.arange(len(counts)), counts)
                    low, last = np.maximum(at, 0), np.minimum(at + width - 1, x.size[piece] - length)
                    mine = np.flatnonzero((low <= last) & (low >= x.low[piece]) & (low < x.high[piece]))
                    at, piece, low, last = at[mine], piece[mine], low[mine], last[mine]
                    origin = x.first[piece] - x.base[piece]
                    core = Hashes(x.data, 0).of(origin + at + width - 1, length - width + 1)
                    hull = Hashes(x.data, 1).of(origin + low, last - low + length)
                    if width > 1:  # ranges cut by the edge of a text equal none that are not
                        hull = mix(hull + (low - at).astype(np.uint64) * _KEYS[4] + (last - at).astype(np.uint64) * _KEYS[5])
                    for begin in range(0, len(at), CHUNK):
                        some = slice(begin, begin + CHUNK)
                        rows = pa.array(x.row[piece[some]])
                        columns = [_signed(core[some]), _signed(hull[some]), part.column("doc").take(rows), part.column("key").take(rows)]
                        yield pa.RecordBatch.from_arrays(
                            [*columns, pa.array(at[some].astype(np.int32))], ["core", "hull", "doc", "key", "at"]
                        )

    return docs.select("doc", "key", "text", "open").mapInArrow(run, _ROWS)


def _runs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals (end exclusive) that cover the same integers as ``low <= i < high``."""
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]])) if len(low) else np.zeros(0, np.int64)
    return low[new], reach[np.append(new[1:], len(low)) - 1] if len(new) else reach


def _settle(ranges: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Of a level's ranges, the repeated ones (doc, key, at, width) and the open ones (doc, key, open).

    A range is repeated if its hull occurs twice. It stays open if its core occurs twice; then
    one range of each hull of that core goes on, since it may hold what the open one repeats.
    """
    hulls = ranges.groupBy("core", "hull").agg(F.count("*").alias("n"), F.min(F.struct("doc", "key", "at")).alias("one"))
    hulls, path = written(hulls, "hulls")
    repeated = _marks(ranges, hulls.filter("n > 1"), width)
    cores = hulls.groupBy("core").agg(F.sum("n").alias("total"), F.min("n").alias("least"))
    cores = cores.filter("total > 1 and least = 1").select("core")
    going = hulls.join(cores, "core").select("one.*").groupBy("doc", "key").agg(F.collect_set("at").alias("open"))
    going = cut_lineage(going, "open-ranges")
    remove(ranges.sparkSession, path)
    return repeated, going


def _marks(ranges: DataFrame, twice: DataFrame, width: int) -> DataFrame:
    """Each text's ranges among those of the hulls in ``twice``."""
    found = ranges.join(twice.select("core", "hull"), ["core", "hull"])
    found = found.groupBy("doc", "key").agg(F.collect_set("at").alias("at"))
    return cut_lineage(found.withColumn("width", F.lit(width)), "marks")


def _merge(suffixes: DataFrame) -> DataFrame:
    """The strings that occur twice (doc, key, at, width): first by 64 bits of their name, then by all."""
    spark = suffixes.sparkSession
    cores = suffixes.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
    cores, known = written(cores, "repeated-prefixes")
    release(spark)
    likely, path = written(suffixes.join(cores, "core"), "likely-prefixes")
    release(spark)
    whole = likely.groupBy("core", "hull").agg(F.count("*").alias("n")).filter("n > 1")
    found = _marks(likely, whole, 1)
    remove(spark, known, path)
    return found


def _verdicts(docs: DataFrame, length: int, with_bytes: bool) -> DataFrame:
    """One row per row of ``docs``, which has the repeated ranges of strings of its text as ``marks``."""
    made = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:int,end:int>>"
    made += ", kept binary" if with_bytes else ""

    def judge(text: bytes, marks: pa.Scalar) -> tuple[list[dict], bytes]:
        if not marks.is_valid:
            return [], text
        levels = [(np.array(x["at"], np.int64), x["width"]) for x in marks.as_py()]
        at = np.concatenate([x for x, _ in levels])
        width = np.repeat([w for _, w in levels], [len(x) for x, _ in levels])
        low, high = _runs(np.maximum(at, 0), np.minimum(at + width - 1 + length, len(text)))
        spans = [{"begin": a, "end": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        edges = [0, *(e for s in spans for e in (s["begin"], s["end"])), len(text)]
        return spans, b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                texts = pc.fill_null(part.column("text"), "").cast(pa.binary()).to_pylist()
                found = [judge(*x) for x in zip(texts, part.column("marks"), strict=True)]
                columns = [
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(t) - len(k) for t, (_, k) in zip(texts, found, strict=True)], pa.int64()),
                    pa.array([len(s) for s, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for _, k in found], pa.string()),
                    pa.array([s for s, _ in found], kind),
                ]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
                if with_bytes:
                    columns.append(pa.array([k for _, k in found], pa.binary()))
                    names.append("kept")
                others = [c for c in part.schema.names if c not in ("text", "marks")]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], *columns], [*others, *names])

    passed = [f for f in docs.schema if f.name not in ("text", "marks")]
    return docs.mapInArrow(run, T.StructType([*passed, *T.StructType.fromDDL(made)]))


def repeated_bytes(
    docs: DataFrame, length: int = LENGTH, extra: list[str] | None = None, with_bytes: bool = False
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte of a text (UTF-8) is removed if a string of ``length`` bytes that covers it also starts
    anywhere else, in this row or another one; strings are judged on the input and lie in one
    text. ``spans`` are the maximal removed runs (end exclusive); ``with_bytes`` adds ``kept``, the
    bytes that stay, which may begin inside a character. Null texts are empty ones, and texts
    shorter than ``length`` stay whole. Rows of equal id, or without one, are texts like any
    other, so equal rows lose every string they hold. ``extra`` columns come along inside a struct
    ``extra``. An empty table gives an empty one. A text is hashed in pieces of ``CHUNK`` bytes.
    """
    m = modulus_for(length)
    spark = docs.sparkSession
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"),
        "text",
        *([F.struct(*[F.col(quoted(c)) for c in extra]).alias("extra")] if extra else []),
        F.col("doc_id"),
    )
    named = _sampled_names(base, length).groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")
    named, path = written(named.select("name"), "repeated-names")
    release(spark)
    going = _sampled_places(base, length).join(named, "name").groupBy("doc", "key").agg(F.collect_set("at").alias("open"))
    going = cut_lineage(going, "repeated-places")
    remove(spark, path)
    release(spark)
    repeated, outer = [], 1
    for width in dict.fromkeys([m, -(-m // PARTS), 1]):
        texts = base.select("doc", "key", "text").join(going, ["doc", "key"])
        ranges, path = written(_inner_ranges(texts, length, outer, width), "ranges")
        release(spark)
        if width > 1:
            found, going = _settle(ranges, width)
        else:
            found = _merge(ranges)
        remove(spark, path)
        release(spark)
        repeated.append(found)
        outer = width
    marks = reduce(DataFrame.unionByName, repeated).groupBy("doc", "key").agg(F.collect_list(F.struct("at", "width")).alias("marks"))
    return _verdicts(base.join(marks, ["doc", "key"], "left").drop("doc", "key"), length, with_bytes)
