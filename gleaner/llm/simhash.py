"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint is cut into ``max_bits + 2`` blocks. Two fingerprints that differ in at most
``max_bits`` bits agree in two blocks at least, so they meet under one of the keys made of
two blocks. Within a key's group the distance is verified. Only the links of a spanning
forest leave a group, never its pairs; a group above GROUP_MAX is cut by the same rule
once more, over the bits that its key leaves free.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import private_names, quoted, starts_of
from gleaner.llm.components import components
from gleaner.session import cut_lineage

SEED = 42
#: Groups above this size are cut again. It bounds memory and time; links are the same.
GROUP_MAX = 2048
#: Shingle hashes held at once while a batch is summed.
_FLUSH = 1_000_000

#: For each byte, its eight bits in the eight bytes of a word.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_SPREAD = _SPREAD.copy().view(np.uint64).ravel()


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 of each run of ``shingle`` words, lower-cased A-Z; of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def _majority(hashes: list[int], counts: list[int]) -> np.ndarray:
    """The fingerprint of each document; one without hashes gets zero.

    Bits are counted in byte lanes, 255 hashes at a time, then by document.
    """
    out = np.zeros(len(counts), np.uint64)
    sizes = np.array(counts, np.int64)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    sizes = sizes[filled]
    first = starts_of(sizes)
    pieces = -(-sizes // 255)
    of_doc = starts_of(pieces)
    within = np.arange(of_doc[-1]) - np.repeat(of_doc[:-1], pieces)
    cuts = np.repeat(first[:-1], pieces) + 255 * within
    bits = np.zeros((len(filled), 64), np.uint8)
    for k in range(8):
        lanes = np.add.reduceat(_SPREAD[octets[:, k]], cuts)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), of_doc[:-1])
        bits[:, 8 * k : 8 * k + 8] = 2 * ones > sizes[:, None]
    out[filled] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``text_key`` (a 64-bit hash of the text) and ``fingerprint`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, hashes, counts = [], [], []
            for text in batch.column("text"):
                new = shingle_hashes(text.as_py(), shingle)
                hashes += new
                counts.append(len(new))
                if len(hashes) >= _FLUSH:
                    found.append(_majority(hashes, counts))
                    hashes, counts = [], []
            found.append(_majority(hashes, counts))
            prints = pa.array(np.concatenate(found).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), prints],
                ["doc_id", "text_key", "fingerprint"],
            )

    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        "text",
    )
    return keyed.mapInArrow(run, "doc_id long, text_key long, fingerprint long")


def _chunks(bits: list[int], parts: int) -> list[list[int]]:
    edges = [round(k * len(bits) / parts) for k in range(parts + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _masks(bits: list[int], max_bits: int) -> list[int]:
    """Masks of two of ``max_bits + 2`` blocks; one of them hides every allowed difference."""
    blocks = _chunks(bits, max_bits + 2)
    value = lambda x: sum(1 << b for b in x)
    return [value(a) | value(b) for a, b in combinations(blocks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(masks: list[int]) -> Column:
    each = [
        F.struct(F.lit(k).alias("no"), F.col("node").bitwiseAND(F.lit(_signed(m))).alias("bits"))
        for k, m in enumerate(masks)
    ]
    return F.explode(F.array(*each))


def spanning_links(group: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (member, smallest member) of the components within a group of distinct prints."""
    links, rest = [], np.sort(group)
    bits = rest.view(np.uint64)
    while len(rest):
        root, queue = int(rest[0]), [bits[0]]
        rest, bits = rest[1:], bits[1:]
        while queue and len(rest):
            near = np.bitwise_count(bits ^ queue.pop()) <= max_bits
            if near.any():
                links += [(int(x), root) for x in rest[near]]
                queue += list(bits[near])
                rest, bits = rest[~near], bits[~near]
    return links


def _linked(groups: DataFrame, max_bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u: list[int] = []
            v: list[int] = []
            for members in batch.column("members"):
                for a, b in spanning_links(np.array(members.values, np.int64), max_bits):
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"]
            )

    return groups.select("members").mapInArrow(run, "u long, v long")


def links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Spanning links ``(u, v)`` among distinct fingerprints ``node`` at most ``max_bits`` apart.

    Two levels of keys fix 48 of 64 bits for ``max_bits`` 2, so a group of distinct
    fingerprints has at most 65,536 members whatever the corpus.
    """
    masks = _masks(list(range(64)), max_bits)
    keyed = nodes.select("node", _keys(masks).alias("key")).select("node", "key.no", "key.bits")
    sizes = cut_lineage(
        keyed.groupBy("no", "bits").count().filter("count > 1"), "block-sizes"
    )
    small = keyed.join(sizes.filter(F.col("count") <= GROUP_MAX), ["no", "bits"])
    few = small.groupBy("no", "bits").agg(F.collect_list("node").alias("members"))
    found = _linked(few, max_bits)
    large = keyed.join(sizes.filter(F.col("count") > GROUP_MAX), ["no", "bits"])
    large = cut_lineage(large.select("node", "no", "bits"), "large-blocks")
    inner = [_masks([b for b in range(64) if not m >> b & 1], max_bits) for m in masks]
    for no, second in enumerate(inner):
        again = large.filter(F.col("no") == no).select("node", "no", "bits", _keys(second).alias("key"))
        again = again.groupBy("bits", "key").agg(F.collect_list("node").alias("members"))
        found = found.union(_linked(again.filter(F.size("members") > 1), max_bits))
    return found


def _classes(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """The rows of ``near_duplicates`` with ``root``, the smallest fingerprint of the class."""
    prints = cut_lineage(fingerprints(docs, shingle), "fingerprints")
    nodes = cut_lineage(
        prints.groupBy(F.col("fingerprint").alias("node")).agg(F.min("doc_id").alias("first")), "nodes"
    )
    roots = components(cut_lineage(links(nodes.select("node"), max_bits), "links"))
    classed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = cut_lineage(classed.join(lowest, "root").select("node", "component_id", "root"), "classes")
    return prints.join(classes, prints["fingerprint"] == classes["node"]).drop("node")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, fingerprint (long), component_id.

    component_id is the smallest doc_id reachable over fingerprints at most ``max_bits``
    apart, its own included; null if no row of the component has an id. Null and empty
    texts have fingerprint zero and are linked like any other. Equal rows share a class.
    """
    return _classes(docs, shingle, max_bits).drop("root")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each class: that of smallest doc_id, then smallest text key.

    A row without an id goes if its class has a row with one. Equal rows count once.
    """
    classes = _classes(docs, shingle, max_bits)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = classes.groupBy("root").agg(F.min(rank).alias("r"))
    text_key, id_key, no_id = private_names(docs, "_text_key", "_id_key", "_no_id")
    chosen = first.select(
        F.coalesce("r.doc_id", F.lit(0)).alias(id_key),
        F.col("r.doc_id").isNull().alias(no_id),
        F.col("r.text_key").alias(text_key),
    ).distinct()
    keys = [id_key, no_id, text_key]
    keyed = docs.withColumns(
        {
            id_key: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
            no_id: F.col("doc_id").isNull(),
            text_key: F.xxhash64(F.coalesce("text", F.lit(""))),
        }
    )
    kept = keyed.join(cut_lineage(chosen, "chosen"), keys, "left_semi")
    return kept.dropDuplicates(keys).select(*[quoted(c) for c in docs.columns])
