"""Cross-tokenizer alignment: intervals of two tokenizations of a text, coalesced into groups.

A is a byte-level vocabulary that reads a space and the text, B a piece vocabulary that puts
that space there itself, so the tokens of both are byte intervals over the same string.

1. All A and B tokens of a run of texts are sorted by start (``lexsort``); the running
   maximum of their ends tells where a group ends: at a start that reaches it.
2. Inside a group every A token is linked with every B token.
3. Spark counts for each pair of ids in how many documents it is linked. Pairs above a
   frequency that at most ``FREQUENT`` pairs reach meet the documents as a broadcast table,
   all others by a join, so no pair that every document holds is shuffled for each of them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import release, shared, slices, starts_of
from gleaner.session import cut_lineage

A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
#: Characters after which a long text is cut at the next safe place.
PART = 1 << 18
#: Links expanded at once.
LINKS = 1 << 21
#: Bound on the pairs that are broadcast.
FREQUENT = 1 << 18

#: Both vocabularies always begin a token at a space between two ASCII letters.
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: White space on which the splitting pattern of tiktoken runs out of stack.
_LONG_BLANK = re.compile(r"\s{5000}")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>\Z")


def parts(text: str, limit: int = PART) -> Iterator[str]:
    """A text cut at spaces where no token of either vocabulary reaches across.

    The space at a cut is left out: either tokenization of a part brings it back.
    """
    begin = 0
    while len(text) - begin > limit:
        at = _SAFE.search(text, begin + limit)
        if at is None:
            break
        yield text[begin : at.start()]
        begin = at.end()
    yield text[begin:]


class ByteLevel:
    """Ids and token bytes of a byte-level tokenizer file; special strings are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"]
        plain = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if i not in added}
        size = max([*vocabulary.values(), *added]) + 1
        self.bytes = [b""] * size
        for token, i in [*plain.items(), *((t, i) for i, t in added.items())]:
            self.bytes[i] = token
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        merges = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        self.fast = None
        if merges == sorted(set(merges)):  # ids follow the merges, so they serve as ranks
            self.fast = tiktoken.Encoding(
                "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain, special_tokens={}
            )

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [
            self.fast.encode_ordinary(t)
            if self.fast and not _LONG_BLANK.search(t)
            else self.library.encode(t, add_special_tokens=False).ids
            for t in texts
        ]


class Pieces:
    """Ids and token bytes of a piece model; the mark of a space counts as one byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            byte = _BYTE_PIECE.match(piece) if self.model.is_byte(i) else None
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Groups and links of runs of texts. Vocabularies are read once for each worker."""

    def __init__(self, paths: str):
        a_path, b_path = paths.split("\n")
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_size = np.array([len(x) for x in self.a.bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b.bytes], np.int64)
        self.width = len(self.b.bytes)
        # a group's first A token follows ";", its first B token "|", any other token ","
        most = max(len(self.a.bytes), self.width)
        self.most = most
        self.shown = [f"{sign}{i}" for sign in ",;|" for i in range(most)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of both; texts that either does not give back byte by byte are marked."""
        a, b = self.a.encode([" " + t for t in texts]), self.b.encode(texts)
        a_bytes, b_bytes = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        good = np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            want = b" " + text.encode()
            good[k] = b"".join(map(a_bytes, a[k])) == want and b"".join(map(b_bytes, b[k])) == want
        return a, b, good

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The group of each A and each B token, and the byte where each token starts.

        Both sequences tile the same bytes.
        """
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.concatenate([a_ends, b_ends])
        starts = np.concatenate([a_ends - self.a_size[a], b_ends - self.b_size[b]])
        order = np.lexsort((ends, starts))
        reach = np.maximum.accumulate(ends[order])
        new = np.zeros(len(order), np.int64)
        new[1:] = starts[order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new)
        return group[: len(a)], group[len(a) :], starts[: len(a)], starts[len(a) :]

    def links(self, a, b, a_group, b_group, row_of_group) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        """Distinct ``row * |A| * |B| + a * |B| + b`` of all links in order, and how many links each has."""
        sizes = np.bincount(b_group, minlength=len(row_of_group))
        first = starts_of(sizes)
        per_token = sizes[a_group]
        before = starts_of(per_token)
        codes, times = [], []
        begin, span = 0, len(self.a.bytes) * self.width
        while begin < len(a):
            end = max(int(np.searchsorted(before, before[begin] + LINKS, "right")) - 1, begin + 1)
            count = per_token[begin:end]
            left = np.repeat(np.arange(begin, end), count)
            right = np.arange(len(left)) - np.repeat(before[begin:end] - before[begin], count) + first[a_group[left]]
            code, n = np.unique(row_of_group[a_group[left]] * span + a[left] * self.width + b[right], return_counts=True)
            codes.append(code)
            times.append(n)
            begin = end
        return merged(codes, times)

    def text(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> list[str]:
        """Each token with the sign before it, groups in order, A before B inside a group."""
        side = np.concatenate([a_group * 2, b_group * 2 + 1])
        order = np.argsort(side, kind="stable")
        side = side[order]
        lead = np.ones(len(side), bool)
        lead[1:] = side[1:] != side[:-1]
        sign = np.where(lead, 1 + side % 2, 0)
        return [self.shown[k] for k in (sign * self.most + np.concatenate([a, b])[order]).tolist()]


def merged(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) == 1:
        return codes[0], times[0]
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, place = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(place, weights=np.concatenate(times), minlength=len(code)).astype(np.int64)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum())), sizes


class _Rows:
    """What the rows of one slice add up to, part by part."""

    def __init__(self, n: int, with_groups: bool):
        self.n = n
        self.counts = np.zeros((4, n), np.int64)  # A tokens, B tokens, groups, links
        self.good = np.ones(n, bool)
        self.digests = [hashlib.sha256() for _ in range(n)]
        self.begun = np.zeros(n, bool)
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.groups: list[list[dict]] | None = [[] for _ in range(n)] if with_groups else None
        self.bytes = np.zeros(n, np.int64)

    def add(self, aligner: Aligner, rows: list[int], texts: list[str]) -> None:
        a_lists, b_lists, good = aligner.encode(texts)
        row = np.array(rows, np.int64)
        self.good[row[~good]] = False
        use = np.flatnonzero(good).tolist()
        if not use:
            return
        row = row[use]
        a, a_sizes = _flat([a_lists[k] for k in use])
        b, b_sizes = _flat([b_lists[k] for k in use])
        a_group, b_group, a_start, b_start = aligner.groups(a, b)
        first = starts_of(a_sizes)
        # texts begin with a group of their own: the tokens before them end where they start
        group_first = np.append(a_group[first[:-1]], a_group[-1] + 1)
        n_groups = np.diff(group_first)
        row_of_group = np.repeat(row, n_groups)
        links = np.bincount(a_group) * np.bincount(b_group)
        for k, part in enumerate([a_sizes, b_sizes, n_groups, np.add.reduceat(links, group_first[:-1])]):
            np.add.at(self.counts[k], row, part)
        codes, times = aligner.links(a, b, a_group, b_group, row_of_group)
        self.codes.append(codes)
        self.times.append(times)
        shown = aligner.text(a, b, a_group, b_group)
        at = starts_of(a_sizes + b_sizes)
        for k, r in enumerate(row.tolist()):
            text = "".join(shown[at[k] : at[k + 1]])
            self.digests[r].update((text if self.begun[r] else text[1:]).encode())
            self.begun[r] = True
            if self.groups is not None:
                self._keep_groups(r, text, int(self.bytes[r]) - int(a_start[first[k]]), a_start[first[k] : first[k + 1]], a_group[first[k] : first[k + 1]])
            self.bytes[r] += int(aligner.a_size[a[first[k] : first[k + 1]]].sum())

    def _keep_groups(self, r: int, text: str, shift: int, starts: np.ndarray, group: np.ndarray) -> None:
        begins = starts[np.flatnonzero(np.diff(group, prepend=-1))] + shift
        for begin, one in zip(begins.tolist(), text[1:].split(";"), strict=True):
            a, b = one.split("|")
            self.groups[r].append({"begin": begin, "a": [int(x) for x in a.split(",")], "b": [int(x) for x in b.split(",")]})

    def columns(self, aligner: Aligner) -> list[pa.Array]:
        good = self.good & self.begun
        counts = np.where(good, self.counts, 0)
        codes, times = merged(self.codes, self.times)
        span = len(aligner.a.bytes) * aligner.width
        row = codes // span
        kept = good[row]
        codes, times, row = codes[kept], times[kept], row[kept]
        offsets = pa.array(np.searchsorted(row, np.arange(self.n + 1)), pa.int32())
        pairs = pa.ListArray.from_arrays(offsets, pa.array(codes - row * span))
        many = pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))
        digests = [d.hexdigest() if ok else "" for d, ok in zip(self.digests, good.tolist(), strict=True)]
        out = [*(pa.array(c) for c in counts), pa.array(digests, pa.string()), pairs, many]
        if self.groups is not None:
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            out.append(pa.array([g if ok else [] for g, ok in zip(self.groups, good.tolist(), strict=True)], kind))
        return out


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, with_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: its alignment. ``row`` numbers them, ``doc_id`` comes along.

    ``n_a, n_b, n_groups, n_links`` count tokens, groups and linked token pairs;
    ``groups_sha256`` is the digest of ``a1,a2|b1;a3|b2,b3``; ``pairs`` holds the distinct linked
    id pairs as ``a * |B| + b`` and ``times`` how many links each has. ``with_groups`` adds
    ``groups array<struct<begin, a, b>>``, ``begin`` counting bytes of space and text.

    Null and empty texts, and texts that either vocabulary does not give back byte by byte
    (those with U+2581, say), have no tokens: zeros, empty lists and ''. Long texts are aligned
    in parts of some ``PART`` characters, cut where both vocabularies begin a token; one
    without such a place is aligned whole. Equal rows are rows like any other, other columns
    are not looked at, and an empty table gives an empty one.
    """
    paths = f"{a_path or public_tokenizers.path(A_FILE)}\n{b_path or public_tokenizers.path(B_FILE)}"
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    names += ["groups"] if with_groups else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared(Aligner, paths)
        seen = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows in slices(batch, "text", 2 << 20):
                texts = rows.column("text").to_pylist()
                found = _Rows(len(texts), with_groups)
                queue: list[tuple[int, str]] = []
                size = 0
                for k, text in enumerate(texts):
                    for part in parts(text) if text else ():
                        queue.append((k, part))
                        size += len(part)
                        if size > 4 * PART:
                            found.add(aligner, *map(list, zip(*queue, strict=True)))
                            queue, size = [], 0
                if queue:
                    found.add(aligner, *map(list, zip(*queue, strict=True)))
                numbers = pa.array(np.arange(seen, seen + len(texts)))
                seen += len(texts)
                yield pa.RecordBatch.from_arrays([numbers, rows.column("doc_id"), *found.columns(aligner)], names)

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    schema += "pairs array<long>, times array<int>"
    schema += ", groups array<struct<begin:bigint,a:array<int>,b:array<int>>>" if with_groups else ""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, T.StructType.fromDDL(schema))


def link_table(aligned: DataFrame, b_size: int) -> DataFrame:
    """``pair, a, b, docs, best``: the documents that hold each linked pair of ids.

    ``best`` marks the pairs that no other pair of the same A id exceeds.
    """
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    counts = cut_lineage(counts, "links")
    counts = counts.select("pair", F.expr(f"pair div {b_size}").alias("a"), F.expr(f"pair % {b_size}").alias("b"), "docs")
    # at most one row for each id of A
    top = counts.groupBy("a").agg(F.max("docs").alias("most"))
    marked = counts.join(F.broadcast(top), "a").withColumn("best", F.col("docs") == F.col("most"))
    return cut_lineage(marked.select("pair", "a", "b", "docs", "best"), "link-table")


def _frequent_from(links: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs reach in documents."""
    power = F.floor(F.log2(F.col("docs").cast("double"))).cast("int")
    sizes = {r["power"]: r["n"] for r in links.groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, max(sizes, default=0) + 1
    while least > 0 and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    return 1 << least


def link_sums(aligned: DataFrame, links: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of its lists, read from the link table."""
    bound = _frequent_from(links, frequent)
    known = links.select("pair", "docs", "best")
    common, rare = known.filter(F.col("docs") >= bound), known.filter(F.col("docs") < bound)
    single = aligned.select("row", F.expr("inline(arrays_zip(pairs, times))")).toDF("row", "pair", "times")
    sums = [F.sum(F.col("times") * F.col("docs")).alias("count_sum"), F.sum(F.expr("if(best, times, 0)")).alias("n_best")]
    often = single.join(F.broadcast(common), "pair").groupBy("row").agg(*sums)
    seldom = single.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(rare, "pair")
    seldom = seldom.groupBy("row").agg(*sums)
    both = often.union(seldom).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = aligned.drop("pairs", "times").join(both, "row", "left")
    return out.fillna(0, ["count_sum", "n_best"])


def aligned_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: its alignment with sums over the corpus-wide counts of its links."""
    spark = docs.sparkSession
    b_file = b_path or public_tokenizers.path(B_FILE)
    aligned = cut_lineage(align(docs, a_path, b_path), "aligned")
    links = link_table(aligned, len(shared(Pieces, b_file).bytes))
    release(spark)
    return link_sums(aligned, links)
