"""N-best segmentation: forward Viterbi scores guide a backward A-star over the piece lattice.

The forward pass gives the best score of every prefix. A search from the end of the text
then adds one piece at a time; a partial path's own score plus the best score of what is
left is exactly the best total it can reach, so complete paths come out best first.

No piece reaches over the start of a word, so a text's lattice is a chain of word lattices.
A text's N best paths leave the best path in at most N - 1 words, and those are among the
words whose second path costs least; only these are searched.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import KEPT_LENGTH, Recent, shared, slices, starts_of
from gleaner.llm.prefix import MARK, MODEL, words_of

N_BEST = 4
#: Words that a worker keeps, in each of two generations.
KEPT_WORDS = 400_000
#: Words with their N best paths, likewise: texts share the words of cheap second paths.
KEPT_SEARCHES = 20_000
#: Words whose summaries are made together.
AT_ONCE = 1 << 15
_LOW = float("-inf")


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Lattice:
    """Pieces and scores of a model, and the paths through words and texts.

    A character that no piece covers becomes its UTF-8 bytes, at UNKNOWN below the lowest score.
    """

    UNKNOWN = 10.0

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.scores: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("pieces of this model reach over the start of a word")
        # by character: the score of the piece that ends there, if any, and what may follow
        self.tree: dict[str, list] = {}
        for piece, score in self.scores.items():
            below = self.tree
            for c in piece:
                node = below.setdefault(c, [None, {}])
                below = node[1]
            node[0] = score
        self.unknown = min(self.scores.values()) - self.UNKNOWN
        self.pieces = {i: p for p, i in self.ids.items()}
        self.octets = {i: b for b, i in self.bytes.items()}
        # by id: the UTF-8 bytes that it decodes to, marks as spaces
        held = [bytes([self.octets[i]]) if i in self.octets else self.pieces.get(i, "").replace(MARK, " ").encode("utf-8") for i in range(model.get_piece_size())]
        self.decoded = pa.array(held, pa.large_binary())
        self._number_nodes()
        self.known = Recent(self.summary, KEPT_WORDS)
        self.searched = Recent(lambda asked: self.word_paths(*asked), KEPT_SEARCHES, lambda asked: len(asked[0]))

    def lattice(self, word: str) -> tuple[list[tuple[int, int, float]], list[float], list[int]]:
        """``(begin, end, score)`` of all pieces by begin, and the forward pass over them:
        the best score of each prefix and where its last piece begins."""
        tree, scores, edges, n = self.tree, self.scores, [], len(word)
        best, back = [0.0] + [_LOW] * n, [0] * (n + 1)
        for i in range(n):
            here = best[i]
            if word[i] not in scores:
                edges.append((i, i + 1, self.unknown))
                if here + self.unknown > best[i + 1]:
                    best[i + 1], back[i + 1] = here + self.unknown, i
            below, j = tree, i
            while j < n:
                node = below.get(word[j])
                if node is None:
                    break
                score, below = node
                j += 1
                if score is not None:
                    edges.append((i, j, score))
                    if here + score > best[j]:
                        best[j], back[j] = here + score, i
        return edges, best, back

    def path_ids(self, word: str, cuts: list[int]) -> list[int]:
        """Ids of the pieces between consecutive cuts."""
        out = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            found = self.ids.get(word[i:j])
            out += [found] if found is not None else [self.bytes[b] for b in word[i:j].encode("utf-8")]
        return out

    def summary(self, word: str) -> tuple[bytes, float, float]:
        """Ids of the best path, its score, and what the second-best path costs more: a
        forward pass that keeps two scores a prefix."""
        tree, scores, n = self.tree, self.scores, len(word)
        best, second, back = [0.0] + [_LOW] * n, [_LOW] * (n + 1), [0] * (n + 1)
        for i in range(n):
            here, after = best[i], second[i]
            below, j = tree, i
            if word[i] not in scores:
                t = here + self.unknown
                if t > best[i + 1]:
                    second[i + 1] = max(best[i + 1], after + self.unknown)
                    best[i + 1], back[i + 1] = t, i
                elif t > second[i + 1]:
                    second[i + 1] = t
            while j < n:
                node = below.get(word[j])
                if node is None:
                    break
                j += 1
                score, below = node
                if score is not None:
                    t = here + score
                    if t > best[j]:
                        second[j] = max(best[j], after + score)
                        best[j], back[j] = t, i
                    elif t > second[j]:
                        second[j] = t
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
        return _packed(self.path_ids(word, cuts)), best[n], best[n] - second[n]

    def _number_nodes(self) -> None:
        """The tree as arrays: a number for each node, and its children by (node, character).

        Characters that are pieces themselves have numbers; any other has -1.
        """
        alone = sorted(c for c in self.scores if len(c) == 1)
        self.alone = np.full(0x110000, -1, np.int32)
        self.alone[[ord(c) for c in alone]] = np.arange(len(alone))
        self.fan = len(alone) + 1
        keys, scores, ids = [], [_LOW], [0]
        below = [(0, "", self.tree)]
        while below:
            node, prefix, children = below.pop()
            for c, (score, further) in children.items():
                # no word of numbered characters comes past another one
                if self.alone[ord(c)] >= 0:
                    keys.append((node * self.fan + int(self.alone[ord(c)]), len(scores)))
                    below.append((len(scores), prefix + c, further))
                    scores.append(_LOW if score is None else score)
                    ids.append(0 if score is None else self.ids[prefix + c])
        self.keys, self.children = np.array(sorted(keys), np.int64).reshape(-1, 2).T.copy()
        self.node_scores, self.node_ids = np.array(scores), np.array(ids, np.uint32)

    def learn(self, words: Iterable[str]) -> None:
        """Keep the summaries of those words that are not known yet, made together.

        Long words and those with a character outside the vocabulary are left to :meth:`summary`.
        """
        kept, older = self.known.new, self.known.old
        fresh = [w for w in dict.fromkeys(words) if len(w) <= KEPT_LENGTH and w not in kept and w not in older]
        for k in range(0, len(fresh), AT_ONCE):
            kept.update(self.summaries(fresh[k : k + AT_ONCE]))

    def summaries(self, words: list[str]) -> dict[str, tuple[bytes, float, float]]:
        """What :meth:`summary` gives, for all words whose characters are pieces: the same
        forward pass over all of them, place by place."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        numbers = self.alone[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        begin = starts_of(sizes)
        covered = np.diff(starts_of(numbers < 0)[begin]) == 0
        order = np.flatnonzero(covered & (sizes > 0))
        order = order[np.argsort(-sizes[order], kind="stable")]
        if not len(order):
            return {}
        sizes, begin = sizes[order], begin[:-1][order]
        longest = int(sizes[0])
        # words longer than each place
        live = np.searchsorted(-sizes, -np.arange(longest + 1), "left").tolist()
        at = [numbers[begin[:n] + i].astype(np.int64) for i, n in enumerate(live[:-1])]
        shape = (longest + 1, len(order))
        best, second = np.full(shape, _LOW), np.full(shape, _LOW)
        back, by = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
        best[0] = 0.0
        for i in range(longest):
            rows, node = np.arange(live[i]), np.zeros(live[i], np.int64)
            for j in range(i, longest):
                asked = node * self.fan + at[j][rows]
                found = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
                there = self.keys[found] == asked
                rows, node = rows[there], self.children[found[there]]
                if not len(rows):
                    break
                score = self.node_scores[node]
                ends = score > _LOW
                row, score = rows[ends], score[ends]
                t, old = best[i, row] + score, best[j + 1, row]
                better = t > old
                second[j + 1, row] = np.where(better, np.maximum(old, second[i, row] + score), np.maximum(second[j + 1, row], t))
                row = row[better]
                best[j + 1, row], back[j + 1, row], by[j + 1, row] = t[better], i, node[ends][better]
                left = int(np.searchsorted(rows, live[j + 1]))
                rows, node = rows[:left], node[:left]
        row = np.arange(len(order))
        total, rest = best[sizes, row], second[sizes, row]
        place, taken = sizes.copy(), []
        while len(row):
            taken.append((row, self.node_ids[by[place, row]]))
            place = back[place, row]
            row, place = row[place > 0], place[place > 0]
        counts = np.bincount(np.concatenate([r for r, _ in taken]), minlength=len(order))
        bounds = starts_of(counts)
        ids = np.empty(bounds[-1], "<u4")
        for k, (row, found) in enumerate(taken):
            ids[bounds[row + 1] - 1 - k] = found
        data, cuts = ids.tobytes(), (4 * bounds).tolist()
        paths = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return dict(zip([words[k] for k in order.tolist()], zip(paths, total.tolist(), (total - rest).tolist(), strict=True), strict=True))

    def word_paths(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """Up to ``n`` best paths of a word, by A-star from its end. Ties come in a fixed order."""
        edges, best, _ = self.lattice(word)
        into: list[list[tuple[int, float]]] = [[] for _ in range(len(word) + 1)]
        for i, j, s in edges:
            into[j].append((i, s))
        order = count()
        # the latest of equal entries goes first, so that ties lead on to an end
        agenda: list[tuple] = [(-best[-1], next(order), len(word), 0.0, None)]
        out = []
        while agenda and len(out) < n:
            _, _, at, gained, later = heapq.heappop(agenda)
            if at == 0:
                cuts, node = [0], later
                while node is not None:
                    cuts.append(node[0])
                    node = node[1]
                out.append((gained, self.path_ids(word, cuts)))
                continue
            for i, s in into[at]:
                if best[i] > _LOW:
                    heapq.heappush(agenda, (-(gained + s + best[i]), -next(order), i, gained + s, (at, later)))
        return out

    def text_paths(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """Up to ``n`` best paths of a text as (score, ids); empty text has one empty path."""
        return self.paths_of(words_of(text), n)

    def paths_of(self, words: list[str], n: int) -> list[tuple[float, bytes]]:
        """:meth:`text_paths` of a text cut into words."""
        if not words:
            return [(0.0, b"")]
        ids, scores, extra = zip(*self.known.all(words), strict=True)
        total = float(sum(scores))
        costs = np.array(extra)
        at = np.arange(len(costs))
        if len(costs) >= n > 1:
            at = np.flatnonzero(costs <= np.partition(costs, n - 2)[n - 2])
        ways: list[tuple[float, dict[int, bytes]]] = [(0.0, {})]
        for k in sorted(at.tolist(), key=lambda k: (costs[k], k))[: n - 1]:
            paths = self.searched.all([(words[k], n)])[0]
            first = paths[0][0]
            options = [(0.0, None)] + [(first - s, p) for s, p in self._others(paths, ids[k])]
            merged = [(c + d, w if p is None else {**w, k: p}) for c, w in ways for d, p in options]
            ways = heapq.nsmallest(n, merged, key=lambda x: x[0])
        return [(total - cost, self._joined(ids, swap)) for cost, swap in ways]

    @staticmethod
    def _joined(ids: tuple[bytes, ...], swap: dict[int, bytes]) -> bytes:
        """The ids of a text's words, but for those words that are taken otherwise."""
        taken = list(ids)
        for k, other in swap.items():
            taken[k] = other
        return b"".join(taken)

    @staticmethod
    def _others(paths: list[tuple[float, list[int]]], best: bytes) -> list[tuple[float, bytes]]:
        """The paths but for the one that the forward pass took."""
        return [(s, ids) for s, ids in ((s, _packed(p)) for s, p in paths) if ids != best]

    def characters(self, ids: list[int]) -> str:
        """Pieces and runs of bytes joined, marks as they are."""
        try:
            return "".join(map(self.pieces.__getitem__, ids))
        except KeyError:
            out, octets = [], bytearray()
        for i in ids:
            piece = self.pieces.get(i)
            if piece is None:
                octets.append(self.octets[i])
                continue
            if octets:
                out.append(octets.decode("utf-8"))
                octets = bytearray()
            out.append(piece)
        if octets:
            out.append(octets.decode("utf-8"))
        return "".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of a path: its characters with marks as spaces, without the first one."""
        return self.characters(np.frombuffer(ids, "<u4").tolist()).replace(MARK, " ")[1:]

    def decode_all(self, paths: list[bytes]) -> list[bytes]:
        """What :meth:`decode` gives for each path, in UTF-8: the pieces of all of them taken at once."""
        taken = self.decoded.take(pa.array(np.frombuffer(b"".join(paths), "<u4")))
        data = memoryview(taken.buffers()[2] or b"")
        ends = np.frombuffer(taken.buffers()[1], np.int64)[np.cumsum([0, *(len(p) // 4 for p in paths)])].tolist()
        return [bytes(data[a + 1 : b]) for a, b in zip(ends, ends[1:], strict=False)]


def segment(docs: DataFrame, path: str | None = None, n: int = N_BEST, with_ids: bool = False) -> DataFrame:
    """Best segmentations of each text.

    ``doc_id, n_pieces, ids_crc32`` (of the best path, ids as little-endian 32-bit numbers),
    ``scores`` (best first), ``lengths`` (pieces of each), ``decoded`` (whether each path decodes
    to the text; the model reads its own mark as a space) and ``paths_crc32`` (of each path's ids).
    ``with_ids`` adds ``paths array<array<int>>``. Null texts count as empty: one path without
    pieces, score 0.
    """
    path = path or public_tokenizers.path(MODEL)
    ddl = "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, lengths array<int>, decoded boolean"
    ddl += ", paths_crc32 array<long>"
    ddl += ", paths array<array<int>>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared(Lattice, path)
        for batch in batches:
            for rows in slices(batch, "text"):
                texts = [text or "" for text in rows.column("text").to_pylist()]
                split = [words_of(text) for text in texts]
                lattice.learn(chain.from_iterable(split))
                found = [lattice.paths_of(words, n) for words in split]
                again = iter(lattice.decode_all([ids for ways in found for _, ids in ways]))
                out: list[list] = [[] for _ in range(7)]
                for text, ways in zip(texts, found, strict=True):
                    whole = text.replace(MARK, " ").encode("utf-8")
                    sums = [zlib.crc32(ids) for _, ids in ways]
                    row = (
                        len(ways[0][1]) // 4,
                        sums[0],
                        [score for score, _ in ways],
                        [len(ids) // 4 for _, ids in ways],
                        [next(again) == whole for _ in ways].count(False) == 0,
                        sums,
                        [np.frombuffer(ids, "<u4").tolist() for _, ids in ways] if with_ids else None,
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))]
                names = ["n_pieces", "ids_crc32", "scores", "lengths", "decoded", "paths_crc32", "paths"][: 6 + with_ids]
                arrays = [pa.array(c, k) for c, k, _ in zip(out, kinds, names, strict=False)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *arrays], ["doc_id", *names])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, ddl)
