"""Exact top-k inner products: buckets by vector length, local cosine thresholds, verification.

Vectors are sorted by length and cut into buckets; queries are cut into blocks. A bucket of
the longest vectors gives each query a lower bound of its k-th score. That bound, over the
query's length and the bucket's greatest one, is the cosine a vector of the bucket must
reach. Above 1 the bucket is skipped. A high local threshold prunes by one coordinate: a
vector that near to the query must have a value close to the query's in its largest
coordinate. A low one prunes by length alone. What is left is verified by exact products.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import cut_lineage

TOP = 20
SCALE = 64.0
#: Vectors in a bucket and queries in a block, about.
BUCKET_ROWS = 2048
BLOCK_ROWS = 256
#: Local thresholds from here on prune by coordinate.
COSINE = 0.5
#: Products up to this size are exact in doubles.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def _vectors(table: DataFrame) -> DataFrame:
    """``uid, vec_id, dim, norm, data``: usable rows, components scaled and floored as doubles.

    A vector with a component too long to be scaled as a double stays as it is; an infinite
    norm marks it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            pairs = zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True)
            for vec_id, vector in pairs:
                if vec_id is None or not vector.is_valid or vector.values.null_count:
                    continue
                given = np.asarray(vector.values, np.float64)
                if np.isfinite(given).all():
                    with np.errstate(over="ignore"):
                        x = np.floor(SCALE * given)
                        norm = min(float(np.linalg.norm(x)), np.finfo(float).max)
                    if not np.isfinite(x).all():
                        x, norm = given, np.inf
                    rows.append((uid, vec_id, len(x), norm, x.tobytes()))
                    uid += 1
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["uid", "vec_id", "dim", "norm", "data"],
            )

    plain = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return plain.mapInArrow(run, "uid long, vec_id long, dim int, norm double, data binary")


def _packed(vectors: DataFrame, parts: int) -> DataFrame:
    """One row per part and dimension, longest vectors first: ``part, dim, uids, ids, norms, data``.

    Rows are spread by range of (dimension, length, id), which no two rows share, so equal
    vectors fill as many parts as they need.
    """
    order = [F.col("dim"), F.col("norm").desc(), F.col("vec_id"), F.col("uid")]
    spread = vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list]] = {}
        for batch in batches:
            for uid, vec_id, dim, norm, data in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                for column, value in zip(held.setdefault(dim, [[], [], [], []]), (uid, vec_id, norm, data), strict=True):
                    column.append(value)
        part = TaskContext.get().partitionId()
        out = [
            (part, dim, np.array(u, np.int64).tobytes(), np.array(i, np.int64).tobytes(), np.array(n).tobytes(), _narrow(b"".join(d)))
            for dim, (u, i, n, d) in held.items()
        ]
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["part", "dim", "uids", "ids", "norms", "data"],
        )

    return spread.mapInArrow(run, "part int, dim int, uids binary, ids binary, norms binary, data binary")


def _narrow(data: bytes) -> bytes:
    """The numbers in one byte each where they fit, behind a mark of the width."""
    x = np.frombuffer(data)
    if len(x) and np.abs(x).max() > 127:
        return b"d" + data
    return b"b" + x.astype(np.int8).tobytes()


def _matrix(data: bytes, rows: int) -> np.ndarray:
    kind = np.int8 if data[:1] == b"b" else np.float64
    return np.frombuffer(data[1:], kind).astype(np.float64).reshape(rows, -1)


def _numbers(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, kind)


def _whole(x: np.ndarray, norm: float) -> list[int]:
    """The components as integers; an infinite norm marks those that are still to be scaled."""
    if np.isfinite(norm):
        return [int(v) for v in x]
    with np.errstate(over="ignore"):
        return [int(np.floor(SCALE * v)) if np.isfinite(SCALE * v) else int(SCALE) * int(v) for v in x]


def exact_scores(rows: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> list[int]:
    """Integer products of any size, held within the limits of a long."""
    q = _whole(query, norm)
    found = [sum(map(operator.mul, q, _whole(row, n))) for row, n in zip(rows, norms, strict=True)]
    return [max(-_LONG - 1, min(_LONG, s)) for s in found]


class Bucket:
    """Vectors of one dimension, longest first."""

    def __init__(self, rows: list[dict]):
        join = lambda name, kind: np.concatenate([_numbers(r[name], kind) for r in rows])
        self.uids, self.ids, self.norms = join("uids", np.int64), join("ids", np.int64), join("norms", np.float64)
        self.data = np.vstack([_matrix(r["data"], len(r["ids"]) // 8) for r in rows])
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, query: np.ndarray, norm: float, cosine: float) -> np.ndarray:
        """Vectors whose value in the query's largest coordinate allows this cosine."""
        f = int(np.abs(query).argmax())
        if f not in self.sorted:
            unit = self.data[:, f] / np.where(self.norms > 0, self.norms, 1)
            order = np.argsort(unit, kind="stable")
            self.sorted[f] = order, unit[order]
        order, values = self.sorted[f]
        angle, reach = np.arccos(np.clip(query[f] / norm, -1, 1)), np.arccos(min(cosine, 1.0)) + 1e-6
        low, high = np.cos(min(np.pi, angle + reach)), np.cos(max(0.0, angle - reach))
        return order[np.searchsorted(values, low - 1e-9) : np.searchsorted(values, high + 1e-9, "right")]

    def best(self, uid: int, query: np.ndarray, norm: float, bound: float, k: int) -> tuple[np.ndarray, list[int]]:
        """Places and scores of the up to ``k`` best vectors that reach ``bound``."""
        rows = np.arange(len(self.ids))
        if norm > 0 and np.isfinite(norm) and np.isfinite(self.norms[0]) and np.isfinite(bound):
            top = norm * self.norms[0]
            if bound > top * (1 + 1e-9):
                return rows[:0], []
            if bound > 0:
                cosine = bound / top * (1 - 1e-9)
                if cosine >= COSINE:
                    rows = self.by_coordinate(query, norm, cosine)
                else:
                    reach = bound / norm * (1 - 1e-9)
                    rows = rows[: np.searchsorted(-self.norms, -reach, "right")]
        rows = rows[self.uids[rows] != uid]
        if not len(rows):
            return rows, []
        if norm * self.norms[0] < _EXACT:
            scores = self.data[rows] @ query
            reached = scores >= bound
            rows, scores = rows[reached], scores[reached]
            order = np.lexsort((self.ids[rows], -scores))[:k]
            return rows[order], [int(s) for s in scores[order]]
        scores = exact_scores(self.data[rows], self.norms[rows], query, norm)
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k]
        return rows[order], [scores[i] for i in order]


def _bounds(blocks: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """``blocks`` with ``bounds``: for each query a score that its k-th best reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                probe = Bucket(row["probe"])
                uids, norms = _numbers(row["uids"], np.int64), _numbers(row["norms"], np.float64)
                queries = _matrix(row["data"], len(uids))
                bounds = np.full(len(uids), -np.inf)
                for j in range(len(uids)):
                    _, scores = probe.best(int(uids[j]), queries[j], norms[j], -np.inf, k)
                    if len(scores) == k and abs(scores[-1]) < _EXACT:
                        bounds[j] = scores[-1]
                made.append(bounds.tobytes())
            kept = [batch.column(c) for c in ("dim", "uids", "ids", "norms", "data")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(made, pa.binary())], ["dim", "uids", "ids", "norms", "data", "bounds"]
            )

    joined = blocks.join(F.broadcast(probes), "dim").drop("part")
    return joined.mapInArrow(run, "dim int, uids binary, ids binary, norms binary, data binary, bounds binary")


def _verified(pairs: DataFrame, k: int) -> DataFrame:
    """``query_uid, query_id, vec_id, score`` of the best of each query in each bucket."""
    names = ["query_uid", "query_id", "uid", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                bucket = Bucket([{c: row[f"bucket_{c}"] for c in ("uids", "ids", "norms", "data")}])
                uids, ids = _numbers(row["uids"], np.int64), _numbers(row["ids"], np.int64)
                norms, bounds = _numbers(row["norms"], np.float64), _numbers(row["bounds"], np.float64)
                queries = _matrix(row["data"], len(uids))
                places, scores, of = [], [], []
                for j in range(len(uids)):
                    at, found = bucket.best(int(uids[j]), queries[j], norms[j], bounds[j], k)
                    places.append(at)
                    scores += found
                    of += [j] * len(found)
                at = np.concatenate(places) if places else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (uids[of], ids[of], bucket.uids[at], bucket.ids[at], scores)],
                    names,
                )

    return pairs.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def search(table: DataFrame, every: int = 20, k: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of each query.

    Queries are the rows whose vec_id is divisible by ``every``. Ties go to the smaller
    vec_id. Rows without an id, null vectors and vectors with a null or non-finite component
    take no part; vectors of different dimension have no product. Rows of equal id are rows
    of their own. Scores beyond a long are given as its limit.
    """
    vectors = cut_lineage(_vectors(table), "vectors")
    total = vectors.count()
    parts = max(1, -(-total // BUCKET_ROWS))
    buckets = cut_lineage(_packed(vectors, parts), "buckets")
    asked = vectors.filter(F.col("vec_id") % every == 0)
    blocks = cut_lineage(_packed(asked, max(1, -(-total // every // BLOCK_ROWS))), "blocks")
    first = buckets.groupBy("dim").agg(F.min("part").alias("first"))
    final, filled = buckets.agg(F.coalesce(F.max("part"), F.lit(0)), F.countDistinct("part")).first()
    # the longest vectors of each dimension in the table, about BUCKET_ROWS of them
    depth = -(-BUCKET_ROWS * max(1, filled) // max(1, total))
    probes = (
        buckets.join(first, "dim")
        .filter(F.col("part") < F.col("first") + depth)
        .groupBy("dim")
        .agg(F.sort_array(F.collect_list(F.struct("part", "uids", "ids", "norms", "data"))).alias("probe"))
    )
    bounded = _bounds(blocks, probes, k)
    # each block of queries meets each bucket once
    sent = bounded.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(final))))
    renamed = buckets.select(
        "part", "dim", *[F.col(c).alias(f"bucket_{c}") for c in ("uids", "ids", "norms", "data")]
    )
    found = _verified(sent.join(renamed, ["part", "dim"]), k)
    best = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "vec_id", "uid")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
