"""What several operators of this package share."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from gleaner.session import cut_lineage, run_dir

#: ASCII white space, as a Java and Python pattern.
SPACES = r"[ \t\n\x0B\f\r]"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of finished jobs.

    Spark removes them once their plans are garbage; a driver with a quiet heap may
    not collect for a long time, while the files of every stage pile up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path."""
    path = run_dir(df.sparkSession, label)
    return cut_lineage(df, label, path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables whose readers have all been written themselves."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def private_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` bears, whatever its case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and how many each text has; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    parts = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(parts.offsets)
    flat = parts.flatten()
    real = np.asarray(pc.not_equal(flat, ""))
    before = np.concatenate([[0], np.cumsum(real)])
    ends = offsets - offsets[0]
    words = flat.filter(pa.array(real))
    # lowered last: ascii_lower (Arrow 23) mixes up the bytes of a slice that was cast
    return pc.ascii_lower(words) if lower else words, np.diff(before[ends])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each group begins in a flat array of groups of these sizes."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def safe_name(text: str) -> str:
    return re.sub(r"\W+", "-", text)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about ``limit`` bytes; a longer text stands alone.

    Work on a slice is vectorised, so its memory follows the limit and not the batch.
    """
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    begin, total = 0, 0
    for k, size in enumerate(sizes):
        if k > begin and total + size > limit:
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += size
    if len(sizes) > begin:
        yield batch.slice(begin)


def word_hashes(words: pa.Array) -> np.ndarray:
    """XXH64 of each word, computed once for each distinct word."""
    coded = words.dictionary_encode()
    known = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    return hashes[np.asarray(coded.indices)]


#: Longest key whose value a worker keeps: text without spaces is one word however long.
KEPT_LENGTH = 64


class Recent:
    """Values made on demand, the recently used ones kept: two generations of ``limit`` each.

    A full generation replaces the older one, so what is asked for often stays. Keys beyond
    KEPT_LENGTH are made once a call and not kept, so that entries are bounded in size too.
    """

    def __init__(self, make: Callable, limit: int, length: Callable = len):
        self.make, self.limit, self.length = make, limit, length
        self.new: dict = {}
        self.old: dict = {}

    def all(self, keys: list) -> list:
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        once: dict = {}
        get, fetch = self.new.get, self._fetch
        return [get(k) or fetch(k, once) for k in keys]

    def _fetch(self, key, once):  # noqa: ANN001, ANN202
        value = self.old.get(key)
        if value is None:
            value = once.get(key)
        if value is None:
            value = self.make(key)
        kept = once if self.length(key) > KEPT_LENGTH else self.new
        kept[key] = value
        return value


_shared: dict = {}


def shared(kind: type, path: str):  # noqa: ANN201
    """One object of a kind for a file, kept by the Python worker from task to task."""
    if (kind, path) not in _shared:
        _shared[kind, path] = kind(path)
    return _shared[kind, path]
