"""A hidden Markov language model: Baum-Welch over partitions, exact likelihood by forward recursion.

A word falls into one of BUCKETS classes by its CRC-32; the end of a text is a symbol of its
own. Latent states emit classes, and within its class a word has the probability
``(c + 1) / (N_b + V_b + 1)`` from the counts of all training words, one share being kept
for unknown ones. The word given its class does not depend on the state, so

    log P(text) = log P(classes) + sum of log P(word | class),

where the first term is the scaled forward recursion and the second is a sum over words.
The table of words is joined block by block: one entry for each distinct word of a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import release, remove, slices, split_words, starts_of, written
from gleaner.session import cut_lineage

#: Classes of words; their numbers are kept as 16-bit ones.
BUCKETS = 1 << 14
STATES = 8
#: Passes of Baum-Welch over all training texts.
ROUNDS = 3
#: Training texts are worked on in runs of this many tokens, their states carried over the cuts.
RUN = 128
#: Matrices of runs are scaled after so many tokens, long before their products leave a double's range.
SCALED = 8
#: The starting point is fitted on this many runs, those of smallest hash, in so many rounds.
START_RUNS, START_ROUNDS = 1500, 15
BLOCK_BYTES = 6 << 20
FOLDS, HELD = 7, 2
END = BUCKETS


@dataclass
class Model:
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


@dataclass
class Expected:
    """Expected counts of one or more partitions."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray

    @classmethod
    def none(cls, states: int) -> Expected:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((states, BUCKETS + 1)))


@dataclass
class Runs:
    """Runs of whole texts, in order: place, size, and the text and number of each."""

    begin: np.ndarray
    sizes: np.ndarray
    text: np.ndarray
    ordinal: np.ndarray
    last: np.ndarray


def runs_of(sizes: np.ndarray) -> Runs:
    """The runs that whole sequences are cut into."""
    pieces = -(-sizes // RUN)
    text = np.repeat(np.arange(len(sizes)), pieces)
    ordinal = np.arange(len(text)) - starts_of(pieces)[:-1][text]
    first = starts_of(sizes)[:-1][text]
    begin = first + RUN * ordinal
    return Runs(begin, np.minimum(RUN, first + sizes[text] - begin), text, ordinal, ordinal == pieces[text] - 1)


def _transfers(model: Model, symbols: np.ndarray, begin: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run the matrix that takes the state before it to that after it, up to a factor.

    The first run of a text takes any distribution to what the start leads to.
    """
    states = len(model.start)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes, first = begin[order], sizes[order], first[order]
    emits = np.ascontiguousarray(model.emits.T)
    made = np.repeat(model.moves[None], len(begin), axis=0)
    made[first] = model.start
    made *= emits[symbols[begin]][:, None, :]
    made /= made.sum(axis=(1, 2), keepdims=True)
    for t in range(1, int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -t, "left"))
        # one product for the rows of all matrices
        moved = (made[:n].reshape(-1, states) @ model.moves).reshape(n, states, states)
        np.multiply(moved, emits[symbols[begin[:n] + t]][:, None, :], out=made[:n])
        if t % SCALED == 0:
            made[:n] /= made[:n].sum(axis=(1, 2), keepdims=True)
    out = np.empty_like(made)
    out[order] = made
    return out


def _carried(model: Model, symbols: np.ndarray, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """The state before each run (its first one aside) and the backward state after it, each up to a factor.

    Texts of several runs are walked run by run, all texts at once: as many steps as the
    longest one has runs.
    """
    states = len(model.start)
    before = np.full((len(runs.begin), states), 1.0 / states)
    behind = np.ones((len(runs.begin), states))
    cut = np.flatnonzero((runs.ordinal > 0) | ~runs.last)
    if not len(cut):
        return before, behind
    matrices = np.empty((len(runs.begin), states, states))
    matrices[cut] = _transfers(model, symbols, runs.begin[cut], runs.sizes[cut], runs.ordinal[cut] == 0)
    by_step = np.argsort(runs.ordinal, kind="stable")
    bounds = np.searchsorted(runs.ordinal[by_step], np.arange(int(runs.ordinal.max()) + 2))
    for k in range(1, len(bounds) - 1):
        here = by_step[bounds[k] : bounds[k + 1]]
        state = np.einsum("ni,nij->nj", before[here - 1], matrices[here - 1])
        before[here] = state / state.sum(axis=1, keepdims=True)
    for k in range(len(bounds) - 2, 0, -1):
        here = by_step[bounds[k] : bounds[k + 1]]
        state = np.einsum("nij,nj->ni", matrices[here], behind[here])
        behind[here - 1] = state / state.sum(axis=1, keepdims=True)
    return before, behind


def expect(model: Model, symbols: np.ndarray, sizes: np.ndarray, total: Expected) -> None:
    """Add the expected counts of whole texts, whatever their length.

    Texts are cut into runs, and the forward and backward states at the cuts come first, from a
    matrix for each run. Then all runs are walked at once, some thousands together, so memory
    follows the runs at hand; the counts are those of the uncut texts.
    """
    runs = runs_of(sizes)
    before, behind = _carried(model, symbols, runs)
    for k in range(0, len(runs.begin), 4096):
        part = slice(k, k + 4096)
        _expect_runs(model, symbols, runs.begin[part], runs.sizes[part], runs.ordinal[part] == 0, before[part], behind[part], total)


def _expect_runs(
    model: Model, symbols: np.ndarray, begin: np.ndarray, sizes: np.ndarray, first: np.ndarray,
    before: np.ndarray, behind: np.ndarray, total: Expected,
) -> None:
    """Step by step, longest first; a run begins and ends with the states of its text there."""
    order = np.argsort(-sizes, kind="stable")
    begin, sizes, first, before, behind = (x[order] for x in (begin, sizes, first, before, behind))
    emits = np.ascontiguousarray(model.emits.T)
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(int(sizes[0]) if len(sizes) else 0)]
    alphas, scales, seen = [], [], []
    for t, n in enumerate(active):
        at = symbols[begin[:n] + t]
        reached = alphas[-1][:n] @ model.moves if t else np.where(first[:, None], model.start, before @ model.moves)
        a = emits[at] * reached
        c = a.sum(axis=1)
        alphas.append(a / c[:, None])
        scales.append(c)
        seen.append(at)
    beta = None
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        m = len(beta) if beta is not None else 0
        now = np.empty((n, len(model.start)))
        now[m:] = behind[m:n] / (alphas[t][m:] * behind[m:n]).sum(axis=1, keepdims=True)
        if m:
            ahead = emits[seen[t + 1]] * beta / scales[t + 1][:, None]
            total.moves += model.moves * (alphas[t][:m].T @ ahead)
            now[:m] = ahead @ model.moves.T
        beta = now
        if t == 0:
            over = emits[seen[0]] * beta / scales[0][:, None]
            total.moves += model.moves * (before[~first].T @ over[~first])
        alphas[t] = alphas[t] * beta
        if t == 0:
            total.start += alphas[0][first].sum(axis=0)
    if active:
        at, gamma = np.concatenate(seen), np.concatenate(alphas)
        for k in range(len(model.start)):
            total.emits[k] += np.bincount(at, weights=gamma[:, k], minlength=BUCKETS + 1)


def maximise(total: Expected, mass: np.ndarray) -> Model:
    """New parameters; ``mass`` is shared by the states as what each symbol has beforehand."""
    states = len(total.start)
    emits = total.emits + mass / states
    moves, start = total.moves + 1.0, total.start + 1.0
    return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True))


def first_model(mass: np.ndarray, states: int) -> Model:
    noise = np.random.default_rng(1).uniform(0.5, 1.5, (states, len(mass)))
    emits = noise * mass
    moves = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), moves, emits / emits.sum(axis=1, keepdims=True))


def likelihoods(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each whole sequence."""
    order = np.argsort(-sizes, kind="stable")
    begin, ranked = starts_of(sizes)[:-1][order], sizes[order]
    emits = np.ascontiguousarray(model.emits.T)
    logs = np.zeros(len(sizes))
    ends = -ranked
    state = None
    for t in range(int(ranked[0]) if len(ranked) else 0):
        n = int(np.searchsorted(ends, -t, "left"))
        a = emits[symbols[begin[:n] + t]] * (model.start if t == 0 else state[:n] @ model.moves)
        c = a.sum(axis=1)
        logs[:n] += np.log(c)
        state = a / c[:, None]
    out = np.empty(len(sizes))
    out[order] = logs
    return out


def held_out(doc_id: Column) -> Column:
    """Whether a document takes no part in training; one without an id does."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def _packed(codes: np.ndarray) -> bytes:
    """Word numbers byte plane by byte plane: the upper ones are mostly zero. The least of a block's files."""
    planes = np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _codes(batch: pa.RecordBatch, row: int) -> np.ndarray:
    """The word numbers of a block; its sizes say how many."""
    n = int(_flat(batch, "sizes", row).sum())
    planes = pa.decompress(batch.column("codes")[row].as_py(), 4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<i4").ravel()


def blocks_of(docs: DataFrame) -> DataFrame:
    """Texts as word numbers, a block of about BLOCK_BYTES a row.

    ``block, doc_ids, held, sizes, codes`` (packed numbers of words in ``words``), ``buckets`` and
    ``counts`` (the class and the number of training tokens of each distinct word).
    """
    ddl = (
        "block long, codes binary, doc_ids array<long>, held array<boolean>, sizes array<int>, "
        "words array<string>, buckets array<short>, counts array<long>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                words, sizes = split_words(part.column("text"), lower=True)
                coded = words.dictionary_encode()
                codes = np.asarray(coded.indices).astype(np.int32)
                known = coded.dictionary.cast(pa.large_binary()).to_pylist()
                buckets = np.fromiter((zlib.crc32(w) for w in known), np.int64, len(known)) % BUCKETS
                trains = np.repeat(~np.asarray(part.column("held").to_numpy(zero_copy_only=False), bool), sizes)
                counts = np.bincount(codes[trains], minlength=len(known)).astype(np.int64)
                columns = [
                    (part.column("doc_id"), pa.int64()),
                    (part.column("held"), pa.bool_()),
                    (pa.array(sizes.astype(np.int32)), pa.int32()),
                    (coded.dictionary.cast(pa.string()), pa.string()),
                    (pa.array(buckets.astype(np.int16)), pa.int16()),
                    (pa.array(counts), pa.int64()),
                ]
                arrays = [
                    pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c.cast(k)) for c, k in columns
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([_packed(codes)], pa.binary()), *arrays],
                    ["block", "codes", "doc_ids", "held", "sizes", "words", "buckets", "counts"],
                )
                block += 1

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held"))
    return plain.mapInArrow(run, ddl)


def _flat(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _symbols(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Class symbols of a block's texts, each with its end, and their sizes."""
    classes = _flat(batch, "buckets", row).astype(np.int64)[_codes(batch, row)]
    sizes = _flat(batch, "sizes", row).astype(np.int64)
    out = np.full(len(classes) + len(sizes), END, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = classes
    return out, sizes + 1


def _training_texts(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    symbols, sizes = _symbols(batch, row)
    trains = ~_flat(batch, "held", row).astype(bool)
    return symbols[np.repeat(trains, sizes)], sizes[trains]


def _start(blocks: DataFrame, mass: np.ndarray, states: int, tokens: int) -> Model:
    """The model before the first full pass, fitted on a bounded sample of runs, each by itself.

    The partitions send the runs below a hash that lets a few times START_RUNS pass, not
    START_RUNS each.
    """
    below = (1 << 32) * min(1.0, 4 * START_RUNS * RUN / max(1, tokens))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                symbols, whole = _training_texts(batch, row)
                cut = runs_of(whole)
                runs = [symbols[b : b + s].astype("<i4").tobytes() for b, s in zip(cut.begin.tolist(), cut.sizes.tolist(), strict=True)]
                hashes = [zlib.crc32(r) for r in runs]
                best = [i for i, h in enumerate(hashes) if h <= below]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashes[i] for i in best], pa.int64()), pa.array([runs[i] for i in best], pa.binary())],
                    ["hash", "symbols"],
                )

    picked = blocks.select("held", "sizes", "codes", "buckets").mapInArrow(pick, "hash long, symbols binary")
    rows = picked.orderBy("hash", "symbols").limit(START_RUNS).collect()
    model = first_model(mass, states)
    parts = [np.frombuffer(r.symbols, "<i4").astype(np.int64) for r in rows]
    sizes = np.array([len(p) for p in parts], np.int64)
    if parts:
        symbols = np.concatenate(parts)
        # the sample stands for the corpus, so the mass beforehand shrinks with it
        small = mass * min(1.0, len(symbols) / max(1.0, mass.sum()))
        for _ in range(START_ROUNDS):
            total = Expected.none(states)
            expect(model, symbols, sizes, total)
            model = maximise(total, small + 1e-6)
    return model


def _one_round(blocks: DataFrame, model: Model, mass: np.ndarray) -> Model:
    """Baum-Welch: partitions give expected counts, Spark adds them up by symbol."""
    states = len(model.start)
    names = [f"s{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Expected.none(states)
        for batch in batches:
            for row in range(batch.num_rows):
                expect(model, *_training_texts(batch, row), total)
        used = np.flatnonzero(total.emits.any(axis=0))
        keys = np.concatenate([used, [-1], -2 - np.arange(states)])
        values = np.vstack([total.emits[:, used].T, total.start, total.moves])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int32()), *[pa.array(np.ascontiguousarray(values[:, k])) for k in range(states)]], ["symbol", *names]
        )

    counts = blocks.select("held", "sizes", "codes", "buckets").mapInArrow(
        run, "symbol int, " + ", ".join(f"{n} double" for n in names)
    )
    total = Expected.none(states)
    # at most BUCKETS + STATES + 2 rows
    for r in counts.groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).collect():
        values = np.array(r[1:])
        if r.symbol >= 0:
            total.emits[:, r.symbol] = values
        elif r.symbol == -1:
            total.start = values
        else:
            total.moves[-2 - r.symbol] = values
    return maximise(total, mass)


def train(
    blocks: DataFrame, mass: np.ndarray, tokens: int, states: int = STATES, rounds: int = ROUNDS
) -> Model:
    model = _start(blocks, mass, states, tokens)
    for _ in range(rounds):
        model = _one_round(blocks, model, mass)
    return model


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    Scores are base-10 logarithms of a whole text's probability, its end included: of the
    smoothed unigram base, and of the model. Null and empty texts are an end alone. Rows
    with equal or no ids are texts of their own. A table without training texts gives the
    scores of a model that knows no word. Texts are whole in training too: a long one is worked
    on in runs of RUN tokens whose counts are those of the uncut text.
    """
    spark = docs.sparkSession
    blocks = cut_lineage(blocks_of(docs), "hmm-blocks", compression="zstd")
    words = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select("w.words", "w.counts")
    table = words.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("c")).filter("c > 0")
    table, counted = written(table, "hmm-words")
    release(spark)
    by_class = table.groupBy((F.crc32("word") % BUCKETS).cast("int").alias("b")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    n_class, v_class = np.zeros(BUCKETS), np.zeros(BUCKETS)
    # at most BUCKETS rows
    for r in by_class.collect():
        n_class[r.b], v_class[r.b] = r.n, r.v
    ends = blocks.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    n_all, v_all = int(n_class.sum()) + ends, int(v_class.sum()) + (ends > 0)
    mass = np.append(v_class + 1.0, 1.0)
    model = train(blocks, mass, n_all, states, rounds)
    release(spark)

    coded = blocks.select("block", F.posexplode("words").alias("place", "word"))
    known = (
        coded.join(table, "word")
        .groupBy("block")
        .agg(F.collect_list("place").alias("places"), F.collect_list("c").alias("found"))
    )
    known = cut_lineage(known, "hmm-known", compression="zstd")
    remove(spark, counted)
    release(spark)
    ready = blocks.select("block", "doc_ids", "held", "sizes", "codes", "buckets").join(known, "block", "left")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                classes, codes = _flat(batch, "buckets", row), _codes(batch, row)
                c = np.zeros(len(classes))
                if batch.column("places")[row].is_valid:
                    c[_flat(batch, "places", row)] = _flat(batch, "found", row)
                sizes = _flat(batch, "sizes", row).astype(np.int64)
                text = np.repeat(np.arange(len(sizes)), sizes)
                over = lambda x: np.bincount(text, weights=x[codes], minlength=len(sizes))  # noqa: E731, B023
                seen, inner = np.log(c + 1.0), np.log(n_class[classes] + v_class[classes] + 1.0)
                n_tokens = sizes + 1
                base = over(seen) + np.log(ends + 1.0) - n_tokens * np.log(n_all + v_all + 1.0)
                symbols, lengths = _symbols(batch, row)
                total = likelihoods(model, symbols, lengths) + over(seen - inner)
                columns = [
                    batch.column("doc_ids")[row].values,
                    batch.column("held")[row].values,
                    n_tokens,
                    np.rint(over((c > 0).astype(float))).astype(np.int64) + (ends > 0),
                    np.full(len(sizes), n_all),
                    base / np.log(10),
                    total / np.log(10),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return ready.mapInArrow(run, ddl)
