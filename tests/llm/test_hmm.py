import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from gleaner.llm import hmm


def tiny(states=2, symbols=4, seed=2):
    rng = np.random.default_rng(seed)
    part = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.uniform(0.2, 1, shape))
    emits = np.zeros((states, hmm.BUCKETS + 1))
    emits[:, :symbols] = part(states, symbols)
    return hmm.Model(part(states), part(states, states), emits)


def paths(model, symbols):
    """Each state path of a sequence and its joint probability."""
    for states in itertools.product(range(len(model.start)), repeat=len(symbols)):
        p = model.start[states[0]]
        for t, (s, x) in enumerate(zip(states, symbols, strict=True)):
            p *= model.emits[s, x] * (model.moves[states[t - 1], s] if t else 1)
        yield states, p


def test_likelihood_is_the_sum_over_all_paths():
    model, rng = tiny(3), random.Random(1)
    texts = [[rng.randrange(4) for _ in range(n)] for n in (1, 6, 3, 1, 7)]
    got = hmm.likelihoods(model, np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts]))
    want = [math.log(sum(p for _, p in paths(model, t))) for t in texts]
    assert np.allclose(got, want, rtol=1e-12)


def test_expected_counts_are_the_posterior_ones():
    model, rng = tiny(), random.Random(4)
    texts = [[rng.randrange(4) for _ in range(n)] for n in (5, 2, 6, 1)]
    sizes = np.array([len(t) for t in texts])
    got = hmm.Expected.none(2)
    hmm.expect(model, np.array(sum(texts, []), np.int64), sizes, got)
    want = hmm.Expected.none(2)
    for t in texts:
        total = sum(p for _, p in paths(model, t))
        for states, p in paths(model, t):
            want.start[states[0]] += p / total
            for k, x in enumerate(t):
                want.emits[states[k], x] += p / total
                if k:
                    want.moves[states[k - 1], states[k]] += p / total
    for name in ("start", "moves", "emits"):
        assert np.allclose(getattr(got, name), getattr(want, name))


def test_runs_cover_every_token(monkeypatch):
    monkeypatch.setattr(hmm, "RUN", 4)
    sizes = np.array([3, 4, 9, 1])
    runs = hmm.runs_of(sizes)
    covered = sorted(x for b, s in zip(runs.begin, runs.sizes, strict=True) for x in range(b, b + s))
    assert covered == list(range(17)) and runs.sizes.max() == 4
    assert runs.text.tolist() == [0, 1, 2, 2, 2, 3] and runs.last.tolist() == [True, True, False, False, True, True]


def test_counts_of_cut_texts_are_those_of_whole_ones(monkeypatch):
    model, rng = tiny(3, 9), random.Random(8)
    sizes = np.array([1, 40, 7, 300, 3, 64, 65, 8, 16, 1])
    symbols = np.array([rng.randrange(9) for _ in range(sizes.sum())], np.int64)
    found = {}
    for run in (1, 3, 8, 1000):
        monkeypatch.setattr(hmm, "RUN", run)
        found[run] = hmm.Expected.none(3)
        hmm.expect(model, symbols, sizes, found[run])
        assert abs(found[run].start.sum() - len(sizes)) < 1e-9
        assert abs(found[run].moves.sum() - (sizes.sum() - len(sizes))) < 1e-6
        assert abs(found[run].emits.sum() - sizes.sum()) < 1e-6
    for run in (1, 3, 8):
        for name in ("start", "moves", "emits"):
            assert np.allclose(getattr(found[run], name), getattr(found[1000], name), rtol=1e-9, atol=1e-12)


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def sample_rows(n=60):
    rng = random.Random(9)
    tongues = [[f"{x}{i}" for i in range(30)] for x in "ABC"]
    rows = [(i, " ".join(rng.choice(tongues[i % 3]) for _ in range(rng.randint(30, 200)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "É  new\tNEW\nwords"), (n + 2, "same id"), (None, "No Id a1")]


def test_base_scores_and_counts(spark):
    rows = sample_rows()
    counts = Counter()
    for d, t in rows:
        if not is_held(d):
            counts.update([*words_of(t), None])
    total, types = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        tokens = [*words_of(t), None]
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in tokens)
        want.append((d, is_held(d), len(tokens), sum(w in counts for w in tokens), total, round(base, 6)))
    out = hmm.score(spark.createDataFrame(rows, "doc_id long, text string"), states=3, rounds=2).collect()
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out]
    order = lambda r: (r[0] is None, r[0] or 0, r[2:])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_scores_are_those_of_a_plain_forward_pass(spark):
    rows = sample_rows(25)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = hmm.blocks_of(docs).cache()
    counts, classes = Counter(), {}
    for d, t in rows:
        if not is_held(d):
            counts.update(words_of(t))
    n, v = np.zeros(hmm.BUCKETS), np.zeros(hmm.BUCKETS)
    for w, c in counts.items():
        classes[w] = zlib.crc32(w.encode()) % hmm.BUCKETS
        n[classes[w]] += c
        v[classes[w]] += 1
    texts = sum(not is_held(d) for d, _ in rows)
    model = hmm.train(blocks, np.append(v + 1.0, 1.0), sum(counts.values()) + texts, 3, 2)
    share = lambda w, b: (counts.get(w, 0) + 1) / (n[b] + v[b] + 1)
    for b in set(classes.values()):  # the words of a class and its unknown ones share one
        assert abs(sum(share(w, b) for w in counts if classes[w] == b) + share(None, b) - 1) < 1e-12
    want = []
    for d, t in rows:
        words = words_of(t)
        symbols = [zlib.crc32(w.encode()) % hmm.BUCKETS for w in words] + [hmm.END]
        state, total = model.start, 0.0
        for k, x in enumerate(symbols):
            state = (state if k == 0 else state @ model.moves) * model.emits[:, x]
            total += math.log10(state.sum())
            state = state / state.sum()
        total += sum(math.log10(share(w, b)) for w, b in zip(words, symbols, strict=False))
        want.append((d, len(symbols), round(total, 6)))
    got = [(r.doc_id, r.n_tokens, round(r.score, 6)) for r in hmm.score(docs, states=3, rounds=2).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in hmm.score(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.95 * len(held)


def test_blocks_after_the_first_keep_their_words(spark):
    rows = [(i, f"Word{i} É x\t" * (20_000 + i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    blocks = hmm.blocks_of(docs).collect()
    assert len(blocks) > 1
    for r in blocks:
        assert list(r.sizes) == [len(words_of(rows[d][1])) for d in r.doc_ids]
        assert sorted(r.words) == sorted({w for d in r.doc_ids for w in words_of(rows[d][1])})


def test_empty_table(spark):
    assert hmm.score(spark.createDataFrame([], "doc_id long, text string"), rounds=1).count() == 0
    only = [d for d in range(200) if is_held(d)][:2]
    rows = hmm.score(spark.createDataFrame([(d, "a b") for d in only], "doc_id long, text string"), rounds=1).collect()
    assert [r.n_known for r in rows] == [0, 0] and all(r.train_tokens == 0 and r.score < 0 for r in rows)


def test_matrices_of_long_runs_lead_where_each_step_does():
    model, rng = tiny(3), np.random.default_rng(9)
    sizes = np.array([3 * hmm.RUN, hmm.RUN + 5, 2 * hmm.SCALED + 1])
    symbols = rng.integers(0, 4, sizes.sum())
    runs = hmm.runs_of(sizes)
    got = hmm._transfers(model, symbols, runs.begin, runs.sizes, runs.ordinal == 0)
    for matrix, b, n, k in zip(got, runs.begin, runs.sizes, runs.ordinal, strict=True):
        want = np.eye(3)
        for t, x in enumerate(symbols[b : b + n]):
            want = (want @ model.moves if t or k else np.tile(model.start, (3, 1))) * model.emits[:, x]
            want /= want.sum()
        assert np.allclose(matrix / matrix.sum(), want, rtol=1e-10)
    # rare symbols over a whole stretch between two scalings stay in range
    rare = hmm.Model(model.start, model.moves, model.emits * 1e-30)
    again = hmm._transfers(rare, symbols, runs.begin, runs.sizes, runs.ordinal == 0)
    assert np.isfinite(again).all()
    assert np.allclose(again / again.sum(axis=(1, 2), keepdims=True), got / got.sum(axis=(1, 2), keepdims=True))
