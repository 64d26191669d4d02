import re
from collections import Counter

import numpy as np
import xxhash

from gleaner.llm import quality

GOOD = "the calm river runs past quiet fields and old stone walls while small birds sing above the mill each morning"


def plain(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[p : p + 8]) for p in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {k for p, w in enumerate(windows) if seen[w] > 1 for k in range(p, p + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


TEXTS = [
    None, "", " \t\n", "one", GOOD, GOOD.upper(), GOOD + "\n" + GOOD, "\n".join([GOOD, "x", "x", " x", "", "", "x"]),
    "a " * 60, "a b c d e f g h " * 2, GOOD + " a b c d e f g h a b c d e f g h", "#*$%&|<> " * 30, "日本語 é\x0b🙂\x0cx " * 9,
    "x" * 50_000, " ".join(f"w{i}" for i in range(20_000)), "\x1c \x85 " * 25,
]


def test_base_counts(spark):
    rows = [(i, t, "mine", i) for i, t in enumerate(TEXTS)] + [(None, GOOD, "mine", 0), (4, GOOD, "mine", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string, llr int")
    out = quality.base_counts(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        text = GOOD if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(text)


def buckets(text, size):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    one = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
    pair = lambda a, b: one(b, one(a, 42))
    return [signed(x) % size for x in h] + [signed(pair(a, b)) % size for a, b in zip(h, h[1:], strict=False)]


def test_likelihood_ratio_matches_brute_force(spark):
    junk = " ".join(f"zq{i % 7}$$$ xx{i % 5}" for i in range(40))
    rows = [(i, GOOD + f" number{i} here") for i in range(30)] + [(100 + i, junk + f" {i}") for i in range(30)] + [(200, None)]
    labels = [(i, 1, 0) for i in range(0, 30, 2)] + [(101, 1, 1), (102, 0, 0), (3, 1, None), (None, 1, 0), (4, 1, 0)]
    raw, hit = Counter(), Counter()
    trusted = {d for d, q, t in labels if q == 1 and not t and d is not None}
    for d, t in rows:
        raw.update(buckets(t, quality.BUCKETS))
        if d in trusted:
            hit.update(buckets(t, quality.BUCKETS))
    n, m, b = sum(raw.values()), sum(hit.values()), quality.BUCKETS
    want = {}
    for d, t in rows:
        grams = buckets(t, b)
        logs = [np.log((hit[g] + 1) / (raw[g] * m / n + 1)) for g in grams]
        want[d] = float(np.mean(logs)) if grams else 0.0
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = quality.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    for r in out:
        assert abs(r.llr - want[r.doc_id]) < 1e-9
        assert r.kept == (not plain(dict(rows)[r.doc_id])[-1] and want[r.doc_id] >= quality.MIN_SCORE)
    assert {r.doc_id for r in out if r.kept} == set(range(30))


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, GOOD)], "doc_id long, text string")
    out = quality.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(docs, labels).count() == 0
    one = quality.quality_rules(spark.createDataFrame([(1, GOOD)], docs.schema), labels).first()
    assert one.llr == 0.0 and one.kept
