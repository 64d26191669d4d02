import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from gleaner.llm import substring


def plain(rows):
    """(doc_id, text) rows: what each keeps, by comparing all windows."""
    split = [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for _, t in rows]
    first = {}
    key = lambda d: float("inf") if d is None else d
    for (d, _), words in zip(rows, split, strict=True):
        for p in range(len(words) - 12):
            w = tuple(words[p : p + 13])
            first[w] = min(first.get(w, float("inf")), key(d))
    out = []
    for (d, _), words in zip(rows, split, strict=True):
        gone = set()
        for p in range(len(words) - 12):
            if first[tuple(words[p : p + 13])] < key(d):
                gone.update(range(p, p + 13))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(map(tuple, got), key=order) == sorted(plain(rows), key=order)


def test_matches_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "日本"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(10, 60))] for _ in range(12)]
    rows = []
    for d in range(80):
        words = []
        for _ in range(rng.randint(0, 6)):
            piece = list(rng.choice(passages))
            if rng.random() < 0.5:
                a = rng.randrange(len(piece))
                piece = piece[a:] if rng.random() < 0.5 else piece[: a + 1]
            if rng.random() < 0.3:
                piece[rng.randrange(len(piece))] = "changed"
            words += piece + [rng.choice(vocabulary) for _ in range(rng.randint(0, 20))]
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(words)))
    rng.shuffle(rows)
    check(spark, rows)


def test_one_word_texts_ties_and_repeated_rows(spark):
    same = " ".join(f"t{i}" for i in range(30))
    rows = [(1, "a " * 500), (2, "a " * 40), (3, None), (4, ""), (5, "x" * 100_000), (6, same), (6, same)]
    rows += [(7, same + " tail"), (None, same), (None, same), (8, "a " * 12), (-3, same[:50])]
    check(spark, rows)


def test_empty_table(spark):
    check(spark, [])


def test_cut_text_keeps_rows_columns_and_lines(spark):
    same = " ".join(f"t{i}" for i in range(20))
    rows = [(1, f"head\n{same}\nend", "k", 9), (2, f"other\n{same}\nlast word", "m", 9), (3, "short", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Key string, n_chars int")
    out = substring.drop_repeats(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(tuple, out.collect())) == [rows[0], (2, "other\nlast word", "m", 15), rows[2]]


def test_spans_are_maximal(spark):
    same = " ".join(f"t{i}" for i in range(20))
    docs = spark.createDataFrame([(1, same), (2, f"a {same} b {same}")], "doc_id long, text string")
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in substring.repeats(docs).collect()}
    assert spans == {1: [], 2: [(1, 21), (22, 42)]}


def test_digests_and_spans_of_many_texts_at_once():
    rng = random.Random(3)
    texts = [[], ["é"], [], *([rng.choice(["a", "bc", "日本"]) for _ in range(n)] for n in (1, 9, 40, 0, 3)), []]
    first = np.cumsum([0, *map(len, texts)])
    words = pa.array([w for t in texts for w in t], pa.large_string())
    for share in (0.0, 0.5, 1.0):
        gone = np.array([rng.random() < share for _ in range(len(words))], bool)
        digests = substring._digests(words, first, gone)
        spans = substring._spans(first, gone).to_pylist()
        assert len(digests) == len(spans) == len(texts)
        for k, text in enumerate(texts):
            cut = gone[first[k] : first[k + 1]]
            kept = " ".join(w for w, g in zip(text, cut, strict=True) if not g)
            assert digests[k] == hashlib.sha256(kept.encode()).hexdigest()
            inside = [i for s in spans[k] for i in range(s["begin"], s["end"])]
            assert inside == np.flatnonzero(cut).tolist()
            assert all(a["end"] < b["begin"] for a, b in zip(spans[k], spans[k][1:], strict=False))
    none = pa.array([], pa.large_string())
    assert substring._digests(none, np.array([0, 0]), np.zeros(0, bool)) == [hashlib.sha256(b"").hexdigest()]
    assert substring._digests(none, np.array([0]), np.zeros(0, bool)) == []
