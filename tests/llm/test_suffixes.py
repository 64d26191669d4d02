import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from gleaner.llm import suffixes


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        n_spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((d, len(t), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def check(spark, rows, length):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.repeated_bytes(docs, length, with_bytes=True)
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[4])
    found = [(*r[:5], bytes(r[5])) for r in got]
    assert sorted(found, key=order) == sorted(plain(rows, length), key=order)


def random_rows(rng, n, length):
    passages = ["".join(rng.choice("abé日 ") for _ in range(rng.randint(length // 2, 3 * length))) for _ in range(10)]
    rows = []
    for d in range(n):
        text = ""
        for _ in range(rng.randint(0, 5)):
            one = rng.choice(passages)
            a, b = sorted(rng.randrange(len(one) + 1) for _ in range(2))
            text += rng.choice([one, one[a:], one[:b], one[a:b]]) + "".join(rng.choice("xyzü\n") for _ in range(rng.randint(0, length)))
        rows.append((d, text))
    return rows


def test_differences_of_covers_are_all_residues():
    for m, cover in suffixes.COVERS.items():
        assert {(a - b) % m for a in cover for b in cover} == set(range(m))


@pytest.mark.parametrize("length", [15, 26, 40])
def test_matches_brute_force(spark, length):
    check(spark, random_rows(random.Random(length), 60, length), length)


def test_matches_brute_force_at_400_bytes(spark):
    check(spark, random_rows(random.Random(4), 40, 400), 400)


def test_periodic_texts_nulls_repeated_rows_and_ids(spark):
    same = "".join(random.Random(1).choice("abcdefgh") for _ in range(90))
    rows = [(1, None), (2, ""), (3, "a" * 500), (4, "ab" * 40), (5, same), (5, same), (5, same[:50]), (None, same[20:])]
    rows += [(None, "q" * 19), (None, "q" * 19), (7, "r" * 20), (8, "s" * 21), (-1, same[:19]), (9, "é" * 10), (10, "é" * 11)]
    check(spark, rows, 20)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 64)
    rng = random.Random(3)
    body = "".join(rng.choice("abc") for _ in range(700))
    rows = [(1, body + "x" + body[100:400]), (2, "y" * 10 + body[350:] * 2), (3, "short")]
    texts = [t for _, t in rows]
    # the pieces of a long text see every sampled place once, with its name in the whole text
    import pyarrow as pa

    for text in texts:
        wide = pa.array([text])
        found = []
        for x in suffixes.pieces(wide, 20):
            s = suffixes.samples(x, 20)
            names = suffixes._names(x, s, suffixes.Hashes(x.data, 0), 20)
            found += zip(s.at.tolist(), names.tolist(), strict=True)
        monkeypatch.setattr(suffixes, "CHUNK", 1 << 20)
        (x,) = suffixes.pieces(wide, 20)
        s = suffixes.samples(x, 20)
        names = suffixes._names(x, s, suffixes.Hashes(x.data, 0), 20)
        assert found == list(zip(s.at.tolist(), names.tolist(), strict=True))
        monkeypatch.setattr(suffixes, "CHUNK", 64)


def test_long_texts_in_pieces_match_brute_force(spark):
    rng = random.Random(9)
    body = "".join(rng.choice("abcd") for _ in range(5_000_000))
    rows = [(1, body), (2, body[1_048_000:1_049_000] + "x" + body[4_000_000:]), (3, body[:300] + "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffixes.repeated_bytes(docs).collect()}
    assert got == {1: [(1_048_000, 1_049_000), (4_000_000, 5_000_000)], 2: [(0, 1000), (1001, 1_001_001)], 3: []}


def test_empty_table_and_extra_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.repeated_bytes(none).count() == 0
    docs = spark.createDataFrame([(1, "a" * 30, 7, "x")], "doc_id long, text string, at int, name string")
    row = suffixes.repeated_bytes(docs, 20, extra=["at", "name"]).first()
    assert (row.extra.at, row.extra["name"], row.n_removed) == (7, "x", 30)
    with pytest.raises(ValueError, match="15 bytes"):
        suffixes.repeated_bytes(docs, 8)
