import random
import re
import zlib
from collections import Counter

import pytest
from gleaner.llm import variants

LOWER = str.maketrans(variants.UPPER, variants.UPPER.lower())


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = sorted((a, b), key=len, reverse=True)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_groups(counts):
    out = {}
    for w, n in counts.items():
        close = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form = close[0][1] if close and -close[0][0] >= 2 * n else None
        out[w] = [form, n, len(close), counts[form] if form else None]
    rows = set()
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, form_n))
    return rows


def plain_words(rows, slip=97):
    found = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_groups_match_brute_force(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(500)} | {"aaaaa", "aaaaaa", "aaaaaaa"}
    counts = {w: rng.choice([1, 2, 3, 5, 8, 20, 50]) for w in sorted(words)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)
    assert rows_of(variants.group_variants(table)) == plain_groups(counts)


def test_texts_match_brute_force(spark):
    rng = random.Random(6)
    base = ["Hamburg", "Bremen", "Île×de÷France", "MÜNCHEN", "kaffee", "straße", "Ærø-Inseln", "ŁódźPolska", "x" * 300]
    rows = []
    for d in range(300):
        picked = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choice(base)
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeiÉ") + w[k:], w[:k] + "ö" + w[k + 1 :]])
            picked.append(w)
        rows.append((d, rng.choice([" ", ", ", "3"]).join(picked)))
    rows += [(1, None), (1, ""), (None, "Hamburg Hamburg"), (None, "Hamburg Hamburg"), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(variants.spelling_groups(docs)) == plain_groups(plain_words(rows))
    words = variants.slipped_runs(docs, slip=3)
    got = {r.word: r.n for r in variants.vocabulary(words).collect()}
    assert got == plain_words(rows, slip=3)


def test_numbers_of_nodes_are_those_of_distinct_prefixes(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    keys = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "key string, value long").repartition(5)
    rows = variants.trie_nodes(keys).collect()
    number = {}
    for r in rows:
        assert r.rank == r.value  # ranks are places in the sorted list
        for k, node in enumerate(r.nodes):
            assert number.setdefault(r.key[:k], node) == node
    assert len(set(number.values())) == len(number)


def test_chains_end_at_their_last_word(spark):
    counts = {"k" * (5 + i): 3 * 2**i for i in range(12)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = variants.group_variants(table).collect()
    assert {r.root for r in rows} == {"k" * 16}


@pytest.mark.parametrize("words", [[], [("alone", 4)]])
def test_empty_and_single_vocabularies(spark, words):
    table = spark.createDataFrame(words, "word string, n long")
    assert rows_of(variants.group_variants(table)) == {(w, None, w, n, 0, None) for w, n in words}


def test_texts_with_their_variants(spark):
    docs = spark.createDataFrame([(1, "colour Color x", "v"), (2, None, "w")], "doc_id long, text string, variants string")
    table = spark.createDataFrame([("color", "colour"), ("colour", "colour")], "word string, root string")
    out = {r.doc_id: r for r in variants.canonical(docs, table).collect()}
    assert [tuple(x) for x in out[1]["_variants"]] == [("color", "colour")]
    assert out[2]["_variants"] == [] and out[2]["variants"] == "w"
