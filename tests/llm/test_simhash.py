import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import simhash
from gleaner.llm.components import components


def plain_print(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """Union-find over all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def classes_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    out = simhash.near_duplicates(docs).collect()
    return {r.doc_id: (r.fingerprint & (2**64 - 1), r.component_id) for r in out}


def test_matches_brute_force(spark):
    rng = random.Random(3)
    words = [f"Wort{i}é" for i in range(300)]
    texts = [None, "", " \n\t", "one", "one two", "ONE\ttwo", "x" * 5000]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(3, 700))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append("\n".join(copy) if rng.random() < 0.3 else " ".join(copy))
    rng.shuffle(texts)
    got = classes_of(spark, [(i, t, "x") for i, t in enumerate(texts)])
    prints = [plain_print(t) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == prints
    assert [got[i][1] for i in range(len(texts))] == plain_classes(prints)
    assert len(set(plain_classes(prints))) < len(texts)


def test_large_block_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_MAX", 3)
    rng = np.random.default_rng(5)
    nodes = {int(x) for x in rng.integers(-(2**62), 2**62, 3)}
    for x in list(nodes):
        for _ in range(40):
            nodes.add(x ^ (1 << int(rng.integers(0, 62))) ^ (1 << int(rng.integers(0, 62))))
    nodes = sorted(nodes)
    frame = spark.createDataFrame([(x,) for x in nodes], "node long")
    found = components(simhash.links(frame))
    root = {r.node: r.root for r in found.collect()}
    want = plain_classes([x & (2**64 - 1) for x in nodes])
    assert [root.get(x, x) for x in nodes] == [nodes[k] for k in want]


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    rows = components(edges).collect()
    assert len(rows) == 301 and {r.root for r in rows} == {0}


def test_empty_table_and_missing_ids(spark):
    assert classes_of(spark, []) == {}
    got = classes_of(spark, [(None, "a b c d", ""), (7, "a b c d", ""), (9, "other words stand here", "")])
    assert got[None][1] == 7 and got[7][1] == 7 and got[9][1] == 9
    lone = classes_of(spark, [(None, "a b c d", "")])
    assert lone[None][1] is None


def test_keep_one_row_of_each_class(spark):
    rows = [(3, "a b c d e", "k"), (2, "A b c d e", "m"), (2, "A b c d e", "m"), (5, "far away text is it", "z")]
    rows += [(None, "a b c d e", "n"), (None, "nobody owns this text", "p"), (None, "nobody owns this text", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _TEXT_KEY string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] or -1, r[2]) for r in kept.collect()) == [(-1, "p"), (2, "m"), (5, "z")]


def test_rows_without_ids_keep_one_of_a_class(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:k] + ["other"] + words[k + 1 :]) for k in range(0, 400, 8)]
    prints = [plain_print(t) for t in texts]
    roots = plain_classes(prints)
    assert len(set(roots)) < len(set(prints))  # some fingerprints of a class differ
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert simhash.keep_one(docs).count() == len(set(roots))
