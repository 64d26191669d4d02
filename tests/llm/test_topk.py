import math
import random
from fractions import Fraction

import pytest

from gleaner.llm import topk


def plain(rows, every=20, k=20):
    usable = []
    for i, (vec_id, v) in enumerate(rows):
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, vec_id, [math.floor(64 * Fraction(x)) for x in v]))
    out = []
    for i, q, a in usable:
        if q % every == 0:
            held = lambda s: max(-(2**63), min(2**63 - 1, s))
            product = lambda b, a=a: held(sum(x * y for x, y in zip(a, b, strict=True)))
            scores = sorted((-product(b), c) for j, c, b in usable if j != i and len(a) == len(b))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def check(spark, rows):
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == plain(rows)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 60)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(9)]
    rows = []
    for i in range(500):
        scale = rng.choice([0.02, 0.3, 1, 4])
        rows.append((i, [scale * (x + rng.gauss(0, 0.1)) for x in rng.choice(centres)]))
    rng.shuffle(rows)
    check(spark, rows)


def test_ties_hot_vectors_and_odd_rows(spark):
    same = [0.5, -0.25, 1.0]
    rows = [(i, same) for i in range(300)] + [(40, same), (40, [9.0, 9.0, 9.0])]
    rows += [(None, same), (1000, None), (1020, [1.0, None, 2.0]), (1040, [float("nan")] * 3), (1060, [math.inf, 0.0, 0.0])]
    rows += [(1080, [0.0, 0.0, 0.0]), (1100, [1.0, 2.0]), (1101, [2.0, 1.0]), (1120, []), (1121, []), (1140, [-1.0] * 3)]
    check(spark, rows)


def test_products_beyond_doubles_and_longs(spark):
    rows = [(i, [1e7 * (i + 1), -3e6 * i, 5.0]) for i in range(45)] + [(100, [1e17, 1e17, 0.0]), (120, [1e200, 0.0, 1.0])]
    check(spark, rows)


def test_components_too_long_to_scale_take_part(spark):
    rows = [(20, [3e306, 4e306, 0.013]), (21, [1.0, -1.0, 70.5]), (22, [-1.7e308, 2e-300, 1.0]), (40, [0.0, 0.0, 3.0]), (41, [1e155] * 3)]
    check(spark, rows + [(100 + i, [i / 7, 1.0, -2.0]) for i in range(30)])


def test_few_or_no_rows(spark):
    check(spark, [])
    check(spark, [(0, [1.0])])
    check(spark, [(0, [1.0]), (1, [2.0])])
