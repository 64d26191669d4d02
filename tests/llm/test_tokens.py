"""Segmentation, prefix counts and packing against brute force and the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import nbest, packing, prefix
from gleaner.llm.common import Recent

ODD = [
    None, "", " ", "  ", "a  b ", " a", "日本語 テスト🙂 ▁x", "a\n\n b\t", "<s> <0x0A> </s>", "x" * 3000,
    "  " * 40 + "x", "é" * 30, "it's  'tis \n x\x1c y \x1cz  ", "　x 　 y", "1 2  3 ...  !",
    "a<|endoftext|> b <|endoftext|>", "The end. " * 400,
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return ODD + [r.text for r in rows]


def frame(spark, texts):
    rows = [(None if i == 3 else i, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


@pytest.fixture(scope="module")
def lattice():
    return nbest.Lattice(public_tokenizers.path(nbest.MODEL))


def all_paths(lattice, text):
    chars = "".join(prefix.words_of(text))
    out = []

    def go(i, score, cuts):
        if i == len(chars):
            out.append((score, tuple(cuts)))
            return
        for j in range(i + 1, len(chars) + 1):
            if chars[i:j] in lattice.scores:
                go(j, score + lattice.scores[chars[i:j]], [*cuts, j])
        if chars[i] not in lattice.scores:
            go(i + 1, score + lattice.unknown, [*cuts, i + 1])

    go(0, 0.0, [0])
    return sorted(out, reverse=True), chars


def test_n_best_matches_enumeration(lattice):
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice("abc the日🙂 é") for _ in range(rng.randint(0, 9)))
        every, chars = all_paths(lattice, text)
        found = lattice.text_paths(text, 5)
        assert [s for s, _ in found] == [s for s, _ in every[:5]]
        ids = {(s, np.array(lattice.path_ids(chars, list(c)), "<u4").tobytes()) for s, c in every}
        assert set(found) <= ids and len({p for _, p in found}) == len(found)
        assert all(lattice.decode(p) == text for _, p in found)


def test_word_search_gives_best_first(lattice):
    paths = lattice.word_paths("▁anthology", 20)
    scores = [s for s, _ in paths]
    assert scores == sorted(scores, reverse=True) and len({tuple(p) for _, p in paths}) == 20


def test_segment_rows(spark, texts):
    out = nbest.segment(frame(spark, texts), with_ids=True).collect()
    assert len(out) == len(texts) and all(r.decoded for r in out)
    for r in out:
        assert r.n_pieces == r.lengths[0] and list(r.lengths) == [len(p) for p in r.paths]
        assert r.ids_crc32 == zlib.crc32(np.array(r.paths[0], "<u4").tobytes())
        assert list(r.scores) == sorted(r.scores, reverse=True)


def test_every_path_is_made_and_decoded(spark, lattice, texts):
    docs = frame(spark, texts).select(F.col("n_tokens").alias("doc_id"), "text")
    made = {r.doc_id: r for r in nbest.segment(docs).collect()}
    for i, text in enumerate(texts):
        paths = [ids for _, ids in lattice.text_paths(text or "", nbest.N_BEST)]
        assert made[i].paths_crc32 == [zlib.crc32(p) for p in paths]
        assert lattice.decode_all(paths) == [lattice.decode(p).encode("utf-8") for p in paths]
    broken = lattice.path_ids("▁the", [0, 4]), lattice.path_ids("▁a", [0, 2])
    assert lattice.decode_all([np.array(p, "<u4").tobytes() for p in (*broken, [])]) == [b"the", b"a", b""]


def test_counts_match_the_library(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(prefix.MODEL))
    want = {i: len(model.encode(t or "")) for i, t in enumerate(texts)}
    out = prefix.token_counts(frame(spark, texts), limit=50).collect()
    assert len(out) == len(texts)
    for r in out:
        i = 3 if r.doc_id is None else r.doc_id
        text = texts[i] or ""
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want[i], len(text.encode()), want[i] > 50)
        if len(text) < 2000:
            fits = max(k for k in range(len(text) + 1) if len(model.encode(text[:k])) <= 50)
            assert r.fitting_chars == fits


def test_every_prefix(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(prefix.MODEL))
    short = [(t or "")[:150] for t in texts[:60]]
    for r in prefix.prefix_counts(spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")).collect():
        text = short[r.doc_id]
        assert r.counts == [len(model.encode(text[:k])) for k in range(len(text) + 1)]


def test_runs_encode_as_the_library(texts):
    encoder = packing.RunEncoder(public_tokenizers.path(packing.TOKENIZER))
    plain = [t or "" for t in texts]
    got = [np.frombuffer(x, np.uint16).tolist() for x in encoder.encode(plain)]
    assert got == [x.ids for x in encoder.library.encode_batch(plain, add_special_tokens=False)]


@pytest.mark.parametrize("length", [7, 2048])
def test_pieces_hold_every_token_once(spark, texts, length):
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = {i: [*x.ids, 1] for i, x in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False))}
    rows = packing.pack(frame(spark, texts).repartition(3), length=length, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault(3 if r.doc_id is None else r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, ids in want.items():
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == ids
        assert [r.start for r in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert {r.doc_tokens for r in pieces} == {len(ids)}
    total = sum(map(len, want.values()))
    assert sorted(by_sequence) == list(range(-(-total // length)))
    for k, pieces in by_sequence.items():
        pieces.sort(key=lambda r: r.offset)
        ends = [r.offset + r.length for r in pieces]
        assert [r.offset for r in pieces] == [0, *ends[:-1]]
        assert ends[-1] == length or k == max(by_sequence)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none).count() == prefix.token_counts(none).count() == nbest.segment(none).count() == 0


def test_caches_keep_no_long_words():
    """Text without spaces is one word, whose value is made once a call and dropped."""
    made = []
    recent = Recent(lambda key: made.append(key) or [len(key)], 100)
    long = "語" * 1000
    for _ in range(2):
        assert recent.all(["a", long, "a", long]) == [[1], [1000]] * 2
    assert made == ["a", long, long] and list(recent.new) == ["a"]
    encoder = packing.RunEncoder(public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(4)
    for _ in range(5):
        encoder.encode(["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(500)) + " tail" for _ in range(20)])
    assert set(encoder.new[1]) == {"tail"} and not encoder.new[0]


def test_summaries_made_together_are_the_single_ones():
    lattice = nbest.Lattice(public_tokenizers.path(nbest.MODEL))
    rng = random.Random(12)
    words = [nbest.MARK + "".join(rng.choice("abeinorstué.,-1日") for _ in range(rng.randint(0, 30))) for _ in range(600)]
    words += ["", nbest.MARK, nbest.MARK * 9, "x", "s" * 64, nbest.MARK + "the", nbest.MARK + "\U0001f9ec", "a\x00b", *words[:3]]
    got = lattice.summaries(words)
    assert all(got[w] == lattice.summary(w) for w in got)
    covered = lambda w: w and all(c in lattice.scores for c in w)
    assert set(got) == {w for w in words if covered(w)} and lattice.summaries([]) == {}
    lattice.learn([*words, "e" * 65])
    assert set(lattice.known.new) == set(got)
