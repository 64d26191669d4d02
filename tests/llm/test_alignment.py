import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from gleaner.llm import alignment
from tokenizers import Tokenizer

ODD = [
    None, "", " ", "   ", "a", "Hello, world!", "it's  a\ttest\n\nwith   spaces ", "日本語のテキストです。", "กขคงจ สวัสดี",
    "<|endoftext|> <s> </s> <unk> <0x41>", "mark ▁ here", "▁", "é 👩‍👩‍👧 ‍", "x" * 3000, "\x00\x01 \x7f", "é" * 50,
    "same text", "same text", "  lead", "trail  ", "\n", "12345678 3.14159 http://a.b/c?d=e&f=g", "ﬁ ﬀ ① ½ Å",
]


def byte_table():
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def plain(rows):
    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = byte_table()
    docs, count = [], Counter()
    for d, text in rows:
        a, b, groups = [], [], []
        if text:
            one = a_tok.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(table[c] for c in t)) for i, t in zip(one.ids, one.tokens, strict=True)]
            for i in b_tok.encode(text):
                p = b_tok.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()))
            want = (" " + text).encode()
            if b"".join(t for _, t in a) != want or b"".join(t for _, t in b) != want:
                a, b = [], []
        ends = [set(), set()]
        for k, side in enumerate((a, b)):
            at = 0
            for _, t in side:
                at += len(t)
                ends[k].add(at)
        both = sorted(ends[0] & ends[1])
        groups = [([], []) for _ in both]
        for k, side in enumerate((a, b)):
            at, g = 0, 0
            for i, t in side:
                at += len(t)
                groups[g][k].append(i)
                g += at == both[g]
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        count.update(links.keys())
        docs.append((d, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for d, n_a, n_b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            d, n_a, n_b, len(groups), sum(links.values()),
            sum(n for p, n in links.items() if count[p] == most[p[0]]),
            sum(n * count[p] for p, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "Token", "izer", "café", "naïve", "日本", "'s", "<s>", "42", "co-op", "ﬁn", "กข", "...", "🙂"]
    return [rng.choice([" ", "  ", "\n", "", "\t "]).join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]


def test_matches_plain_alignment(spark):
    rows = [(k, t) for k, t in enumerate([*ODD, *texts(1, 150)])] + [(None, "same text"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r[c] for c in COLUMNS) for r in alignment.aligned_counts(docs).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_parts_blocks_and_rare_pairs_give_the_same(spark, monkeypatch):
    rows = [(k, " and ".join(texts(k, 12))) for k in range(10)] + [(99, "word " * 500 + "▁"), (100, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(list(alignment.parts(rows[0][1], 40))) > 3
    aligner = alignment.Aligner(f"{public_tokenizers.path(alignment.A_FILE)}\n{public_tokenizers.path(alignment.B_FILE)}")
    monkeypatch.setattr(alignment, "PART", 1 << 30)
    whole = alignment._Rows(len(rows), False)
    for k, (_, text) in enumerate(rows):
        if text:
            whole.add(aligner, [k], [text])
    want = whole.columns(aligner)
    monkeypatch.setattr(alignment, "LINKS", 5)
    cut = alignment._Rows(len(rows), False)
    for k, (_, text) in enumerate(rows):
        for part in alignment.parts(text, 40) if text else ():
            cut.add(aligner, [k], [part])
    assert [c.to_pylist() for c in cut.columns(aligner)] == [c.to_pylist() for c in want]
    monkeypatch.undo()
    aligned = alignment.align(docs).cache()
    links = alignment.link_table(aligned, aligner.width)
    sums = lambda most: sorted(map(tuple, alignment.link_sums(aligned, links, most).select(*COLUMNS).collect()), key=str)
    assert sums(1 << 18) == sums(0) == sums(10) == sorted(plain(rows), key=str)


def test_groups_cover_the_bytes(spark):
    docs = spark.createDataFrame([(1, "Tokenization isn't trivial"), (2, "▁")], "doc_id long, text string")
    one, two = alignment.align(docs, with_groups=True).orderBy("doc_id").collect()
    begins = [g.begin for g in one.groups]
    assert begins[0] == 0 and begins == sorted(set(begins)) and len(begins) == one.n_groups
    assert sum(len(g.a) for g in one.groups) == one.n_a and sum(len(g.b) for g in one.groups) == one.n_b
    assert (two.n_a, two.n_groups, two.groups_sha256, two.groups) == (0, 0, "", [])


def test_long_runs_of_white_space_and_empty_tables(spark):
    rows = [(1, "a" + " " * 20_000 + "b"), (2, "\n" * 12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in alignment.aligned_counts(docs).collect())
    assert got == sorted(plain(rows))
    none = spark.createDataFrame([], "doc_id long, text string, row int, pairs string")
    assert alignment.aligned_counts(none).count() == 0
