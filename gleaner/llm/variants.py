"""Spelling variants: words that one inserted, deleted or replaced code point tells apart.

Words are the paths of a trie, reversed words those of a second one, and the nodes of both
are numbered. A word with a gap at one place is then a pair of integers: the node of what
stands before the gap and the node of what stands behind it.

* Two words that differ by one replaced code point share the pair that skips it.
* A word that lacks one code point of another one has, at that place and without skipping
  anything, the pair of the longer word that skips it.

So an equality join on pairs gives exact neighbours. A pair is shared by one word for each
letter at most, and one without a letter there: groups stay as small as the alphabet.

Numbers come from sorting: a node is the rank of the first word through it, and its depth.
Each task of the sort numbers its own range; what its first words share with the range before
is settled from the first and last word of each range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import private_names, release
from gleaner.session import cut_lineage

#: Runs of letters: ASCII and Latin-1 from A-grave on.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LENGTH = 5
LEAST_COUNT = 3
FACTOR = 2
SLIP = 97
#: Bits of a node's number that hold its depth; no text is longer.
DEPTH_BITS = 28


def _lowered(run: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    plain = F.octet_length(run) == F.length(run)
    return F.when(plain, F.lower(run)).otherwise(F.translate(run, UPPER, UPPER.lower()))


def slipped_runs(docs: DataFrame, slip: int = SLIP) -> DataFrame:
    """``word``: each run of letters of each text; where ``slip`` divides its hash it lacks a letter.

    The hash is the CRC-32 of the document's id, a colon and the lower-cased run; the letter is
    the one at that hash modulo the run's length. Null texts have no runs, a null id reads as ''.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all("text", F.lit(f"({RUN})"), 1)).alias("run"),
    )
    runs = runs.select("doc", _lowered(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    cut = F.expr("concat(left(run, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    return hashed.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""
    counted = words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _shared_length(one: str, other: str) -> int:
    for k, (x, y) in enumerate(zip(one, other, strict=False)):
        if x != y:
            return k
    return min(len(one), len(other))


def _first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each sorted key: its place in the range, and for each prefix the place of the first key that has it."""
    part, at, last = TaskContext.get().partitionId(), 0, ""
    path: list[int] = []
    for batch in batches:
        for rows in (batch.slice(k, 4096) for k in range(0, batch.num_rows, 4096)):
            firsts, sizes = [], [0]
            begin = at
            for key in rows.column("key").to_pylist():
                same = _shared_length(last, key)
                del path[same:]
                path.extend([at] * (len(key) - same))
                firsts.append(np.array(path, np.int64))
                sizes.append(sizes[-1] + len(path))
                at, last = at + 1, key
            found = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(firsts)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(firsts), part, np.int32)),
                    pa.array(np.arange(begin, at)),
                    rows.column("key"),
                    rows.column("value"),
                    found,
                ],
                ["part", "at", "key", "value", "firsts"],
            )


def trie_nodes(keys: DataFrame) -> DataFrame:
    """``key, value, rank, nodes`` of distinct ``key, value``: ``nodes[k]`` numbers the prefix of k letters.

    The empty prefix has number 0. Ranks count the sorted keys from 0.
    """
    spark = keys.sparkSession
    ranged = keys.repartitionByRange("key").sortWithinPartitions("key")
    schema = "part int, at long, key string, value long, firsts array<long>"
    local = cut_lineage(ranged.mapInArrow(_first_words, T.StructType.fromDDL(schema)), "trie")
    # one row for each task of the sort
    ranges = local.groupBy("part").agg(
        F.count("*").alias("n"),
        F.min("key").alias("first"),
        F.max_by(F.struct("key", "firsts"), "key").alias("last"),
    )
    origin, path, before = 0, [], None
    known = []
    for r in sorted(ranges.collect(), key=lambda x: x["part"]):
        same = _shared_length(before, r["first"]) if before is not None else 0
        carried = path[:same]
        known.append((r["part"], origin, carried))
        path = [carried[k] if f == 0 and k < same else f + origin for k, f in enumerate(r["last"]["firsts"])]
        before, origin = r["last"]["key"], origin + r["n"]
    carry = spark.createDataFrame(known, "part int, origin long, carried array<long>")
    node = f"shiftleft(if(f = 0 and k < size(carried), get(carried, k), f + origin), {DEPTH_BITS}) + k + 1"
    numbered = local.join(F.broadcast(carry), "part").select(
        "key",
        "value",
        (F.col("origin") + F.col("at")).alias("rank"),
        F.expr(f"concat(array(0L), transform(firsts, (f, k) -> {node}))").alias("nodes"),
    )
    return cut_lineage(numbered, "trie-nodes")


def gaps(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """``p, s, skip, lead, neg, rank``: each word with one letter skipped, and with none at each place.

    ``lead`` is false where the skipped letter repeats the one before it, since skipping that
    one gives the same rest. ``neg`` is the word's count with its sign turned, so that the
    smallest ``(neg, rank)`` is the most frequent word, ties going to the first one.
    """
    words = forward.select("rank", F.col("key").alias("word"), (-F.col("value")).alias("neg"), F.col("nodes").alias("p"))
    both = words.join(backward.select(F.col("value").alias("rank"), F.col("nodes").alias("s")), "rank")
    both = both.select("rank", "neg", "p", "s", F.split("word", "").alias("c"))
    skipped = """transform(sequence(0, size(c) - 1), i -> struct(
        p[i] as p, s[size(c) - 1 - i] as s, true as skip, i = 0 or c[i] <> get(c, i - 1) as lead))"""
    inserted = "transform(sequence(0, size(c)), i -> struct(p[i] as p, s[size(c) - i] as s, false as skip, false as lead))"
    return both.select("neg", "rank", F.expr(f"inline(concat({skipped}, {inserted}))"))


def neighbours(pairs: DataFrame) -> DataFrame:
    """``rank, n_near, best``: how many near words each word has, and ``(neg, rank)`` of the first of them."""
    groups = pairs.groupBy("p", "s").agg(
        F.array_sort(F.collect_list(F.expr("if(skip, struct(neg, rank, lead), null)"))).alias("long"),
        F.min(F.expr("if(skip, null, struct(neg, rank))")).alias("short"),
    )
    groups = groups.filter(F.expr("size(long) + if(short is null, 0, 1) > 1"))
    groups = groups.withColumn("leads", F.expr("filter(long, x -> x.lead)"))
    best_other = """case when i > 0 then struct(long[0].neg as neg, long[0].rank as rank)
        when size(long) > 1 then struct(long[1].neg as neg, long[1].rank as rank) end"""
    longer = f"""transform(long, (x, i) -> struct(
        x.rank as rank,
        size(long) - 1L + if(x.lead and short is not null, 1L, 0L) as near,
        array_min(filter(array({best_other}, if(x.lead, short, null)), y -> y is not null)) as best))"""
    shorter = """if(short is null or size(leads) = 0, filter({0}, x -> false), array(struct(
        short.rank as rank, cast(size(leads) as bigint) as near, struct(leads[0].neg as neg, leads[0].rank as rank) as best)))"""
    each = groups.select(F.expr(f"inline(concat({longer}, {shorter.format(longer)}))"))
    return each.groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``rank, root`` of ``rank, form``: the end of each chain, its length halved round by round."""
    current = cut_lineage(forms.select("rank", F.col("form").alias("root")), "forms")
    while True:
        onward = current.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        stepped = current.join(onward, "root", "left")
        stepped = stepped.select("rank", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        stepped = cut_lineage(stepped, "roots")
        if stepped.filter("moved").isEmpty():
            return stepped.select("rank", "root")
        current = stepped.select("rank", "root")


def group_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of the distinct, non-empty ``word, n`` of a vocabulary.

    ``n_near`` counts the words that one inserted, deleted or replaced code point tells apart
    from this one. ``form`` is the most frequent of them (ties: the first in code-point order),
    if its count is at least ``factor`` (2 or more) times the word's; ``root`` is where the chain
    of forms ends, the word itself if it has no form. Other columns are not looked at; an empty
    table gives an empty one. Words may be as long as a text can be: a word of n letters makes
    2 n + 1 rows of integers.
    """
    spark = words.sparkSession
    kept = cut_lineage(words.select(F.col("word").alias("key"), F.col("n").cast("long").alias("value")), "words")
    release(spark)
    forward = trie_nodes(kept)
    backward = trie_nodes(forward.select(F.reverse("key").alias("key"), F.col("rank").alias("value")))
    near = cut_lineage(neighbours(gaps(forward, backward)), "near")
    release(spark)
    known = forward.select("rank", F.col("key").alias("word"), F.col("value").alias("n"))
    linked = known.join(near, "rank", "left")
    good = -F.col("best.neg") >= factor * F.col("n")
    linked = linked.select(
        "rank",
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best.rank")).alias("form"),
        F.when(good, -F.col("best.neg")).alias("form_n"),
    )
    linked = cut_lineage(linked, "linked")
    ends = roots(linked.filter("form is not null").select("rank", "form"))
    names = known.select("rank", "word")
    out = linked.join(ends, "rank", "left")
    out = out.join(names.toDF("form", "form_word"), "form", "left").join(names.toDF("root", "root_word"), "root", "left")
    return out.select(
        "word",
        F.col("form_word").alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        "n_near",
        "form_n",
    )


def spelling_groups(docs: DataFrame) -> DataFrame:
    """The words of ``docs`` (doc_id, text; other columns are not looked at) with their forms and roots.

    Null and empty texts have no words; rows of equal id, or without one, are rows like any other.
    """
    return group_variants(vocabulary(slipped_runs(docs)))


def canonical(docs: DataFrame, variants: DataFrame) -> DataFrame:
    """``docs`` with ``variants array<struct<word, root>>``: the words of each text that have another root.

    Words are those of the text as it stands, lower-cased, in code-point order, once each.
    """
    row, word, found = private_names(docs, "row_number", "variant_word", "variants")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    numbered = cut_lineage(numbered, "numbered-texts")
    runs = numbered.select(row, F.explode(F.regexp_extract_all("text", F.lit(f"({RUN})"), 1)).alias(word))
    runs = runs.select(row, _lowered(F.col(word)).alias("word")).distinct()
    moved = variants.filter(F.col("root") != F.col("word")).select("word", "root")
    lists = runs.join(moved, "word").groupBy(row).agg(F.array_sort(F.collect_list(F.struct("word", "root"))).alias(found))
    empty = F.expr("cast(array() as array<struct<word:string,root:string>>)")
    out = numbered.join(lists, row, "left").drop(row)
    return out.withColumn(found, F.coalesce(found, empty))
