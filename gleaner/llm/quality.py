"""Quality rules: base counts and a hashed n-gram likelihood ratio, in DataFrame functions only.

A document's hashed unigrams and bigrams are scored by the logarithm of their share in a
trusted target corpus over their share in the raw corpus. The sum, divided by the number of
n-grams, is held against a fixed threshold, so each document's verdict depends on the
corpus counts and on nothing random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import SPACES
from gleaner.session import cut_lineage

#: Buckets of the hashed n-grams; the weight table has this many doubles at any corpus size.
BUCKETS = 1 << 14
#: At most so many labelled documents make up the target corpus (those of smallest hash).
TARGET_DOCS = 20_000
#: Documents below this mean log ratio (nats per n-gram) are rejected.
MIN_SCORE = -0.1
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACES}+"), "")


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES[1:-1]}]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _windows(hashes: Column) -> Column:
    """A hash for each run of WINDOW words."""
    n = F.size(hashes) - (WINDOW - 1)
    at = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(
        F.array().cast("array<bigint>")
    )


def _covered(windows: Column) -> Column:
    """Words inside windows that occur at least twice: a sort brings equal windows together."""

    def over(s: Column) -> Column:
        same = lambda x, k: x["h"].eqNullSafe(F.get(s, k)["h"])
        twice = F.filter(s, lambda x, j: ((j > 0) & same(x, j - 1)) | same(x, j + 1))
        starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
        return _let(
            starts,
            lambda p: F.aggregate(
                F.transform(
                    p,
                    lambda x, j: F.least(
                        F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))
                    ),
                ),
                F.lit(0).cast("bigint"),
                lambda a, x: a + x,
            ),
        )

    keyed = F.transform(windows, lambda h, j: F.struct(h.alias("h"), j.alias("p")))
    return _let(F.sort_array(keyed), over)


def _repeat_words(hashes: Column) -> Column:
    return _let(
        _windows(hashes),
        lambda w: F.when(
            F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")
        ).otherwise(_covered(w)),
    )


def _grams(hashes: Column, buckets: int) -> Column:
    """Bucket numbers of all unigrams and bigrams."""
    size = F.lit(buckets).cast("bigint")
    single = F.transform(hashes, lambda h: F.pmod(h, size).cast("int"))
    n = F.size(hashes)
    pair = lambda i: F.pmod(
        F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)), size
    ).cast("int")
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), pair)).otherwise(
        F.array().cast("array<int>")
    )
    return F.concat(single, pairs)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null or empty text has no words and fails. Windows are compared by 64-bit hashes.
    Columns of these names in ``docs`` are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = _words(body)
    facts = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _let(_hashes(w), _repeat_words).alias("n_repeat_words"),
        ),
    )
    out = docs.withColumn("base_failed", facts).withColumns(
        {
            "n_words": F.col("base_failed.n_words"),
            "word_chars": F.col("base_failed.word_chars"),
            "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": _duplicate_lines(body),
            "n_repeat_words": F.col("base_failed.n_repeat_words"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return out.withColumn("base_failed", failed)


def gram_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row ``weights array<double>``: the log ratio of target to raw share by bucket.

    Raw counts cover every document. The target corpus is a bounded sample of labelled
    rows: quality 1 and not toxic, the TARGET_DOCS of smallest hash. A weight is
    ``log((hit + 1) / (raw * hit_all / raw_all + 1))``. Without a trusted label all weights are zero.
    """
    trusted = (
        labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
        .select(F.col("doc_id").alias("trusted_id"))
        .distinct()
        .orderBy(F.xxhash64("trusted_id"), "trusted_id")
        .limit(TARGET_DOCS)
    )
    # at most TARGET_DOCS ids of 8 bytes
    marked = docs.select("doc_id", "text").join(
        F.broadcast(trusted), F.col("doc_id") == F.col("trusted_id"), "left"
    )
    grams = _let(
        _hashes(_words(F.coalesce(F.col("text"), F.lit("")))), lambda h: _grams(h, buckets)
    )
    counts = (
        marked.select(F.col("trusted_id").isNotNull().alias("t"), F.explode(grams).alias("bucket"))
        .groupBy("bucket", "t")
        .count()
        .groupBy("bucket")
        .agg(F.sum("count").alias("raw"), F.sum(F.when(F.col("t"), F.col("count"))).alias("hit"))
    )
    counts = cut_lineage(counts, "gram-counts")
    totals = counts.agg(
        F.coalesce(F.sum("raw"), F.lit(0)).alias("raw_all"),
        F.coalesce(F.sum("hit"), F.lit(0)).alias("hit_all"),
    )
    slots = docs.sparkSession.range(buckets).withColumn("bucket", F.col("id").cast("int"))
    # the raw count in a corpus of the target's size, so that neither size tilts the ratio
    fair = F.coalesce(F.col("raw"), F.lit(0)) * F.col("hit_all") / F.col("raw_all")
    weight = F.when(F.col("hit_all") == 0, F.lit(0.0)).otherwise(
        F.log((F.coalesce(F.col("hit"), F.lit(0)) + 1) / (fair + 1))
    )
    # one row of totals, and one row a bucket
    rows = slots.join(counts, "bucket", "left").crossJoin(F.broadcast(totals))
    return rows.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("bucket", weight.alias("w")))), lambda x: x["w"]
        ).alias("weights")
    )


def quality_rules(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with the base counts, ``llr`` (mean log ratio) and ``kept``.

    kept: the base rules pass and llr >= min_score. A text without words has llr 0 and
    fails the base rules. Every row is judged by itself: copies and ties get equal verdicts.
    """
    # BUCKETS numbers, whatever the corpus: they travel in the plan as one folded literal
    values = gram_weights(docs, labels).first()["weights"]
    weights = F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")

    def mean(grams: Column) -> Column:
        total = _let(
            weights,
            lambda w: F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(w, g)),
        )
        return F.when(F.size(grams) == 0, F.lit(0.0)).otherwise(total / F.size(grams))

    grams = _let(_hashes(_words(F.coalesce(F.col("text"), F.lit("")))), lambda h: _grams(h, BUCKETS))
    out = base_counts(docs).withColumn("llr", _let(grams, mean))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= min_score))
