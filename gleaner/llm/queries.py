"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import (
    alignment,
    hmm,
    nbest,
    packing,
    prefix,
    quality,
    simhash,
    substring,
    suffixes,
    surrogates,
    topk,
    variants,
    warc,
)
from gleaner.llm.common import table


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the trained model and the unigram base."""
    return hmm.score(table(spark, sf_dir, "documents"))


def op2_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every document, decoded again."""
    return nbest.segment(table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every query vector."""
    return topk.search(table(spark, sf_dir, "embeddings"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to packages and read back by range."""
    packages = warc.archive_pages(table(spark, sf_dir, "pages"))
    read = warc.read_packages(packages, with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, how many repeat earlier documents, and what stays."""
    out = substring.repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document, over 3-word shingles and 2 bits."""
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return classes.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, mean log ratio and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs, table(spark, sf_dir, "labels")).drop("text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data and secrets replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, surrogates.SAMPLE_KEY, count="n_replaced")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, and how much of it fits into 4,096 tokens."""
    return prefix.token_counts(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizations of every document, weighed by corpus-wide counts."""
    return alignment.aligned_counts(table(spark, sf_dir, "documents")).drop("row")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of all documents with its near words, its form and its root."""
    return variants.spelling_groups(table(spark, sf_dir, "documents"))


def op13_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeated strings of 400 bytes cover, and what stays."""
    out = suffixes.repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {
    "op1_hidden_markov": op1_hidden_markov,
    "op2_segmentation": op2_segmentation,
    "op3_top_k": op3_top_k,
    "op4_warc": op4_warc,
    "op5_substring": op5_substring,
    "op6_simhash": op6_simhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_surrogates": op9_surrogates,
    "op10_token_counts": op10_token_counts,
    "op11_alignment": op11_alignment,
    "op12_variants": op12_variants,
    "op13_suffix_array": op13_suffix_array,
}

ORACLES: dict[str, str] = {
    "op3_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
""",
    "op4_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), m AS (
  SELECT digest, max(page_id) AS latest FROM p GROUP BY digest
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> latest THEN latest END AS refers_to
FROM p JOIN m USING (digest)
""",
    "op5_substring": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') AS words
  FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(list_slice(words, p, p + 12), ' ') AS body
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS p FROM w WHERE len(words) >= 13)
), firsts AS (
  SELECT body, min(doc_id) AS first_id FROM win GROUP BY body
), hits AS (
  SELECT DISTINCT win.doc_id, unnest(generate_series(p, p + 12)) AS pos
  FROM win JOIN firsts USING (body) WHERE first_id < win.doc_id
), gone AS (
  SELECT doc_id, list(pos) AS cut FROM hits GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
       CAST(coalesce(len(cut), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN cut IS NULL THEN words ELSE
         list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(cut, i)),
                        lambda i: words[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
""",
}
