"""The registered queries of this package: thin projections of its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwise.llm import (
    alignment,
    bpe,
    exact_dedup,
    fingerprints,
    kmeans_tree,
    minhash,
    packing,
    quality,
    repeats,
    secret_scan,
    spelling,
    token_counts,
    warc,
)
from chartwise.llm.common import table

JSON_FILE = public_tokenizers.path("byte_bpe_50k.json")
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@_query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bpe.encode_text(table(spark, sf_dir, "documents"), RANK_FILE, public_tokenizers.PATTERN)
    spaces = F.length("ids_text") - F.length(F.replace("ids_text", F.lit(" "), F.lit("")))
    return e.select(
        "doc_id", F.when(F.col("ids_text") == "", 0).otherwise(spaces + 1).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


@_query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), words=4, percent=80)


@_query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = token_counts.counts(table(spark, sf_dir, "documents"), RANK_FILE)
    return c.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_counts.LIMIT).alias("over_limit"), "fitting_bytes")


@_query
def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@_query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), JSON_FILE, RANK_FILE)


@_query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@_query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(spelling.occurrences(table(spark, sf_dir, "documents"))))


@_query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), JSON_FILE, RANK_FILE, PIECE_FILE)


@_query
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


ORACLES["op10_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

# SHA-1 in base32: every five hex digits are four characters
ORACLES["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda i:
        array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          ((CAST('0x' || substr(h, CAST(i * 5 + 1 AS INTEGER), 5) AS INTEGER) >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
        max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM d
"""

ORACLES["op6_minhash"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 4 THEN list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' '))
        WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT i.a, i.b FROM i JOIN n AS x ON x.doc_id = i.a JOIN n AS y ON y.doc_id = i.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id, n.doc_id = min(r) AS kept
FROM n JOIN reach ON n.doc_id = reach.doc_id GROUP BY n.doc_id, n.n
"""

# CRC-32 over the bytes of each string, with the table made from its polynomial
ORACLES["op11_spelling"] = r"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) AS r(b)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS r FROM documents),
low AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM runs),
per AS (SELECT doc_id, w, count(*) AS k FROM low GROUP BY ALL),
hashed AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT)),
       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
     FROM (SELECT w, k, coalesce(doc_id::VARCHAR, '') || ':' || w AS s FROM per), crc_table),
typed AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed),
v AS (SELECT word, sum(k)::BIGINT AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (SELECT a.word AS word, a.n AS n, b.word AS other, b.n AS n_other FROM cuts AS a JOIN cuts AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT cuts.word, cuts.n, v.word, v.n FROM cuts JOIN v ON rest = v.word
    UNION SELECT v.word, v.n, cuts.word, cuts.n FROM cuts JOIN v ON rest = v.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n_other DESC, other) AS top, max(n_other) AS top_n FROM pairs GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * v.n THEN top END AS form, CASE WHEN top_n >= 10 * v.n THEN top_n END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON walk.at = forms.word WHERE forms.form IS NOT NULL)
SELECT forms.word, forms.form, walk.at AS root, forms.n, forms.n_near, forms.form_n FROM forms JOIN walk ON walk.word = forms.word JOIN forms AS f ON walk.at = f.word WHERE f.form IS NULL
"""
