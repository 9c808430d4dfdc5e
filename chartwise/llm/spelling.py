"""Spelling variants of words and the frequent form each belongs to (operator 11).

Two words are near if one code point inserted, deleted or replaced turns one
into the other. They are found with asymmetric q-chunks:

1. The shorter word of a pair (of equally long ones the smaller) is cut into
   two disjoint chunks, its first and its second half. One edit cannot touch
   both, so one chunk survives in the other word.
2. The other word contributes all its positional grams of the sizes its
   partners' chunks can have.
3. A chunk meets equal grams at its own place, or one further right where the
   other word is one longer and the chunk is the second; place and length are
   part of the join key. What meets is verified by the edit distance of the
   other halves; a pair that met twice counts once.

A word's form is its most frequent near word if that is at least ``times``
as frequent. Following forms raises the frequency that much each step, so a
chain over counts below 2^63 has at most 19 steps; roots are found by
pointer jumping, which doubles the step every round.

Only counts of distinct words are paired: occurrences are added up before
the shuffle, so a word that makes up a third of all text is a few rows.
A chunk common to very many words meets all grams equal to it; such a join
key is split by adaptive execution, and nothing is capped.

Cases: null or empty text has no words; a null doc_id counts as empty in the
hash of an occurrence; repeated rows count as often as they occur; ties go
to the smaller word in code-point order; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.llm.common import drop, save

LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10
TYPO_EVERY = 31


def occurrences(docs: DataFrame, least_length: int = LEAST_LENGTH, typo_every: int | None = TYPO_EVERY) -> DataFrame:
    """(word): every run of letters, A-Z in lower case, of at least ``least_length`` code points.

    A run whose hash with its document's id ``typo_every`` divides loses one
    code point (a reproducible typing error); None leaves runs as they are.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{least_length},}})"), F.lit(1)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"), run.alias("_run"))
    word = F.translate("_run", string.ascii_uppercase, string.ascii_lowercase)
    if typo_every is None:
        return runs.select(word.alias("word"))
    hashed = runs.select(word.alias("_w"), F.crc32(F.concat("_doc", F.lit(":"), word).cast("binary")).alias("_h"))
    shorter = F.concat(F.expr("substring(_w, 1, int(_h % length(_w)))"), F.expr("substring(_w, int(_h % length(_w)) + 2)"))
    typed = F.when(F.col("_h") % typo_every == 0, shorter).otherwise(F.col("_w"))
    return hashed.select(typed.alias("word")).filter(F.length("word") >= least_length)


def vocabulary(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur at least ``least_count`` times."""
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), once per pair of near words; ``words``: word (distinct, at least two code points), n."""
    w = words.select("word", "n", F.length("word").alias("size"), F.expr("int(length(word) / 2)").alias("half"))
    ends = {side: [F.ascii(rest).alias(f"first_{side}"), F.ascii(F.right(rest, F.lit(1))).alias(f"last_{side}")] for side, rest in (
        ("a", F.col("c.rest")), ("b", F.expr("if(at = 0, substring(word, q + 1), substring(word, 1, at))")))}
    # the first half stays at its place; the second moves right by what the other word is longer
    chunks = w.select(
        F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(F.expr("""array(
            struct(substring(word, 1, half) AS gram, 0 AS at, size AS size, substring(word, half + 1) AS rest),
            struct(substring(word, 1, half) AS gram, 0 AS at, size + 1 AS size, substring(word, half + 1) AS rest),
            struct(substring(word, half + 1) AS gram, half AS at, size AS size, substring(word, 1, half) AS rest),
            struct(substring(word, half + 1) AS gram, half + 1 AS at, size + 1 AS size, substring(word, 1, half) AS rest))""")).alias("c"),
        F.col("size").alias("size_a")).select("a", "n_a", "size_a", "c.gram", "c.at", "c.size", *ends["a"])
    # partners are as long or one shorter: their halves have size div 2 or one less (even size) or one more (odd size)
    grams = w.withColumn("q", F.explode(F.expr("array(half, half + if(size % 2 = 0, -1, 1))"))).filter("q > 0")
    grams = grams.withColumn("at", F.explode(F.expr("sequence(0, size - q)")))
    grams = grams.select(F.expr("substring(word, at + 1, q)").alias("gram"), "at", "size", F.col("word").alias("b"), F.col("n").alias("n_b"), *ends["b"])
    # with the chunk equal, the words are near if what is left of both is; unless that is one letter, its first or last stays too
    met = chunks.join(grams, ["gram", "at", "size"]).filter(
        "(first_a = first_b OR last_a = last_b OR size - length(gram) < 2) AND (size_a < size OR a < b)")
    left = [F.expr(f"if(at = 0, substring({x}, length(gram) + 1), substring({x}, 1, {n} - length(gram)))") for x, n in (("a", "size_a"), ("b", "size"))]
    return met.filter(F.levenshtein(*left, 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word of ``forms`` (word, form) along forms to the last. No circles, as counts grow."""
    now = save(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        after = save(now.join(ahead, "root", "left").select(
            "word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")))
        drop(now)
        now = after
        if not now.filter("_moved").limit(1).count():
            return now.select("word", "root")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of ``words`` (word, n)."""
    words = save(words)
    pairs = save(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), "n_a", F.col("b").alias("other"), "n_b").union(
        pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n_a"), F.col("a").alias("other"), F.col("n_a").alias("n_b")))
    best = both.groupBy("word", F.col("n_a").alias("n")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("other"))).alias("top"))
    has = -F.col("top.less") >= times * F.col("n")
    best = save(best.select("word", "n_near", F.when(has, F.col("top.other")).alias("form"), F.when(has, -F.col("top.less")).alias("form_n")))
    last = roots(best.filter("form IS NOT NULL"))
    return words.join(best, "word", "left").join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long"))
