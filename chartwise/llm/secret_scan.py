"""Secret scans with character Markov models, in DataFrame functions only (operator 5).

Three patterns give the base findings: assignments to a password-like
name, access keys, and long runs of hex digits. Two first-order Markov
models over characters add to them: one of random strings, trained on the
values the patterns found, one of ordinary identifiers, trained on words
of up to 19 characters that no pattern found. Of a run of 20 or more characters
of the value alphabet, the parts outside base findings are scored together;
each is reported as ``markov`` if their log-likelihood ratio of the two
models exceeds a threshold. So a long secret of which a pattern finds only
a piece is found whole, and base findings stay as they are.

Labelled samples: of the distinct values and words of all documents, those
with the smallest hash, at most SAMPLE of each class (only words of low hash
are shuffled). Half trains the models;
the threshold is the largest ratio of FALSE_SHARE of the other half's
ordinary strings, at least 0.

One pass over the texts extracts findings and candidate runs with their
places; training and scoring read that small table. Places come from the
pieces between matches: a match starts after all earlier pieces and
matches. They are added up in blocks of BLOCK matches, since arrays grow by
copying. Nothing is shuffled but distinct words and values, and bigram counts.

Cases: null text is empty and has no findings; repeated rows are scanned
each; without random (or ordinary) samples that model is uniform; long
runs are scored in linear time; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartwise.llm.common import boxed, drop, nz, save

KINDS = ("assign", "access", "hex", "markov")
# fixed patterns of the base findings
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run of 16 or more from its first AKIA
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z0-9_]{5,18}(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SAMPLE = 20_000
BLOCK = 256
FALSE_SHARE = 0.999
FALL_BACK = 100.0
MASK = "[SECRET]"
_SIDE = len(ALPHABET) + 1


def _let(value: Column, made) -> Column:
    """``made`` of ``value``, which is evaluated once however often ``made`` names it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK items."""
    last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * BLOCK + 1, BLOCK))


def _found(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """array<struct<a,k,b,ab,bb,v>>: code-point range, kind, byte range and value of every match, left to right."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(value_group)) if value_group else whole
    items = F.zip_with(F.arrays_zip(whole.alias("m"), value.alias("v")), F.split(text, pattern, -1),
                       lambda x, gap: F.struct(gap.alias("g"), x["m"].alias("m"), x["v"].alias("v")))
    none = F.array().cast("array<struct<a:int,k:int,b:int,ab:int,bb:int,v:string>>")
    items = F.filter(items, lambda x: x["m"].isNotNull())  # the piece after the last match pairs with no match
    size = lambda x, of: of(x["g"]) + of(x["m"])

    def total(block, of):
        return F.aggregate(block, F.lit(0), lambda n, x: n + size(x, of))

    def start(state, block):
        return F.struct((state["a"] + total(block, F.length)).alias("a"), (state["ab"] + total(block, F.octet_length)).alias("ab"),
                        F.concat(state["out"], F.array(F.struct(state["a"].alias("a"), state["ab"].alias("ab")))).alias("out"))

    def add(state, x):
        a, ab = state["a"] + F.length(x["g"]), state["ab"] + F.octet_length(x["g"])
        b, bb = a + F.length(x["m"]), ab + F.octet_length(x["m"])
        one = F.struct(a.alias("a"), F.lit(kind).alias("k"), b.alias("b"), ab.alias("ab"), bb.alias("bb"), x["v"].alias("v"))
        return F.struct(b.alias("a"), bb.alias("ab"), F.concat(state["out"], F.array(one)).alias("out"))

    def starts(bl):
        return F.aggregate(bl, F.struct(F.lit(0).alias("a"), F.lit(0).alias("ab"), F.array().cast("array<struct<a:int,ab:int>>").alias("out")),
                           start, lambda s: s["out"])

    def places(bl, st):
        return F.flatten(F.zip_with(bl, st, lambda block, at: F.aggregate(
            block, F.struct(at["a"].alias("a"), at["ab"].alias("ab"), none.alias("out")), add, lambda s: s["out"])))

    found = _let(items, lambda it: _let(_blocks(it), lambda bl: _let(starts(bl), lambda st: places(bl, st))))
    return F.when(text.rlike(pattern), found).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, _h, base, runs): base findings in order, and candidate runs."""
    t = docs.select("doc_id", F.xxhash64(nz()).alias("_h"), nz().alias("_t"))
    text = F.col("_t")
    parts = t.select(
        "doc_id", "_h", _found(text, ASSIGN, 0, 2).alias("assign"), _found(text, ACCESS, 1).alias("access"),
        _found(text, HEX, 2).alias("hex"), _found(text, RUN, 3).alias("runs"))
    assign = F.filter("assign", lambda x: F.length(x["v"]) >= 8)
    return parts.select("doc_id", "_h", F.array_sort(F.concat(assign, "access", "hex")).alias("base"), "runs")


def _places(s: Column) -> Column:
    """Alphabet place of every character, 0 for others."""
    return F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _pairs(s: Column) -> Column:
    p = _places(s)
    return F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), lambda a, b: a * _SIDE + b)


def samples(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(s, random, held): labelled strings, half of them held out."""
    values = scanned.select(F.explode("base.v").alias("s")).filter(F.length("s") >= 8)
    words = docs.select(F.explode(F.regexp_extract_all(nz(), F.lit(WORD), F.lit(0))).alias("s"))

    # only strings whose hash is low are told apart: about four times as many as are wanted, or all if that was too few
    about = words.agg(F.approx_count_distinct("s")).first()[0]
    known = values.distinct()
    low = save(_low_hash(words, 4.0 * SAMPLE / max(1, about)).distinct().join(known, "s", "left_anti"))
    if 4 * SAMPLE < about and low.count() < SAMPLE:
        drop(low)
        low = words.distinct().join(known, "s", "left_anti")

    def lowest_hash(strings, random):
        one = strings.distinct().orderBy(F.xxhash64("s"), "s").limit(SAMPLE)
        return one.select("s", F.lit(random).alias("random"), (F.pmod(F.xxhash64("s", F.lit(3)), F.lit(2)) == 0).alias("held"))

    return lowest_hash(values, True).union(lowest_hash(low, False))


def _low_hash(strings: DataFrame, share: float) -> DataFrame:
    """The strings whose hash is among the lowest ``share`` of all hashes."""
    if share >= 1:
        return strings
    return strings.filter(F.xxhash64("s") < F.lit(int(-(1 << 63) + share * (1 << 64))))


def train(sample: DataFrame) -> tuple[list[float], float]:
    """Log-likelihood ratio of every pair of characters (by place), and the threshold on a string's sum."""
    counted = (sample.filter("not held").select("random", F.explode(_pairs(F.col("s"))).alias("p"))
               .groupBy("random", "p").count().collect())  # at most two rows per pair of alphabet characters
    logs = {}
    for random in (True, False):
        table = [[0.0] * _SIDE for _ in range(_SIDE)]
        for r in counted:
            if r["random"] == random:
                table[r["p"] // _SIDE][r["p"] % _SIDE] = float(r["count"])
        # pairs that are rare after their first character fall back on how common the second is
        single = [1.0 + sum(row[k] for row in table) for k in range(_SIDE)]
        whole = sum(single)
        logs[random] = [math.log((row[k] + FALL_BACK * single[k] / whole) / (sum(row) + FALL_BACK)) for row in table for k in range(_SIDE)]
    ratio = [a - b for a, b in zip(logs[True], logs[False], strict=True)]
    held = sample.filter("held and not random").select(score(F.col("s"), ratio).alias("r"))
    most = held.agg(F.percentile("r", FALSE_SHARE)).first()[0]  # exact; at most SAMPLE rows
    return ratio, max(0.0, most or 0.0)


def score(s: Column, ratio: list[float]) -> Column:
    table = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")
    return F.aggregate(_pairs(s), F.lit(0.0), lambda acc, p: acc + F.get(table, p))


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["a"].cast("string"), x["b"].cast("string"))), ",")


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, _h, base, added): base findings and those the models add, per row of ``docs``."""
    scanned = save(scan(docs))
    sample = save(samples(docs, scanned))  # read twice; at most 2 * SAMPLE rows
    ratio, least = train(sample)
    drop(sample)
    # the base findings that meet a block of runs first, then those that meet a run: both are in order of their places
    outside = F.flatten(F.transform(_blocks(F.col("runs")), lambda block: _let(_meeting(F.col("base"), block), lambda near: F.transform(
        block, lambda x: _outside(x, near)))))
    random = F.filter(outside, lambda parts: F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + score(p["v"], ratio)) > least)
    return scanned.select("doc_id", "_h", "base", F.flatten(random).alias("added"))


def _meeting(base: Column, block: Column) -> Column:
    first, last = F.get(block, F.lit(0)), F.element_at(block, -1)
    return F.when(F.size(block) == 0, F.slice(base, 1, 0)).otherwise(F.filter(base, lambda y: (y["a"] < last["b"]) & (first["a"] < y["b"])))


def _outside(run: Column, base: Column) -> Column:
    """The parts of a run that no base finding covers, in order (a run is ASCII, so places in it are bytes and code points)."""
    def part(a, b):
        return F.struct(a.alias("a"), F.lit(KINDS.index("markov")).alias("k"), b.alias("b"), (run["ab"] + (a - run["a"])).alias("ab"),
                        (run["ab"] + (b - run["a"])).alias("bb"), F.substring(run["v"], a - run["a"] + 1, b - a).alias("v"))

    def cut(state, y):
        return F.struct(F.greatest(state["at"], y["b"]).alias("at"), F.when(y["a"] > state["at"], F.concat(
            state["out"], F.array(part(state["at"], y["a"])))).otherwise(state["out"]).alias("out"))

    def rest(state):
        return F.when(state["at"] < run["b"], F.concat(state["out"], F.array(part(state["at"], run["b"])))).otherwise(state["out"])

    met = F.filter(base, lambda y: (y["a"] < run["b"]) & (run["a"] < y["b"]))
    none = F.array().cast("array<struct<a:int,k:int,b:int,ab:int,bb:int,v:string>>")
    return F.when(F.size(met) == 0, F.array(run)).otherwise(F.aggregate(met, F.struct(run["a"].alias("at"), none.alias("out")), cut, rest))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans per row of ``docs``."""
    f = findings(docs)

    def count(k):
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    return f.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.size("added").cast("long").alias("n_markov"),
        F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _text(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every finding replaced by MASK (n_chars, if there, follows)."""
    spans = findings(docs).filter("size(base) + size(added) > 0").dropDuplicates(["doc_id", "_h"]).select(
        F.col("doc_id").alias("_id"), F.col("_h").alias("_g"),
        F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["ab"].alias("a"), x["bb"].alias("b")))).alias("_s"))
    rows = boxed(docs, _doc=F.col("doc_id"), _text=F.col("text"), _h=F.xxhash64(nz()))
    both = rows.join(spans, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left")

    def piece(raw, a, b):
        return F.substring(raw, a + 1, b - a).cast("string")

    def ends(state, block):  # how far the findings before each block reach
        return F.struct(F.greatest(state["at"], F.coalesce(F.array_max(F.transform(block, lambda x: x["b"])), F.lit(-1))).alias("at"),
                        F.concat(state["out"], F.array(state["at"])).alias("out"))

    def add(raw):
        def one(state, x):  # findings that overlap or touch share one mask
            return F.struct(
                F.greatest(state["at"], x["b"]).alias("at"),
                F.when(x["a"] <= state["at"], state["out"]).otherwise(
                    F.concat(state["out"], F.array(piece(raw, F.greatest(state["at"], F.lit(0)), x["a"]), F.lit(MASK)))).alias("out"))
        return one

    def pieces(raw, blocks):
        starts = F.aggregate(blocks, F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("out")), ends, lambda s: s["out"])
        return F.flatten(_let(starts, lambda st: F.zip_with(blocks, st, lambda block, at: F.aggregate(
            block, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), add(raw), lambda s: s["out"]))))

    reach = F.array_max(F.transform("_s", lambda x: x["b"]))
    masked = _let(F.col("_text").cast("binary"), lambda raw: F.concat(
        F.array_join(_let(_blocks(F.col("_s")), lambda blocks: pieces(raw, blocks)), ""), piece(raw, reach, F.octet_length("_text"))))
    out = both.select("_row", F.when(F.col("_s").isNull(), F.col("_text")).otherwise(masked).alias("_text"))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_row.text").eqNullSafe(F.col("_text")), F.col("_row.n_chars")).otherwise(F.length("_text").cast("long"))
    return out.select(*[(changed[c] if c in changed else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
