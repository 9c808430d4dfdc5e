"""Spelling variants, tokenizer alignment and fingerprints against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from chartwise.llm import alignment, fingerprints, spelling, tokens
from chartwise.llm.queries import JSON_FILE, PIECE_FILE, QUERIES, RANK_FILE

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- spelling variants

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows, times=10, least=2):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return brute_forms({w: k for w, k in n.items() if k >= least}, times)


def brute_forms(n, times=10):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= times * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_spelling_query(spark, corpus):
    got = QUERIES["op11_spelling"](spark, SF).collect()
    want = brute_variants(zip(corpus.doc_id, corpus.text, strict=True))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_chunks_find_every_near_pair(spark):
    r = random.Random(3)
    n = {"a" * 7: 900, "a" * 8: 80, "a" * 9: 7, "aaaaaab": 8, "ééééééé": 50, "éééééé": 5}
    for _ in range(300):
        w = "".join(r.choice("abé") for _ in range(r.randint(2, 9)))
        n[w] = r.choice([2, 3, 30, 500, 6000])
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    pairs = spelling.near_pairs(words).collect()
    want = {(a, b) for a, b in itertools.combinations(n, 2) if one_edit(a, b)}
    assert {frozenset((p.a, p.b)) for p in pairs} == set(map(frozenset, want)) and len(pairs) == len(want)
    got = spelling.variants(words).collect()
    assert {tuple(x) for x in got} == brute_forms(n)
    assert any(x.root not in (x.form, x.word) for x in got)  # chains of several steps occur


def test_spelling_edges(edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()] + [(None, "Ångströms ångströms Ångström")] * 3
    more = edge.sparkSession.createDataFrame(rows, "doc_id long, text string")
    got = spelling.variants(spelling.vocabulary(spelling.occurrences(more)))
    assert {tuple(r) for r in got.collect()} == brute_variants(rows)
    assert spelling.variants(spelling.vocabulary(spelling.occurrences(nothing))).count() == 0


# ---- cross-tokenizer alignment

@pytest.fixture(scope="module")
def coders():
    ranks = tokens.ranks_of(RANK_FILE)
    a = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return a, {i: b for b, i in ranks.items()}, sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)


def brute_alignment(rows, coders):
    enc, a_bytes, sp = coders
    docs = []
    for doc, text in rows:
        a = enc.encode_ordinary(" " + text) if text else []
        b = sp.encode(text) if text else []
        ba = [a_bytes[i] for i in a]
        bb = [bytes([int(p[1:-1], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        if not text or b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            docs.append((doc, [], [], [], []))
            continue
        ea, eb = list(itertools.accumulate(map(len, ba))), list(itertools.accumulate(map(len, bb)))
        ends = collections.defaultdict(list)
        for y, f in zip(b, eb, strict=True):
            ends[f].append(y)
        links = [(x, y) for x, e in zip(a, ea, strict=True) for y in ends.get(e, ())]
        at_a, at_b = {e: k + 1 for k, e in enumerate(ea)}, {e: k + 1 for k, e in enumerate(eb)}
        groups, la, lb = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            ia, ib = at_a[e], at_b[e]
            groups.append((a[la:ia], b[lb:ib]))
            la, lb = ia, ib
        docs.append((doc, a, b, groups, links))
    n = collections.Counter(p for d in docs for p in d[4])
    top = collections.Counter()
    for (_, y), k in n.items():
        top[y] = max(top[y], k)
    out = collections.Counter()
    for doc, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[(doc, len(a), len(b), len(groups), len(links), sum(n[p] == top[p[1]] for p in links), sum(n[p] for p in links), sha(text) if a else "")] += 1
    return out


def test_alignment_query(spark, corpus, coders):
    got = collections.Counter(map(tuple, QUERIES["op12_alignment"](spark, SF).collect()))
    assert got == brute_alignment(list(zip(map(int, corpus.doc_id), corpus.text, strict=True)), coders)


def test_alignment_edges(spark, edge, nothing, coders):
    rows = [(r.doc_id, r.text) for r in edge.collect()] + [(30, "a▁b"), (31, "ab  c d ﬁ"), (32, "<s> </s> <0x41> <|endoftext|>"), (33, "\x00\x01"), (34, " "), (35, "é 가")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(map(tuple, alignment.align(docs, JSON_FILE, RANK_FILE, PIECE_FILE).collect()))
    assert got == brute_alignment(rows, coders)
    assert any(k[0] == 30 and k[1] == 0 for k in got)  # the mark for a space does not come back
    assert alignment.align(nothing, JSON_FILE, RANK_FILE, PIECE_FILE).count() == 0
    cut = alignment.aligned(docs, JSON_FILE, RANK_FILE, PIECE_FILE, keep_groups=True).filter("doc_id = 15").first()
    assert sum(x >> 32 for x in cut.pairs) == cut.n_a and sum(x & 0xFFFFFFFF for x in cut.pairs) == cut.n_b


def test_ends_in_blocks_are_the_same():
    r = np.random.default_rng(1)
    for _ in range(20):
        a, b = (np.cumsum(r.integers(1, 5, r.integers(1, 60))) for _ in "ab")
        a, b = a[a <= min(a[-1], b[-1])], b[b <= min(a[-1], b[-1])]
        want = alignment.shared_ends(a, b)
        both = sorted(set(a.tolist()) & set(b.tolist()))
        assert want == ([a.tolist().index(e) + 1 for e in both], [b.tolist().index(e) + 1 for e in both])
        assert alignment.shared_ends(a, b, block=3) == want
    assert list(alignment.groups([1, 2, 3], [7, 8], [2, 3], [1, 2])) == [([1, 2], [7]), ([3], [8])]


def test_pairs_are_bounded_by_the_vocabularies():
    a, b = alignment.byte_coder(JSON_FILE, RANK_FILE)[1], alignment.piece_coder(PIECE_FILE)[1]
    assert alignment.pair_bound(a, b) == 324300
    assert alignment.pair_bound([b"ab", b"b"], [b"b", b"cab"]) == 4


# ---- fingerprints

def brute_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (doc, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]

        def like(x, y):
            x, y = set(fingerprints.paragraphs(x)), set(fingerprints.paragraphs(y))
            return len(x & y) / len(x | y) if x | y else 1.0

        out[doc] = (len(text), sha(new), like(text, new), like(text, following))
    return out


def test_fingerprint_query(spark, corpus):
    rows = list(zip(map(int, corpus.doc_id), corpus.text, strict=True))
    got = QUERIES["op13_fingerprints"](spark, SF).collect()
    want = brute_edits(rows)
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got} == want and len(got) == len(rows)
    assert all(len(fingerprints.read_back(r.fingerprint)) == fingerprints.BASE_CELLS for r in got)
    by_text = collections.defaultdict(set)
    texts = dict(rows)
    for r in got:
        by_text[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprint_edges(spark, edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = fingerprints.with_edits(edge).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(d for d, _ in rows)
    once = [(d, t) for d, t in rows if [x for x, _ in rows].count(d) == 1]
    one = spark.createDataFrame(once, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in fingerprints.with_edits(one).collect()} == brute_edits(once)
    assert fingerprints.with_edits(nothing).count() == 0
    single = fingerprints.with_edits(spark.createDataFrame([(5, "a\nb\nc")], "doc_id long, text string")).first()
    assert single.near_next == 1.0 and single.edited_sha256 == sha("a\nba\n")


def test_difference_is_recovered_and_retried():
    r = random.Random(9)
    lines = [f"line {i}" for i in range(3000)]
    sets = []
    for size, changes in ((0, 0), (1, 1), (10, 3), (500, 2), (3000, 700), (40, 40)):
        old = r.sample(lines, size)
        new = [f"new {x}" if k < changes else x for k, x in enumerate(old)]
        sets.append(("\n".join(old), "\n".join(new)))
    a, b = [fingerprints.digests(x) for x, _ in sets], [fingerprints.digests(y) for _, y in sets]
    got, took = fingerprints.differences(a, b)
    for x, y, (only_x, only_y) in zip(a, b, got, strict=True):
        assert set(only_x) == set(x) - set(y) and set(only_y) == set(y) - set(x)
    assert took[3] == fingerprints.BASE_CELLS and took[4] > 1000
    # a fingerprint read back from its text is the same sketch
    s = fingerprints.sketches(a[2], np.array([0, len(a[2])]), 24)[0]
    assert (fingerprints.read_back(fingerprints.written(s)) == s).all()


def test_versions_compare_by_their_paragraphs(spark):
    pairs = spark.createDataFrame([("k", "a\nb\nc", "a\nx\nc"), ("n", None, "a"), ("e", None, "")], "key string, old string, new string")
    got = {r.key: r for r in fingerprints.compare_versions(pairs).collect()}
    assert got["k"].likeness == 0.5 and len(got["k"].only_old) == len(got["k"].only_new) == 1
    assert got["k"].only_old == [int(fingerprints.digests("b").view(np.int64)[0])]
    assert got["n"].likeness == 0.0 and got["e"].likeness == 1.0


def test_long_lines_fall_into_sentences():
    long = " ".join(f"Sentence number {i} is here." for i in range(20))
    assert len(fingerprints.paragraphs(long)) == 20 and len(fingerprints.paragraphs(long[:100])) == 1
