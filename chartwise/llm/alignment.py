"""Alignment of two tokenizers over the same text by the places where their tokens end (operator 12).

Tokenizer A is byte-level, B a piece vocabulary with byte fallback; both see
a space before the text (B adds it). A token covers a byte range, so the
running sum of token sizes gives every token's end. Each side becomes a
dictionary from end to the number of tokens up to it; the keys that both
dictionaries hold, sorted, cut the two id lists into groups. A link is a pair of tokens that
end together. Tokens have at least one byte, so within a group that is its
last A and its last B token.

Ends of a long text are looked up in blocks of BLOCK bytes; a group that
spans blocks is cut where its end is found, so blocks change no result.

Corpus-wide counts of linked id pairs are added up by Spark. Two linked
tokens end at the same byte, so the bytes of one are the end of the other's:
the number of different pairs is bounded by the two vocabularies (``pair_bound``;
324,300 for the two of the query), whatever the corpus. Only this table is
broadcast.

Cases: a text that is null, empty, or not given back byte for byte by both
tokenizers has no tokens, zeros and ''; strings of special tokens are plain
text; repeated rows count as often as they occur; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.llm import tokens
from chartwise.llm.common import save, ship, trim

BLOCK = 1 << 20
SPACE = b" "
_loaded: dict = {}


def piece_coder(model_file: str):
    """(sentencepiece processor, bytes of every id), once per worker."""
    if model_file not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        _loaded[model_file] = sp, [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return _loaded[model_file]


def byte_coder(json_file: str, rank_file: str):
    """(text -> ids with special strings as plain text, or None if they do not give the text back; bytes of every id), once per worker."""
    key = (json_file, rank_file)
    if key not in _loaded:
        ranks = tokens.ranks_of(rank_file)
        table = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            table[i] = b
        quick = tokens.fast(rank_file)
        size = np.array([len(b) for b in table])

        def ids(text: str) -> np.ndarray | None:
            raw = text.encode()
            if not tokens.beyond_ranks(text):
                got = quick.encode_to_numpy(text, disallowed_special=())
                # tokens are consecutive parts of the text: their sizes add up only if nothing is left out
                return got if int(size[got].sum()) == len(raw) else None
            lib = tokens.library(json_file)
            lib.encode_special_tokens = True
            try:
                got = lib.encode(text, add_special_tokens=False).ids
            finally:
                lib.encode_special_tokens = False
            return np.asarray(got) if b"".join(map(table.__getitem__, got)) == raw else None

        _loaded[key] = ids, table
    return _loaded[key]


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """Most pairs of ids that can be linked: one token's bytes are the end of the other's."""
    def times(table):
        count: dict[bytes, int] = {}
        for t in table:
            count[t] = count.get(t, 0) + 1
        return count

    of_a, of_b = times(a), times(b)
    return (sum(of_b.get(t[k:], 0) for t in a for k in range(len(t)))
            + sum(of_a.get(t[k:], 0) for t in b for k in range(1, len(t))))


def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray, block: int = BLOCK) -> tuple[list[int], list[int]]:
    """For every end that both sides have, in order: how many A and how many B tokens lie before it."""
    upto_a: list[int] = []
    upto_b: list[int] = []
    total = int(ends_a[-1]) if len(ends_a) else 0
    edges = np.arange(0, total + block, block)
    cut_a, cut_b = np.searchsorted(ends_a, edges, side="right"), np.searchsorted(ends_b, edges, side="right")
    for k in range(len(edges) - 1):
        at_a = dict(zip(ends_a[cut_a[k]: cut_a[k + 1]].tolist(), range(int(cut_a[k]) + 1, int(cut_a[k + 1]) + 1), strict=True))
        at_b = dict(zip(ends_b[cut_b[k]: cut_b[k + 1]].tolist(), range(int(cut_b[k]) + 1, int(cut_b[k + 1]) + 1), strict=True))
        both = sorted(at_a.keys() & at_b.keys())
        upto_a += map(at_a.__getitem__, both)
        upto_b += map(at_b.__getitem__, both)
    return upto_a, upto_b


def groups(ids_a: list[int], ids_b: list[int], upto_a: list[int], upto_b: list[int]):
    """The id lists cut at the shared ends: (A ids, B ids) per group."""
    la = lb = 0
    for ia, ib in zip(upto_a, upto_b, strict=True):
        yield ids_a[la:ia], ids_b[lb:ib]
        la, lb = ia, ib


class Writer:
    """Writes groups as ``a1,a2|b1;a3|b2,b3`` (decimal ids), from tables of every id with the mark that follows it."""

    def __init__(self, n_a: int, n_b: int):
        self.marked = [f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)]
        self.bases = (0, n_a, 2 * n_a, 2 * n_a + n_b)  # A within a group, A at its end, B within, B at its end

    def text(self, a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> str:
        out = np.empty(len(a) + len(b), np.int64)
        per_a, per_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        # a group's A ids come before its B ids: each id moves on by what the other side has written until then
        at_a = np.arange(len(a)) + np.repeat(upto_b - per_b, per_a)
        at_b = np.arange(len(b)) + np.repeat(upto_a, per_b)
        out[at_a] = a + self.bases[0]
        out[at_b] = b + self.bases[2]
        out[at_a[upto_a - 1]] = a[upto_a - 1] + self.bases[1]
        out[at_b[upto_b - 1]] = b[upto_b - 1] + self.bases[3]
        return "".join(map(self.marked.__getitem__, out.tolist()))[:-1]


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>, pairs array<long>"


def aligned(docs: DataFrame, json_file: str, rank_file: str, model_file: str, keep_groups: bool = False) -> DataFrame:
    """Per document: token and group counts, hash of the written groups, and its links.

    ``links``: A id << 32 | B id, in order. ``pairs`` holds, with
    ``keep_groups``, how many A and B tokens each group has (A << 32 | B), else null.
    """
    ship(docs.sparkSession)

    def run(batches):
        encode_a, bytes_a = byte_coder(json_file, rank_file)
        sp, bytes_b = piece_coder(model_file)
        size_a = np.array([len(x) for x in bytes_a])
        size_b = np.array([len(x) for x in bytes_b])
        writer = Writer(len(bytes_a), len(bytes_b))
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                values = (doc, 0, 0, 0, "", [], [] if keep_groups else None)
                a = encode_a(" " + text) if text else None
                ids_b = sp.encode(text, num_threads=1) if a is not None else []
                if ids_b and b"".join(map(bytes_b.__getitem__, ids_b)) == SPACE + text.encode():
                    b = np.asarray(ids_b)
                    ua, ub = map(np.asarray, shared_ends(np.cumsum(size_a[a]), np.cumsum(size_b[b])))
                    sha = hashlib.sha256(writer.text(a, b, ua, ub).encode()).hexdigest()
                    links = (a[ua - 1].astype(np.int64) << 32) | b[ub - 1]
                    cut = (np.diff(ua, prepend=0) << 32) | np.diff(ub, prepend=0) if keep_groups else None
                    values = (doc, len(a), len(b), len(ua), sha, links, cut)
                for col, v in zip(cols, values, strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()),
                 pa.array(cols[5], pa.list_(pa.int64())), pa.array(cols[6], pa.list_(pa.int64()))],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "pairs"])
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """(link, n, best): how often each id pair is linked in the corpus, and whether no pair of its B id is linked more often."""
    counts = found.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))
    counts = counts.withColumn("_b", F.col("link").bitwiseAND(0xFFFFFFFF))
    top = counts.groupBy("_b").agg(F.max("n").alias("_top"))
    return counts.join(top, "_b").select("link", "n", (F.col("n") == F.col("_top")).alias("best"))


def scored(found: DataFrame) -> DataFrame:
    """``found`` (from ``aligned``, saved) with n_links, n_best and count_sum."""
    table = pair_counts(found).toArrow().sort_by("link")  # bounded by the vocabularies, see above
    link, n = table.column("link").to_numpy(), table.column("n").to_numpy()
    best = table.column("best").to_numpy().astype(np.int64)
    known = found.sparkSession.sparkContext.broadcast((link, n, best))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches):
        link, n, best = known.value
        for batch in batches:
            lists = batch.column(5)
            off = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy()[off[0]: off[-1]]
            off = off - off[0]
            at = np.searchsorted(link, values)
            sums = np.zeros((2, len(values) + 1), np.int64)
            np.cumsum(best[at], out=sums[0, 1:])
            np.cumsum(n[at], out=sums[1, 1:])
            per = sums[:, off[1:]] - sums[:, off[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(4)), pa.array(np.diff(off)), pa.array(per[0]), pa.array(per[1]), batch.column(4)], names=names)
        trim()

    return found.select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links").mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, json_file: str, rank_file: str, model_file: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document."""
    return scored(save(aligned(docs, json_file, rank_file, model_file)))
