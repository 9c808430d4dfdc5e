"""Token counts at every prefix by dynamic programming (operator 7).

Byte-level BPE encodes each match of the splitting pattern by itself, and
within a match the encoding of a prefix is the encoding of a shorter
prefix plus one token: the one token that ends the prefix and that the
shorter prefix's last token leaves alone when both are encoded together.
So one pass over a match gives the token count of all its prefixes, and
a running sum over matches gives those of the document. Truncation ("how
many bytes fit into 1024 tokens") and budget questions ("how many tokens
do the first 500 bytes take") are then look-ups; nothing is encoded again.

A prefix that ends inside a match can be split differently at its end than
the whole text: white space before a word gives its last character to the
word, and "'re", "'ve", "'ll" are one match only when complete. Those
positions are counted by the split that the prefix has.

``counts`` returns per document n_bytes, n_tokens, the longest prefix
within ``limit`` tokens, and on request the whole table of prefix counts.

Cases: null text is empty and has 0 tokens; prefixes that end inside a
character carry the byte-level count of their match; the end-of-text
string inside a text is one token, as the library's default has it;
repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.llm import tokens
from chartwise.llm.common import ship

LIMIT = 1024
CACHED_WORDS = 1_000_000  # matches a worker remembers; the frequent ones come early
CACHED_PAIRS = 500_000
_LATE = {b"'re", b"'ve", b"'ll"}


class PrefixCounter:
    """Token counts of all byte prefixes of a text, for one vocabulary."""

    def __init__(self, rank_file: str):
        import public_tokenizers

        self.ranks = tokens.ranks_of(rank_file)
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, raw: bytes) -> list[bytes]:
        """Plain ranked merges of a short byte string; only pairs of tokens come here."""
        parts = [raw[i: i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if best == 1 << 30:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens side by side stay what they are."""
        known = self.merged(left + right) == ([left, right] if left else [right])
        if len(self.pairs) < CACHED_PAIRS:
            self.pairs[(left, right)] = known
        return known

    def prefixes(self, raw: bytes) -> bytes:
        """Token count of raw[:1], raw[:2], ... as one match each (unsigned 32-bit)."""
        last, count = [b""], [0]
        ranks, known = self.ranks, self.pairs.get
        for i in range(1, len(raw) + 1):
            for j in range(max(0, i - self.longest), i):
                piece = raw[j:i]
                if piece in ranks:
                    alone = known((last[j], piece))
                    if alone or (alone is None and self.stays(last[j], piece)):
                        last.append(piece)
                        count.append(count[j] + 1)
                        break
        if raw in _LATE:
            count[2] = 2
        return array("I", count[1:]).tobytes()

    def total(self, word: str) -> int:
        return int.from_bytes(self.word(word)[-4:], sys.byteorder)

    def word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = self.prefixes(word.encode())
            if len(word) <= 64 and len(self.words) < CACHED_WORDS:
                self.words[word] = got
        return got

    def text(self, text: str | None) -> np.ndarray:
        """Token count of every byte prefix of ``text`` (entry i: the first i+1 bytes)."""
        out, base = [], 0
        parts = (text or "").split(tokens.END)
        for k, part in enumerate(parts):
            if k:
                out.append(self._inside_end(parts[k - 1], base))
                base += 1
            table = self._part(part, base)
            if len(table):
                out.append(table)
                base = int(table[-1])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _part(self, text: str, base: int) -> np.ndarray:
        words = self.split(text)
        if not words:
            return np.zeros(0, np.uint32)
        known = self.words
        tables = [known.get(w) or self.word(w) for w in words]
        sizes = np.fromiter(map(len, tables), np.int64, len(tables)) >> 2
        out = np.frombuffer(bytearray(b"".join(tables)), dtype=np.uint32)
        ends = np.cumsum(sizes)
        totals = out[ends - 1].astype(np.int64)
        before = np.cumsum(totals) - totals + base
        out += np.repeat(before, sizes).astype(np.uint32)
        # a run of white space before a word: until the word begins, the run and the character taken from it are one match
        for i, w in enumerate(words):
            if w.isspace() and i + 1 < len(words) and words[i + 1][0].isspace():
                taken = words[i + 1][0]
                out[int(ends[i]) + len(taken.encode()) - 1] = before[i] + self.total(w + taken)
        return out

    def _inside_end(self, before: str, base: int) -> np.ndarray:
        """Counts while the end-of-text string is incomplete: it then continues the text before it."""
        last = self.split(before)[-2:]
        rest = base - sum(map(self.total, last))
        out = [rest + sum(map(self.total, self.split("".join(last) + tokens.END[:i]))) for i in range(1, len(tokens.END))]
        return np.array([*out, base + 1], dtype=np.uint32)


_counters: dict[str, PrefixCounter] = {}


def counter(rank_file: str) -> PrefixCounter:
    if rank_file not in _counters:
        _counters[rank_file] = PrefixCounter(rank_file)
    return _counters[rank_file]


def fitting_bytes(table: np.ndarray, raw: bytes, limit: int) -> int:
    """Longest prefix (whole characters, in bytes) with at most ``limit`` tokens."""
    for n in np.flatnonzero(table <= limit)[::-1]:
        if n + 1 == len(raw) or raw[n + 1] & 0xC0 != 0x80:
            return int(n) + 1
    return 0


def counts(docs: DataFrame, rank_file: str, limit: int = LIMIT, keep_prefixes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, fitting_bytes[, prefix_tokens]) per row of ``docs``."""
    ship(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_tokens long, fitting_bytes long" + ", prefix_tokens array<int>" * keep_prefixes

    def run(batches):
        c = counter(rank_file)
        for batch in batches:
            ids = batch.column(0)
            cols: list[list] = [[], [], []]
            kept = []
            for text in batch.column(1):
                text = text.as_py() or ""
                t = c.text(text)
                n = len(t)
                total = int(t[-1]) if n else 0
                cols[0].append(n)
                cols[1].append(total)
                cols[2].append(n if total <= limit else fitting_bytes(t, text.encode(), limit))
                if keep_prefixes:
                    kept.append(t.astype(np.int32))
            arrays = [ids, *(pa.array(x, pa.int64()) for x in cols)]
            names = ["doc_id", "n_bytes", "n_tokens", "fitting_bytes"]
            if keep_prefixes:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def tokens_within(table: DataFrame, n_bytes) -> DataFrame:
    """Budget question on stored prefixes: tokens of the first ``n_bytes`` bytes."""
    n = F.least(F.lit(n_bytes) if isinstance(n_bytes, int) else n_bytes, F.col("n_bytes")).cast("int")
    return table.withColumn("tokens_within", F.when(n <= 0, 0).otherwise(F.try_element_at("prefix_tokens", n)))
