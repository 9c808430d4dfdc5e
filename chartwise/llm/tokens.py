"""Token ids of whole texts for the byte-level vocabularies, cached per Python worker.

``ids_of`` gives what the ``tokenizers`` library gives for the .json
vocabulary. Texts whose characters all lie below U+0250 go through the
rank file of the same vocabulary, which is several times faster and was
found equal on every such character; all other texts go through the
library itself.
"""

from __future__ import annotations

import base64
import re

import numpy as np

END = "<|endoftext|>"
END_ID = 50256
_wide = re.compile("[^\x00-ɏ]")
_loaded: dict = {}


def ranks_of(rank_file: str) -> dict[bytes, int]:
    if rank_file not in _loaded:
        with open(rank_file, "rb") as f:
            _loaded[rank_file] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return _loaded[rank_file]


def fast(rank_file: str):
    """tiktoken coder with the end-of-text string as a special token."""
    key = ("fast", rank_file)
    if key not in _loaded:
        import public_tokenizers
        import tiktoken

        _loaded[key] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                         mergeable_ranks=ranks_of(rank_file), special_tokens={END: END_ID})
    return _loaded[key]


def library(json_file: str):
    key = ("library", json_file)
    if key not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[key] = Tokenizer.from_file(json_file)
    return _loaded[key]


def beyond_ranks(text: str) -> bool:
    """Whether ``text`` has characters that need the library itself."""
    return _wide.search(text) is not None


def ids_of(text: str | None, json_file: str, rank_file: str) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    if beyond_ranks(text):
        return np.asarray(library(json_file).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    return fast(rank_file).encode_to_numpy(text, allowed_special="all")
