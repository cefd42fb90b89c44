"""Token ids of a byte-level BPE vocabulary.

The vocabulary file is a parameter. Where the same vocabulary lies beside it as a rank file, texts
of Latin letters go through the rank encoder, which gives the same ids several times faster; the
tests compare the two on every such character. All other texts go through the vocabulary's own
tokenizer, and so do texts that hold an added token of the vocabulary, which has an id of its own.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
#: Ids that a vocabulary may have beyond its ranks.
SPECIAL = 256
#: Characters on which both encoders are known to split alike.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa0-\xac\xae-ɏ]*")


class Encoder:
    """``dtype``: two bytes for each id where ids fit (a larger id raises an error)."""

    def __init__(self, path: str):
        self.path, self.fast, self.added = path, None, None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                pairs = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})
            with open(path, encoding="utf-8") as vocabulary:
                added = [t["content"] for t in json.load(vocabulary).get("added_tokens") or []]
            self.added = re.compile("|".join(map(re.escape, added))) if added else None
            size = len(pairs) + SPECIAL
        else:
            size = self.slow.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    @functools.cached_property
    def slow(self):
        """The vocabulary's own tokenizer; most workers never need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and _PLAIN.fullmatch(text) and not (self.added and self.added.search(text)):
            return np.array(self.fast.encode_ordinary(text), dtype=self.dtype)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=self.dtype)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
