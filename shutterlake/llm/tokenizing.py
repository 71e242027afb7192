"""Whole-text encoding with a public byte-level vocabulary, one encoder per Python worker."""

from __future__ import annotations

import base64
import json
import re

import numpy as np

#: Name of the vocabulary within the public tokenizer files; their folder comes from the files' own package.
VOCABULARY = "byte_bpe_50k"
#: Characters on whose classes every regular-expression engine agrees. Other texts take the slower library.
_SETTLED = re.compile("[^\x00-ӿ‐-⁞€、。一-龥]").search
_LOADED: dict[str, "Encoder"] = {}


class Encoder:
    """The ids that `tokenizers` gives with add_special_tokens=False; a special string in a text is its own id, as there.

    Texts of settled characters are encoded by the same vocabulary's faster implementation, which gives the same ids;
    those with a special string are left to the library. A null or empty text has no ids, one of any length is encoded
    whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import public_tokenizers
        import tiktoken

        ranks = {}
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            for line in lines:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self._file = public_tokenizers.path(f"{vocabulary}.json")
        with open(self._file, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        self._fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._whole = None
        #: Bytes of text that each id stands for.
        self.byte_length = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, rank in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.byte_length[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        """Token ids of one whole text, as little-endian unsigned 32-bit numbers."""
        if _SETTLED(text) is None and self._special(text) is None:
            return np.array(self._fast.encode_ordinary(text), "<u4")
        return self.ids_by_library(text)

    def ids_by_library(self, text: str) -> np.ndarray:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._file)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4")


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """This process's encoder."""
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = Encoder(vocabulary)
    return _LOADED[vocabulary]
