"""Byte-level BPE ids of whole texts: the compiled encoder, and the prefix programme where that has no stack left."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import tiktoken

from siftline.llm import bpe

#: Characters of white space in a row from which the compiled encoder's pattern may run out of stack.
LONG_SPACE = 1 << 16

_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")


class ByteEncoder:
    """Ids of a text under a byte-level tokenizer definition.

    With ``specials`` the special tokens' strings in a text are those tokens, else ordinary text.
    """

    def __init__(self, definition: str, specials: bool) -> None:
        spec, letters = json.loads(definition), bpe.byte_letters()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        ranks = {
            bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added
        }
        self._specials = specials
        self._compiled = tiktoken.Encoding(
            "byte-level",
            # the vocabulary's pattern; runs with nothing behind them need no way back
            pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+",
            mergeable_ranks=ranks,
            special_tokens=added if specials else {},
        )
        self._definition = definition if specials else json.dumps(spec | {"added_tokens": []})
        #: The bytes of every token.
        self.raw = np.full(max([*ranks.values(), *added.values()]) + 1, b"", object)
        for token, i in [*ranks.items(), *((content.encode(), i) for content, i in added.items())]:
            self.raw[i] = token

    @functools.cached_property
    def _programme(self) -> bpe.Encoder:
        return bpe.Encoder(bpe.Vocabulary(self._definition))

    def ids(self, text: str) -> list[int]:
        if len(text) >= LONG_SPACE and _LONG_SPACE.search(text):
            return self._programme.encode(text).tolist()
        if self._specials:
            return self._compiled.encode(text, allowed_special="all")
        return self._compiled.encode_ordinary(text)

    def id_array(self, text: str) -> np.ndarray:
        """The ids of :meth:`ids` as an array; with ``specials`` no list of them is made on the way."""
        if self._specials and not (len(text) >= LONG_SPACE and _LONG_SPACE.search(text)):
            try:
                return self._compiled.encode_to_numpy(text, allowed_special="all")
            except UnicodeEncodeError:  # a lone surrogate, which the list's way replaces
                pass
        return np.array(self.ids(text), "<u4")


@functools.lru_cache(maxsize=2)
def encoder(definition: str, specials: bool) -> ByteEncoder:
    return ByteEncoder(definition, specials)
