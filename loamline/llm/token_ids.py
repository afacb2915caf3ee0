"""Token ids of whole texts, for counting and packing.

A byte-level vocabulary encodes each pretoken by itself, and a pretoken begins
at every space that a non-space character follows.  So a text is cut before
those spaces and each piece is looked up in a bounded table of pieces already
encoded; only new pieces go through the tokenizer.  The ids are those of the
tokenizer over the whole text.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

from loamline.llm.blocks import release

#: Pieces held at most before the table starts anew; it bounds memory and changes no id.
TABLE = 300_000
SPECIAL = "<|endoftext|>"
_CUT = re.compile(r" (?=\S)")
_LOOSE = re.compile(r" (?=\s|$)")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(text) as little-endian unsigned 32-bit bytes."""

    def __init__(self, json_path: str, table: int = TABLE):
        self.path = json_path
        self.plain = _plain(json_path)
        self.first = _Table(self._encode, "", table)
        self.rest = _Table(self._encode, " ", table)

    @functools.cached_property
    def whole(self):
        """The tokenizer itself; loaded where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _encode(self, piece: str) -> bytes:
        ids = self.plain.encode_ordinary(piece) if self.plain else self.whole.encode(piece, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def forget(self) -> None:
        """Empties the tables, at the end of a task: the process goes on to other stages."""
        self.first.clear()
        self.rest.clear()
        release()

    def ids(self, text: str, special: bool = True) -> bytes:
        """With `special`, the special token's string in a text is that token, as the tokenizer has it; else ordinary text."""
        if special and SPECIAL in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        pieces = text.split(" ") if _LOOSE.search(text) is None else _CUT.split(text)
        return self.first[pieces[0]] + b"".join(map(self.rest.__getitem__, pieces[1:]))


class _Table(dict):
    def __init__(self, encode, lead: str, most: int):
        super().__init__()
        self.encode, self.lead, self.most = encode, lead, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        got = self.encode(self.lead + piece)
        if len(piece) <= 64:
            self[piece] = got
        return got


def _plain(json_path: str):
    """The same vocabulary as ranks, whose encoder is quicker on short pieces; None where there is no such file."""
    import os

    import public_tokenizers
    import tiktoken

    path = re.sub(r"\.json$", ".tiktoken", json_path)
    if path == json_path or not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def encoder(json_path: str) -> Encoder:
    """The process's encoder of a vocabulary."""
    return Encoder(json_path)
