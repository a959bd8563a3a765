"""Ids of a byte-level BPE file of the tokenizers library, with their byte widths.

The library itself encodes these texts at about 3 MB a second and core. Its ids
are fixed by the file's vocabulary and merges, so they are handed to the
tiktoken core, which gives the same ids four times as fast; the tests hold the
two equal. A file whose ids do not follow its merges is left to the library.

As in the library's plain call, the text of a special token (``<|endoftext|>``)
inside a document is that token.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from . import base, bpe

#: Fixed value: the pattern that the byte-level pre-tokenizer splits by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 bytes stand for themselves, the others follow from U+0100.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        added = spec.get("added_tokens", [])
        special = {t["content"]: t["id"] for t in added}
        plain = not any(t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip"))
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.width = np.zeros(max([*vocab.values(), *special.values()]) + 1, np.int64)
        for t, i in ranks.items():
            self.width[i] = len(t)
        for t, i in special.items():
            self.width[i] = len(t.encode())
        self.special = special
        longest_first = sorted(special, key=lambda t: (-len(t), t))
        self.split = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if special else None
        if usual and plain and merged == sorted(merged) and len(ranks) == 256 + len(merged):
            import tiktoken

            self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.core = None
            self.tokenizer = Tokenizer.from_file(path)

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers, as the library's ``encode`` without special tokens added."""
        if self.core is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if self.split is None or not self.split.search(text):
            return bpe.encode(self.core, text)
        parts = self.split.split(text)  # texts and, at odd places, special tokens
        return np.concatenate([np.array([self.special[p]], "<u4") if k % 2 else bpe.encode(self.core, p) for k, p in enumerate(parts)])


@lru_cache(2)
def ids(path: str) -> Ids:
    return Ids(path)


base.cache("ids", lambda: ids.cache_info().currsize, ids.cache_clear)
