"""Byte-level BPE encoding and decoding with the tiktoken library."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import base

#: A letter or digit before an ASCII character that is neither. The pattern's
#: matches never run over such a place: its runs of letters and of digits end
#: there, no run of other characters or white space holds a letter or digit,
#: and the contractions end with a letter.
SAFE = re.compile(r"[^\W_](?=[\n\r\t -/:-@\[-`{-~])")
LONG = 1 << 18
#: White space as the pattern's ``\\s`` has it (the Unicode property).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space so long that the library's pattern engine, which backtracks over it, may end the process.
RUN = re.compile(f"[{WHITE}]{{{1 << 16},}}")


@lru_cache(2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


base.cache("bpe", lambda: encoding.cache_info().currsize, encoding.cache_clear)


def safe_pieces(text: str, size: int = LONG) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut only where the pattern always splits.

    A text without such a place past ``size`` (one unbroken run) is one piece.
    """
    at = 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size - 1)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def encode(enc, text: str, size: int = LONG) -> np.ndarray:
    """Ids of a whole text. The pattern takes a run of white space but for its last character, if text follows, as one match.

    Long runs are therefore cut out and given to the merges as the matches that
    they are; an unbroken run of anything else is one match of the library's own.
    """
    if len(text) <= size:
        return np.array(enc.encode_ordinary(text), "<u4")
    out = []
    for p in safe_pieces(text, size):
        at = 0
        for m in RUN.finditer(p):
            end = m.end() if m.end() == len(p) else m.end() - 1
            out.append(np.array(enc.encode_ordinary(p[at : m.start()]), "<u4"))
            out.append(np.array(enc._encode_single_piece(p[m.start() : end]), "<u4"))
            at = end
        out.append(np.array(enc.encode_ordinary(p[at:]), "<u4"))
    return np.concatenate(out)


def decode(enc, ids: np.ndarray, most: int = 1 << 20) -> bytes:
    return b"".join(enc.decode_bytes(ids[at : at + most].tolist()) for at in range(0, len(ids), most))


OUT = "n_tokens long, ids binary, decoded binary"


def transcode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = LONG) -> DataFrame:
    """Encode whole texts and decode the ids again.

    Returns ``id_col``, n_tokens, ids (little-endian unsigned 32-bit integers in
    one binary) and decoded (the bytes that the ids stand for). Each match of
    ``pattern`` is encoded by itself, no text is a special token. A null or
    empty text has no tokens and empty binaries; an id may be null or repeat,
    each row is encoded on its own. A text of any length is encoded whole, also
    one unbroken run of letters or white space. No rows give none. Other columns
    are ignored.
    ``path`` is a rank file that every executor can open.
    """
    base.ship(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches):
        base.claim("bpe")
        enc = encoding(path, pattern)
        for b in base.slices(batches, text_col, 8 << 20):
            n, ids, raw = [], [], []
            for t in base.strings(b.column(1)):
                x = encode(enc, t, size)
                n.append(len(x))
                ids.append(x.tobytes())
                raw.append(decode(enc, x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(raw, pa.binary())], [id_col, "n_tokens", "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {OUT}")
