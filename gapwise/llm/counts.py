"""Token counts of sections by offset-mapped attribution."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import base
from .ids import ids as ids_of

#: A section is a line with the line feed that ends it.
SECTION = re.compile(rb"[^\n]*\n|[^\n]+")

RULES = ("start", "end", "most")


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary); spans are given by their ends, both cover the text.

    A token that crosses boundaries goes whole to one section: by ``start`` to
    that of its first byte, by ``end`` to that of its last, by ``most`` to that
    which holds the most of its bytes (the first of equals).
    """
    starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    if rule == "start":
        to = first
    elif rule == "end":
        to = last
    else:
        to = first.copy()
        begins = np.concatenate(([0], section_ends[:-1])) if len(section_ends) else section_ends
        for t in np.flatnonzero(first != last):
            s = np.arange(first[t], last[t] + 1)
            to[t] = s[np.argmax(np.minimum(section_ends[s], token_ends[t]) - np.maximum(begins[s], starts[t]))]
    return to, first != last


def section_counts(docs: DataFrame, path: str, rule: str = "start", section: re.Pattern = SECTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each section of each whole document.

    A document is encoded once, as a whole, by the tokenizers file ``path``;
    its tokens' spans are joined to the sections' spans (two sorted lists of
    ends) and each token counts in one section, by ``rule`` where it crosses a
    boundary. Sections are the matches of ``section`` in the UTF-8 text, what
    lies between matches is a section too: by default lines with their line feed.

    Returns per section: id, section (from 0), char_start, char_end (code
    points; a section inside a character starts after it), n_tokens, n_crossing
    (tokens counted here that reach into another section). The counts of a
    document add up to its tokens. A null or empty text has one section without
    tokens. Rows are counted one by one; ids may be null or repeat. No rows give
    none. Other columns are ignored, whatever their names.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    base.ship(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches):
        base.claim("ids")
        enc = ids_of(path)
        for b in base.slices(batches, text_col, 4 << 20):
            parts = [[] for _ in range(5)]
            rows = []
            for k, text in enumerate(base.strings(b.column(1))):
                raw = text.encode()
                bounds = {e for m in section.finditer(raw) for e in m.span()} | {len(raw)}
                ends = np.array(sorted(bounds - {0}) or [0], np.int64)
                to, crosses = attribute(np.cumsum(enc.width[enc.encode(text)]), ends, rule)
                chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))[ends]
                n = len(ends)
                rows.append(np.full(n, k))
                for p, x in zip(parts, (np.arange(n), np.concatenate(([0], chars[:-1])), chars, np.bincount(to, minlength=n), np.bincount(to[crosses], minlength=n))):
                    p.append(x)
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(rows))), *(pa.array(np.concatenate(p).astype(np.int64)) for p in parts)], [id_col, "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, section long, char_start long, char_end long, n_tokens long, n_crossing long")
