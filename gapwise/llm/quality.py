"""Quality rules over word suffix arrays."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import base

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeat_lengths(ids: np.ndarray) -> np.ndarray:
    """For each position the longest substring from it that occurs elsewhere too.

    Suffix array by prefix doubling, in arrays of 32 bits but for the pairs that
    a round sorts; the longest common prefixes of neighbours (LCP) by Kasai's
    algorithm from the final order alone. A position's neighbours in the array
    bound the LCP intervals that it lies in, so the larger of the two is the
    length of its longest repeat.
    """
    n = len(ids)
    if n < 2:
        return np.zeros(n, np.int32)
    rank = ids.astype(np.int32)  # numbered from 0 without gaps
    k, order = 1, None
    while True:
        if order is None:
            order = np.argsort(rank, kind="stable").astype(np.int32)
        else:
            pair = rank * np.int64(n + 1)
            pair[:-k] += rank[k:] + 1
            order = np.argsort(pair).astype(np.int32)
            new = np.zeros(n, bool)
            new[1:] = pair[order[1:]] != pair[order[:-1]]
            del pair
            rank[order] = np.cumsum(new, dtype=np.int32)
            k *= 2
        if rank[order[-1]] == n - 1 or k >= n:
            break
    return _longest(ids, order)


def _longest(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The larger LCP of each suffix with its two neighbours in ``order``."""
    before = np.full(len(ids), -1, np.int32)
    before[order[1:]] = order[:-1]
    lcp = _plcp(ids, before)
    out = lcp.copy()
    after = np.flatnonzero(before >= 0)
    np.maximum.at(out, before[after], lcp[after])
    return out


def _plcp(ids: np.ndarray, before: np.ndarray) -> np.ndarray:
    """LCP of each position with the one that ``before`` names (none: 0), in text order.

    From a position to the next the LCP falls by one at most (Kasai), and by one
    exactly where the two positions before are neighbours too and hold an equal
    word. Only elsewhere is the match measured; those sum up to O(n log n).
    """
    n = len(ids)
    lcp = np.zeros(n, np.int32)
    irreducible = np.ones(n, bool)
    i = np.flatnonzero((before[1:] > 0)) + 1
    irreducible[i] = (before[i - 1] != before[i] - 1) | (ids[i - 1] != ids[before[i] - 1])
    # elsewhere the match is that of the position before, less one word
    starts = np.flatnonzero(irreducible)
    lcp[starts] = _match(ids, starts, before[starts])
    run = np.maximum.accumulate(np.where(irreducible, np.arange(n, dtype=np.int32), 0))
    return np.maximum(lcp[run] - (np.arange(n, dtype=np.int32) - run), 0)


def _match(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the matches of the texts at ``a`` and at ``b`` (-1: none): all pairs word by word, long ones then in growing steps."""
    n = len(ids)
    out = np.zeros(len(a), np.int32)
    live = np.flatnonzero(b >= 0)
    for at in range(32):
        x, y = a[live] + at, b[live] + at
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[ids[x] == ids[y]]
        out[live] = at + 1
        if not len(live):
            return out
    for k in live.tolist():
        x, y, step, at = int(a[k]), int(b[k]), 64, 32
        while True:
            m = min(step, n - x - at, n - y - at)
            if m <= 0:
                break
            differ = ids[x + at : x + at + m] != ids[y + at : y + at + m]
            j = int(differ.argmax())
            if differ[j]:
                at += j
                break
            at += m
            step = min(2 * step, 1 << 16)
        out[k] = at
    return out


def covered(lengths: np.ndarray, least: int) -> int:
    """Positions in the union of the repeats that are at least ``least`` long."""
    n = len(lengths)
    at = np.flatnonzero(lengths >= least)
    if not len(at):
        return 0
    edge = np.zeros(n + 1, np.int64)
    edge[at] += 1
    np.subtract.at(edge, at + lengths[at], 1)
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def word_numbers(raw: bytes, size: int = 1 << 20) -> np.ndarray:
    """The words of a text, equal ones with equal numbers from 0 on; split in parts of about ``size`` bytes."""
    seen: dict[bytes, int] = {}
    out, at = [], 0
    while at < len(raw):
        m = _BLANK.search(raw, at + size)
        to = m.start() if m else len(raw)
        out.append(np.array([seen.setdefault(w, len(seen)) for w in raw[at:to].split()], np.int32))
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def measure(raw: bytes, window: int, least: int) -> tuple[int, int, int, int, int, int, int]:
    b = np.frombuffer(raw, np.uint8)
    space = _SPACE[b]
    ids = word_numbers(raw)
    chars = int(np.count_nonzero(((b & 0xC0) != 0x80) & ~space))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    lengths = repeat_lengths(ids)
    return len(ids), chars, int(np.count_nonzero(_SYMBOL[b])), len(lines) - len(set(lines)), covered(lengths, window), covered(lengths, least), int(lengths.max(initial=0))


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, window: int = 5, max_window_percent: int = 20, min_repeat: int = 10, max_covered: float = 0.15, max_longest: int = 50) -> DataFrame:
    """Measures of each whole text, and whether it is kept.

    Words are runs of anything but space, tab, LF, VT, FF and CR. base_failed:
    fewer than ``min_words`` words, or over ``max_window_percent`` % of the words
    in repeats of at least ``window`` words. kept: base did not fail, repeats of
    at least ``min_repeat`` words cover at most ``max_covered`` of the words, and
    the longest repeat (a passage and its copy, which may overlap) has at most
    ``max_longest`` words. ``max_covered`` is below the base limit, which no row
    past the base could exceed with its longer repeats alone. A null, empty or blank text has zeros, fails the base
    and is not kept. Each row is measured on its own, whole; ids may be null or
    repeat. No rows give none. Other columns are ignored.
    """
    base.ship(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches):
        for b in base.slices(batches, text_col, 8 << 20):
            m = np.array([measure(t, window, min_repeat) for t in base.utf8(b.column(1))], np.int64).reshape(-1, 7)
            n, repeat, cover, longest = m[:, 0], m[:, 4], m[:, 5], m[:, 6]
            failed = (n < min_words) | (100 * repeat > max_window_percent * n)
            kept = ~failed & (cover <= max_covered * n) & (longest <= max_longest)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[:, i]) for i in range(7)), pa.array(failed), pa.array(kept)], [id_col, *NAMES, "base_failed", "kept"])

    fields = ", ".join(f"{x} long" for x in NAMES)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {fields}, base_failed boolean, kept boolean")
