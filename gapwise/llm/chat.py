"""Chat formatting by columnar byte assembly."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

HEAD, MIDDLE, FOOT = b"### ", b": ", b" </turn>\n"
_MARKED = np.zeros(256, bool)
_MARKED[list(b"\\#/:")] = True
#: Texts hold no bare backslash, #, / or colon after escaping, so none of the marks above.
_TURN = re.compile(rb"### ((?:[^\\#/:]++|\\.)*+): ((?:[^\\#/:]++|\\.)*+)/turn>\n", re.DOTALL)
_ESCAPE = re.compile(rb"\\(.)", re.DOTALL)


def column_bytes(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column on end, and where each cell starts (one entry more)."""
    c = pc.fill_null(c.cast(pa.large_binary()), b"")
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
    _, offsets, data = c.buffers()
    off = np.frombuffer(offsets, np.int64)[c.offset : c.offset + len(c) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def escaped(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A backslash before each marked byte; where the cells start then."""
    marked = _MARKED[raw]
    before = np.concatenate(([0], np.cumsum(marked)))
    out = np.full(len(raw) + before[-1], ord("\\"), np.uint8)
    out[np.arange(len(raw)) + before[1:]] = raw
    return out, off + before[off]


def scatter(out: np.ndarray, to: np.ndarray, raw: np.ndarray, off: np.ndarray) -> None:
    """Copy cell i of ``raw`` to ``out[to[i]:]``."""
    size = np.diff(off)
    out[np.repeat(to - off[:-1], size) + np.arange(len(raw))] = raw


def assemble(t: pa.Table, conv: str) -> pa.RecordBatch:
    """One row for each run of equal ids of ``t``."""
    n = t.num_rows
    role, role_off = escaped(*column_bytes(t.column("role")))
    text, text_off = escaped(*column_bytes(t.column("text")))
    role_n, text_n = np.diff(role_off), np.diff(text_off)
    size = len(HEAD) + role_n + len(MIDDLE) + text_n + len(FOOT)
    start = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(start[-1], np.uint8)
    at = start[:-1].copy()
    for fixed, n_after in ((HEAD, role_n), (MIDDLE, text_n), (FOOT, None)):
        out[at[:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
        at += len(fixed)
        if n_after is not None:
            scatter(out, at, role if fixed is HEAD else text, role_off if fixed is HEAD else text_off)
            if fixed is MIDDLE:
                text_at = at.copy()
            at += n_after
    ids = t.column(conv).combine_chunks() if isinstance(t.column(conv), pa.ChunkedArray) else t.column(conv)
    codes = ids.dictionary_encode("encode").indices.to_numpy()
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    bounds = np.append(first, n)
    conv_start = start[bounds]
    formatted = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(conv_start.astype(np.int64)), pa.py_buffer(out)])
    lossy = pc.fill_null(pc.equal(t.column("role"), "assistant"), False)
    lossy = np.flatnonzero(lossy.to_numpy(zero_copy_only=False) if isinstance(lossy, pa.Array) else lossy.to_numpy())
    group = np.searchsorted(bounds, lossy, "right") - 1
    spans = np.searchsorted(group, np.arange(len(first) + 1)).astype(np.int32)
    begin = text_at[lossy] - conv_start[group]
    lists = [pa.ListArray.from_arrays(pa.array(spans), pa.array(x)) for x in (begin, begin + text_n[lossy])]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(np.diff(bounds)), formatted.cast(pa.binary()) if start[-1] < 2**31 else formatted, *lists], [conv, "n_turns", "formatted", "loss_starts", "loss_ends"])


def format_conversations(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Each conversation as one UTF-8 string with its loss spans.

    A turn is ``### role: text </turn>`` and a line feed, with a backslash put
    before each ``\\``, ``#``, ``/`` and ``:`` of role and text, so that the
    marks cannot occur inside. Rows are put in order of turn, then role, then
    text, null turns first; a null role or text is empty; rows with a null id
    are a conversation of their own; repeated rows stay. Only conv, turn, role
    and text are read. No rows give none.

    Returns the id, n_turns, formatted (binary), loss_starts and loss_ends: byte
    spans of the escaped texts of turns whose role is ``assistant``. The rows of
    one conversation stream through its task in batches; what must fit in
    memory is its own string.
    """
    base.ship(turns.sparkSession)
    kind = dict(turns.select(conv).dtypes)[conv]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0)
            last, n = ids[-1], b.num_rows
            if held and not (held[-1].column(0)[-1] == ids[0] or not (held[-1].column(0)[-1].is_valid or ids[0].is_valid)):
                yield assemble(pa.Table.from_batches(held), conv)
                held = []
            same = pc.is_null(ids) if not last.is_valid else pc.fill_null(pc.equal(ids, last), False)
            at = n - int(np.count_nonzero(same.to_numpy(zero_copy_only=False)))
            if at:
                yield assemble(pa.Table.from_batches([*held, b.slice(0, at)]), conv)
                held = []
            held.append(b.slice(at))
        if held:
            yield assemble(pa.Table.from_batches(held), conv)

    dealt = turns.select(conv, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition(conv).sortWithinPartitions(conv, "turn", "role", "text")
    return dealt.select(conv, "role", "text").mapInArrow(run, f"`{conv}` {kind}, n_turns long, formatted binary, loss_starts array<long>, loss_ends array<long>")


def unescape(x: bytes) -> bytes:
    return _ESCAPE.sub(rb"\1", x) if b"\\" in x else x


def parse(formatted: bytes) -> list[tuple[str, str]]:
    """(role, text) of each turn; raises ValueError if the string isn't of the template."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None or not m[2].endswith(b" <"):
            raise ValueError(f"no turn at byte {at}")
        out.append((unescape(m[1]).decode(), unescape(m[2][:-2]).decode()))
        at = m.end()
    return out


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what the formatted strings and their loss spans hold."""
    base.ship(formatted.sparkSession)
    kind = dict(formatted.select(conv).dtypes)[conv]

    def run(batches):
        for b in batches:
            out = []
            for x, starts, ends in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                turns = parse(x)
                loss = b"".join(unescape(x[s:e]) for s, e in zip(starts, ends))
                all_turns = "".join(f"{r}\n{t}\n" for r, t in turns).encode()
                out.append((len(turns), hashlib.sha256(all_turns).hexdigest(), len(loss.decode()), hashlib.sha256(loss).hexdigest(), len(x.decode())))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(conv, "formatted", "loss_starts", "loss_ends").mapInArrow(run, f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
