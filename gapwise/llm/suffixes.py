"""Removal of repeated passages by a logarithmic family of suffix arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .base import mix

#: Any passage of the least length holds an anchor: the least of its GRAM-grams by hash.
GRAM = 24
#: A key with more contexts is split by the content around it.
HOT = 20_000
#: Passages that are looked up in a broadcast: the most frequent ones, at most so many rows.
TOP = 4_096
BATCH = 16_384
BLOCKS = 4
#: Contexts that a task looks at together; their keys are never split, so HOT more at most.
UNIT = 65_536

_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` bytes from each position on; the last n - 1 are of no use."""
    out, have, h, k = None, 0, _VALUE[data], 1
    while True:
        factor = np.uint64(pow(_STEP, k, 2**64))
        if n & k:
            if out is None:
                out = h.copy()
            else:
                out[: len(out) - have] = out[: len(out) - have] * factor + h[have:]
            have += k
        if have == n:
            return mix(out)
        h[: max(0, len(h) - k)] = h[: max(0, len(h) - k)] * factor + h[k:]
        k *= 2


def window_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbours."""
    k = 1
    while 2 * k <= n:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, key) of each anchor of ``texts``, which hold under 2^24 bytes, or are one text.

    Each ``length`` bytes of a text have the least of their GRAM-grams (the first
    of equals) as an anchor, by content alone, so equal passages have anchors at
    equal places.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64),)
    keys = gram_hashes(data, GRAM)
    ends = np.cumsum(size)
    hits, span = [], 1 << 23
    for a in range(0, len(data) - length + 1, span):  # in parts, for texts over 2^24 bytes
        part = keys[a : a + span + length - GRAM]
        packed = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        least = (window_least(packed, length - GRAM + 1) & _LOW).astype(np.int64) + a
        least = least[: len(data) - length + 1 - a]
        start = np.arange(a, a + len(least))
        inside = start + length <= ends[np.searchsorted(ends, start, "right")]
        hits.append(least[inside])
    at = np.concatenate(hits)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    text = np.searchsorted(ends, at, "right")
    return text, at - (ends - size)[text], keys[at].view(np.int64)


def _keys(rows: np.ndarray, n: np.ndarray, *first: np.ndarray) -> np.ndarray:
    """Rows as strings that sort like texts of ``n`` bytes: the zeros behind the end, then n, so that an end comes first."""
    m = np.concatenate([*(x[:, None].astype(np.uint8) for x in first), rows, n[:, None].astype(np.uint8)], axis=1)
    return np.ascontiguousarray(m).view(f"S{m.shape[1]}").ravel()


def _cells(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.uint8).reshape(len(keys), keys.dtype.itemsize)


def _common(a: np.ndarray, b: np.ndarray, head: int) -> np.ndarray:
    """Common prefixes of texts by the cells of their keys; -1 if the ``head`` differs."""
    same = a[:, :-1] == b[:, :-1]
    lcp = np.where(same.all(1), same.shape[1], same.argmin(1)) - head
    return np.minimum(lcp, np.minimum(a[:, -1], b[:, -1]).astype(np.int64))


class Contexts:
    """Anchors in document order: the bytes right of each, and left of each read backwards, to ``length``.

    ``low`` to ``high`` are the bytes left of the anchor at which a passage may
    start. Contexts of different ``block`` never match.
    """

    def __init__(self, right, left, n_right, n_left, low, high, block=None):
        self.low, self.high = low, high
        self.right = _keys(right, n_right, np.zeros(len(low), np.uint8) if block is None else block)
        self.left = _keys(left, n_left)

    def __len__(self) -> int:
        return len(self.low)

    @classmethod
    def of(cls, contexts: list[bytes], n_left: np.ndarray, low: np.ndarray, high: np.ndarray, block: np.ndarray, length: int) -> Contexts:
        n, size = len(contexts), np.array([len(c) for c in contexts])
        data = np.frombuffer(b"".join(contexts) + bytes(1), np.uint8)
        middle = np.cumsum(size) - size + n_left
        n_right = size - n_left
        span = np.arange(length)
        take = lambda at, ok: np.where(ok, data[np.where(ok, at, 0)], 0).astype(np.uint8)
        right = take(middle[:, None] + span, span < n_right[:, None])
        left = take(middle[:, None] - 1 - span[: length - GRAM], span[: length - GRAM] < n_left[:, None])
        return cls(right.reshape(n, length), left.reshape(n, length - GRAM), n_right, n_left, low, high, block)


def _range_counts(across: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For each bit of the values, high to low: zeros before each place, and zeros in all; values go on sorted by that bit."""
    out, v = [], across.astype(np.int32)
    for bit in range(len(across).bit_length() - 1, -1, -1):
        zero = (v >> bit) & 1 == 0
        out.append((np.concatenate(([0], np.cumsum(zero))).astype(np.int32), int(zero.sum())))
        v = np.concatenate((v[zero], v[~zero]))
    return out


class Level:
    """Suffix arrays of some contexts: right sides and reversed left sides, each sorted, and for each right side the place of its left one."""

    def __init__(self, right: np.ndarray, left: np.ndarray, across: np.ndarray):
        self.right, self.left, self.across = right, left, across
        self._counts: list | None = None

    def __len__(self) -> int:
        return len(self.right)

    def merge(self, other: Level) -> Level:
        """One level of both, by merging the sorted arrays."""
        n = len(self) + len(other)

        def places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at_b = np.searchsorted(a, b, "right") + np.arange(len(b))
            of_a = np.ones(n, bool)
            of_a[at_b] = False
            at_a = np.flatnonzero(of_a)
            keys = np.empty(n, a.dtype)
            keys[at_a], keys[at_b] = a, b
            return keys, at_a, at_b

        right, ra, rb = places(self.right, other.right)
        left, la, lb = places(self.left, other.left)
        across = np.empty(n, np.int64)
        across[ra], across[rb] = la[self.across], lb[other.across]
        return Level(right, left, across)

    def longest(self, keys: np.ndarray, own: np.ndarray, head: int) -> np.ndarray:
        """The longest prefix that each of ``keys`` shares with a row of the sorted ``own``: with a neighbour of its place."""
        at, cells, rows = np.searchsorted(own, keys), _cells(keys), _cells(own)
        return np.maximum(_common(cells, rows[np.maximum(at - 1, 0)], head), _common(cells, rows[np.minimum(at, len(own) - 1)], head))

    @staticmethod
    def _interval(own: np.ndarray, keys: np.ndarray, depth: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray]:
        """The LCP interval in ``own`` of the first ``depth`` bytes of each of ``keys``."""
        low, high = _cells(keys).copy(), _cells(keys).copy()
        behind = np.arange(low.shape[1]) >= depth[:, None] + head
        low[behind], high[behind] = 0, 255
        low[:, -1] = depth
        kind = own.dtype
        return np.searchsorted(own, low.view(kind).ravel(), "left"), np.searchsorted(own, high.view(kind).ravel(), "right")

    def _less(self, a: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many of across[a:b] are less than y."""
        n, bits = np.zeros(len(a), np.int64), len(self.across).bit_length()
        for k, (zeros, all_zeros) in enumerate(self._counts):
            za, zb = zeros[a], zeros[b]
            one = (y >> (bits - 1 - k)) & 1 == 1
            n += np.where(one, zb - za, 0)
            a, b = np.where(one, a - za + all_zeros, za), np.where(one, b - zb + all_zeros, zb)
        return n

    def holds(self, batch: Contexts, who: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
        """Whether a context here shares length - j bytes to the right and j to the left with each of ``who``."""
        if self._counts is None:
            self._counts = _range_counts(self.across)
        a, b = self._interval(self.right, batch.right[who], length - j, 1)
        x, y = self._interval(self.left, batch.left[who], j, 0)
        some = np.flatnonzero((a < b) & (x < y))
        out = np.zeros(len(who), bool)
        a, b = a[some], b[some]
        out[some] = self._less(a, b, y[some]) > self._less(a, b, x[some])
        return out

    def scan(self, batch: Contexts, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and most start of a passage of each of ``batch`` that occurs here; (length, -1): there is none."""
        least, most = np.full(len(batch), length), np.full(len(batch), -1)
        first = np.maximum(batch.low, length - self.longest(batch.right, self.right, 1))
        last = np.minimum(batch.high, self.longest(batch.left, self.left, 0))
        who = np.flatnonzero(first <= last)
        at = first[who]
        while len(who):  # the least start, from below
            found = self.holds(batch, who, at, length)
            least[who[found]] = at[found]
            on = ~found & (at < last[who])
            who, at = who[on], at[on] + 1
        who = np.flatnonzero(least < length)
        at = last[who]
        while len(who):  # the most, from above; at the least one it ends
            found = self.holds(batch, who, at, length)
            most[who[found]] = at[found]
            who, at = who[~found], at[~found] - 1
        return least, most


def repeats(batch: Contexts, length: int) -> tuple[np.ndarray, np.ndarray, Level]:
    """The least and most bytes left of the anchor at which a passage starts that an earlier one of ``batch`` has, and its suffix arrays.

    A passage of ``length`` bytes that starts j bytes left of its anchor is
    given by its LCP interval of depth length - j in the suffix array of the
    right sides and that of depth j in the array of the reversed left sides. Of
    the contexts in the same two intervals all but the first are repeats.
    (length, -1): there is none.
    """
    n = len(batch)
    least, most = np.full(n, length), np.full(n, -1)
    ro, lo = np.argsort(batch.right, kind="stable"), np.argsort(batch.left, kind="stable")
    place = np.empty(n, np.int64)
    place[lo] = np.arange(n)
    level = Level(batch.right[ro], batch.left[lo], place[ro])
    if n > 1:
        rows, sides = _cells(level.right), _cells(level.left)
        rl, ll = _common(rows[1:], rows[:-1], 1), _common(sides[1:], sides[:-1], 0)
        bits = np.uint64(int(n).bit_length())
        by_right, by_left = np.empty(n, np.uint64), np.empty(n, np.uint64)
        for j in range(length - GRAM + 1):
            v = np.flatnonzero((batch.low <= j) & (j <= batch.high))
            if len(v) < 2:
                continue
            by_right[ro] = np.concatenate(([0], np.cumsum(rl < length - j))).astype(np.uint64)
            by_left[lo] = np.concatenate(([0], np.cumsum(ll < j))).astype(np.uint64)
            pair = (by_left[v] << bits) | by_right[v]
            if 3 * int(bits) <= 64:
                x = np.sort((pair << bits) | v.astype(np.uint64))
                again = x[1:][(x[1:] >> bits) == (x[:-1] >> bits)] & ((np.uint64(1) << bits) - np.uint64(1))
                again = again.astype(np.int64)
            else:  # the index does not fit beside the pair
                order = np.argsort(pair, kind="stable")
                x = pair[order]
                again = v[order[1:][x[1:] == x[:-1]]]
            most[again] = j
            least[again] = np.minimum(least[again], j)
    return least, most, level


class Family:
    """Levels of suffix arrays, oldest and largest first; equal-sized levels merge.

    A batch is sorted once. Against each level it is merge-scanned: its rows
    find their places in the level's sorted arrays by binary search, never all
    rows of the level. ``touched`` counts rows sorted, scanned and merged: for N
    contexts it grows as N log N.
    """

    def __init__(self, length: int):
        self.length, self.levels, self.touched = length, [], 0

    def add(self, batch: Contexts) -> tuple[np.ndarray, np.ndarray]:
        """Scan a batch, all of it later than what the levels hold, against itself and each level; then keep it."""
        least, most, own = repeats(batch, self.length)
        self.touched += len(batch) * (1 + len(self.levels))
        for _, level in self.levels:
            x, y = level.scan(batch, self.length)
            least, most = np.minimum(least, x), np.maximum(most, y)
        self.levels.append((0, own))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (_, b), (rank, a) = self.levels.pop(), self.levels.pop()
            self.touched += len(a) + len(b)
            self.levels.append((rank + 1, a.merge(b)))
        return least, most


def _hash_span(h64: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` bytes, 64 to 128, from ``at`` on."""
    return mix(mix(h64[at]) + h64[at + size - 64])


def _blocks(length: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, length - GRAM + 1, BLOCKS + 1).astype(int)
    return [(int(a), int(b) - 1) for a, b in zip(edges[:-1], edges[1:])]


ROW = "route long, none boolean, id {kind}, row long, pos long, n_left long, low long, high long, context binary"


def _emit(length: int, hot: bool):
    """Contexts of the listed anchors, routed by their key or, if ``hot``, by the core of each block of starts.

    ``low`` has the number of the block, from 1, above its eight bits.
    """

    def run(batches):
        base.claim("suffixes")
        for b in base.slices(batches, "text", 1 << 20):
            rows, cols, ctx = [], [[] for _ in range(5)], []
            for k, (raw, asks) in enumerate(zip(base.utf8(b.column(3)), b.column(4))):
                pos = np.sort(asks.values.to_numpy())
                a, z = np.maximum(0, pos - (length - GRAM)), np.minimum(len(raw), pos + length)
                lo, hi = np.maximum(0, length - (len(raw) - pos)), np.minimum(length - GRAM, pos)
                if hot:
                    h64 = gram_hashes(np.frombuffer(raw, np.uint8), 64)
                    parts = []
                    for k_block, (j0, j1) in enumerate(_blocks(length), 1):
                        at = np.flatnonzero((np.maximum(lo, j0) <= np.minimum(hi, j1)))
                        core = _hash_span(h64, pos[at] - j0, length - (j1 - j0)) + np.uint64(j0)
                        parts.append((at, core.view(np.int64), np.maximum(lo[at], j0) | k_block << 8, np.minimum(hi[at], j1)))
                    at, route, low, high = (np.concatenate(x) for x in zip(*parts))
                else:
                    at = np.flatnonzero(lo <= hi)
                    route = np.array([xxhash.xxh64_intdigest(raw[x : x + GRAM]) for x in pos[at].tolist()], np.uint64).view(np.int64)
                    low, high = lo[at], hi[at]
                rows.append(np.full(len(at), k))
                for c, x in zip(cols, (route, pos[at], pos[at] - a[at], low, high)):
                    c.append(x)
                ctx.extend(raw[x:y] for x, y in zip(a[at].tolist(), z[at].tolist()))
            if rows:
                t = b.select(["none", "id", "row"]).take(pa.array(np.concatenate(rows)))
                route, pos, n_left, low, high = (pa.array(np.concatenate(c).astype(np.int64)) for c in cols)
                yield pa.RecordBatch.from_arrays([route, *t.columns, pos, n_left, low, high, pa.array(ctx, pa.binary())], ["route", "none", "id", "row", "pos", "n_left", "low", "high", "context"])

    return run


def repeated_spans(docs: DataFrame, length: int, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents by row, rows of first texts, (row, start, end) of repeated passages); see ``remove_repeats``."""
    base.ship(docs.sparkSession)
    i, t = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    more = [f"c{k}" for k in range(len(carry))]
    own = docs.select(i.alias("id"), F.xxhash64(i, t).alias("row"), t.alias("text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)])
    kind = dict(own.dtypes)["id"]
    held = own.repartition("row")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    firsts = own.groupBy(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2")).agg(F.min(place).alias("p"), F.max(F.octet_length("text")).alias("n"))
    firsts = firsts.select("p.row", "n")
    whole = held.join(firsts.where(F.col("n") >= length).hint("shuffle_hash"), "row").select("id", "row", "text", *more)

    def find(batches):
        base.claim("suffixes")
        for b in base.slices(batches, "text", 1 << 20):
            text, pos, key = anchors(base.utf8(b.column(1)), length)
            row = b.column(0).take(pa.array(text))
            # 48 bits are enough to drop what occurs once: of 10^12 anchors less than one in a hundred meets another by chance,
            # and contexts are told apart by their bytes
            yield pa.RecordBatch.from_arrays([pa.array(key & ((1 << 48) - 1)), row, pa.array(pos)], ["key", "row", "pos"])

    # all columns, or the id is pruned and the exchange of texts is not the one that the others use
    found = whole.select("row", "text", "id", *more).mapInArrow(find, "key long, row long, pos long")
    # the complement is a key that the counts are not dealt by: both sides come from exchanges of their own, of which AQE can split a hot key's
    shared = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.bitwise_not("key").alias("other"), (F.col("n") > HOT).alias("hot"))
    asks = found.join(shared, F.bitwise_not("key") == F.col("other")).groupBy("row", "hot").agg(F.collect_set("pos").alias("asks"))

    def contexts(hot: bool) -> DataFrame:
        some = whole.join(asks.where(F.col("hot") == hot).select("row", "asks").hint("shuffle_hash"), "row")
        return some.select(F.col("id").isNull().alias("none"), "id", "row", "text", "asks", *more).mapInArrow(_emit(length, hot), ROW.format(kind=kind))

    # hot keys: only cores that occur twice go on, and the hot ones of them as single passages
    split = contexts(True)
    cores = split.groupBy("route").agg(F.count("*").alias("n")).where("n > 1")
    split = split.join(cores, "route")
    usual = contexts(False).unionByName(split.where(F.col("n") <= HOT).drop("n"))

    def unit(t: pa.Table) -> pa.RecordBatch:
        """Repeated spans among the contexts of whole keys."""
        ids = t.column("id").combine_chunks().dictionary_encode()
        rank = np.argsort(np.argsort(ids.dictionary.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        code = ids.indices.fill_null(0).to_numpy()
        none = t.column("none").to_numpy()
        by_id = np.where(none, len(rank), rank[code] if len(rank) else 0)
        row, pos, low = (t.column(c).to_numpy() for c in ("row", "pos", "low"))
        order = np.lexsort((low, pos, row, by_id))
        twin = (np.diff(row[order]) == 0) & (np.diff(pos[order]) == 0) & (np.diff(low[order]) == 0)
        order = order[np.concatenate(([True], ~twin))]  # rows that repeat id and text
        t = t.take(pa.array(order))
        n_left, low, high, row, pos = (t.column(c).to_numpy() for c in ("n_left", "low", "high", "row", "pos"))
        low, block = low & 255, low >> 8
        context, family, out = t.column("context"), Family(length), []
        for a in range(0, len(row), BATCH):
            s = slice(a, a + BATCH)
            least, most = family.add(Contexts.of(context[s].to_pylist(), n_left[s], low[s], high[s], block[s], length))
            some = most >= 0
            out.append((row[s][some], (pos[s] - most)[some], (pos[s] - least + length)[some]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["row", "start", "end"])

    def shard(batches):
        base.claim("suffixes")
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= UNIT:  # all but the last key, of which more may come
                t = pa.Table.from_batches(held).combine_chunks()
                route = t.column("route").to_numpy()
                to = int(np.searchsorted(route, route[-1]))
                if to:
                    yield unit(t.slice(0, to).combine_chunks())
                    held, n = t.slice(to).combine_chunks().to_batches(), len(route) - to
        if held:
            yield unit(pa.Table.from_batches(held).combine_chunks())

    # sorted by key, so that a task holds a bounded number of contexts however many its shard has
    shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = usual.repartition(shards, "route").sortWithinPartitions("route").mapInArrow(shard, "row long, start long, end long")

    def passages(batches):
        for b in batches:
            low, high, pos, n_left = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("low", "high", "pos", "n_left"))
            context = b.column(b.schema.get_field_index("context")).to_pylist()
            size = np.array([len(c) for c in context])
            if not len(size):
                continue
            low = low & 255
            n = high - low + 1
            at = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at]
            h64 = gram_hashes(np.frombuffer(b"".join(context), np.uint8), 64)
            v = _hash_span(h64, (np.cumsum(size) - size + n_left)[at] - j, length)
            t = b.select(["none", "id", "row"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), *t.columns, pa.array(pos[at] - j)], ["v", "none", "id", "row", "start"])

    single = split.where(F.col("n") > HOT).drop("n").mapInArrow(passages, f"v long, none boolean, id {kind}, row long, start long")
    # the first of a passage by partial aggregation; rows of the most frequent passages find it in a broadcast of at
    # most TOP rows, and only the others are dealt by passage
    place = F.struct("none", "id", "row", "start")
    first = single.groupBy("v").agg(F.min(place).alias("p"), F.count("*").alias("n")).where("n > 1")
    frequent = first.where(F.col("n") > TOP).orderBy(F.desc("n"), "v").limit(TOP)
    rest = single.join(F.broadcast(frequent.select("v")), "v", "left_anti").join(first.select("v", "p"), "v")
    again = single.join(F.broadcast(frequent.select("v", "p")), "v").unionByName(rest)
    again = again.where(place != F.col("p")).select("row", "start", (F.col("start") + length).alias("end"))
    return held, firsts.select("row"), spans.unionByName(again)


def merged(spans: list[int]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, each given as start * 256 + size."""
    starts, ends = [], []
    for x in sorted(spans):
        a, b = x >> 8, (x >> 8) + (x & 255)
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _char_start(raw: bytes, at: int) -> int:
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _char_end(raw: bytes, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """Remove each byte of a ``length``-byte passage that also starts earlier.

    Texts are UTF-8 bytes; earlier is a smaller id (null ids last; texts of equal
    ids by a hash) or an earlier start in the same text; passages are judged on
    the input and do not cross texts. Equal texts enter the index once, for the
    first of them. Every passage has an anchor, placed by content; anchors whose
    key occurs once cannot be in a repeated passage and go no further. The rest
    go, with the bytes around them, to a shard by their key; a task takes whole
    keys, about UNIT contexts at a time, and keeps a logarithmic family of them:
    in document order each batch gets suffix arrays of its contexts (right
    sides, and left sides backwards), is merge-scanned against each level by LCP
    intervals, joins as a level, and equal levels merge their sorted arrays. A
    key with more than HOT contexts is split by the content around the anchor,
    and what is still hot becomes single passages that are grouped by hash, with
    partial aggregation. The TOP most frequent passages are looked up in a
    broadcast, so that none fills a task. Nothing is capped or dropped.

    ``as_text`` gives ``kept`` as text: a character of which a removed run has
    some bytes goes whole, since the others alone are no character.

    ``length`` is 64 + GRAM to 128. Returns per row: id, n_bytes, starts and ends
    (maximal removed runs, in bytes), kept (the other bytes), and the columns named in
    ``carry``. A null text is
    empty. Rows that repeat id and text are one document and get the same
    result. No rows give no rows.
    """
    if not 64 + GRAM <= length <= 128:
        raise ValueError("length must be 88 to 128")
    held, firsts, spans = repeated_spans(docs, length, id_col, text_col, carry)
    kind = dict(held.dtypes)["id"]
    # a span is at most 2 * length bytes: start and size fit one long
    lists = spans.groupBy("row").agg(F.collect_list(F.col("start") * 256 + (F.col("end") - F.col("start"))).alias("spans"))
    # one side for both facts of a row: whether its text is the first, and its spans
    facts = firsts.distinct().withColumn("first", F.lit(True)).join(lists, "row", "left")
    x = held.join(facts.hint("shuffle_hash"), "row", "left").select("id", "text", "first", "spans", *[f"c{k}" for k in range(len(carry))])

    def finish(batches):
        base.claim("suffixes")
        for b in base.slices(batches, "text", 1 << 20):
            n, starts, ends, kept = [], [], [], []
            for raw, first, spans in zip(base.utf8(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if first:
                    s, e = merged(spans or [])
                else:
                    s, e = ([0], [len(raw)]) if len(raw) >= length else ([], [])
                n.append(len(raw))
                starts.append(s)
                ends.append(e)
                if as_text:
                    s, e = [_char_start(raw, x) for x in s], [_char_end(raw, x) for x in e]
                left = b"".join(raw[x:y] for x, y in zip([0, *e], [*s, len(raw)])) if s else raw
                kept.append(left.decode("utf-8") if as_text else left)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.string() if as_text else pa.binary()), *b.columns[4:]], [id_col, "n_bytes", "starts", "ends", "kept", *b.schema.names[4:]])

    kinds = dict(x.dtypes)
    rest = "".join(f", c{k} {kinds[f'c{k}']}" for k in range(len(carry)))
    out = x.mapInArrow(finish, f"`{id_col}` {kind}, n_bytes long, starts array<long>, ends array<long>, kept {'string' if as_text else 'binary'}{rest}")
    return out.select(f"`{id_col}`", "n_bytes", "starts", "ends", "kept", *[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)])


def kept_texts(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what ``remove_repeats`` keeps as their texts, and __cut: whether a text lost anything."""
    rest = tuple(c for c in docs.columns if c not in (id_col, text_col))
    # columns of the result may be named like columns of docs
    apart = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(rest)])
    x = remove_repeats(apart, length, "__id", "__text", tuple(f"__{k}" for k in range(len(rest))), as_text=True)
    named = {id_col: "__id", text_col: "kept"} | {c: f"__{k}" for k, c in enumerate(rest)}
    return x.select(*[F.col(named[c]).alias(c) for c in docs.columns], (F.size("starts") > 0).alias("__cut"))
