"""Near-duplicate documents by fast similarity sketching."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .base import cut, mix
from .graph import components

COORDINATES = 256
_MOST = np.uint64(2**64 - 1)
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Hashes(dict):
    """Word to 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()
base.cache("minhash", lambda: len(_HASHES), _HASHES.clear)


def shingles(raw: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``k`` words of lower-cased ``raw``.

    With fewer words than ``k`` the whole sequence is one; without words, none.
    Two different shingles of a corpus of 10^12 agree with odds of 10^-7 or so.
    """
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([_HASHES[w] for w in words], np.uint64)
    m = min(k, len(h))
    x = mix(h[: len(h) - m + 1] + np.uint64(m))
    for i in range(1, m):
        x = mix(x + h[i : len(h) - m + 1 + i])
    return np.unique(x)


def fast_sketch(u: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of a set of hashes: ``t`` coordinates, all filled.

    Round i puts every element into a bin by its hash and keeps each bin's least
    value, with i as the high bits so that earlier rounds win; in the last t
    rounds round t + j puts all into bin j. It ends when no bin is empty, after
    about t ln t placements. Some rounds are done at once for small sets.
    """
    out, r = np.full(t, _MOST), 0
    while r < 2 * t and (r == 0 or (out == _MOST).any()):
        n = min(2 * t - r, max(1, 1024 // len(u)))
        rounds = np.arange(r, r + n)
        x = mix(u[None, :] ^ _SEEDS[rounds, None])
        bins = np.where(rounds[:, None] < t, ((x & np.uint64(0xFFFF)) * np.uint64(t) >> np.uint64(16)).astype(np.int64), rounds[:, None] - t)
        value = (x >> np.uint64(16)) | (rounds.astype(np.uint64)[:, None] << np.uint64(48))
        np.minimum.at(out, bins.ravel(), value.ravel())
        r += n
    return out


def shape(similarity: float, miss: float = 1e-6, t: int = COORDINATES) -> tuple[int, int]:
    """(rows a band, bands): the most rows at which a pair of ``similarity`` shares no band with odds under ``miss``."""
    return max(((r, t // r) for r in range(1, 17) if (1 - similarity**r) ** (t // r) < miss), default=(1, t))


def most_unlike(similarity: float, t: int = COORDINATES) -> int:
    """Low bits of the sketches that may differ: six standard deviations over what ``similarity`` gives."""
    p = (1 - similarity) / 2
    return int(t * p + 6.1 * math.sqrt(t * p * (1 - p)))


def sketches(docs: DataFrame, k: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(id, row, n, cls, b0..b3, bands): cls is a hash of the set, b* the low bits of the coordinates."""
    base.ship(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    rows, bands = shape(similarity)

    def run(batches):
        base.claim("minhash")
        for b in base.slices(batches, "text", 8 << 20):
            sets = [shingles(t, k) for t in base.utf8(b.column(2))]
            some = np.array([len(s) > 0 for s in sets], bool)
            s = np.array([fast_sketch(x) for x in sets if len(x)]).reshape(-1, COORDINATES).astype(np.uint64)
            low = np.packbits((s & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
            parts = s[:, : rows * bands].reshape(len(s), bands, rows)
            key = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(s), 1))
            for i in range(rows):
                key = mix(key + parts[:, :, i])
            at = np.cumsum(some) - 1
            at = pa.array(np.where(some, at, 0), mask=~some)
            cls = np.array([int.from_bytes(hashlib.md5(x.tobytes()).digest()[:8], "little", signed=True) for x in sets if len(x)], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * bands), pa.array(key.astype(np.uint64).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(cls).take(at), *(pa.array(np.ascontiguousarray(low[:, i])).take(at) for i in range(4)), lists.take(at)], ["id", "row", "n", "cls", "b0", "b1", "b2", "b3", "bands"])

    own = keyed(docs, id_col, text_col)
    return own.mapInArrow(run, f"id {kind}, row long, n long, cls long, b0 long, b1 long, b2 long, b3 long, bands array<long>")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, text): row is a hash of id and text."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(i.alias("id"), F.xxhash64(i, t).alias("row"), t.alias("text"))


def alike(a: str, b: str, similarity: float):
    """Whether two rows' low bits and set sizes allow ``similarity``."""
    unlike = sum((F.bit_count(F.col(f"{a}b{i}").bitwiseXOR(F.col(f"{b}b{i}"))) for i in range(1, 4)), F.bit_count(F.col(f"{a}b0").bitwiseXOR(F.col(f"{b}b0"))))
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return (unlike <= most_unlike(similarity)) & (F.least(n, m) * 100 >= F.greatest(n, m) * math.floor(similarity * 100 - 1e-9))


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, arow, b, brow) whose full sets are alike enough, as (a, b).

    The text of b is fetched first, so that a text that is the a of many pairs
    is not moved with each of them.
    """
    need = pairs.select(F.col("arow").alias("row")).unionAll(pairs.select(F.col("brow").alias("row"))).distinct()
    held = texts.select("row", "text").join(need, "row", "left_semi").dropDuplicates(["row"])
    full = pairs.join(held.select(F.col("row").alias("brow"), F.col("text").alias("btext")), "brow").join(held.select(F.col("row").alias("arow"), F.col("text").alias("atext")), "arow")

    def run(batches):
        last, left = None, None
        for b in base.slices(batches, "btext", 8 << 20):
            keep = []
            for row, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if row != last:
                    last, left = row, shingles(x.encode(), k)
                right = shingles(y.encode(), k)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.select("a", "b", "arow", "atext", "btext").mapInArrow(run, "a long, b long")


#: Buckets up to SMALL are joined with themselves; larger ones go in chunks, and these in blocks.
#: A block is decided by a matrix product if its matrix has at most DENSE cells.
SMALL, CHUNK, BLOCK, DENSE = 48, 1024, 128, 1 << 22


def compare_buckets(rest: DataFrame, texts: DataFrame, k: int, percent: int, unlike: int) -> DataFrame:
    """Links (a, b) between the parts of each bucket; a pair is decided in the first bucket that it shares.

    A bucket's rows are dealt to chunks and each two chunks meet in one task,
    which compares them in blocks and returns one link for two parts at most:
    no pairs are moved, and no task holds more than two chunks.
    """
    held = texts.select("row", "text").join(rest.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    two = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(F.least("chunk", x).alias("i"), F.greatest("chunk", x).alias("j"))))
    dealt = rest.join(held, "row").withColumn("x", two).select("band", "x.i", "x.j", "chunk", "cls", "part", "b0", "b1", "b2", "b3", "bands", "text")

    def compare(key, t):
        t = t.sort_by("cls").combine_chunks()
        band, left, right = (x.as_py() for x in key)
        cls, part, chunk = (t.column(c).to_numpy() for c in ("cls", "part", "chunk"))
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(cls), -1)
        before = bands[:, : int(np.flatnonzero(bands[0] == band)[0])]
        low = np.stack([t.column(f"b{i}").to_numpy() for i in range(4)], 1)
        sets = [shingles(x, k) for x in base.utf8(t.column("text"))]
        size = np.array([len(x) for x in sets])
        rows, cols = np.flatnonzero(chunk == left), np.flatnonzero(chunk == right)
        out = []
        for x in range(0, len(rows), BLOCK):
            for y in range(x if left == right else 0, len(cols), BLOCK):
                a, b = rows[x : x + BLOCK], cols[y : y + BLOCK]
                ok = part[a][:, None] != part[b]
                ok &= np.bitwise_count(low[a][:, None] ^ low[b]).sum(2, dtype=np.int64) <= unlike
                ok &= 100 * np.minimum.outer(size[a], size[b]) >= percent * np.maximum.outer(size[a], size[b])
                ok &= ~(before[a][:, None] == before[b]).any(2)
                u, v = np.nonzero(ok)
                if not len(u):
                    continue
                every, code = np.unique(np.concatenate([sets[i] for i in (*a, *b)]), return_inverse=True)
                if (len(a) + len(b)) * len(every) <= DENSE:
                    of = np.zeros((len(a) + len(b), len(every)), np.float32)
                    of[np.repeat(np.arange(len(of)), np.concatenate((size[a], size[b]))), code] = 1
                    both = np.rint(of[: len(a)] @ of[len(a) :].T)[u, v].astype(np.int64)
                else:
                    both = np.array([len(np.intersect1d(sets[a[i]], sets[b[j]], assume_unique=True)) for i, j in zip(u, v)])
                u, v = a[u], b[v]
                linked = 100 * both >= percent * (size[u] + size[v] - both)
                u, v = u[linked], v[linked]
                if len(u):
                    _, one = np.unique(np.stack((part[u], part[v])), axis=1, return_index=True)
                    out.append(np.stack((cls[u[one]], cls[v[one]])))
        a, b = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("band", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose sets of ``k``-word shingles are at least ``percent`` % alike (Jaccard).

    Words are lower-cased (A-Z only) runs of anything but ASCII white space; with
    fewer than ``k`` words the whole sequence is the one shingle. Equal sets are
    one class from the start. Classes that share a band of their sketches are
    candidates. In each bucket all are compared with the class that the largest
    buckets share, which joins a group of copies of one text in one step; then
    those of a bucket that are still in different components are compared with
    each other. Candidates whose sketches or set sizes rule out the similarity by
    six standard deviations are left out; the rest are decided on full sets. A
    pair at the bound is missed with odds under 10^-6.

    Returns per row: id, row (hash of id and text), n_shingles, component_id (the
    smallest id of the group), kept (id is component_id), representative (true
    for one row of each group: smallest id, then smallest row). A null, empty or
    blank text has no shingles and is linked with nothing. Null ids come after
    all others; a group of only null ids has a null component_id and is kept.
    Rows with one id and different texts are apart, unless alike. No rows give
    no rows.
    """
    s = percent / 100
    sk = cut(sketches(docs, k, s, id_col, text_col))
    texts = keyed(docs, id_col, text_col)
    info = ["n", "b0", "b1", "b2", "b3"]
    cls = cut(sk.where("n > 0").groupBy("cls").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in [*info, "bands"]]))
    buckets = cls.select("cls", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(buckets.join(shared, "band"))
    weight = shared.groupBy("cls").agg(F.sum("size").alias("weight"))
    lead = shared.join(weight, "cls").groupBy("band").agg(F.max(F.struct("weight", "cls")).alias("m")).select("band", F.col("m.cls").alias("a"))
    side = lambda c: cls.select(F.col("cls").alias(c), *[F.col(x).alias(f"{c}{x}") for x in ["row", *info]])
    first = shared.join(lead, "band").select("a", F.col("cls").alias("b")).where("a <> b").distinct()
    first = cut(first.join(side("b"), "b").join(side("a"), "a").where(alike("a", "b", s)).select("a", "arow", "b", "brow"))
    links = cut(verify(first, texts, k, percent))
    part = components(links)

    own = shared.select("band", "cls").join(part.withColumnRenamed("node", "cls"), "cls", "left").withColumn("part", F.coalesce("component", "cls")).select("band", "cls", "part")
    mixed = own.groupBy("band").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("size")).where("x <> y").select("band", "size")
    rest = cut(own.join(mixed, "band"))
    few, many = rest.where(F.col("size") <= SMALL), rest.where(F.col("size") > SMALL)
    few = few.join(cls.select("cls", "row", *info), "cls")
    one = lambda c: few.select("band", *[F.col(x).alias(c if x == "cls" else f"{c}{x}") for x in ["cls", "row", "part", *info]])
    second = one("a").join(one("b"), "band").where((F.col("a") < F.col("b")) & (F.col("apart") != F.col("bpart")) & alike("a", "b", s)).select("a", "arow", "b", "brow").distinct()
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = cut(second.join(done, ["a", "b"], "left_anti"))
    more = verify(second, texts, k, percent)
    if not many.isEmpty():
        many = many.withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
        many = many.join(cls.select("cls", "row", *info, "bands"), "cls")
        more = more.unionAll(compare_buckets(many, texts, k, percent, most_unlike(s)))
    more = cut(more)
    if not more.isEmpty():
        part = components(links.unionAll(more))

    rows = sk.select("id", "row", F.col("n").alias("n_shingles"), "cls").join(part.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("component", "cls"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    firsts = rows.where("label is not null").groupBy("label").agg(F.min(order).alias("m"))
    out = rows.select("id", "row", "n_shingles", "label").join(firsts, "label", "left")
    found = F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("m.id"))
    return out.select(F.col("id").alias(id_col), "row", "n_shingles", found.alias("component_id"), F.col("id").eqNullSafe(found).alias("kept"), F.coalesce(F.col("m.row") == F.col("row"), F.lit(True)).alias("representative"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all its columns.

    The row is the group's representative, see ``near_duplicates``. Of rows that
    repeat its id and text but differ in other columns one stays, whichever
    comes first in its task. Other columns pass through unread, but for one of
    the name ``__row``, which would be lost. No rows give none.
    """
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    stays = near_duplicates(docs, k, percent, id_col, text_col).where("representative").select(F.col("row").alias("__row")).distinct()
    return docs.withColumn("__row", F.xxhash64(i, t)).join(stays, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
