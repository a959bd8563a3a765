"""Near-duplicate vectors by a forest of random-projection trees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .base import cut
from .graph import components


def spill_of(bound: float, d: int) -> float:
    """How far from a split a unit vector of ``d`` dimensions goes both ways.

    The projections of two vectors at the bound differ by their distance over
    the root of d, as a deviation. A pair is parted where the two lie on either
    side beyond the spill; at two fifths of that deviation this happens at 4 % of
    the splits or so, while a vector among scattered ones goes both ways at 12 %.
    """
    return 0.4 * math.sqrt(2 * (1 - bound) / d)


class Tree:
    """Splits by random directions at the sample's medians; nodes in heap order.

    A node of whose sample more than ``CROWDED`` would go both ways is not split,
    since splitting would copy it, not part it; nor is one with under 8 of the sample.
    """

    CROWDED = 0.4

    def __init__(self, sample: np.ndarray, depth: int, seed: int, spill: float):
        rng = np.random.default_rng(seed)
        self.depth, self.spill, d = depth, spill, sample.shape[1]
        self.ways = rng.standard_normal((2**depth, d)).astype(np.float32)
        self.ways /= np.maximum(np.linalg.norm(self.ways, axis=1, keepdims=True), 1e-30)
        self.cuts, self.stop = np.zeros(2**depth), np.ones(2**depth, bool)
        parts = {1: sample}
        for node in range(1, 2**depth):
            x = parts.pop(node, None)
            if x is None or len(x) < 8:
                continue
            p = x @ self.ways[node]
            cut = np.median(p)
            if (np.abs(p - cut) <= spill).mean() > self.CROWDED:
                continue
            self.cuts[node], self.stop[node] = cut, False
            parts[2 * node], parts[2 * node + 1] = x[p <= cut], x[p > cut]

    def leaves(self, x: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) down to each row's ``depth``: a row within the spill of a split goes both ways."""
        row, node, rows, nodes = np.arange(len(x)), np.ones(len(x), np.int64), [], []
        for level in range(self.depth):
            ends = self.stop[node] | (depth[row] <= level)
            rows.append(row[ends])
            nodes.append(node[ends])
            row, node = row[~ends], node[~ends]
            p = np.einsum("ij,ij->i", x[row], self.ways[node]) - self.cuts[node]
            left, right = p <= self.spill, p > -self.spill
            row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
        return np.concatenate([*rows, row]), np.concatenate([*nodes, node])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, also where squares would over- or underflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Lists:
    """A list of codes for each row."""

    def __init__(self, row: np.ndarray, code: np.ndarray, n: int):
        order = np.lexsort((code, row))
        self.flat, self.ends = code[order], np.searchsorted(row[order], np.arange(n + 1))

    def of(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in g, code) of the rows g."""
        size = self.ends[g + 1] - self.ends[g]
        at = np.repeat(self.ends[g] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(np.arange(len(g)), size), self.flat[at]


def met_before(n: int, row: np.ndarray, code: np.ndarray, step: int = 4096) -> np.ndarray | None:
    """Which of ``n`` rows have a code in common; None if no code occurs twice."""
    seen, at, times = np.unique(code, return_inverse=True, return_counts=True)
    often = times[at] > 1
    if not often.any():
        return None
    row, code = row[often], np.unique(at[often], return_inverse=True)[1]
    out = np.zeros((n, n), bool)
    for a in range(0, int(code.max()) + 1, step):
        some = (code >= a) & (code < a + step)
        member = np.zeros((n, step), np.float32)
        member[row[some], code[some] - a] = 1
        out |= member @ member.T > 0
    return out


def _roots(mask: np.ndarray) -> np.ndarray:
    """Least index of each one's component of a symmetric mask."""
    label = np.arange(len(mask))
    while True:
        new = np.minimum(label, np.where(mask, label[None, :], len(mask)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: Rows in a block of a comparison; leaves of more than WIDE times ``leaf`` are split again in their task.
BLOCK, WIDE = 1024, 4
#: Bytes of vectors that a leaf may bring to one task; the rows of a larger one are dealt to chunks, and each two chunks meet.
LEAF_BYTES = 64 << 20
#: Bytes of the trees of a vector length, and vector lengths that get trees (the most frequent; others are compared by label).
TREE_BYTES, LENGTHS = 128 << 20, 64


def near_vectors(rows: DataFrame, bound: float = 0.93, trees: int = 8, leaf: int = 256, sample: int = 20_000, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links between vectors of equal label whose cosine is at least ``bound``, and their groups.

    Equal vectors of a label are one class from the start. The trees are fitted
    on at most about ``sample`` unit vectors of a length, taken by hash, and at
    most ``TREE_BYTES``; all classes go down every tree, both ways near a split
    (see ``spill_of``), to the depth at which a leaf holds about ``leaf`` classes
    of their label, as far as the sample can tell. A leaf that is still wide is
    split on by further random directions, fitted on its own vectors, in the
    task that compares it; one of more than ``LEAF_BYTES`` is dealt to chunks, of
    which each two meet in a task of their own and are split on there in the same
    way. What shares a leaf is compared in double precision, in blocks, and a pair counts in the first leaf that it shares only. A leaf
    gives per class its number of links and one link towards its component,
    never the pairs.

    Returns per row: id, n_links (other rows linked directly), component_id (the
    smallest id reachable), kept (id is component_id). Null labels and vectors
    that are null, empty, zero, or hold null or non-finite components link with
    nothing. Vectors of different length never link. Null ids come after all
    others. Rows that repeat id and vector are linked with each other. No rows
    give no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    base.ship(spark)
    v, label = F.col(f"`{vector_col}`"), F.col(f"`{label_col}`")
    v = v.cast("array<double>")
    fine = F.coalesce(label.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    own = rows.select(F.col(f"`{id_col}`").alias("id"), F.when(fine, F.xxhash64(label.cast("string"), v, F.size(v))).alias("cls"), F.when(fine, F.xxhash64(label.cast("string"), F.size(v))).alias("space"), F.when(fine, v).alias("v"))
    classes = cut(own.where("cls is not null").groupBy("cls").agg(F.count("*").alias("w"), F.first("space").alias("space"), F.first("v").alias("v")))
    spaces = classes.groupBy("space").agg(F.count("*").alias("n"), F.first(F.size("v")).alias("d"))
    most = spaces.groupBy("d").agg(F.max("n").alias("largest"), F.sum("n").alias("n")).orderBy(F.desc("n"), "d").limit(LENGTHS).collect()
    forests = {}
    for r in most:
        some = min(sample, TREE_BYTES // (8 * r.d))
        part = classes.where(F.size("v") == r.d).where(F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < math.ceil((1 << 30) * min(1.0, some / r.n))).select("v").toArrow()
        x = unit(np.array(part.column("v").combine_chunks().flatten()).reshape(-1, r.d)) if part.num_rows else np.zeros((0, r.d))
        depth = max(0, min(24, math.ceil(math.log2(max(1, r.largest / leaf)))))
        # a split needs some of the sample, and the trees have to fit
        depth = min(depth, max(0, int(math.log2(max(1, len(x) / 8)))), max(0, int(math.log2(max(1, TREE_BYTES / (4 * trees * r.d))))))
        forests[r.d] = [Tree(x, depth, seed + i, spill_of(bound, r.d)) for i in range(trees)]
    held = spark.sparkContext.broadcast(forests)
    narrow = dict(rows.select(v.alias("v"), F.col(f"`{vector_col}`").alias("own")).dtypes)["own"] == "array<float>"
    kind = np.float32 if narrow else np.float64  # a float column travels as it is

    def deal(batches):
        for b in batches:
            lists = b.column(3)
            size = pc.list_value_length(lists).to_numpy()
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                t = b.take(pa.array(at))
                x = np.array(t.column(3).flatten()).reshape(-1, d)
                row, leaf_id = np.arange(len(x)), np.zeros(len(x), np.int64)
                if d in held.value:
                    depth = np.ceil(np.log2(np.maximum(1, t.column(4).to_numpy() / leaf))).astype(np.int64)
                    u = unit(x)
                    found = [tree.leaves(u, depth) for tree in held.value[d]]
                    row = np.concatenate([r for r, _ in found])
                    leaf_id = np.concatenate([(np.int64(i) << np.int64(40)) | n for i, (_, n) in enumerate(found)])
                    # all of a label shares the leaf of a tree that does not split it: once is enough
                    whole = leaf_id & ((1 << 40) - 1) == 1
                    first = np.full(len(x), np.int64(1) << np.int64(62))
                    np.minimum.at(first, row[whole], leaf_id[whole])
                    again = whole & (leaf_id > first[row])
                    row, leaf_id = row[~again], leaf_id[~again]
                mine = Lists(row, leaf_id, len(x))
                row, leaf_id = mine.of(np.arange(len(x)))
                all_of = pa.ListArray.from_arrays(pa.array(mine.ends.astype(np.int32)), pa.array(mine.flat)).take(pa.array(row))
                raw = pa.array([y.tobytes() for y in x.astype(kind)], pa.binary()).take(pa.array(row))
                rest = t.select(["cls", "w", "space"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([rest.column(2), pa.array(leaf_id), rest.column(0), rest.column(1), all_of, raw], ["space", "leaf", "cls", "w", "leaves", "raw"])

    def compare(key, t):
        t = t.sort_by("cls").combine_chunks()
        n, leaf_now, left, right = t.num_rows, key[1].as_py(), key[2].as_py(), key[3].as_py()
        cls, w = t.column("cls").to_numpy(), t.column("w").to_numpy()
        links, top = np.zeros(n, np.int64), np.arange(n)
        if n > 1:
            x = unit(np.frombuffer(b"".join(t.column("raw").to_pylist()), kind).reshape(n, -1).astype(np.float64))
            lists = t.column("leaves").combine_chunks()
            row, code = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            before = Lists(row[code < leaf_now], code[code < leaf_now], n)
            sub, at, chunk = np.arange(n), np.zeros(n, np.int64), t.column("chunk").to_numpy()
            one, other = chunk == left, chunk == right
            if n > WIDE * leaf:
                some = np.random.default_rng(seed).permutation(n)[:sample]
                sub, at = Tree(x[some], min(12, math.ceil(math.log2(n / leaf))), seed + leaf_now % (1 << 31), spill_of(bound, x.shape[1])).leaves(x, np.full(n, 64))
            parts = Lists(sub, at, n)
            order = np.lexsort((sub, at))
            for g in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                if len(g):  # two chunks meet here, each of them with itself in another task
                    g, now = sub[g], at[g[0]]
                    _compare(*((g, None) if left == right else (g[one[g]], g[other[g]])), now, x, w, bound, before, parts, links, top)
        top = np.array([_find(top, u) for u in range(n)], np.int64) if n else top
        some = links > 0
        return pa.table({"cls": cls[some], "links": links[some], "other": cls[top][some]})

    dealt = classes.join(spaces.select("space", "n"), "space").select("cls", "w", "space", "v", "n").mapInArrow(deal, "space long, leaf long, cls long, w long, leaves array<long>, raw binary")
    room = F.lit(LEAF_BYTES) / F.max(F.octet_length("raw"))
    large = cut(dealt.groupBy("space", "leaf").agg(F.count("*").alias("n"), room.alias("room")).where("n > room").select("space", "leaf", F.ceil(2 * F.col("n") / F.col("room")).cast("int").alias("chunks")))
    if large.isEmpty():
        dealt = dealt.select("*", F.lit(0).alias("chunks"), F.lit(0).alias("chunk"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        dealt = dealt.join(large, ["space", "leaf"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
        dealt = dealt.withColumn("chunk", F.when(F.col("chunks") > 0, F.pmod(F.xxhash64("cls"), F.greatest("chunks", F.lit(1))).cast("int")).otherwise(0))
        two = F.transform(F.sequence(F.lit(0), F.greatest(F.col("chunks") - 1, F.lit(0))), lambda y: F.struct(F.least("chunk", y).alias("i"), F.greatest("chunk", y).alias("j")))
        dealt = dealt.withColumn("x", F.explode(two)).select("space", "leaf", "cls", "w", "leaves", "raw", "chunks", "chunk", "x.i", "x.j")
    found = cut(dealt.groupBy("space", "leaf", "i", "j").applyInArrow(compare, "cls long, links long, other long"))
    groups = components(found.where("cls <> other").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    n_links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    per = classes.select("cls", "w").join(n_links, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    per = per.select("cls", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "cls").alias("part"))
    out = own.select("id", "cls").join(per, "cls", "left")
    order = F.struct(F.col("id").isNull().alias("none"), "id")
    firsts = out.where("part is not null").groupBy("part").agg(F.min(order).alias("m"))
    out = out.join(firsts, "part", "left")
    to = F.when(F.col("part").isNull(), F.col("id")).otherwise(F.col("m.id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), to.alias("component_id"), F.col("id").eqNullSafe(to).alias("kept"))


def _compare(g: np.ndarray, h: np.ndarray | None, now: int, x: np.ndarray, w: np.ndarray, bound: float, before: Lists, parts: Lists | None, links: np.ndarray, top: np.ndarray) -> None:
    """Count the links among the rows ``g``, or between ``g`` and ``h``, that did not meet in an earlier leaf or part, and join their components."""
    for a in range(0, len(g), BLOCK):
        for b in range(a if h is None else 0, len(g if h is None else h), BLOCK):
            i, j = g[a : a + BLOCK], (g if h is None else h)[b : b + BLOCK]
            own = h is None and a == b
            near = x[i] @ x[j].T >= bound
            if own:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            both = i if own else np.concatenate((i, j))
            for lists, least in ((before, None), (parts, now)):
                if lists is None:
                    continue
                r, c = lists.of(both)
                if least is not None:
                    r, c = r[c < least], c[c < least]
                met = met_before(len(both), r, c)
                if met is not None:
                    near &= ~(met if own else met[: len(i), len(i) :])
            links[i] += near @ w[j]
            if not own:
                links[j] += near.T @ w[i]
            p, q = np.nonzero(near)
            if not len(p):
                continue
            # join what this block links: labels over its rows, then over the labels
            p, q = i[p], j[q]
            m = np.unique(np.concatenate((p, q)))
            block = np.zeros((len(m), len(m)), bool)
            block[np.searchsorted(m, p), np.searchsorted(m, q)] = True
            block |= block.T
            root = m[_roots(block)]
            for u, r in zip(m[root != m], root[root != m]):
                u, r = _find(top, u), _find(top, r)
                top[max(u, r)] = min(u, r)


def _find(top: np.ndarray, x: int) -> int:
    while top[x] != x:
        top[x] = top[top[x]]
        x = top[x]
    return x
