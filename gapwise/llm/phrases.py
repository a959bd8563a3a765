"""Collocations by hashed bucket counts (PCY, DHP) and Apriori pruning before exact counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import remove, remove_later, shared_folder
from . import base

#: Bytes of text of one coded row.
SLICE = 8 << 20
#: Counters of the buckets, as a power of two, and those of one chunk.
BUCKETS, CHUNK = 26, 16

#: A byte that no UTF-8 text holds stands for the separators.
GAP = 255
#: Lower case for A-Z, blanks for tabs, GAP for `.,;:!?` and U+000A to U+000D.
TABLE = bytes(c + 32 if 65 <= c <= 90 else GAP if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    """Words of a translated text; a separator is a word of its own."""
    # other control characters belong to words, and are no white space for split() here
    return text.replace(b"\xff", b" \xff ").split()


def text_parts(text: bytes, size: int, keep: int) -> Iterator[tuple[list[bytes], int]]:
    """Words of a translated text in parts of ``size`` bytes or more, and how many of them stand in the part before too.

    A part that ends inside a piece hands its last ``keep`` words on, so that
    every run of ``keep`` + 1 words is whole in the part where it ends.
    """
    at, carried = 0, []
    while True:
        to = len(text)
        if to - at > size:
            cuts = [x for x in (text.find(b" ", at + size), text.find(b"\xff", at + size)) if x >= 0]
            to = min(cuts, default=to)
        words = split_words(text[at:to])
        yield carried + words, len(carried)
        if to == len(text):
            return
        at = to
        carried = (carried + words)[-keep:] if keep else []


ROW = "lang string, words array<binary>, codes binary, skip int"


def coded(docs: DataFrame, keep: int, size: int = SLICE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Texts as numbers: a row for about ``size`` bytes of one language, with its words, a code a word (-1 between pieces) and how many leading words only give context."""
    base.ship(docs.sparkSession)

    def row(lang, tokens, skip):
        d = pa.array(tokens, pa.binary()).dictionary_encode()
        order = pc.sort_indices(d.dictionary).to_numpy()  # phrases then come sorted out of the passes, and compress better
        place = np.empty(len(order), "<i4")
        place[order] = np.arange(len(order))
        words, codes = d.dictionary.take(pa.array(order)), place[d.indices.to_numpy()]
        if len(words) and words[-1].as_py() == b"\xff":  # no word is greater
            codes[codes == len(words) - 1] = -1
        listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), listed, pa.array([codes.tobytes()], pa.binary()), pa.array([skip], pa.int32())], ["lang", "words", "codes", "skip"])

    def run(batches):
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        total = 0
        for b in batches:
            for lang, cell in zip(b.column(0).to_pylist(), b.column(1)):
                x = cell.as_buffer()
                if x is None or not x.size:
                    continue
                text = x.to_pybytes().translate(TABLE)
                if len(text) > size:
                    for tokens, skip in text_parts(text, size, keep):
                        yield row(lang, tokens, skip)
                    continue
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                total += len(text)
                if sizes[lang] >= size or total >= 4 * size:
                    most = max(sizes, key=sizes.get)
                    total -= sizes.pop(most)
                    yield row(most, split_words(b"\xff".join(held.pop(most))), 0)
        for lang, texts in held.items():
            yield row(lang, split_words(b"\xff".join(texts)), 0)

    lang = F.coalesce(F.col(f"`{lang_col}`"), F.lit("und"))
    return docs.select(lang.alias("__lang"), F.col(f"`{text_col}`").cast("binary").alias("__text")).mapInArrow(run, ROW)


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def gram_hash(parts: list[np.ndarray]) -> np.ndarray:
    """The hash of n-grams from those of their words."""
    h = parts[0]
    for x in parts[1:]:
        h = base.mix(h * np.uint64(0x9E3779B97F4A7C15) + x)
    return h


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (base.mix(h) >> np.uint64(64 - bits)).astype(np.int64)


class Slice:
    """A coded row: its n-grams by the place of their last word."""

    def __init__(self, lang: str, words: pa.Array, codes: bytes, skip: int):
        self.lang, self.words, self.skip = lang, words, skip
        self.codes = np.frombuffer(codes, "<i4").astype(np.int64)
        self.hashes = word_hashes(lang, words.to_pylist())

    def ends(self, n: int) -> np.ndarray:
        """Places where an n-gram ends that lies in one piece and whose last word is not context."""
        if len(self.codes) < n:
            return np.zeros(0, np.int64)
        whole = np.ones(len(self.codes) - n + 1, bool)
        for k in range(n):
            whole &= self.codes[k : len(self.codes) - n + 1 + k] >= 0
        at = np.flatnonzero(whole) + n - 1
        return at[at >= self.skip]

    def hash(self, ends: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
        """Hashes of the n words that end ``skip`` words before ``ends``."""
        return gram_hash([self.hashes[self.codes[ends - skip - k]] for k in range(n - 1, -1, -1)])

    def count(self, ends: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
        """The different n-grams that end at ``ends``, and how often each does."""
        key, kinds = self.codes[ends - n + 1], len(self.words)
        for k in range(n - 2, -1, -1):
            if kinds > (1 << 62) // max(1, len(self.words)):  # renumber before the key passes 64 bits
                key = np.unique(key, return_inverse=True)[1]
                kinds = len(ends)
            key = key * len(self.words) + self.codes[ends - k]
            kinds *= len(self.words)
        _, first, n_each = np.unique(key, return_index=True, return_counts=True)
        texts = [self.words.take(pa.array(self.codes[ends[first] - k], pa.int64())) for k in range(n - 1, -1, -1)]
        return pc.binary_join_element_wise(*texts, b" ") if n > 1 else texts[0], n_each


def slices_of(batches) -> Iterator[Slice]:
    for b in batches:
        for lang, words, codes, skip in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist()):
            yield Slice(lang, words.values, codes.as_buffer().to_pybytes(), skip)


#: Bitmaps by the length of their n-grams: of frequent n-grams, and of buckets that may hold some.
Maps = dict[tuple[str, int], np.ndarray]


def test(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def survivors(s: Slice, n: int, maps: Maps, bits: int) -> np.ndarray:
    """Ends of the n-grams that can be frequent by ``maps``: both runs of n - 1 words are (Apriori), and so is the bucket."""
    ends = s.ends(n)
    for (kind, size), bitmap in maps.items():
        for skip in range(n - size + 1):
            if kind == "frequent" or size == n:
                ends = ends[test(bitmap, bucket(s.hash(ends, size, skip), bits))]
    return ends


PASS = "kind string, lang string, phrase string, n long, chunk int, cells binary"
PASS_NAMES = ["kind", "lang", "phrase", "n", "chunk", "cells"]


def pass_rows(kind: str, lang=None, phrase=None, n=None, chunk=None, cells=None) -> pa.RecordBatch:
    m = len(n if cells is None else cells)
    columns = [(lang, pa.string()), (phrase, pa.string()), (n, pa.int64()), (chunk, pa.int32()), (cells, pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([kind] * m, pa.string())] + [pa.nulls(m, t) if x is None else pa.array(x, t) for x, t in columns], PASS_NAMES)


def pack_cells(at: np.ndarray, count: np.ndarray, least: int) -> tuple[np.ndarray, list[bytes]]:
    """Chunks of the buckets ``at`` (ascending), and for each its buckets (16 bits) and their counts (8 or 16 bits), which stop at ``least``."""
    count = np.minimum(count, least).astype("<u1" if least < 256 else "<u2")
    low = (at & (1 << CHUNK) - 1).astype("<u2")
    chunk, first = np.unique(at >> CHUNK, return_index=True)
    return chunk, [low[a:b].tobytes() + count[a:b].tobytes() for a, b in zip(first.tolist(), [*first[1:].tolist(), len(at)])]


def counting_pass(rows: DataFrame, n: int, longest: int, maps, bits: int, least: int) -> DataFrame:
    """One pass over the coded rows, in rows of three kinds.

    ``n``: exact counts a slice of the n-grams that ``maps`` (a broadcast)
    leaves. ``b``: bucket counts a slice of the next length, of those n-grams of
    which both parts are among the former; they stop at ``least``, since sums of
    them reach it where the true sums do. ``t``, in pass 0: the words of a slice.
    """

    def run(batches):
        for s in slices_of(batches):
            ends = s.ends(n + 1)
            if n:
                left = survivors(s, n, maps.value, bits)
                phrase, count = s.count(left, n)
                yield pass_rows("n", [s.lang] * len(count), phrase.cast(pa.string()), count)
                here = np.zeros(len(s.codes) + 1, bool)
                here[left] = True
                here[: s.skip] = True  # the slice before has counted what ends in the context
                ends = ends[here[ends] & here[ends - 1]]
            else:
                yield pass_rows("t", [s.lang], None, [len(ends)])
            if n < longest:
                at, count = np.unique(bucket(s.hash(ends, n + 1), bits), return_counts=True)
                chunk, cells = pack_cells(at, count, least)
                yield pass_rows("b", chunk=chunk, cells=cells)

    return rows.mapInArrow(run, PASS)


def bucket_bitmap(counted: DataFrame, least: int, bits: int) -> np.ndarray:
    """Bits of the buckets with ``least`` counts or more. The driver sees the bitmap alone, 2 ** ``bits`` bits."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, cells in zip(b.column(0).to_pylist(), b.column(1)):
                kind = np.dtype("<u1" if least < 256 else "<u2")
                m = len(cells.as_buffer()) // (2 + kind.itemsize)
                at = np.frombuffer(cells.as_buffer(), "<u2", m).astype(np.int64)
                if chunk not in sums:
                    sums[chunk] = np.zeros(1 << CHUNK, np.uint16)
                held = sums[chunk]
                held[at] = np.minimum(held[at].astype(np.int64) + np.frombuffer(cells.as_buffer(), kind, m, 2 * m), least)
        for chunk, held in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(held >= least, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    rows = counted.where("kind = 'b'").select("chunk", "cells").repartition("chunk").mapInArrow(run, "chunk int, bits binary")
    return _gathered(rows, bits)


def frequent_bitmap(frequent: DataFrame, n: int, bits: int) -> np.ndarray:
    """Bits of the buckets that a frequent phrase of ``n`` words is in."""

    def run(batches):
        held = np.zeros(1 << bits, bool)
        for b in batches:
            words: dict[str, list[bytes]] = {}
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words.setdefault(lang, []).extend(phrase.encode().split(b" "))
            for lang, x in words.items():
                held[bucket(gram_hash(list(word_hashes(lang, x).reshape(-1, n).T)), bits)] = True
        for chunk in np.unique(np.flatnonzero(held) >> CHUNK).tolist():
            part = held[chunk << CHUNK : (chunk + 1) << CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(x.as_buffer(), np.uint8)
                sums[chunk] = sums[chunk] | x if chunk in sums else x.copy()
        for chunk, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["chunk", "bits"])

    rows = frequent.select("lang", "phrase").mapInArrow(run, "chunk int, bits binary").repartition("chunk").mapInArrow(merge, "chunk int, bits binary")
    return _gathered(rows, bits)


def _gathered(rows: DataFrame, bits: int) -> np.ndarray:
    out = np.zeros((1 << bits) // 8, np.uint8)
    width = (1 << CHUNK) // 8
    for chunk, x in rows.collect():
        out[chunk * width : (chunk + 1) * width] = np.frombuffer(bytes(x), np.uint8)
    return out


def phrase_counts(docs: DataFrame, folder: str, longest: int = 3, least: int = 10, bits: int = BUCKETS, size: int = SLICE, text_col: str = "text", lang_col: str = "lang") -> list[DataFrame]:
    """(lang, n) of all words, then (lang, phrase, n) of the phrases of 1 to ``longest`` words with ``least`` occurrences or more.

    Texts are coded once (``coded``) in ``folder``. Pass n counts n-grams exactly
    and hashes those of n + 1 words into 2 ** ``bits`` bucket counters (pass 0
    hashes words only). Between passes bitmaps of 2 ** ``bits`` bits go to all
    tasks: buckets with ``least`` counts, and hashes of the frequent n-grams.
    Both only rule out; what is left is counted by its words.
    """
    spark = docs.sparkSession
    coded(docs, longest - 1, size, text_col, lang_col).write.option("compression", "zstd").parquet(f"{folder}/codes")
    rows = spark.read.parquet(f"{folder}/codes")
    out, maps = [], {}
    for n in range(longest + 1):
        sent = spark.sparkContext.broadcast(maps)
        counting_pass(rows, n, longest, sent, bits, least).write.option("compression", "zstd").parquet(f"{folder}/pass{n}")
        sent.unpersist()
        counted = spark.read.parquet(f"{folder}/pass{n}")
        maps = {}
        if n:
            counts = counted.where("kind = 'n'").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            counts.write.parquet(f"{folder}/counts{n}")
            out.append(spark.read.parquet(f"{folder}/counts{n}"))
            if n < longest:
                maps["frequent", n] = frequent_bitmap(out[-1], n, bits)
        else:
            counted.where("kind = 't'").groupBy("lang").agg(F.sum("n").alias("n")).write.parquet(f"{folder}/words")
            out.append(spark.read.parquet(f"{folder}/words"))
        if n < longest:
            maps["bucket", n + 1] = bucket_bitmap(counted, least, bits)
        remove(spark, f"{folder}/pass{n}")  # its counts and bitmaps are kept
    remove(spark, f"{folder}/codes")
    return out


def score() -> Column:
    """floor(10^6 a a / (l r)) in exact arithmetic; a is at most l and r."""
    return F.expr("(CAST(1000000 AS DECIMAL(38, 0)) * a * a) div (CAST(l AS DECIMAL(38, 0)) * r)")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, most: int = 2000, bits: int = BUCKETS, size: int = SLICE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``most`` best phrases of 2 to ``longest`` words of each language.

    A-Z are lower-cased; texts are cut at ``.,;:!?`` and line ends into pieces,
    those at blanks and tabs into words. Candidates occur ``least`` times or
    more (a); overlapping occurrences count. Cutting one after its first k words
    gives l and r, the occurrences of its parts, and floor(10^6 a a / (l r)); the
    cut with the lowest score counts, of equal ones the first. Candidates that
    lie inside a longer one with ``percent`` % of their occurrences or more are
    dropped. Scores are exact while counts stay below 10^15.

    Returns lang, rank, phrase, a, l, r, n (the language's words) and score, by
    score and a descending and phrase (by bytes) ascending. A null language is
    ``und``, together with rows that say ``und``; a null or empty text has no
    words. Every row counts, also where rows or ids repeat. Texts of any length
    are read whole. No rows give none. Other columns are ignored.
    """
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
    remove_later(spark, folder)
    counts = phrase_counts(docs, folder, longest, least, bits, size, text_col, lang_col)
    total, parts, found = counts[0], counts[1], counts[2]
    for shorter, x in zip(counts[2:], counts[3:]):
        parts, found = parts.unionAll(shorter), found.unionAll(x)
    words = F.split("phrase", " ", -1)
    found = found.select("lang", "phrase", F.col("n").alias("a"), words.alias("w"))

    # those inside a longer phrase
    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    over = found.where(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    found = found.join(over, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)).drop("longer")

    cuts = found.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"), "w")
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    best = cuts.select("lang", "phrase", "a", F.struct(score().alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # first the best of each share of a language, then of the language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = best.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= most)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
