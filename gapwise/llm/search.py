"""Ranked lexical search: postings in windows of documents, scored in arrays."""

from __future__ import annotations

import heapq
import math
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import remove_later, shared_folder
from . import base

#: Documents of a window (its scores fill 32 kB) and the postings after which it closes early (at 10 bytes each and their
#: terms, a row of the index then has some 5 MB; a single longer document makes a longer one).
WINDOW, POSTINGS = 4096, 1 << 18
#: Rows of the index are large, so its files are checked row by row: row groups of some 4 MB (compressed) are all that a task holds.
FILES = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 4, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4}
#: Bytes of the terms of one block of items, which is sent to every task.
BLOCK = 16 << 20
#: Bytes of a long text that are split at once.
PART = 1 << 20

#: Terms are runs of ASCII letters and digits and of all other characters; A-Z are lower-cased.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def parts(data: bytes, size: int = PART) -> Iterator[bytes]:
    """``data`` in parts of ``size`` bytes or more, cut at blanks."""
    at = 0
    while len(data) - at > size:
        to = data.find(b" ", at + size)
        if to < 0:
            break
        yield data[at:to]
        at = to
    yield data[at:]


def terms_of(text: bytes) -> Counter:
    """The terms of a UTF-8 text with their numbers of occurrences."""
    data, out = text.translate(TABLE), Counter()
    for p in parts(data):
        out.update(p.split())
    return out


INDEX = "n_docs long, n_tokens long, ids array<{kind}>, sizes array<long>, terms array<binary>, counts array<int>, slots binary, tfs binary"


class _Window:
    """Documents that are gathered for a window, their postings as numbers (a term's code, its frequency) in arrays."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.codes: dict[bytes, int] = {}
        self.code, self.tf, self.terms, self.size = array("i"), array("q"), array("q"), array("q")

    def add(self, one: pa.Array, text: bytes) -> None:
        found, codes = terms_of(text), self.codes
        self.ids.append(one)
        self.code.extend([codes.setdefault(t, len(codes)) for t in found])
        self.tf.extend(found.values())
        self.terms.append(len(found))
        self.size.append(sum(found.values()))

    def row(self) -> list:
        """The row of the index: documents by ascending id (null last), postings by term and then document."""
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy().astype(np.int64)
        code, tf, terms, size = np.array(self.code, np.int64), np.array(self.tf, np.int64), np.array(self.terms, np.int64), np.array(self.size, np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        slot = np.repeat(place, terms)
        by_term = np.lexsort((slot, code))
        # codes are numbered as terms come, so the keys of the dictionary are in their order
        return [int((size > 0).sum()), int(size.sum()), ids.take(pa.array(order)), size[order], pa.array(self.codes, pa.binary()), np.bincount(code, minlength=len(self.codes)), slot[by_term].astype("<u2").tobytes(), tf[by_term].astype("<i8").tobytes()]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """An inverted index of whole texts, a row for each window of up to ``window`` (at most 65,536) documents.

    A window holds documents that lie together in the table, in the order of
    their ids; a document's place in it is its slot. So the texts are not
    shuffled, and ids may be null, repeat or have gaps. Columns: documents with
    a term, terms with repeats, ids and numbers of terms by slot, terms, the
    number of postings of each, and slots (16 bits) and frequencies (64 bits)
    of the postings, term after term.
    """
    base.ship(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches):
        def row(window):
            x = window.row()
            cells = [pa.array([x[0]], pa.int64()), pa.array([x[1]], pa.int64())]
            for v, t in ((x[2], None), (x[3], pa.int64()), (x[4], None), (x[5], pa.int32())):
                v = v if t is None else pa.array(v, t)
                cells.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
            return pa.RecordBatch.from_arrays([*cells, pa.array([x[6]], pa.binary()), pa.array([x[7]], pa.binary())], ["n_docs", "n_tokens", "ids", "sizes", "terms", "counts", "slots", "tfs"])

        held = _Window()
        for b in batches:
            for k in range(b.num_rows):
                x = b.column(1)[k].as_buffer()
                held.add(b.column(0).slice(k, 1), b"" if x is None else x.to_pybytes())
                if len(held.ids) == window or len(held.code) >= POSTINGS:
                    yield row(held)
                    held = _Window()
        if held.ids:
            yield row(held)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary")).mapInArrow(run, INDEX.format(kind=kind))


def item_blocks(items: DataFrame, most: int = BLOCK) -> DataFrame:
    """``items`` (item, text) with ``block``: items by hash, so that no block of several items holds more than ``most`` bytes of text."""
    weight = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    n = 1 + (items.agg(F.sum(weight)).first()[0] or 0) // most
    while True:
        x = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
        if x.groupBy("block").agg(F.sum(weight).alias("s"), F.count("*").alias("c")).where((F.col("s") > most) & (F.col("c") > 1)).isEmpty():
            return x
        n *= 2


def _starts(terms: pa.Array, counts: np.ndarray, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the terms of a window that are wanted: their places in ``wanted``, and where their postings start and end."""
    ends = np.cumsum(counts, dtype=np.int64)
    at = pc.index_in(terms, value_set=wanted)
    held = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    return at.drop_null().to_numpy().astype(np.int64), ends[held] - counts[held], ends[held]


def length_factor(size: np.ndarray, n: int, length: int) -> np.ndarray:
    """100 - 90 + (90 * size * n) div length, exact also where the product passes 64 bits."""
    if int(size.max(initial=0)) * n * 90 < 1 << 63:
        return 10 + 90 * size * n // length
    return np.array([10 + 90 * int(s) * n // length for s in size.tolist()], np.int64)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each item, all documents considered.

    With N documents that have a term, L terms in all, n terms of a document,
    a term's df documents and tf occurrences: a term weighs
    w = floor(1000 * ln((2N + 2) / (2 df + 1))), and a document's score is the
    sum of w * (10^9 tf div (1000 tf + 8 m)) over the item's different terms,
    with m = 10 + (90 n N) div L.

    The index (``build_index``) is written once and read window by window: a
    term's postings are scattered into an array with a place for each document,
    an occupancy map (a byte a place) tells which were touched, and those with
    the highest scores go into the item's heap. Items are dealt to blocks by size (``item_blocks``);
    only one block's terms and counts are ever at the driver or sent to the
    tasks. Heaps of tasks meet in a grouping, ``k`` rows a task and item.

    Returns item, rank (from 1), id and score. Equal scores go by ascending id,
    a null id last. Documents may repeat or have null ids: each row counts and
    is ranked. A null or empty text has no terms: such a document is in no
    result, such an item has none. Rows that repeat item and text are one item.
    Texts of any length are read whole. No rows give none. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    remove_later(spark, folder)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    build_index(docs, id_col, text_col, window).write.options(**FILES).parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    n, length = index.agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    items = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("text")).where("text is not null").distinct()
    out = None
    if n:
        items = item_blocks(items, block)
        for (b,) in sorted(items.select("block").distinct().collect()):
            one = items.where(F.col("block") == b).drop("block")
            found = _ranked(index, one, k, n, length, kind)
            out = found if out is None else out.unionAll(found)
    if out is None:
        out = items.limit(0).select("item", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("doc"), F.lit(0).cast("long").alias("score"))
    return out.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _ranked(index: DataFrame, items: DataFrame, k: int, n: int, length: int, kind: str) -> DataFrame:
    """The result of one block of items."""
    spark = index.sparkSession
    rows = [(r["item"], r["text"], sorted(terms_of(r["text"].encode()))) for r in items.collect()]
    wanted = sorted({t for *_, x in rows for t in x})
    at = {t: i for i, t in enumerate(wanted)}
    asked = spark.sparkContext.broadcast(([np.array([at[t] for t in x], np.int64) for *_, x in rows], wanted))

    def count(batches):
        of = pa.array(asked.value[1], pa.binary())
        df = np.zeros(len(of), np.int64)
        for b in batches:
            for terms, counts in zip(b.column(0), b.column(1)):
                place, lo, hi = _starts(terms.values, counts.values.to_numpy(zero_copy_only=False), of)
                df[place] += hi - lo
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["term", "df"])

    df = index.select("terms", "counts").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weight = np.zeros(len(wanted), np.int64)
    for t, d in df:
        weight[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1)))
    weights = spark.sparkContext.broadcast(weight)

    def score(batches):
        (terms_of_item, wanted), weight = asked.value, weights.value
        of = pa.array(wanted, pa.binary())
        heaps: list[list] = [[] for _ in terms_of_item]
        names = ["ids", "sizes", "terms", "counts", "slots", "tfs"]
        for b in batches:
            for cells in zip(*[b.column(b.schema.get_field_index(x)) for x in names]):
                ids, size = cells[0].values, cells[1].values.to_numpy(zero_copy_only=False)
                place, lo, hi = _starts(cells[2].values, cells[3].values.to_numpy(zero_copy_only=False), of)
                slots, tf = np.frombuffer(cells[4].as_buffer(), "<u2"), np.frombuffer(cells[5].as_buffer(), "<i8")
                _score_window(heaps, terms_of_item, weight, k, ids, length_factor(size, n, length), dict(zip(place.tolist(), zip(lo.tolist(), hi.tolist()))), slots, tf)
        held = [(i, *x) for i, h in enumerate(heaps) for x in h]
        if held:
            item, score, doc = ([x[j] for x in held] for j in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(doc, ids.type)], ["at", "score", "doc"])

    top = index.select("ids", "sizes", "terms", "counts", "slots", "tfs").mapInArrow(score, f"at long, score long, doc {kind}")
    best = Window.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    top = top.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"at long, item {dict(items.dtypes)['item']}")
    return top.join(named, "at").select("item", "rank", "doc", "score")


def _score_window(heaps, terms_of_item, weight, k, ids, m, ranges, slots, tf) -> None:
    """Score all items over one window and put its best documents into their heaps of (score, id)."""
    share: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for t, (lo, hi) in ranges.items():
        s, f = slots[lo:hi], tf[lo:hi]
        share[t] = s, weight[t] * (1_000_000_000 * f // (1000 * f + 8 * m[s]))
    total = np.zeros(len(m), np.int64)
    touched = np.zeros(len(m), bool)
    for i, terms in enumerate(terms_of_item):
        for t in terms.tolist():
            if t in share:
                s, x = share[t]
                total[s] += x  # a term has one posting a document
                touched[s] = True
        places = np.flatnonzero(touched)
        got = total[places]
        total[places] = 0
        touched[places] = False
        heap = heaps[i]
        least = max(1, heap[-1][0] if len(heap) == k else 1)
        places, got = places[got >= least], got[got >= least]
        if len(got) > k:
            enough = got >= np.partition(got, len(got) - k)[len(got) - k]
            places, got = places[enough], got[enough]
        if len(got):
            first = np.argsort(-got, kind="stable")[:k]  # slots go by id
            new = [(s, ids[p].as_py()) for s, p in zip(got[first].tolist(), places[first].tolist())]
            heaps[i] = heapq.nsmallest(k, heap + new, key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))
