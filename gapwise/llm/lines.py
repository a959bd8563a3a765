"""Line dedup by deletion neighbourhoods, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of what a shared half leaves open; a part of a longer line has at most LONG characters or a root of the half's.
PARTS, LONG = 8, 128
#: The widest class of lengths.
WIDEST = 32


def _words() -> Column:
    """Whether the cell ``line`` holds anything but ASCII white space."""
    return F.col("line").rlike("[^\\x20\\x09-\\x0D]")


def _least_of_class(n: Column) -> Column:
    """The least length of n's class; there are 32 classes between powers of two, or more: none is wider than WIDEST."""
    width = F.least(F.lit(WIDEST), F.greatest(F.lit(1), F.shiftright(F.lit(1) * F.pow(F.lit(2), F.length(F.bin(n)) - 1).cast("int"), 5)))
    return n - n % width


def near_lines(docs: DataFrame, least: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents as id, row, text, carried columns; per row the numbers of the lines that stay, of those with a word).

    See ``dedup_lines``. Three steps keep the neighbourhoods small. A pair
    within one edit has an equal first or last half, so halves are hashed first
    and only lines that share one go on; the rest of such a line is again cut in
    ``PARTS``, of which all but one must be equal; only what stands in the place
    of that one, a few characters, gives its deletion variants. Lengths go by
    classes, so that halves and parts of lines that differ by a character fall
    alike; a line at the edge of a class is in both. No step drops a pair.
    """
    i, t = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = docs.select(i.alias("id"), F.xxhash64(i, t).alias("row"), t.alias("text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)])
    more = [f"c{k}" for k in range(len(carry))]
    lines = own.select("id", "row", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).where(_words())
    lines = lines.withColumns({"h": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line"), "n": F.length("line")})
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "no")
    firsts = lines.groupBy("h", "h2").agg(F.min(place).alias("p"))

    # halves: keys that two different lines share
    m = _least_of_class(F.col("n"))
    m1 = _least_of_class(F.col("n") - 1)
    halves = lines.where(F.col("n") >= least).select("h", "h2", "line", "n", F.explode(F.when(m == m1, F.array(m)).otherwise(F.array(m, m1))).alias("m"))
    tail, head = F.expr("substring(line, n - (m - ceil(m / 2)) + 1, m - ceil(m / 2))"), F.expr("substring(line, 1, ceil(m / 2))")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.xxhash64("m", F.lit(0), tail).alias("key")), F.struct(F.lit(1).alias("side"), F.xxhash64("m", F.lit(1), head).alias("key")))
    halves = halves.select("h", "h2", "m", F.explode(sides).alias("s")).groupBy("s.key", "h", "h2").agg(F.min(F.col("m") * 2 + F.col("s.side")).alias("ms"))
    # both uses of an exchange need all its columns, or the optimizer prunes one and Spark cannot reuse it
    shared = halves.groupBy("key").agg(F.count("*").alias("size"), F.min("ms").alias("ms")).where("size > 1 and ms >= 0").select("key")
    asked = halves.join(shared, "key").join(firsts, ["h", "h2"])
    ask = F.struct(F.col("p.no").alias("no"), F.expr("int(ms div 2)").alias("m"), F.expr("int(ms % 2)").alias("side"), "key")
    asked = asked.select(F.col("p.row").alias("row"), ask.alias("ask")).groupBy("row").agg(F.collect_list("ask").alias("asks"))

    # the other half in parts; own is always 0, so that rows of one document that differ in carried columns have
    # the same places, but reads all columns, so that the exchange of texts stays the one that the result uses
    held = own.repartition("row")
    found = held.join(asked.hint("shuffle_hash"), "row").select("id", "row", F.pmod(F.xxhash64("id", *more), F.lit(1)).alias("own"), F.split("text", "\n", -1).alias("all"), "asks")
    found = found.select("id", "row", "own", F.explode(F.expr("transform(asks, a -> struct(a.no as no, a.m as m, a.side as side, a.key as key, all[a.no] as line))")).alias("a"))
    opened = found.select("id", "row", "own", "a.no", "a.key", "a.side", "a.m", "a.line", F.length("a.line").alias("n"), F.ceil(F.col("a.m") / 2).cast("int").alias("half"))
    gap = F.when(F.col("side") == 0, F.expr("substring(line, 1, n - (m - half))")).otherwise(F.expr("substring(line, half + 1)"))
    # side 0 leaves at least the first half, side 1 at least the rest. Very long lines get more parts: parts that
    # are as long as they are many, so that neither their hashes nor their variants grow with the line's square
    step = F.greatest(F.lit(4), F.least(F.ceil(F.col("half") / PARTS), F.greatest(F.lit(LONG), F.ceil(F.sqrt("half"))))).cast("int")
    opened = opened.select("id", "row", "own", "no", "key", "n", gap.alias("gap"), F.when(F.col("side") == 0, F.col("half")).otherwise(F.col("m") - F.col("half")).alias("base"), step.alias("step"))
    opened = opened.withColumn("part", F.explode(F.expr("sequence(0, greatest(0, int(ceil(base / step)) - 1))")))
    opened = opened.select("id", "row", "own", "no", "key", "n", "gap", "part", F.expr("part * step").alias("before"), F.expr("greatest(0, base - (part + 1) * step)").alias("after"), F.length("gap").alias("g"))
    opened = opened.select("id", "row", F.xxhash64("own", "row", "no").alias("line"), "no", "n", F.expr("xxhash64(key, part, substring(gap, 1, before), substring(gap, g - after + 1, after))").alias("key"), F.expr("substring(gap, before + 1, g - before - after)").alias("rest"))
    several = opened.groupBy("key").agg(F.min("line").alias("x"), F.max("line").alias("y")).where("x <> y").select("key")
    # with line, which reads all columns of the document: see above on exchanges
    opened = opened.join(several, "key").select(F.struct(F.col("id").isNull().alias("none"), "id", "row", "no", "line").alias("p"), "n", "key", "rest")

    # deletion variants: the place of a change of one character, or the string without one
    variants = opened.withColumn("at", F.explode(F.expr("sequence(0, length(rest))")))
    less = F.expr("concat(substring(rest, 1, at - 1), substring(rest, at + 1))")
    kinds = F.when(F.col("at") == 0, F.array(F.struct(F.lit(0).alias("kind"), F.xxhash64("key", F.lit(-1), "n", "rest").alias("v")))).otherwise(
        F.array(F.struct(F.lit(1).alias("kind"), F.xxhash64("key", F.lit(-1), F.col("n") - 1, less).alias("v")), F.struct(F.lit(2).alias("kind"), F.xxhash64("key", "at", "n", less).alias("v")))
    )
    variants = variants.withColumn("x", F.explode(kinds)).select("p", "rest", "x.kind", "x.v")
    # kind 2 meets kind 2 of its place; kind 0, a whole string, meets kind 1 of strings that are longer by one
    first_of = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("p", "rest"))).alias(f"f{kind}")
    groups = variants.groupBy("v").agg(F.count("*").alias("size"), first_of(0), first_of(1), first_of(2)).where("size > 1")
    met = variants.join(groups, "v").withColumn("f", F.when(F.col("kind") == 0, F.col("f1")).when(F.col("kind") == 1, F.col("f0")).otherwise(F.col("f2")))
    near = met.where((F.col("f.p") < F.col("p")) & (F.levenshtein(F.col("f.rest"), F.col("rest"), 1).between(0, 1))).select("p").distinct()

    gone = near.select(F.col("p.row").alias("row"), F.col("p.no").alias("no")).groupBy("row").agg(F.collect_set("no").alias("gone"))
    stay = firsts.select(F.col("p.row").alias("row"), F.col("p.no").alias("no")).groupBy("row").agg(F.collect_list("no").alias("stay"))
    stay = stay.join(gone, "row", "left").select("row", F.when(F.col("gone").isNull(), F.col("stay")).otherwise(F.array_except("stay", "gone")).alias("stay"))
    return held, stay


def dedup_lines(docs: DataFrame, least: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove lines that an earlier line repeats with at most one edit.

    Lines are what stands between line feeds; earlier is a smaller id (null ids
    last; texts of equal ids by a hash), or a smaller line number of the same
    text. A line with a word goes if an earlier line of any document, removed or
    not, is equal, or if the line has ``least`` characters and an earlier line
    is within one inserted, removed or changed character (Levenshtein distance
    1). Lines without a word stay and remove nothing. Lines are equal if their
    128-bit hashes are, near if the hashes of their neighbourhoods meet and the
    edit distance of the rest that differs is at most one.

    Returns per row: id, n_lines, n_removed, kept_text (the lines that stay,
    joined by line feeds; empty if none does), and the columns named in ``carry``
    (of types that can be hashed). A null text is empty: one line
    without a word. Rows that repeat id and text are one document and are
    returned as often, with the same result. No rows give no rows. Lines may
    have millions of characters: the work for a line of n grows as n times the
    root of n, and only if another line shares one of its halves.
    """
    held, stay = near_lines(docs, least, id_col, text_col, carry)
    x = held.join(stay.hint("shuffle_hash"), "row", "left").withColumn("all", F.split("text", "\n", -1))
    # lines without a word stay too
    blank = F.expr("filter(transform(all, (line, k) -> if(line rlike '[^\\\\x20\\\\x09-\\\\x0D]', -1, k)), k -> k >= 0)")
    keep = F.array_sort(F.concat(F.coalesce("stay", F.array().cast("array<int>")), blank))
    x = x.withColumn("keep", keep)
    return x.select(F.col("id").alias(id_col), F.size("all").cast("long").alias("n_lines"), (F.size("all") - F.size("keep")).cast("long").alias("n_removed"), F.expr("array_join(transform(keep, k -> all[k]), '\n')").alias("kept_text"), *[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)])
