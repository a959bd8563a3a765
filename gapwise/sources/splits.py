"""Text files that are read by many tasks although a place in them depends on all that stands before it.

Spark reads a file in blocks. Each block is summed up by itself, for every state
it may begin in; a running sum over the blocks (a row each) tells the state it
does begin in, and from that follow the numbers and bounds of its records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = ["file", "block"]
#: Pieces of a block of a file are taken in runs of 2^RUN, so that no task gets a whole block of a file.
RUN = 14


def pieces(spark: SparkSession, path: str, sep: str = "\n", encoding: str = "UTF-8") -> DataFrame:
    """(file, block, at, text): the file's text between separators; ``block`` (where Spark's block starts, run in it) rises within a file, ``at`` within a block."""
    rows = spark.read.option("lineSep", sep).text(path)
    text = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), text.alias("text"))
    return rows.select("file", F.struct("start", F.shiftright("at", RUN).alias("run")).alias("block"), "at", "text")


def _inside(to: int) -> Window:
    return Window.partitionBy(*BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, to)


def _before(c: Column) -> Column:
    """The sum of ``c`` over the blocks of a file before this one."""
    return F.coalesce(F.sum(c).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (file, block, at, ...) with row_index, their place in the file from 0 on."""
    first = rows.groupBy(*BLOCK).agg(F.count("*").alias("n")).select(*BLOCK, _before(F.col("n")).alias("first"))
    own = rows.withColumn("own", F.count("*").over(_inside(0)))
    return own.join(first, BLOCK).withColumn("row_index", F.col("first") + F.col("own") - 1).drop("first", "own")


def _joined(parts: DataFrame, sep: str) -> DataFrame:
    """(file, row_index, text): the parts of each record in file order."""
    texts = F.array_sort(F.collect_list(F.struct("block", "at", "text")))
    return parts.groupBy("file", "row_index").agg(F.array_join(F.transform(texts, lambda x: x["text"]), sep).alias("text"))


def csv_records(lines: DataFrame, quote: str = '"') -> DataFrame:
    """(file, row_index, text) of the records of CSV ``lines``; a line feed in quotes belongs to its record.

    A line starts a record where an even number of quotes stands before it. Each
    block counts such lines for both cases, even and odd. Only records of
    several lines are put together by grouping; a quote that is never closed
    takes all that follows into its record, as CSV has it.
    """
    quotes = F.length("text") - F.length(F.replace(F.col("text"), F.lit(quote), F.lit("")))
    x = lines.withColumn("quotes", quotes)
    x = x.withColumn("odd", F.coalesce(F.sum("quotes").over(_inside(-1)), F.lit(0)) % 2)
    sums = x.groupBy(*BLOCK).agg(F.sum("quotes").alias("q"), F.count_if(F.col("odd") == 0).alias("n0"), F.count_if(F.col("odd") == 1).alias("n1"))
    sums = sums.withColumn("state", _before(F.col("q")) % 2)
    sums = sums.select(*BLOCK, "state", _before(F.when(F.col("state") == 0, F.col("n0")).otherwise(F.col("n1"))).alias("first"))
    x = x.join(sums, BLOCK).withColumn("starts", F.col("odd") == F.col("state"))
    x = x.withColumn("row_index", F.col("first") + F.count_if("starts").over(_inside(0)) - 1)
    alone = F.col("starts") & (F.col("quotes") % 2 == 0)
    many = _joined(x.where(~alone), "\n")
    return x.where(alone).select("file", "row_index", "text").unionAll(many).withColumn("text", F.regexp_replace("text", "\r$", ""))


def json_objects(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """(file, row_index, text) of the objects of a JSON file that stand inside ``depth`` others.

    The file is read in pieces that end with a closing brace. Braces count
    outside strings only: a piece's braces are counted for both cases, that it
    begins inside a string or not, and which one holds follows from the quotes
    before it. An object ends with the piece after which ``depth`` are open.
    """
    x = pieces(spark, path, "}")
    plain = F.split(F.regexp_replace("text", r"\\.", ""), '"', -1)  # without escapes; every second part is inside a string
    count = lambda odd: F.aggregate(F.filter(plain, lambda s, i: i % 2 == odd), F.lit(0), lambda n, s: n + F.length(s) - F.length(F.replace(s, F.lit("{"), F.lit(""))))
    x = x.withColumns({"quotes": F.size(plain) - 1, "open0": count(0), "open1": count(1)})
    x = x.withColumn("odd", F.coalesce(F.sum("quotes").over(_inside(-1)), F.lit(0)) % 2)
    closes = lambda state: F.when((F.col("odd") + state + F.col("quotes")) % 2 == 0, 1).otherwise(0)
    opens = lambda state: F.when((F.col("odd") + state) % 2 == 0, F.col("open0")).otherwise(F.col("open1"))
    x = x.withColumns({"step0": opens(F.lit(0)) - closes(F.lit(0)), "step1": opens(F.lit(1)) - closes(F.lit(1))})
    sums = x.groupBy(*BLOCK).agg(F.sum("quotes").alias("q"), F.sum("step0").alias("s0"), F.sum("step1").alias("s1"))
    sums = sums.withColumn("state", _before(F.col("q")) % 2)
    sums = sums.select(*BLOCK, "state", _before(F.when(F.col("state") == 0, F.col("s0")).otherwise(F.col("s1"))).alias("height"))
    x = x.join(sums, BLOCK).withColumn("step", F.when(F.col("state") == 0, F.col("step0")).otherwise(F.col("step1")))
    x = x.withColumn("after", F.col("height") + F.sum("step").over(_inside(0)))
    x = x.withColumn("ends", (F.col("after") == depth) & (closes(F.col("state")) == 1))
    n = x.groupBy(*BLOCK).agg(F.count_if("ends").alias("n")).select(*BLOCK, _before(F.col("n")).alias("first"))
    x = x.join(n, BLOCK).withColumn("row_index", F.col("first") + F.coalesce(F.count_if("ends").over(_inside(-1)), F.lit(0)))
    # what follows the last object ends none
    last = x.groupBy("file").agg(F.count_if("ends").alias("all"))
    whole = _joined(x.join(F.broadcast(last), "file").where("row_index < all").select("file", "block", "at", "row_index", "text"), "}")
    skip = r'^(?:[^{"]|"(?:[^"\\]|\\.)*")*+'
    text = F.regexp_replace(F.concat("text", F.lit("}")), skip, "")
    for _ in range(depth):  # the first object has the braces of those around it before its own
        text = F.when(F.col("row_index") == 0, F.regexp_replace(F.substring(text, 2, 2**31 - 1), skip, "")).otherwise(text)
    return whole.select("file", "row_index", text.alias("text"))
