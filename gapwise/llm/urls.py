"""URL rules by a range join over reversed hosts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, then up to ``?``, ``#`` or the end.

    A-Z of the host are lower-cased. A null, or a text without ``://``, has an empty host and path.
    """
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substring(rest, F.length(host) + F.lit(1), F.length(rest))


def _reversed(host: Column) -> Column:
    """Labels of a host, the last one first."""
    return F.reverse(F.split(host, "\\.", -1))


def rule_table(rules: DataFrame) -> DataFrame:
    """(h, path, rule) of each different rule: its reversed host, its path, and what it gives.

    A rule is a host, then a path from the first ``/`` on. Of rules that repeat
    host and path the one with the greatest verdict stays (block before allow);
    a null, or a rule without a host, fits nothing and goes.
    """
    host = F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER)
    x = rules.select(host.alias("host"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("path"), F.col("verdict"))
    x = x.where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    size = F.length("host") + F.length("path")
    found = F.struct(size.alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    return x.select(F.array_join(_reversed(F.col("host")), ".").alias("h"), F.size(_reversed(F.col("host"))).alias("labels"), "path", found.alias("rule"))


def innermost(events: DataFrame) -> DataFrame:
    """(h, k, rule) of each probe among ``events`` that lies in a rule's interval: the innermost one.

    ``events`` has h, k (bytes of a path), kind (0 the start of a rule, 1 a
    probe, 2 the end of a rule) and rule. In the order of (h, k, kind) they are
    swept in ranges: the sum of starts less ends is the height of the stack of
    open rules, and its top is the last rule that was opened at that height.
    Intervals of prefixes nest, so nothing else can be on top. Each range
    takes the height, and the rules left open at each height, from the ranges
    before it; those are at most a row a range and height.
    """
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = cut(events.repartitionByRange(n, "h", "k", "kind").withColumn("range", F.spark_partition_id()))
    step = F.when(F.col("kind") == 0, 1).when(F.col("kind") == 2, -1).otherwise(0)
    order = ["h", "k", "kind"]
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    heights = events.groupBy("range").agg(F.sum(step).alias("d")).select("range", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("low"))
    own = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("height", F.sum(step).over(own)).join(heights, "range").withColumn("height", F.col("height") + F.col("low")).where("kind < 2")
    left = swept.groupBy("range", "height").agg(F.max(F.when(F.col("kind") == 0, F.struct(*order, "rule"))).alias("open"))
    earlier = Window.partitionBy("height").orderBy("range").rangeBetween(Window.unboundedPreceding, -1)
    left = left.select("range", "height", F.last("open", True).over(earlier)["rule"].alias("carried"))
    stack = Window.partitionBy("range", "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    top = swept.withColumn("top", F.last("rule", True).over(stack)).where("kind = 1 and height > 0")
    return top.join(left, ["range", "height"]).select("h", "k", F.coalesce("top", "carried").alias("rule"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url by the longest of ``rules`` (rule, verdict) that fits it.

    A rule such as ``example.org/en/`` fits its host and all subdomains, if the
    url's path starts with the rule's. The longest rule in characters wins, of
    equally long ones the one with the longer host; urls that none fits get
    ``default``. Returns id, host, path, rule (or null) and verdict per row.

    Each url asks once for its host and for each domain above it that rules
    can name, with its path cut to the longest one of that domain's rules, so
    that urls of a busy host meet as few keys; only different ones are swept
    (``innermost``). A null url, or one without ``://``, has an empty host and
    path and gets ``default``. Ids may be null or repeat: each row is judged.
    Urls of any length are read whole. No rows or no rules are fine. Other
    columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    table = rule_table(rules)
    most = table.agg(F.max("labels")).first()[0] or 0
    domains = table.groupBy("h").agg(F.max(F.length("path")).alias("longest"))
    names = F.expr(f"transform(sequence(1, least({max(most, 1)}, size(labels))), n -> array_join(slice(labels, 1, n), '.'))")
    urls = rows.where("host <> ''").select("host", "path").distinct().withColumn("labels", _reversed(F.col("host")))
    asked = urls.select("host", "path", F.explode(names).alias("h")).join(domains, "h")
    asked = asked.select("host", "path", "h", F.expr("substring(path, 1, longest)").cast("binary").alias("k"))
    kind = table.schema["rule"].dataType.simpleString()
    probes = asked.select("h", "k").distinct().select("h", "k", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("rule"))
    starts = table.select("h", F.col("path").cast("binary").alias("k"), F.lit(0).alias("kind"), "rule")
    ends = table.select("h", F.concat(F.col("path").cast("binary"), F.unhex(F.lit("FF"))).alias("k"), F.lit(2).alias("kind"), F.lit(None).cast(kind).alias("rule"))
    found = innermost(probes.unionByName(starts).unionByName(ends))
    best = asked.join(found, ["h", "k"]).groupBy("host", "path").agg(F.max("rule").alias("found"))
    # with the hash as a key both sides are exchanged anew, and AQE can split a url that many rows have
    by = F.xxhash64("host", "path").alias("by")
    out = rows.withColumn("by", by).join(best.withColumn("by", by), ["by", "host", "path"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))


#: The rules of the contract.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def contract_rules(spark) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{r}', '{v}')" for r, v in RULES) + " AS rules(rule, verdict)")
