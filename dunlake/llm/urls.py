"""URL filters: nested prefix rules judged by a sort-merge sweep over canonical keys, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dunlake.llm.common import shuffle_partitions, stored


def _sep() -> Column:
    """Parts of a host and a path are told apart by a byte that no UTF-8 text has."""
    return F.unhex(F.lit("FE"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(labels: Column) -> Column:
    """Bytes of the host labels from the last to the first, each ended by the separator."""
    return F.aggregate(F.reverse(labels), F.unhex(F.lit("")), lambda key, x: F.concat(key, F.encode(x, "UTF-8"), _sep()))


def _key(labels: Column, path: Column) -> Column:
    """Key of (host labels, path): equal for a rule and an address on the same host, then the path decides."""
    return F.concat(_reversed(labels), _sep(), F.encode(path, "UTF-8"))


def breakpoints(rules: DataFrame) -> DataFrame:
    """Places in key order at which the innermost active rule changes: (key, ord, rule_id; null where none is active).

    Prefix intervals are nested or disjoint. The sweep keeps the stack as its depth: a start pushes, an end pops, and
    after a pop the top is the last rule that was pushed at the depth reached. Intervals of different last labels never
    meet, so each label is swept on its own.
    """
    labels = F.split("host", r"\.")
    keyed = rules.select("rule_id", F.element_at(labels, -1).alias("top"), _key(labels, F.col("path")).alias("low"))
    starts = keyed.select("rule_id", "top", F.col("low").alias("key"), F.length("low").alias("size"), F.lit(1).alias("step"))
    ends = keyed.select(
        F.lit(None).cast("long").alias("rule_id"), "top", F.concat("low", F.unhex(F.lit("FF"))).alias("key"),
        (-F.length("low")).alias("size"), F.lit(-1).alias("step"),
    )
    sweep = Window.partitionBy("top").orderBy("key", "size")
    depth = starts.unionByName(ends).withColumn("depth", F.sum("step").over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
    stack = Window.partitionBy("top", "depth").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    return depth.select("key", F.row_number().over(sweep).alias("ord"), F.last("rule_id", True).over(stack).alias("r"), "depth").select(
        "key", "ord", F.when(F.col("depth") > 0, F.col("r")).alias("rule_id")
    )


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Judge each address by the longest rule that fits it.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains where the path starts with the rule's;
    the longest of host and path together wins, then the longer host, then the smaller text. A rule with a null is no
    rule; of rules with equal host and path the smallest verdict counts. Returns id, host, path, rule (host and path, or
    null) and verdict (the rule's, else ``default``). A null url, or one without ``://``, has an empty host and path, which
    no rule fits unless it is empty itself. Repeated rows are judged each; other columns of either table don't matter.

    Each page gives one probe for every number of labels that some rule has. Probes and the breakpoints of the rules are
    sorted into ranges together, split also by row, so a hot host spreads; the rule active at the start of a range comes
    from one row per range.
    """
    spark = pages.sparkSession
    known = (
        rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.min("verdict").alias("rule_verdict"))
        .withColumn("rule_id", F.xxhash64("host", "path"))
        .withColumn("rule_size", F.length("host") + F.length("path"))
    )
    known = stored(known, "url-rules")
    levels = [r[0] for r in known.select(F.size(F.split("host", r"\.")).alias("n")).distinct().collect()]
    url = F.col(url_col).cast("string")
    addresses = stored(
        pages.select(F.col(id_col).alias("page_id"), F.monotonically_increasing_id().alias("row"), host_of(url).alias("host"), path_of(url).alias("path")),
        "url-addresses",
    )
    labels = F.split("host", r"\.")
    probes = addresses.select("row", "path", labels.alias("labels"), F.explode(F.array(*[F.lit(n) for n in levels] or [F.lit(0)])).alias("n"))
    probes = probes.where(F.size("labels") >= F.col("n")).select(
        _key(F.slice(F.col("labels"), F.greatest(F.size("labels") - F.col("n") + 1, F.lit(1)), F.col("n")), F.col("path")).alias("key"),
        F.lit(2147483647).alias("ord"), "row", F.lit(None).cast("long").alias("rule_id"), F.lit(False).alias("is_rule"),
    )
    marks = breakpoints(known).select("key", "ord", F.lit(-1).cast("long").alias("row"), "rule_id", F.lit(True).alias("is_rule"))
    n = shuffle_partitions(spark)
    ranges = stored(
        probes.unionByName(marks).repartitionByRange(n, "key", "ord", "row").withColumn("part", F.spark_partition_id()), "url-ranges"
    )
    # One row per range: the rule left active by the nearest earlier range that has a breakpoint.
    parts = ranges.groupBy("part").agg(F.max_by(F.struct("rule_id"), F.when(F.col("is_rule"), F.struct("key", "ord"))).alias("left"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("part", F.last("left", True).over(before)["rule_id"].alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "ord").rowsBetween(Window.unboundedPreceding, 0)
    active = F.last(F.when(F.col("is_rule"), F.struct("rule_id")), True).over(sweep)
    hits = (
        ranges.join(F.broadcast(carried), "part")
        .withColumn("now", active)
        .where("not is_rule")
        .select("row", F.when(F.col("now").isNull(), F.col("carried")).otherwise(F.col("now")["rule_id"]).alias("rule_id"))
        .dropna()
    )
    named = hits.join(known.select("rule_id", "host", "path", "rule_verdict", "rule_size"), "rule_id")
    best = named.groupBy("row").agg(
        F.max_by(F.struct(F.concat("host", "path").alias("rule"), "rule_verdict"), F.struct("rule_size", F.length("host"), "host")).alias("best")
    )
    return addresses.join(best, "row", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
