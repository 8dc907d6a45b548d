"""URL filter: sort-merge range join of reversed-host keys with nested rules.

A host's labels in reverse order, each closed by a low separator, make a canonical key. A rule
on a host then covers one interval of keys: the host itself and all its subdomains. Intervals
of different rules nest or are disjoint.

* Rules become boundaries: one where a host's interval opens, one where it closes. Each holds
  the stack of rules that are active from there on, longest rule first.
* URLs and boundaries are sorted together by key, and a sweep carries the last boundary's stack
  to every URL behind it. The top-most rule of the stack whose path fits decides.

The sweep runs per top-level label and part: parts split a hot top-level label evenly by a hash
of the row, whatever the hosts in it, and each part gets the boundaries of its label. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import broadcast_if_small, lower_ascii

#: Label separator within keys and the end of an interval of keys: below any label's characters.
SEPARATOR, BEYOND = "\u0001", "\u0002"
#: URLs of one top-level label that are swept in one task: so many, or so many for each boundary
#: of the label, so that repeating the boundaries in every part stays a small share of the work.
PART_ROWS, ROWS_PER_BOUNDARY = 2_000, 20
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
DEFAULT_VERDICT = "allow"
#: Top-level labels of rules that may be broadcast.
BROADCAST_TOPS = 20_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty if it is null or has no ``://``."""
    at = F.locate("://", url)
    has = F.coalesce(at > 0, F.lit(False))
    rest = F.substring(url, at + 3, F.length(url))
    rest = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.when(has, lower_ascii(host)).otherwise(""), F.when(has, path).otherwise("")


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), SEPARATOR), F.lit(SEPARATOR))


def _top(key: Column) -> Column:
    return F.substring_index(key, SEPARATOR, 1)


def boundaries(rules: DataFrame) -> DataFrame:
    """``key, active`` from ``verdict, rule``: the stack from ``key`` on, longest rule first.

    Hosts are joined with the rules of all their ancestors by equality: as many rows as hosts
    have labels.
    """
    slash = F.locate("/", F.col("rule"))
    host = lower_ascii(F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule")))
    parsed = (
        rules.where("rule is not null and verdict is not null")
        .dropDuplicates(["rule"])
        .select("rule", "verdict", host.alias("rule_host"))
        .withColumn("rule_path", F.when(slash > 0, F.substring("rule", slash, F.length("rule"))).otherwise(""))
        .where("rule_host <> ''")
    )
    own = parsed.groupBy("rule_host").agg(
        F.collect_list(F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("host_size"), "rule", "verdict", "rule_host", "rule_path")).alias("own")
    )
    labels = F.split("host", r"\.")
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.array_join(F.slice(labels, -n, n), "."),
    )
    hosts = own.select(F.col("rule_host").alias("host")).withColumn("up", F.explode(above))
    stacks = (
        hosts.join(own, hosts.up == own.rule_host)
        .groupBy("host")
        .agg(
            F.flatten(F.collect_list("own")).alias("all"),
            F.flatten(F.collect_list(F.when(F.col("up") != F.col("host"), F.col("own")))).alias("outer"),
        )
        .withColumn("host_key", host_key(F.col("host")))
    )
    longest = lambda c: F.sort_array(c, asc=False)
    opens = stacks.select(F.col("host_key").alias("key"), longest(F.col("all")).alias("active"))
    closes = stacks.select(
        F.concat(F.expr("substring(host_key, 1, length(host_key) - 1)"), F.lit(BEYOND)).alias("key"),
        longest(F.col("outer")).alias("active"),
    )
    return opens.union(closes)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``page_id, url``.

    A null URL, or one without ``://``, has an empty host and path, fits no rule and gets the
    default. Of rules of one length the one with the longer host wins; of equal rules any one counts. Repeated rows come back as
    often, null ids stay, an empty table gives an empty result, extra columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    keyed = urls.withColumn("key", host_key(F.col("host"))).withColumn("top", _top(F.col("key")))
    marks = boundaries(rules).withColumn("top", _top(F.regexp_replace("key", BEYOND, SEPARATOR)))
    # a top-level label's parts follow from its number of URLs; labels without rules are not swept
    tops = marks.groupBy("top").agg(F.greatest(F.lit(PART_ROWS), ROWS_PER_BOUNDARY * F.count(F.lit(1))).alias("most"))
    sizes = (
        keyed.groupBy("top").count().join(tops, "top").select("top", F.ceil(F.col("count") / F.col("most")).cast("int").alias("parts"))
    )
    spread = keyed.join(broadcast_if_small(sizes, BROADCAST_TOPS)[0], "top", "left").withColumn(
        "part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("page_id", "path", "host"), F.col("parts")).cast("int")).otherwise(0)
    )
    ruled = marks.join(sizes, "top").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    events = spread.select(
        "top", "part", "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast(marks.schema["active"].dataType).alias("active")
    ).union(
        ruled.select(
            "top", "part", "key", F.lit(0).alias("kind"), F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string"), "active"
        )
    )
    sweep = Window.partitionBy("top", "part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("stack", F.last("active", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.filter(
        "stack",
        lambda r: F.col("path").startswith(r["rule_path"])
        & ((F.col("host") == r["rule_host"]) | F.col("host").endswith(F.concat(F.lit("."), r["rule_host"]))),
    )
    return swept.withColumn("hit", F.get(fits, 0)).select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
    )
