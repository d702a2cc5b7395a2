"""URL rules by a sort-merge range join, in DataFrame operations only.

A host's key is its labels in reverse, each ended by a dot (a.example.net: net.example.a.). A rule's host covers the keys
that begin with its own key, the interval from that key up to the same key with its last dot raised to a slash. Such
intervals are nested or apart. A sweep over the sorted keys of distinct hosts and the bounds of the rules keeps the stack
of active nested rules: opening a rule's host pushes it, closing pops back to the enclosing stack. Sorted runs are swept
apart; each starts with the stack that the runs before it leave. Urls then get their host's stack by a join that deals
hot hosts out, and take the longest rule whose path begins theirs (ties: the longer host, then the rule's text).

Null urls and urls without :// have an empty host and path, which no rule fits. Rules without a slash have an empty path,
which fits every path. Repeated rows each count; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.llm._common import buckets_of, cut, join_groups, read
from thicket.llm.exact_dedup import LOWER_AZ, UPPER_AZ

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEFAULT = "allow"


def host_key(host: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    whole = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    pick = lambda k: F.coalesce(F.regexp_extract(url, whole, k), F.lit(""))
    return F.translate(pick(1), UPPER_AZ, LOWER_AZ), pick(2)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """key, stack, below for each host with rules: the rules active at it, and those of the hosts around it."""
    cut_at = F.instr("rule", "/")
    r = rules.select(
        "rule", "verdict",
        F.translate(F.when(cut_at > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")), UPPER_AZ, LOWER_AZ).alias("host"),
        F.when(cut_at > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("").alias("path"),
    ).where("rule is not null").withColumn("key", host_key(F.col("host")))
    item = F.struct(F.length("rule").alias("length"), F.length("host").alias("width"), "rule", "path", "verdict")
    own = cut(r.groupBy("key").agg(F.collect_set(item).alias("own")))
    around = own.select("key", F.explode(F.expr("transform(sequence(1, size(split(key, '[.]')) - 1), i -> substring_index(key, '.', i) || '.')")).alias("outer"))
    nested = around.join(own.withColumnRenamed("key", "outer"), "outer")
    return nested.groupBy("key").agg(
        F.flatten(F.collect_list("own")).alias("stack"), F.flatten(F.collect_list(F.when(F.col("outer") != F.col("key"), F.col("own")))).alias("below")
    )


def sweep(hosts: DataFrame, stacks: DataFrame) -> DataFrame:
    """hosts (host, rows) with the stack of rules active at each."""
    raised = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    events = stacks.select("key", F.lit(1).alias("kind"), "stack").unionByName(stacks.select(raised.alias("key"), F.lit(0).alias("kind"), F.col("below").alias("stack")))
    points = hosts.select(host_key(F.col("host")).alias("key"), F.lit(2).alias("kind"), "host", "rows")
    line = points.unionByName(events, allowMissingColumns=True)
    runs = cut(line.repartitionByRange(buckets_of(hosts.sparkSession), "key").withColumn("run", F.spark_partition_id()))
    last = runs.where("kind < 2").groupBy("run").agg(F.max_by("stack", F.struct("key", "kind")).alias("last"))
    all_runs = runs.select("run").distinct().join(last, "run", "left")
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = all_runs.select("run", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    upto = Window.partitionBy("run").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = runs.join(carried, "run").withColumn("active", F.coalesce(F.last("stack", ignorenulls=True).over(upto), F.col("carried")))
    return swept.where("kind = 2").select("host", "rows", "active")


def url_filter(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """id_column, host, path, rule, verdict of each row. rules: rule (host and path, as example.net/en/), verdict."""
    host, path = parts(F.col(url_column))
    urls = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    hosts = urls.groupBy("host").agg(F.count("*").alias("rows"))
    groups = cut(sweep(hosts, rule_stacks(rules)))
    best = F.expr("array_max(filter(active, r -> startswith(path, r.path)))")
    return join_groups(urls, groups, "host", "rows").withColumn("best", best).select(
        F.col(id_column), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op4_url_filter(spark, sf_dir):
    values = ", ".join(f"('{r}', '{v}')" for r, v in RULES)
    return url_filter(read(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {values} AS t(rule, verdict)"))


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLE_SQL = {
    "op4_url_filter": f"""
WITH u AS (SELECT page_id, url, strpos(url, '://') AS pos FROM pages),
h AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER_AZ}', '{LOWER_AZ}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM h),
r(rule, verdict, rhost, rpath) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
             ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
m AS (SELECT p.page_id, p.host, p.path, r.rule, r.verdict,
             row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1"""
}
