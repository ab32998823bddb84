"""URL rules as a sort-merge range join over reversed-host keys.

A key is a host with its labels reversed, the byte FE, and a path; FE and FF are in no UTF-8 text. A rule
fits a url if the host is the url's or one above it and the path begins with the rule's, so for one of
the url's hosts above (its own included) the key begins with the rule's: the rule is the interval of keys
from its own up to its own and FF. Intervals nest or are disjoint. A sweep over the sorted keys of rules
and urls keeps a stack of the open rules; as each rule knows the one around it, the top of the stack is
all that the sweep has to carry: a start puts the rule there, an end the rule around it. The longest of
the rules found for a url's hosts wins.

Only hosts above that may have rules become keys: those of no more labels than any rule's host, and with
their bit set in a bitmap of the rules' hosts, which has a fixed size; besides it only one row per partition
is broadcast. Other urls are not moved. Keys are dealt by range with a spread inside equal keys,
so one host holding a third of all urls is cut over many tasks; what is open at the start of a partition
comes from the partitions before it. No rule set is collected, whatever its size.

Defined results: a null url, or one without ``://``, has empty host and path; a url that no rule fits gets
a null rule and the default verdict; rules repeated for the same host and path: the smallest verdict string
holds, a null one only if there is no other; a rule with a null host or path fits nothing; of two rules of
equal length the smaller rule string wins; null and repeated ids stay as they are; urls may be of any
length; other columns are left out, whatever their names; no rules leave the default, no pages no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.plans.tables import materialise

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"
#: Bits of the map of rules' hosts: 128 KB, a constant of the plan.
BITMAP_BITS = 1 << 20


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return (
        ascii_lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1)),
        F.regexp_extract(rest, r"\A[^/?#]*(/[^?#]*)?", 1),
    )


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _key(host: Column, path: Column) -> Column:
    return F.concat(F.encode(_reversed(host), "UTF-8"), F.lit(b"\xfe"), F.encode(path, "UTF-8"))


def _slot(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(BITMAP_BITS)) + 1


def _around(rules: DataFrame) -> DataFrame:
    """``rules`` with ``outer``: the longest other rule of the host whose path the rule's begins with."""
    sizes = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("sizes"))  # no more than there are lengths of paths
    inner = rules.join(sizes, "host").select("host", "path", F.explode(F.filter("sizes", lambda n: n < F.length("path"))).alias("n"))
    inner = inner.withColumn("start", F.left("path", F.col("n")))
    known = rules.select("host", F.col("path").alias("start"), F.col("best").alias("outer"))
    outer = inner.join(known, ["host", "start"]).groupBy("host", "path").agg(F.max_by("outer", "n").alias("outer"))
    return rules.join(outer, ["host", "path"], "left")


def _events(rules: DataFrame) -> DataFrame:
    """(key, top): the innermost open rule from each key on, for every start and end of a rule's interval."""
    own = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    own = own.select("host", "path", F.struct((-F.length(rule)).alias("size"), rule.alias("rule"), "verdict").alias("best"))  # the least is the best
    both = _around(own).select(_key(F.col("host"), F.col("path")).alias("key"), "best", "outer")
    end = F.concat("key", F.lit(b"\xff"))
    return both.select("key", F.struct(F.col("best").alias("best")).alias("top")).unionByName(both.select(end.alias("key"), F.struct(F.col("outer").alias("best")).alias("top")))


def _hosts_above(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` with ``above``: the hosts that may have rules, from a url's own upwards."""
    bits = rules.select(_slot(F.col("host")).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("b"))
    packed = bytearray(BITMAP_BITS // 8)
    for r in bits.toLocalIterator():  # BITMAP_BITS / 32768 rows of 4 KB at most
        packed[(r["k"] - 1) * 4096 : r["k"] * 4096] = r["b"]
    most = rules.agg(F.max(F.size(F.split("host", r"\.", -1))).alias("most")).first()["most"] or 0
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    above = F.transform(F.sequence(F.lit(1), F.least(labels, F.lit(max(1, most)))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))

    def known(host: Column) -> Column:
        at = F.pmod(F.xxhash64(host), F.lit(BITMAP_BITS))
        byte = F.conv(F.hex(F.substring(F.lit(bytes(packed)), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0

    return urls.withColumn("above", F.filter(above, known))


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per page: id, host, path, rule, verdict. ``rules`` has host, path and verdict."""
    host, path = split_url(F.col(url_col))
    rules = rules.where("host is not null and path is not null")
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = _hosts_above(urls, rules).withColumn("row", F.monotonically_increasing_id())
    asked = urls.where(F.size("above") > 0).withColumn("above", F.explode("above"))
    asked = asked.select("row", "id", "host", "path", _key(F.col("above"), F.col("path")).alias("key"), F.lit(1).alias("is_url"), F.xxhash64("row").alias("spread"))
    events = _events(rules).withColumns({"is_url": F.lit(0), "spread": F.lit(0).cast("long")})
    both = asked.unionByName(events, allowMissingColumns=True)
    dealt = materialise(both.repartitionByRange("key", "is_url", "spread").withColumn("part", F.spark_partition_id()), "url-ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (  # one row per partition
        dealt.groupBy("part")
        .agg(F.max_by("top", F.when(F.col("is_url") == 0, F.col("key"))).alias("last"))
        .select("part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    )
    sweep = Window.partitionBy("part").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("open", F.last("top", ignorenulls=True).over(sweep)).where("is_url = 1").join(F.broadcast(carried), "part")
    found = swept.select("row", "id", "host", "path", F.coalesce("open", "carried")["best"].alias("best"))
    found = found.groupBy("row").agg(*[F.first(c).alias(c) for c in ("id", "host", "path")], F.min("best").alias("best")).drop("row")
    rest = urls.where(F.size("above") == 0).select("id", "host", "path", F.lit(None).cast(found.schema["best"].dataType).alias("best"))
    return found.unionByName(rest).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every url of pages against RULES."""
    values = ", ".join(str(rule) for rule in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP9_SQL = r"""
WITH r AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM r),
rules(h, pre, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (
  SELECT page_id, h || pre AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(pre) DESC) AS k
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN f ON p.page_id = f.page_id AND k = 1
"""
