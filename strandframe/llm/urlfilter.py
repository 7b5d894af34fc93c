"""URL filters by a temporal list join: entries in force at the time a page was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, staged


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and final dot; '' if there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r":\d*$", "")), r"\.$", "")


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, category, since, until) from dated ``entries (domain, category, action, dated)``.

    An 'add' is in force from its date until the next entry of its domain and category (without end, if there is
    none); a 'remove' ends one. Of entries of one date a 'remove' wins. Entries with a null field are ignored.
    """
    e = entries.select(F.lower("domain").alias("domain"), "category", F.lower("action").alias("action"), F.col("dated").cast("timestamp").alias("since")).dropna()
    e = e.groupBy("domain", "category", "since").agg(F.max("action").alias("action"))  # 'remove' > 'add'
    order = Window.partitionBy("domain", "category").orderBy("since")
    return e.withColumn("until", F.lead("since").over(order)).where("action = 'add'").select("domain", "category", "since", "until")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures (page_id, url, fetched)`` with host, n_active, matched_domain, category, listed_since and blocked.

    A capture is blocked if its host or a parent domain is in force at its fetch time; the longest such domain is
    named, of several categories the first in order. A null URL or one without host, or a null time, is never blocked.
    Equal captures are each returned. Lists may be large: distinct hosts meet them first, and captures meet only the
    intervals that some host has, salted by row where there are too many of those to broadcast.
    """
    c = captures.select("page_id", "url", F.col("fetched").cast("timestamp").alias("fetched"), host_of(F.col("url")).alias("host"))
    hosts = c.where("host <> ''").select("host").distinct()
    pairs = hosts.select("host", F.posexplode(suffixes(F.col("host"))).alias("depth", "domain"))
    met = pairs.join(staged(intervals(entries), "intervals"), "domain")
    held = staged(met.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("depth", "category", "since", "until", "domain"))).alias("held")), "held")
    seen = join_small(c, held, ["host"], "left")
    active = F.filter(F.coalesce("held", F.array().cast("array<struct<depth:int,category:string,since:timestamp,until:timestamp,domain:string>>")),
                      lambda i: F.coalesce((i["since"] <= F.col("fetched")) & (i["until"].isNull() | (F.col("fetched") < i["until"])), F.lit(False)))
    seen = seen.withColumn("active", active).withColumn("hit", F.get("active", F.lit(0)))
    return seen.select("page_id", "host", "fetched", F.size("active").alias("n_active"), F.col("hit.domain").alias("matched_domain"), F.col("hit.category").alias("category"),
                       F.col("hit.since").alias("listed_since"), (F.size("active") > 0).alias("blocked"))
