"""Temporal list join: was a captured address on a list at the moment it was fetched?

Lists are logs of dated entries (list, kind, key, action ``add`` or ``remove``, time). A log becomes
validity intervals, half open in time; a capture is held against the intervals of its own keys. The
as-of join is an equality on (kind, key, time slot) with the interval as residual: an interval
stands once in every slot it touches, so a host with a third of all captures is split over its
slots and, where one slot is still hot, by the skew join. Nothing but built-in columns is used.

Defined results: entries with a null list, kind, key, action or time are ignored, as are unknown
actions; of several entries for a key at one instant ``remove`` wins; repeats change nothing; a
capture with a null address or time is on no list; captures keep their number, order aside, and
every column, whatever its name. An empty log lists nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free

SLOT_SECONDS = 30 * 86400
#: An open interval ends here (9999-12-31); the slots of a join only reach to the last capture.
OPEN_END = 253402214400
#: The most exact kind of a match comes first.
KINDS = ("url", "prefix", "host", "domain")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def address_of(url: Column) -> Column:
    """Host and path with query: no scheme, user, port or fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    return F.concat(host_of(url), F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", ""))


def keys_of(url: Column) -> Column:
    """Every (kind, key) under which a list may hold the address."""
    host, address = host_of(url), address_of(url)
    labels, folders = F.split(host, "[.]"), F.split(F.regexp_replace(address, "[?].*$", ""), "/")
    kind = lambda name, key: F.struct(F.lit(name).alias("kind"), key.alias("key"))
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: kind("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    heads = F.transform(F.filter(F.sequence(F.lit(1), F.size(folders)), lambda i: i < F.size(folders)), lambda i: kind("prefix", F.concat(F.array_join(F.slice(folders, F.lit(1), i), "/"), F.lit("/"))))
    return F.when(host != "", F.array_distinct(F.concat(F.array(kind("url", address), kind("host", host)), tails, heads)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, key, since, until): seconds, ``until`` excluded, from a log with the columns list, kind, key, action, at.

    The next entry of a key is sought within its slot, then among the first entries of its later
    slots, so that no key is ordered as a whole.
    """
    log = entries.select("list", "kind", "key", F.lower("action").alias("action"), F.unix_timestamp(F.col("at").cast("timestamp")).alias("since"))
    log = log.filter("list is not null and kind is not null and key is not null and since is not null and action in ('add', 'remove')")
    one = log.groupBy("list", "kind", "key", "since").agg(F.max("action").alias("action")).withColumn("slot", F.floor(F.col("since") / SLOT_SECONDS))
    name = ["list", "kind", "key"]
    later = one.groupBy(*name, "slot").agg(F.min("since").alias("first"))
    later = later.select(*name, "slot", F.lead("first").over(Window.partitionBy(*name).orderBy("slot")).alias("following"))
    inside = one.withColumn("next", F.lead("since").over(Window.partitionBy(*name, "slot").orderBy("since")))
    return inside.join(later, [*name, "slot"]).filter("action = 'add'").select(*name, "since", F.coalesce("next", "following", F.lit(OPEN_END)).alias("until"))


def lists_at_fetch(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``captures`` with a struct ``active``: the lists an address was on when fetched, sorted, and the most exact kind that matched."""
    (active,) = free(captures, "active")
    own, seconds = F.col(f"`{url}`"), F.unix_timestamp(F.col(f"`{fetched}`").cast("timestamp"))
    facts = captures.select(own.alias("url"), seconds.alias("at")).filter("url is not null and at is not null").distinct()
    keyed = facts.select("url", "at", F.explode(keys_of(F.col("url"))).alias("k")).select("url", "at", "k.kind", "k.key", F.floor(F.col("at") / SLOT_SECONDS).alias("slot"))
    span = facts.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    spans = intervals(entries).filter((F.col("until") > (span.lo or 0)) & (F.col("since") <= (span.hi or 0)))
    spans = spans.withColumn("slot", F.explode(F.sequence(F.floor(F.greatest("since", F.lit(span.lo or 0)) / SLOT_SECONDS), F.floor(F.least(F.col("until") - 1, F.lit(span.hi or 0)) / SLOT_SECONDS))))
    met = keyed.join(spans, ["kind", "key", "slot"]).filter("at >= since and at < until")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    found = met.groupBy("url", "at").agg(F.struct(F.array_sort(F.collect_set("list")).alias("lists"), F.element_at(F.array(*map(F.lit, KINDS)), F.min(rank).cast("int")).alias("kind")).alias(active))
    left, right = free(captures, "_url", "_at")
    found = found.select(F.col("url").alias(left), F.col("at").alias(right), active)
    return captures.join(found, (own == F.col(left)) & (seconds == F.col(right)), "left").drop(left, right)
