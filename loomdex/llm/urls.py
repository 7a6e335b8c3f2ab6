"""URL filters with dated lists: which entries were active when a capture was fetched.

List entries are dated additions and removals of hosts, domains and URL
prefixes. Per entry they become validity intervals, cut at the borders of
periods; a capture probes its host, its parent domains and its path prefixes in
the period of its fetch, and an as-of join finds the one interval that holds
the moment. Only column functions and equality joins are used: an entry with
very many changes is spread over periods, and the interval table is stored
first, so that a host with a third of all captures can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.session import materialize

#: Days of a period.
PERIOD = 30


def host_of(url: Column) -> Column:
    """Lower-case host without user, port, a leading www. and a final dot; empty where there is none."""
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), "\\.$", "")


def path_of(url: Column) -> Column:
    """The path with its leading slash, without query and fragment."""
    return F.concat(F.lit("/"), F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1))


def period_of(moment: Column, days: int) -> Column:
    return F.floor(F.unix_timestamp(moment) / F.lit(86400 * days)).cast("long")


def intervals(entries: DataFrame, days: int = PERIOD) -> DataFrame:
    """(kind, value, since, until, period) of listed intervals from (kind, value, action, at); until is null while open.

    ``action`` is 'add' or 'remove'; of two at one moment the removal holds.
    Repeated additions and removals change nothing. Rows with nulls or another
    action are skipped. ``period`` is the one in which the interval begins.
    """
    known = entries.where("kind is not null and value is not null and at is not null and action in ('add', 'remove')")
    steps = known.groupBy("kind", "value", "at").agg(F.max("action").alias("action")).withColumn("period", period_of(F.col("at"), days))
    firsts = materialize(steps.groupBy("kind", "value", "period").agg(F.min("at").alias("first")), "firsts")
    nexts = firsts.withColumn("next_first", F.lead("first").over(W.partitionBy("kind", "value").orderBy("period"))).drop("first")
    within = F.lead("at").over(W.partitionBy("kind", "value", "period").orderBy("at"))
    timed = steps.withColumn("next", within).join(nexts, ["kind", "value", "period"])
    return timed.where("action = 'add'").select(
        "kind", "value", F.col("at").alias("since"), F.coalesce("next", "next_first").alias("until"), "period")


def probes(host: Column, path: Column, depth: int) -> Column:
    """All (kind, value) that can list a URL: its host, each domain above it, each path prefix of at most ``depth`` parts."""
    parts = F.split(host, "\\.")
    steps = F.split(path, "/")
    one = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value")))
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("value")))
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(steps) - 1, F.lit(max(1, depth)))), lambda i: F.struct(
        F.lit("prefix").alias("kind"), F.concat(host, F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")).alias("value")))
    return F.concat(one, domains, prefixes)


def evaluate(captures: DataFrame, entries: DataFrame, days: int = PERIOD, keep: tuple[str, ...] = ("page_id", "url", "fetched_at")) -> DataFrame:
    """Columns ``keep`` of ``captures`` (url, fetched_at, ...), host, n_entries, entry_kind, entry, listed_since, blocked.

    A capture is blocked if an entry (kind, value, action, at) lists its host
    ('host'), its host or a domain above it ('domain'), or a beginning of host and
    path up to a slash ('prefix') at the moment of the fetch; an interval holds
    from its addition up to, not with, its removal. The entry named is the
    longest, then the first by kind and value. Null or hostless URLs and null
    times meet no entry and are not blocked; repeated rows give repeated rows;
    without captures there are no rows, without entries nothing is blocked.
    """
    listed = materialize(intervals(entries, days), "intervals")
    depth = listed.where("kind = 'prefix'").agg(
        F.max(F.length("value") - F.length(F.replace("value", F.lit("/"), F.lit(""))))).first()[0] or 0
    rows = captures.select(*keep, F.col("url").alias("_url"), F.col("fetched_at").alias("_at"))
    asked = rows.where("_url is not null and _at is not null").select("_url", "_at").distinct().withColumn("host", host_of(F.col("_url")))
    asked = asked.where("host <> ''")
    last = asked.agg(F.max("_at")).first()[0]
    if last is not None:
        # an interval answers for every period it touches up to the last capture
        ends = period_of(F.least(F.coalesce("until", F.lit(last)), F.lit(last)), days)
        listed = listed.where(F.col("since") <= F.lit(last)).withColumn("period", F.explode(F.sequence("period", F.greatest("period", ends))))
    listed = materialize(listed, "periods")
    asked = asked.withColumn("period", period_of(F.col("_at"), days)).select(
        "_url", "_at", "period", F.inline(probes(F.col("host"), path_of(F.col("_url")), depth)))
    met = asked.join(listed, ["kind", "value", "period"]).where(
        (F.col("_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("_at") < F.col("until"))))
    best = F.min_by(F.struct("kind", "value", "since"), F.struct(-F.length("value"), F.col("kind"), F.col("value")))
    found = materialize(met.groupBy("_url", "_at").agg(F.count("*").alias("n"), best.alias("best")), "met")
    return rows.join(found, ["_url", "_at"], "left").select(
        *keep, host_of(F.coalesce("_url", F.lit(""))).alias("host"), F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"),
        F.col("best.kind").alias("entry_kind"), F.col("best.value").alias("entry"), F.col("best.since").alias("listed_since"),
        F.col("n").isNotNull().alias("blocked"))


def number(key: Column, salt: str) -> Column:
    """A repeatable number below 2^24 for a key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 6), 16, 10).cast("int")


def captured(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at): the given pages name no time, so each gets a moment of 2024 from its id."""
    seconds = number(F.col("page_id"), "t") * F.lit(366 * 86400 // (1 << 24) + 1)
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + seconds % F.lit(366 * 86400)).alias("fetched_at"))


def drawn_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, domains and first path parts of the pages themselves.

    Every third host, every seventh first path part of a host, and every fifth
    parent domain's subdomains are added on a day of 2024 and removed up to 120 days later; some are
    added again for good.
    """
    host = host_of(F.coalesce("url", F.lit("")))
    part = F.concat(host, F.lit("/"), F.split(path_of(F.col("url")), "/")[1], F.lit("/"))
    names = pages.select(F.inline(F.array(
        F.struct(F.lit("host").alias("kind"), host.alias("value"), F.lit(3).alias("every")),
        F.struct(F.lit("prefix").alias("kind"), part.alias("value"), F.lit(7).alias("every")),
        F.struct(F.lit("domain").alias("kind"), F.regexp_extract(host, "[^.]+\\.(.+)", 1).alias("value"), F.lit(5).alias("every")),
    ))).where("value is not null and value not in ('', '/', '//')").distinct()
    some = names.where(number(F.col("value"), "s") % F.col("every") == 0)
    day = number(F.col("value"), "d") % F.lit(366)
    days = [(day, "add"), (day + 1 + number(F.col("value"), "r") % F.lit(120), "remove")]
    steps = [F.struct(F.lit(a).alias("action"), F.timestamp_seconds(F.lit(1704067200) + d * F.lit(86400)).alias("at")) for d, a in days]
    again = F.struct(F.lit("add").alias("action"), F.timestamp_seconds(F.lit(1704067200) + (day + 150) * F.lit(86400)).alias("at"))
    return some.select("kind", "value", F.inline(F.when(number(F.col("value"), "a") % F.lit(2) == 0, F.array(*steps, again)).otherwise(F.array(*steps))))
