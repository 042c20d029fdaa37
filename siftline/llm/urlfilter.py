"""Dated URL lists: which entries were active when a page was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.llm.common import id_in, id_out

# The widest kinds come first; a page's own address is the narrowest.
KINDS = ("domain", "host", "prefix", "url")


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and last dot; "" if there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*[^/?#:@.])", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_keys(url: Column) -> Column:
    """What list entries can name a URL by: its domains, host, directories, and the address without query.

    Domains are the suffixes of the host by labels, without the last label alone unless it is the
    host. Directories are the root and every prefix of the path by segments, each with and
    without a slash at its end.
    """
    parts = F.struct(
        host_of(url).alias("host"), path_of(url).alias("path"),
        F.split(host_of(url), r"\.").alias("labels"), F.split(path_of(url), "/").alias("steps"),
    )

    def keys(u: Column) -> Column:
        labels, steps = u["labels"], u["steps"]
        named = lambda kind, pattern: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"))
        domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(u["host"], F.array_join(F.slice(steps, 1, i), "/")))
        # The last step is no directory unless it is the root of an address without a path.
        inner = F.slice(prefixes, 1, F.greatest(F.size(steps) - 1, F.lit(1)))
        prefixes = F.array_distinct(F.concat(prefixes, F.transform(inner, lambda p: F.concat(p, F.lit("/")))))
        return F.when(u["host"] != "", F.concat(
            F.transform(domains, lambda d: named("domain", d)), F.transform(prefixes, lambda p: named("prefix", p)),
            F.array(named("host", u["host"]), named("url", F.concat(u["host"], u["path"]))),
        ))

    # Bound to a lambda, the parts are worked out once a URL.
    return F.element_at(F.transform(F.array(parts), keys), 1)


def validity(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until) from dated ``entries`` (list, kind, pattern, action, day).

    An ``add`` holds from its day until the day before the next entry of the same list and
    pattern; of several on one day a ``remove`` wins. ``until`` is exclusive and
    null for an entry still active. Entries with a null anywhere say nothing.
    """
    known = entries.select("list", "kind", "pattern", "day", (F.col("action") != "add").alias("gone")).na.drop()
    daily = known.groupBy("list", "kind", "pattern", "day").agg(F.max("gone").alias("gone"))
    later = Window.partitionBy("list", "kind", "pattern").orderBy("day")
    spans = daily.select("list", "kind", "pattern", F.col("day").alias("since"), F.lead("day").over(later).alias("until"), "gone")
    return spans.where("not gone").drop("gone")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, day, n_entries, blocked, first_list, narrowest) per row of ``captures`` (page_id, url, day).

    n_entries counts the (list, kind, pattern) entries active on the day of the
    fetch that name the URL; narrowest is the kind of the closest of them. Null or
    relative URLs are named by no entry, and a null day meets none. Repeated rows each
    get a row, a null id comes back as null, an empty list blocks nothing.

    The lists are joined as of each day: captures are reduced to the distinct
    (pattern, day) they ask for, so a host with a third of all captures asks once
    a day, and each question meets the few intervals of its pattern only. The answers are
    unique per (pattern, day) and go back to the captures by one equi-join.
    """
    rows = captures.select(id_in("page_id").alias("page_id"), "url", F.col("day").cast("date").alias("day"))
    once = rows.groupBy("page_id", "url", "day").agg(F.count("*").alias("copies"))
    asked = once.select("*", F.explode_outer(url_keys(F.col("url"))).alias("k")).select(*once.columns, "k.kind", "k.pattern")
    spans = validity(entries)
    questions = asked.where("pattern is not null and day is not null").select("kind", "pattern", "day").distinct()
    active = questions.join(spans, ["kind", "pattern"]).where("since <= day and (until is null or day < until)")
    answers = active.groupBy("kind", "pattern", "day").agg(F.count("*").alias("n"), F.min("list").alias("first_list"))
    names = F.array(*[F.lit(k) for k in KINDS])
    told = asked.join(answers, ["kind", "pattern", "day"], "left")
    told = told.withColumn("rank", F.when(F.col("n") > 0, F.array_position(names, F.col("kind"))))
    judged = told.groupBy(*once.columns).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_entries"), F.min("first_list").alias("first_list"), F.max("rank").alias("rank")
    )
    return judged.select(
        id_out("page_id"), "day", "n_entries", (F.col("n_entries") > 0).alias("blocked"), "first_list",
        F.when(F.col("rank").isNotNull(), F.element_at(names, F.col("rank").cast("int"))).alias("narrowest"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
