"""Report rows and their text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.functions.text import html_escape, md_escape, score_band, split_requirements
from siftline.operators.numbering import number_rows, pos_block
from siftline.operators.ranking import rank_by_tier, tier_breaks
from siftline.session import materialize


def report_header(summary: DataFrame) -> DataFrame:
    """First line of the report from the counts of ``run_summary``."""
    # Fixed value: format of the line.
    line = F.format_string(
        "# Results: %d scored, %d filtered, %d failed, %d duplicates removed\n",
        "scored", "filtered", "failed", "duplicates",
    )
    return summary.select(line.alias("header"))


def ranked_report(scored: DataFrame) -> DataFrame:
    """Report rows: rank and heading next to the scored listing."""
    return tier_breaks(rank_by_tier(scored))


def _lines(items: Column) -> Column:
    return F.array_join(items, "\n")


def render_markdown(ranked: DataFrame) -> DataFrame:
    """Add ``fragment``, the Markdown of one report row."""
    # Layout of a report row.
    heading = F.coalesce(F.concat(F.lit("\n# "), F.col("heading"), F.lit("\n\n")), F.lit(""))
    table = F.format_string(
        "---\n\n| # | Title | Fit | Link |\n|---|-------|-----|------|\n"
        "| %d | %s at %s | %d/100 | [View](%s) |\n",
        F.col("rank"), md_escape(F.col("title")), md_escape(F.col("company")), F.col("score"), F.col("url"),
    )
    location = F.when(
        F.col("location_tier").isNotNull(),
        F.concat(F.lit("\n**Location:** "), F.col("location_note"), F.lit("\n")),
    ).otherwise("")
    scores = F.format_string(
        "\n**Requirements Match:** %d/100\n**Domain Match:** %d/100\n\n",
        "requirements_match", "domain_match",
    )
    body = F.concat(
        F.col("reasoning"),
        F.lit("\n\n**Gaps:** "), F.col("gaps"),
        F.lit("\n\n**Hard Requirements:**\n"), _lines(split_requirements(F.col("hard_requirements"))),
        F.lit("\n\n**Preferred Requirements:**\n"), _lines(split_requirements(F.col("preferred_requirements"))),
        F.lit("\n"),
    )
    return ranked.withColumn("fragment", F.concat(heading, table, location, scores, body))


def write_report(rendered: DataFrame, header: DataFrame, path: str, order: str = "rank") -> None:
    """Write the text in order: part files sorted by name give the whole report. An earlier report there is replaced."""
    lines = header.select(F.lit(0).cast("bigint").alias("_at"), F.col("header").alias("value")).unionByName(
        rendered.select(F.col(order).cast("bigint").alias("_at"), F.col("fragment").alias("value"))
    )
    lines.orderBy("_at").select("value").write.mode("overwrite").text(path)


def dup_report(new: DataFrame, matches: DataFrame) -> DataFrame:
    """One numbered row per duplicate, with both sides' text and its HTML ``fragment``.

    ``matches`` comes from ``match_details``; ``new`` has the listings. The numbers are worked out on positions
    alone and joined to the texts, since a block of positions has a million rows.
    """
    shown = new.select("pos", "title", "company", "url", "description").join(matches, "pos")
    # A position that comes more than once takes consecutive numbers.
    places = new.select("pos").join(matches.select("pos"), "pos")
    starts = number_rows(places, [("_block", pos_block(F.col("pos")))], [F.col("pos")], "n").groupBy("pos").agg(F.min("n").alias("_start"))
    copy = F.row_number().over(Window.partitionBy("pos").orderBy("matched_seq"))
    numbered = shown.withColumn("_copy", copy).join(starts, "pos").withColumn("n", F.col("_start") + F.col("_copy") - 1).drop("_start", "_copy")
    e = lambda c: html_escape(F.coalesce(F.col(c), F.lit("")))
    link = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit('<a href="'), e(c), F.lit('">[link]</a>'))).otherwise("")
    line = lambda label, ours, theirs: F.format_string(f"<tr><th>{label}</th><td>%s</td><td>%s</td></tr>", ours, theirs)
    whole = lambda c: F.format_string("<pre>%s</pre>", e(c))
    score = lambda label, c: F.format_string(f'<li style="color:%s">{label}: %s of 100</li>', score_band(F.col(c)), _whole(F.col(c)))
    fragment = F.concat(
        F.format_string('<section id="duplicate-%d"><h2>%d. %s, %s</h2>', F.col("n"), F.col("n"), e("title"), e("company")),
        F.lit("<table><tr><td></td><th>this run</th><th>store</th></tr>"),
        line("title", e("title"), e("matched_title")), line("company", e("company"), e("matched_company")),
        line("link", link("url"), link("matched_url")), line("first seen", F.lit(""), e("matched_first_seen")),
        line("text", whole("description"), whole("matched_description")),
        F.lit("</table><ul>"), score("company", "company_score"), score("title", "title_score"), score("text", "description_score"),
        F.lit("</ul></section>"),
    )
    return numbered.withColumn("fragment", fragment)


def _whole(c: Column) -> Column:
    """Number without decimals, halves to the even neighbour."""
    return F.bround(c, 0).cast("int").cast("string")


def write_dup_report(report: DataFrame, path: str) -> bool:
    """Write the duplicate report unless it is empty."""
    report = materialize(report, "duplicates")
    if report.isEmpty():
        return False
    header = report.agg(F.count("*").alias("n")).select(
        F.format_string("<h1>Listings seen before</h1>\n<p>%d of this run are in the store already.</p>", "n").alias("header")
    )
    write_report(report, header, path, order="n")
    return True


def write_run(df: DataFrame, path: str, source: str, profile: str, run_date: dt.date, run_id: int = 0) -> None:
    """Write a table under source, profile, date and run; a repeated run replaces its own part only."""
    stamp = run_date.strftime("%Y_%m_%d")
    (
        df.withColumn("source", F.lit(source))
        .withColumn("profile", F.lit(profile))
        .withColumn("run_date", F.lit(stamp))
        .withColumn("run_id", F.lit(run_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source", "profile", "run_date", "run_id")
        .parquet(path)
    )
