"""A whole run: read, prefilter, match against the store, score, locate, report, commit."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.operators.answers import score_logged, scorer_context
from siftline.operators.commit import commit_rows
from siftline.operators.dedup import deduplicate, match_details
from siftline.operators.locate import assign_tier, geocode_worklist, merge_cache
from siftline.operators.numbering import assign_pos
from siftline.operators.prefilter import prefilter
from siftline.operators.ranking import run_summary
from siftline.operators.report import (
    dup_report,
    ranked_report,
    render_markdown,
    report_header,
    write_dup_report,
    write_report,
    write_run,
)
from siftline.operators.scoring import (
    assign_batches,
    build_prompts,
    continuation_prompts,
    parse_responses,
    reassemble,
    score_batches,
)
from siftline.plans.pages import read_board
from siftline.schemas import GEOCODE_CACHE
from siftline.session import materialize
from siftline.sources.listings import fill_listings, read_listings
from siftline.sources.settings import Settings
from siftline.sources.store import append_store, clear_store, read_geocode_cache, read_store, write_geocode_cache


@dataclass(frozen=True)
class RunOptions:
    store_path: str
    report_path: str
    run_id: int
    run_date: dt.date
    batch_size: int | None = None
    conversations: int | None = None
    dedup: bool = True
    clear: bool = False
    duplicate_report: bool = False
    cache_in: str | None = None
    cache_out: str | None = None
    answers_path: str | None = None  # a log of the scorer's answers, so that a repeated run asks for the rest only


@dataclass(frozen=True)
class RunResult:
    results: DataFrame
    matches: DataFrame | None
    report: DataFrame
    summary: DataFrame


def score_listings(
    listings: DataFrame,
    settings: Settings,
    scorer: Callable[[str], str],
    batch_size: int | None = None,
    conversations: int | None = None,
    answers_path: str | None = None,
    run_id: int = 0,
) -> DataFrame:
    """Listings with their result columns.

    Batch size and concurrency come from the scorer's settings unless given.
    With ``answers_path``, answers that ``run_id`` has logged there are not asked for again.

    Positions are made dense first, since a batch is a run of positions. The
    answers are written once: they are expensive and several branches read them.
    """
    if batch_size is None:
        batch_size = int(settings.scorer_settings.get("batch_size", 1))
    dense = assign_pos(listings, order="pos").withColumn("_pos", F.col("pos")).withColumn("pos", F.col("job_id"))
    batched = materialize(assign_batches(dense, batch_size), "batched")
    prompts = (
        build_prompts(batched, settings.profile)
        if conversations is None
        else continuation_prompts(batched, settings.profile, conversations)
    )
    tasks = settings.scorer_settings.get("max_concurrent")
    if answers_path is None:
        answers = score_batches(prompts, scorer, tasks)
    else:
        context = scorer_context(settings.scorer, settings.scorer_settings)
        answers = score_logged(prompts, scorer, answers_path, run_id, context, tasks)
    responses = materialize(answers, "responses")
    results = parse_responses(responses, batched.select("batch", "pos"))
    joined = reassemble(batched, results)
    return joined.withColumn("pos", F.col("_pos")).drop("_pos", "job_id", "batch", "start_index")


def geocoded_cache(
    cache: DataFrame, scored: DataFrame, geocoder: Callable[[DataFrame], DataFrame] | None
) -> DataFrame:
    """The cache with the answers for addresses it lacked.

    ``geocoder`` turns the work list (address) into answers (address, lat, lon);
    an address it leaves out stays unknown and is asked again next time.
    """
    if geocoder is None:
        return cache
    return merge_cache(cache, geocoder(geocode_worklist(scored, cache)))


def run(
    spark: SparkSession,
    settings: Settings,
    options: RunOptions,
    scorer: Callable[[str], str],
    listings: DataFrame | None = None,
    path: str = "",
    geocoder: Callable[[DataFrame], DataFrame] | None = None,
    pages_path: str = "",
) -> RunResult:
    """One run. It sees what earlier runs have committed and commits its own rows last.

    It starts from ``listings``, from the stored pages of the source at ``pages_path``, by the
    source's settings, or from the listing files at ``path``.

    ``pos`` of the results counts all listings in (page, position) order, since positions
    may start again on each page. All outputs carry the run id; repeating a run, also
    one that has failed half-way, replaces them.
    """
    if listings is None and pages_path:
        listings = read_board(spark, pages_path, settings.source, settings.source_settings)
    elif listings is None:
        listings = read_listings(spark, settings.source, path)
    dense = assign_pos(fill_listings(listings))
    listings = materialize(dense.withColumn("pos", F.col("job_id")).drop("job_id"), "listings")
    kept, _ = prefilter(listings, settings.prefilter)
    if options.clear:
        clear_store(spark, options.store_path, settings.profile_name, options.run_id)

    matches = None
    n_duplicates = F.lit(0)
    if options.dedup:
        stored = read_store(spark, options.store_path, settings.profile_name, options.run_id)
        _, found = deduplicate(kept, stored, settings.thresholds)
        matches = materialize(found, "matches")
        n_duplicates = matches.agg(F.count("*")).scalar()
        if options.duplicate_report:
            entries = dup_report(kept, match_details(matches, stored))
            stamp = options.run_date.strftime("%Y_%m_%d")
            write_dup_report(
                entries,
                f"{options.report_path}/dedup_report_{settings.source}_{settings.profile_name}_{stamp}_{options.run_id}",
            )
        kept = kept.join(matches.select("pos"), "pos", "left_anti")

    results = score_listings(
        kept, settings, scorer, options.batch_size, options.conversations, options.answers_path, options.run_id
    )
    if settings.locations:
        cache = (
            read_geocode_cache(spark, options.cache_in)
            if options.cache_in
            else spark.createDataFrame([], GEOCODE_CACHE)
        )
        scored = materialize(results, "results")
        full = geocoded_cache(cache, scored.where(F.col("result_type") == "scored"), geocoder)
        if options.cache_out:
            write_geocode_cache(full, options.cache_out)
            full = read_geocode_cache(spark, options.cache_out)
        located = assign_tier(
            scored.where(F.col("result_type") == "scored"),
            full,
            settings.locations_table(spark),
            settings.default_radius_km,
        )
        others = scored.where(F.col("result_type") != "scored")
        results = located.unionByName(
            others.withColumn("location_tier", F.lit(None).cast("int")).withColumn("location_note", F.lit(""))
        )
    else:
        results = results.withColumn("location_tier", F.lit(None).cast("int")).withColumn(
            "location_note", F.lit("")
        )
    results = materialize(results, "located")

    summary = run_summary(results, n_duplicates)
    report = materialize(
        render_markdown(ranked_report(results.where(F.col("result_type") == "scored"))), "report"
    )
    write_run(
        report.drop("source"), f"{options.report_path}/table", settings.source, settings.profile_name,
        options.run_date, options.run_id,
    )
    stamp = options.run_date.strftime("%Y_%m_%d")
    write_report(
        report,
        report_header(summary),
        f"{options.report_path}/report_{settings.source}_{settings.profile_name}_{stamp}_{options.run_id}",
    )
    if options.dedup:
        stored = read_store(spark, options.store_path, settings.profile_name, options.run_id)
        append_store(
            commit_rows(results, stored, settings.scorer, options.run_date, settings.profile_name, options.run_id),
            options.store_path,
        )
    return RunResult(results, matches, report, summary)
