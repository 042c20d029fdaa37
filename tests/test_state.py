"""Store, runs, locations, reports, streaming, user sources."""

import datetime as dt
import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from siftline.functions.protocol import Profile
from siftline.operators import commit, locate, numbering, ranking, report
from siftline.operators.dedup import Thresholds
from siftline.plans.run import RunOptions, run
from siftline.schemas import GEOCODE_CACHE, LISTING, LOCATION
from siftline.sources import store as st
from siftline.sources.listings import gathered_source, read_listings, register_source
from siftline.sources.settings import Settings, load_settings
from siftline.streaming.intake import read_listing_stream, session_report, stream_run

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY = dt.date(2026, 3, 1)
PLACES = [{"name": "Ballard", "lat": 47.6685, "lon": -122.3844, "radius_km": 2.5}, {"name": "Fremont", "lat": 47.6510, "lon": -122.3500}]
ADDRESSES = {0: "5301 Ballard Ave NW", 1: "1600 Amphitheatre Parkway", 3: "123 Not A Real Street"}


def listing_rows(n=5):
    return [
        (f"Title {i}", f"Firm {i} Inc.", "Seattle", f"http://x/{i}", "2026-03-20", f"Text of job {i}. " * 9, "linkedin", 0, i)
        for i in range(n)
    ]


def golden_scorer(prompt):
    scores = {0: 78, 1: 85, 3: 55, 4: 70}
    out = []
    for part in prompt.split("### JOB ")[1:]:
        i = int(part.split("\n", 1)[0])
        if i in scores:
            out.append(
                f"JOB_ID: {i}\nSTATUS: SCORED\nSCORE: {scores[i]}\nREASONING: r{i}\nADDRESS: {ADDRESSES.get(i, 'null')}"
            )
        else:
            out.append(f"JOB_ID: {i}\nSTATUS: FILTERED\nREASON: too senior")
    return "\n\n".join(out)


def settings(**more):
    return Settings(scorer="golden", profile=Profile(request_address=True), **more)


@pytest.mark.parametrize("located", [False, True])
def test_golden_run(spark, tmp_path, located):
    cache = [(ADDRESSES[0], 47.6655, -122.3827), (ADDRESSES[1], 37.4220, -122.0841), (ADDRESSES[3], None, None)]
    spark.createDataFrame(cache, GEOCODE_CACHE).write.parquet(f"{tmp_path}/cache")
    options = RunOptions(f"{tmp_path}/store", f"{tmp_path}/out", 1, DAY, batch_size=5, cache_in=f"{tmp_path}/cache", duplicate_report=True)
    rows = spark.createDataFrame(listing_rows(), LISTING)
    got = run(spark, settings(locations=PLACES if located else []), options, golden_scorer, listings=rows)
    ranked = got.report.orderBy("rank").collect()
    assert [r.pos for r in ranked] == ([0, 1, 4, 3] if located else [1, 0, 4, 3])
    assert [r.location_note for r in ranked] == (
        ["0.4 km from Ballard", "1137.6 km from Fremont (outside radius)", "no address", "no address"] if located else [""] * 4
    )
    assert got.summary.first().asDict() == {"scored": 4, "filtered": 1, "failed": 0, "committed": 5, "duplicates": 0}
    stored = st.read_store(spark, f"{tmp_path}/store").orderBy("seq").collect()
    assert [r.url[-1] for r in stored] == ["1", "0", "4", "3", "2"]
    assert [r.score for r in stored] == [85, 78, 70, 55, -1]
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/out/report_linkedin_default_2026_03_01_1").collect())
    assert "# Results: 4 scored, 1 filtered, 0 failed, 0 duplicates removed" in text
    assert ("# Tier 3" in text) == located

    again = run(spark, settings(), RunOptions(f"{tmp_path}/store", f"{tmp_path}/out", 2, DAY, duplicate_report=True), golden_scorer, listings=rows)
    assert again.summary.first().asDict() == {"scored": 0, "filtered": 0, "failed": 0, "committed": 0, "duplicates": 5}
    assert spark.read.text(f"{tmp_path}/out/dedup_report_linkedin_default_2026_03_01_2").where("value like '%[link]%'").count() > 0
    off = run(spark, settings(), RunOptions(f"{tmp_path}/store", f"{tmp_path}/out", 3, DAY, batch_size=5, dedup=False), golden_scorer, listings=rows)
    assert off.matches is None and off.summary.first().scored == 4
    cleared = run(spark, settings(), RunOptions(f"{tmp_path}/store", f"{tmp_path}/out", 4, DAY, batch_size=5, clear=True), golden_scorer, listings=rows)
    assert cleared.summary.first().scored == 4
    assert {r.run_id for r in st.read_store(spark, f"{tmp_path}/store").collect()} == {4}


def test_geocoder_fills_cache(spark, tmp_path):
    asked = []

    def geocoder(worklist):
        asked.extend(r.address for r in worklist.collect())
        return worklist.select("address", F.lit(47.6685).alias("lat"), F.lit(-122.3844).alias("lon"))

    spark.createDataFrame([(ADDRESSES[3], None, None)], GEOCODE_CACHE).write.parquet(f"{tmp_path}/cache")
    options = RunOptions(f"{tmp_path}/s", f"{tmp_path}/o", 1, DAY, batch_size=5, cache_in=f"{tmp_path}/cache", cache_out=f"{tmp_path}/cache2")
    got = run(spark, settings(locations=PLACES), options, golden_scorer, listings=spark.createDataFrame(listing_rows(), LISTING), geocoder=geocoder)
    assert sorted(set(asked)) == sorted([ADDRESSES[0], ADDRESSES[1]])
    assert {r.pos: r.location_tier for r in got.report.collect()} == {0: 1, 1: 1, 3: 3, 4: 3}
    assert st.read_geocode_cache(spark, f"{tmp_path}/cache2").count() == 3


def sequential_keys(taken, prints):
    taken, out = set(taken), []
    for fp in prints:
        key, n = fp, 1
        while key in taken:
            n += 1
            key = f"{fp}#{n}"
        taken.add(key)
        out.append(key)
    return out


def test_store_keys_with_colliding_titles(spark):
    rng = random.Random(5)
    for _ in range(4):
        titles = ["eng", "eng#2", "eng#3", "eng#2#2", "eng #2", "dev", "dev#7", "eng#02", "ops"]
        old = sequential_keys([], ["a|" + rng.choice(titles) for _ in range(rng.randint(0, 12))])
        new = [rng.choice(titles) for _ in range(25)]
        rows = spark.createDataFrame([(i, i + 1, "a", t) for i, t in enumerate(new)], "pos bigint, order bigint, company string, title string")
        stored = spark.createDataFrame([(k,) for k in old], "store_key string")
        got = [r.store_key for r in commit.store_keys(rows, stored).orderBy("pos").collect()]
        assert got == sequential_keys(old, ["a|" + t for t in new])


def test_numbering_over_small_blocks(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 5, 9])) for i in range(500)]
    df = spark.createDataFrame(rows, "pos bigint, score int")
    buckets = [("_s", -F.col("score")), ("_b", numbering.pos_block(F.col("pos"), 16))]
    got = {r.pos: r.n for r in numbering.number_rows(df, buckets, [F.col("pos")], "n").collect()}
    want = {pos: i for i, (pos, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert got == want


def test_tiers_on_the_edges(spark):
    places = spark.createDataFrame(
        [(0, "A", 0.0, 0.0, 111.19492664455873), (1, "B", 0.0, 2.0, None), (2, "C", 0.0, 2.0, 500.0)], LOCATION
    )
    cache = spark.createDataFrame([("edge", 0.0, 1.0), ("tie", 0.0, 2.0), ("far", 50.0, 50.0), ("miss", None, None)], GEOCODE_CACHE)
    scored = spark.createDataFrame([(0, "edge"), (1, "tie"), (2, "far"), (3, "miss"), (4, "unknown"), (5, None), (6, "")], "pos bigint, address string")
    got = {r.pos: (r.location_tier, r.location_note) for r in locate.assign_tier(scored, cache, places).collect()}
    assert got[0] == (1, "111.2 km from A")
    assert got[1] == (1, "0.0 km from B")
    assert got[2][0] == 2 and got[2][1].endswith("(outside radius)")
    assert got[3] == got[4] == got[5] == got[6] == (3, "no address")
    none = locate.assign_tier(scored, cache, spark.createDataFrame([], LOCATION)).collect()
    assert {(r.location_tier, r.location_note) for r in none} == {(None, "")}


def test_many_locations_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    places = spark.createDataFrame([(i, f"p{i}", rng.uniform(-80, 80), rng.uniform(-180, 180), 900.0) for i in range(60)], LOCATION)
    points = spark.createDataFrame([(i, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(50)] + [(50, None, None)], "pos bigint, lat double, lon double")
    whole = {r.pos: (r._nearest, r._matched) for r in locate.closest_locations(points, places).collect()}
    monkeypatch.setattr(locate, "PART_LOCATIONS", 7)
    parts = {r.pos: (r._nearest, r._matched) for r in locate.closest_locations(points, places).collect()}
    assert whole == parts and whole[50] == (None, None)


def test_settings_and_defaults(spark, tmp_path):
    folder = tmp_path / "profiles" / "me"
    folder.mkdir(parents=True)
    (tmp_path / "config.json").write_text(json.dumps({"profile": "me", "scorer": "s", "dedup": {"description_threshold": 85}}))
    (folder / "prefilter.json").write_text(json.dumps({"exclude_companies": ["A"], "exclude_title_keywords": []}))
    with pytest.raises(FileNotFoundError):
        load_settings(spark, str(tmp_path))
    for name in ("background", "rules", "fit_criteria"):
        (folder / f"{name}.md").write_text(f"# {name}\n")
    got = load_settings(spark, str(tmp_path))
    assert got.thresholds == Thresholds(50, 80, 85) and got.source == "linkedin"
    assert got.locations == [] and got.default_radius_km == 2.5 and not got.profile.request_address
    assert got.profile.rules == "# rules\n" and got.prefilter.max_age_days is None and got.source_settings == {}
    (folder / "locations.json").write_text(json.dumps({"locations": PLACES}))
    table = load_settings(spark, str(tmp_path)).locations_table(spark).orderBy("loc_pos").collect()
    assert [(r.name, r.radius_km) for r in table] == [("Ballard", 2.5), ("Fremont", 2.5)]


class Board:
    def __init__(self, share, shares):
        self.share, self.shares = share, shares

    def gather_jobs(self):
        for i in range(self.share, 10, self.shares):
            yield {"title": f"t{i}", "company": "c", "location": None, "url": "", "date_posted": "", "description": "d"}


def test_user_source(spark):
    spark.dataSource.register(gathered_source("board", Board))
    register_source("board", lambda session, path: session.read.format("board").option("partitions", 3).load())
    rows = read_listings(spark, "board").collect()
    assert sorted(r.title for r in rows) == [f"t{i}" for i in range(10)]
    assert len({r.pos for r in rows}) == 10 and {r.location for r in rows} == {""}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame(listing_rows(9), LISTING)
    rows.repartition(3).write.json(f"{tmp_path}/in")

    def scorer(prompt):
        job = prompt.split("### JOB ")[1]
        title = job.split("- **Title:** ")[1].split("\n")[0]
        return f"JOB_ID: {job.split(chr(10))[0]}\nSTATUS: SCORED\nSCORE: {title[-1]}\nREASONING: {title}"

    def go():
        stream_run(read_listing_stream(spark, f"{tmp_path}/in", 1), settings(), scorer, f"{tmp_path}/out", f"{tmp_path}/cp", DAY)
        return spark.read.parquet(f"{tmp_path}/out")

    first = go()
    assert first.select("run_id").distinct().count() == 3
    assert {(r.pos, r.score, r.date_posted) for r in first.collect()} == {(i, i, "2026-03-01") for i in range(9)}
    rows.limit(0).unionByName(spark.createDataFrame(listing_rows(10)[9:], LISTING)).write.mode("append").json(f"{tmp_path}/in")
    ranked, summary = session_report(go())
    assert [r.pos for r in ranked.orderBy("rank").collect()] == list(range(9, -1, -1))
    assert summary.first().scored == 10


def test_report_of_an_empty_result(spark, tmp_path):
    rows = spark.createDataFrame([], LISTING)
    got = run(spark, settings(), RunOptions(f"{tmp_path}/s", f"{tmp_path}/o", 1, DAY), golden_scorer, listings=rows)
    assert got.summary.first().asDict() == {"scored": 0, "filtered": 0, "failed": 0, "committed": 0, "duplicates": 0}
    assert st.read_store(spark, f"{tmp_path}/s").count() == 0


def every_job(prompt):
    ids = [part.split("\n", 1)[0] for part in prompt.split("### JOB ")[1:]]
    return "\n\n".join(f"JOB_ID: {i}\nSTATUS: SCORED\nSCORE: 50\nREASONING: r" for i in ids)


def test_positions_may_start_again_on_each_page(spark, tmp_path):
    rows = [(*r[:7], page, 0) for page, r in enumerate(listing_rows(3))]
    go = lambda n, run_id: run(
        spark, settings(), RunOptions(f"{tmp_path}/s", f"{tmp_path}/o", run_id, DAY, batch_size=2), every_job,
        listings=spark.createDataFrame(rows[:n], LISTING),
    )
    assert go(1, 1).summary.first().scored == 1
    second = go(3, 2)
    assert sorted(r.title for r in second.results.collect()) == ["Title 1", "Title 2"]
    assert second.summary.first().duplicates == 1
    table = spark.read.parquet(f"{tmp_path}/o/table")  # two runs on one date
    assert sorted((r.run_id, r.title) for r in table.collect()) == [(1, "Title 0"), (2, "Title 1"), (2, "Title 2")]
    assert st.read_store(spark, f"{tmp_path}/s").count() == 3


def test_run_is_repeated_after_a_crash(spark, tmp_path, monkeypatch):
    from siftline.plans import run as plan

    go = lambda: run(
        spark, settings(), RunOptions(f"{tmp_path}/s", f"{tmp_path}/o", 1, DAY, batch_size=5), every_job,
        listings=spark.createDataFrame(listing_rows(), LISTING),
    )

    def crash(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(plan, "append_store", crash)
        with pytest.raises(RuntimeError):
            go()
    for _ in range(2):
        assert go().summary.first().scored == 5
        assert st.read_store(spark, f"{tmp_path}/s").count() == 5
        assert spark.read.parquet(f"{tmp_path}/o/table").count() == 5


def test_nulls_in_listings(spark, tmp_path):
    rows = [(None, "A", None, None, None, "text one", "linkedin", 0, 0), ("T", None, "x", "u", "d", None, "linkedin", 0, 1)]
    got = run(
        spark, settings(), RunOptions(f"{tmp_path}/s", f"{tmp_path}/o", 1, DAY, batch_size=2), every_job,
        listings=spark.createDataFrame(rows, LISTING),
    )
    assert got.summary.first().scored == 2


def test_prompts_are_spread_over_tasks(spark):
    from siftline.operators.scoring import score_batches

    def where_am_i(prompt):
        from pyspark import TaskContext

        return str(TaskContext.get().partitionId())

    prompts = spark.range(200).selectExpr("id AS batch", "'x' AS prompt")
    assert {r.response for r in score_batches(prompts, where_am_i, 5).collect()} == set("01234")
    chats = prompts.withColumn("conversation", F.col("batch") % 40)
    assert len({r.response for r in score_batches(chats, where_am_i).collect()}) > 1


def test_numbers_in_many_buckets(spark):
    rows = [(page, pos) for page in range(300) for pos in range(page % 4)]
    got = numbering.assign_pos(spark.createDataFrame(rows, "page bigint, pos bigint").repartition(7)).collect()
    assert [(r.page, r.pos) for r in sorted(got, key=lambda r: r.job_id)] == rows
    assert sorted(r.job_id for r in got) == list(range(len(rows)))
