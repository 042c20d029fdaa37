import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import ages, geo, similarity as S, text, urls
from siftline.functions.similarity import _lcs
from siftline.sources import pages

c = F.col


def one(spark, values, expr, schema="c string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expr).collect()]


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


def test_normal_forms(spark):
    got = one(
        spark,
        ["costco", "cisco", "Foo Inc, LLC", "Acme Technologies Inc.", "café-x", "", "Inc", "a  b"],
        text.normalize_company(c("c")),
    )
    assert got == ["cost", "cis", "foo inc", "acme", "caféx", "", "", "a b"]
    got = one(spark, ["foo .", "  A   B ;", "engineer #2", "::x.y;"], text.normalize_title(c("c")))
    assert got == ["foo ", "a b ", "engineer #2", "x.y"]


def test_ages(spark):
    texts = ["Reposted 2 days ago", "30+ days ago", "Just posted", "10 minutes ago", "2mo ago", "3d ago", "1 month ago", "", "12 HOURS"]
    assert one(spark, texts, ages.age_days(c("c"), "long")) == [2, None, None, None, None, None, 30, None, 0.5]
    assert one(spark, texts, ages.age_days(c("c"), "today")) == [2, None, 0, None, None, None, 30, None, 0.5]
    assert one(spark, texts, ages.age_days(c("c"), "short")) == [None, None, None, None, 60, 3, 30, None, 0.5]


def test_links(spark):
    got = one(
        spark,
        ["x?currentJobId=12&r=1", "x?currentJobId=1currentJobId=2", "x?currentJobId=", "q"],
        urls.job_id_from_url(c("c")),
    )
    assert got == ["12", "1", "", ""]
    assert one(spark, ["Dismiss a job", "job", "Dismiss Dismiss  job"], urls.strip_affixes(c("c"), "Dismiss ", " job")) == [
        "a", "job", "Dismiss ",
    ]
    pairs = [("/a", "http://x"), ("/a", "rel"), ("/a", None), ("/a", "")]
    assert one(spark, pairs, urls.prefer_apply_url(c("u"), c("a")), "u string, a string") == ["http://x", "/a", "/a", "/a"]
    assert one(spark, pairs, urls.prefer_apply_url(c("u"), c("a"), False), "u string, a string") == ["http://x", "rel", "/a", "/a"]
    names = [("Own", "a", "b"), (" ", "", " b "), ("", None, None), ("", " ", "b")]
    assert one(spark, names, urls.company_fallback(c("o"), c("a"), c("b")), "o string, a string, b string") == ["Own", "b", "", ""]


def test_small_text_functions(spark):
    assert one(spark, [" N/A ", "None", "", None, " 1 Main St "], text.parse_address(c("c"))) == [None, None, None, None, "1 Main St"]
    assert one(spark, ["<a & 'b\">"], text.html_escape(c("c"))) == ["&lt;a &amp; &#x27;b&quot;&gt;"]
    assert one(spark, ["a | b ||"], text.split_requirements(c("c"))) == [["a", "b", "", ""]]
    assert one(spark, ["a | b ||"], text.split_requirements(c("c"), True)) == [["a", "b"]]
    assert one(spark, ["abcd", "abc"], text.truncate_text(c("c"), 3)) == ["abc...", "abc"]


def test_similarity_anchors(spark):
    pairs = [
        ("this is a test", "this is a test!"),
        ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear"),
        ("fuzzy was a bear", "fuzzy fuzzy was a bear"),
        ("", ""),
        ("", "a"),
    ]
    rows = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    got = rows.select(
        S.indel_ratio(c("a"), c("b")), S.token_sort_ratio(c("a"), c("b")), S.token_set_ratio(c("a"), c("b")), S.company_score(c("a"), c("b"))
    ).collect()
    assert round(got[0][0], 2) == 96.55
    assert got[1][1] == 100.0
    assert got[2][2] == 100.0
    assert list(got[3]) == [100.0, 100.0, 0.0, 100.0]
    assert list(got[4]) == [0.0, 0.0, 0.0, 0.0]


def test_lcs_against_table(spark):
    rng = random.Random(1)
    pairs = []
    for n in [0, 1, 2, 5, 20, 61, 62, 63, 64, 65, 130, 300]:
        for _ in range(6):
            a = "".join(rng.choice("abcdé𝒳 ") for _ in range(n))
            b = list(a)
            for _ in range(rng.randint(0, 1 + n // 3)):
                if b and rng.random() < 0.5:
                    b.pop(rng.randrange(len(b)))
                else:
                    b.insert(rng.randint(0, len(b)), rng.choice("abcdéxyz"))
            pairs.append((a, "".join(b)))
            pairs.append((a, "".join(rng.choice("abcd") for _ in range(rng.randint(0, n)))))
    for a, b in pairs:
        assert _lcs(a, b) == lcs_table(a, b)
        assert _lcs(a, b, lcs_table(a, b)) == lcs_table(a, b)
    short = [p for p in pairs if min(len(p[0]), len(p[1])) <= 62]
    rows = spark.createDataFrame(short, "a string, b string")
    got = rows.select("a", "b", S.indel_distance(c("a"), c("b")).alias("u"), S.indel_distance_native(c("a"), c("b")).alias("n")).collect()
    for r in got:
        assert r.u == r.n == len(r.a) + len(r.b) - 2 * lcs_table(r.a, r.b)
    for a, b in pairs:
        if len(a) + len(b):
            least = 100 * 2 * lcs_table(a, b) / (len(a) + len(b))
            assert _lcs(a, b, int(least * (len(a) + len(b)) / 200) - 1) >= 0


def test_long_text_with_one_change():
    a = " ".join(str(i) for i in range(20000))
    assert _lcs(a, a[:500] + "x" + a[501:]) == len(a) - 1


def test_haversine(spark):
    got = one(spark, [(47.6655, -122.3827, 47.6685, -122.3844), (0.0, 0.0, 0.0, 180.0)],
              geo.haversine_km(c("a"), c("b"), c("d"), c("e")), "a double, b double, d double, e double")
    assert round(got[0], 3) == 0.357
    assert round(got[1], 1) == 20015.1


HTML = (
    '<html><div id="x">no</div><div class="a" id="jobDescriptionText"><div>one<br>two</div><p>three &amp; four</p>'
    "<script>x()</script></div><div>after</div></html>"
)


def test_container_with_nested_tags(spark):
    df = spark.createDataFrame([(HTML,), ("<p>none</p>",)], "html string").coalesce(1)
    got = [r.description for r in pages.extract_container_text(df, "div", 'id="jobDescriptionText"').collect()]
    assert got == ["one\ntwo\nthree & four", None]


@pytest.mark.parametrize(
    "script, want",
    [
        ('{"props":{"pageProps":{"job":{"apply_url":"http://a"}}}}', ("http://a", False)),
        ('{"props":{"pageProps":{"job":null}}}', (None, True)),
        ('{"props":null}', (None, True)),
        ('{"props":{}}', (None, False)),
        ("{broken", (None, False)),
    ],
)
def test_embedded_json(spark, script, want):
    html = f'<script id="__NEXT_DATA__" type="j">{script}</script>'
    row = pages.extract_embedded_json(spark.createDataFrame([(html,)], "html string")).first()
    assert (row.apply_url, row.embedded_error) == want


def test_attributes(spark):
    html = '<button class="job-apply-btn--list" data-job-id="7" data-job-title="A &amp; B"></button><button>x</button>'
    rows = pages.extract_attrs(spark.createDataFrame([(html,)], "html string"), marker="job-apply-btn--list").collect()
    assert [(r.job_id, r.title, r.company) for r in rows] == [("7", "A & B", "")]
