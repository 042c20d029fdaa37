"""Fuzzy matching of new listings against the store of seen ones.

A new listing is a duplicate if some stored one has a similar company, a
similar title and a nearly equal description. The result names the first such
stored listing in store order, not the best one.

The three conditions hold together, so the search starts from the most
selective one that a join key can express, the description:

1. Equal texts meet in an equi-join on their digest.
2. For high thresholds a stored text is cut into consecutive pieces of p
   characters. An edit (one inserted or deleted character) spoils at most one
   piece, so a text within d edits keeps at least ``pieces - d`` of them
   unchanged, moved by at most d characters. With p short enough for
   ``pieces > d``, every match shares a piece, and looking up
   all p-grams of the new texts finds it (pigeonhole principle, as in Pass-Join,
   Li et al., VLDB 2011). The counted pieces then filter before any text is
   compared. This is done in cells of texts of like length (``siftline.operators.texts``).
3. For low thresholds no such p exists: a text of n characters has at most n / 3
   pieces of three, and 0.3 n edits at 85. The other two conditions come first then:
   similar (company, title) forms are looked up in an index of the title
   dictionary, and texts meet in an equi-join on such forms and a length band.

Copies of a text are collapsed to one before 1-3. No step is approximate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions.similarity import (
    company_score,
    indel_ratio,
    indel_ratio_at_least,
    token_sort,
)
from siftline.functions.text import normalize_company, normalize_title
from siftline.operators.texts import similar_in_cells
from siftline.session import materialize

# Shortest piece that is still selective; below it the length bands are used.
MIN_PIECE = 5
# Rows of the first slice of the store, and how much longer each next one is.
FIRST_SLICE = 1024
SLICE_GROWTH = 32
# The same for low thresholds, where most texts of like titles are compared.
LOW_SLICE = 8
LOW_GROWTH = 8
# Rows of one text that the search deals with in one task.
FREQUENT = 1000


@dataclass(frozen=True)
class Thresholds:
    company: float = 50
    title: float = 80
    description: float = 95


def _edit_share(threshold: float) -> float:
    """Edits per character of one text that a match at ``threshold`` may have, at most."""
    t = threshold / 100
    return math.inf if t <= 0 else 2 * (1 - t) / t


def piece_tiers(threshold: float) -> list[tuple[int, int]]:
    """(shortest text length, piece length) pairs, longest texts first.

    A text of length n has floor(n / p) pieces and at most share * n edits, so
    pieces outnumber edits for n >= 1 / (1/p - share). The 2 instead of 1 keeps
    the bound clear of rounding. Texts below the last tier allow no edit at all
    or fall to pieces of one character.
    """
    share = _edit_share(threshold)
    tiers: list[tuple[int, int]] = []
    if share == 0 or math.floor(1 / share - 1e-9) < MIN_PIECE:
        return tiers
    longest = min(math.floor(1 / share - 1e-9), 16)
    for p in range(longest, 0, -1):
        slack = 1 / p - share
        from_length = math.ceil(2 / slack)
        if p == longest and slack < 0.1 / p:
            continue
        if not tiers or from_length <= tiers[-1][0] // 2 or p == 1:
            tiers.append((from_length, p))
    return tiers if tiers[0][1] >= MIN_PIECE else []


def with_keys(df: DataFrame) -> DataFrame:
    """Add the normal forms that matching uses: company, title, text, digest, length."""
    return (
        df.withColumn("n_company", normalize_company(F.coalesce("company", F.lit(""))))
        .withColumn("n_title", normalize_title(F.coalesce("title", F.lit(""))))
        .withColumn("_text", F.lower(F.coalesce("description", F.lit(""))))
        .withColumn("_digest", F.sha2("_text", 256))
        .withColumn("_len", F.length("_text"))
    )


def distinct_texts(keyed: DataFrame, order: str, out: str) -> DataFrame:
    """Rows of texts for the search, named by ``order``, with ``_form``: company and title, null if it is known that rows of the text differ in them.

    Of a text with more than FREQUENT rows only those with the least ``order`` stay. There are few such texts, so their
    digests are broadcast, and no text is shuffled; the search itself takes one row of any other text.
    """
    form = F.concat("n_company", F.lit("|"), F.col("n_title"))
    rows = keyed.where(F.col(order).isNotNull()).select(F.col(order).alias(out), "_digest", "_text", "_len", form.alias("_form"))
    counted = rows.groupBy("_digest").agg(F.min(out).alias("_first"), F.count("*").alias("_rows"))
    frequent = materialize(counted.where(F.col("_rows") > FREQUENT).select("_digest", "_first"), "frequent")
    marked = rows.join(F.broadcast(frequent), "_digest", "left").where((F.col("_first") == F.col(out)) | F.col("_first").isNull())
    return marked.select(out, "_digest", "_len", "_text", F.when(F.col("_first").isNull(), F.col("_form")).alias("_form"))


def _length_ratio(threshold: float) -> float:
    """Longer over shorter length that a match may have, at most."""
    t = threshold / 100
    return math.inf if t <= 0 else (2 - t) / t


def _edits(threshold: float, a: Column, b: Column) -> Column:
    """Most edits between texts of these lengths at ``threshold``."""
    return F.floor((1 - threshold / 100) * (a + b) + 1e-6)


def similar_titles_possible(a: Column, b: Column, threshold: float) -> Column:
    """JVM-side test that every pair of token-sorted titles at ``threshold`` passes.

    The Levenshtein distance is never above the indel distance.
    """
    edits = _edits(threshold, F.length(a), F.length(b))
    return (F.abs(F.length(a) - F.length(b)) <= edits) & (F.levenshtein(a, b) <= edits)


def _band(length: Column, ratio: float) -> Column:
    """Number of the length band; bands are as wide as a match may stretch, -1 is the empty text."""
    if ratio == 1:
        return F.when(length == 0, -1).otherwise(length).cast("int")
    base = math.log(ratio) * (1 + 1e-9)
    return F.when(length == 0, -1).otherwise(F.floor(F.ln(length.cast("double")) / base)).cast("int")


def _pairs_by_forms(new: DataFrame, stored: DataFrame, thresholds: Thresholds) -> DataFrame:
    """(new tuple, stored tuple, both scores) with similar titles and companies and compatible lengths, for low thresholds.

    Titles and companies are compared in their dictionaries. Texts then meet by an
    equi-join on forms that passed and a length band, so no pair of rows is looked at
    whose titles or companies differ.
    """
    forms = similar_forms(
        new.select("n_company", "n_title").distinct(), stored.select("s_company", "s_title").distinct(), thresholds
    )
    ratio = _length_ratio(thresholds.description)
    if ratio == math.inf:
        band, bands, lengths = F.lit(0), F.array(F.lit(0)), F.lit(True)
    else:
        band = _band(F.col("s_len"), ratio)
        own = _band(F.col("n_len"), ratio)
        bands = F.when(own == -1, F.array(F.lit(-1))).otherwise(F.array(own - 1, own, own + 1))
        edits = _edits(thresholds.description, F.col("n_len"), F.col("s_len"))
        lengths = F.abs(F.col("n_len") - F.col("s_len")) <= edits
    left = new.join(forms, ["n_company", "n_title"]).withColumn("_band", F.explode(bands))
    right = stored.withColumn("_band", band)
    return left.join(right, ["s_company", "s_title", "_band"]).where(lengths).drop("_band")


def _score_pairs(pairs: DataFrame, thresholds: Thresholds) -> DataFrame:
    """Title, then company score; each step drops pairs before the next one."""
    titled = pairs.withColumn(
        "title_score", indel_ratio(F.col("n_sorted"), F.col("s_sorted"))
    ).where(F.col("title_score") >= thresholds.title)
    return titled.withColumn(
        "company_score", company_score(F.col("n_company"), F.col("s_company"))
    ).where(F.col("company_score") >= thresholds.company)


def _variants(keyed: DataFrame, order: str, prefix: str) -> DataFrame:
    """Distinct (text, company, title) with the first ``order``."""
    return (
        keyed.groupBy("_digest", "n_company", "n_title")
        .agg(F.min(order).alias(f"{prefix}first"), F.any_value("_len").alias(f"{prefix}len"))
        .withColumn(f"{prefix}sorted", token_sort(F.col("n_title")))
        .withColumnRenamed("_digest", f"{prefix}digest")
        .withColumnRenamed("n_company", f"{prefix}company")
        .withColumnRenamed("n_title", f"{prefix}title")
    )


def fuzzy_candidates(new: DataFrame, stored: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Pairs of distinct (company, title) of both sides that pass both thresholds.

    Rows with equal normal forms are collapsed first. Titles meet in an index (see ``similar_titles``);
    companies are compared once per distinct pair among the titles that passed.
    """
    side = lambda df, p: df.select(
        normalize_company(F.col("company")).alias(f"{p}company"),
        normalize_title(F.col("title")).alias(f"{p}title"),
    ).distinct()
    return similar_forms(side(new, "n_"), side(stored, "s_"), thresholds)


def similar_forms(ours: DataFrame, theirs: DataFrame, thresholds: Thresholds) -> DataFrame:
    """``fuzzy_candidates`` of distinct normal forms (n_company, n_title) and (s_company, s_title)."""
    titles = similar_titles(ours.select("n_title"), theirs.select("s_title"), thresholds.title)
    pairs = ours.join(titles, "n_title").join(theirs, "s_title")
    companies = pairs.select("n_company", "s_company").distinct().withColumn(
        "company_score", company_score(F.col("n_company"), F.col("s_company"))
    )
    passed = companies.where(F.col("company_score") >= thresholds.company)
    return pairs.join(passed, ["n_company", "s_company"])


def _shared_grams(threshold: float, length: Column) -> Column:
    """How many bigrams, repeats counted, a string of ``length`` shares at least with any match at ``threshold``.

    With d characters deleted and i inserted, the bigrams of a fall by 2 d + i at most: of a pair with
    lengths a and b there remain 3 LCS - a - b - 1, where LCS is t (a + b) / 2 at least. The shortest partner counts.
    """
    t = threshold / 100
    shortest = F.ceil(length / _length_ratio(threshold) - 1e-9)
    return F.ceil((1.5 * t - 1) * (length + shortest) - 1 - 1e-9)


def _gram_keys(titles: DataFrame, sorted_: str, needed: Column, frequency: DataFrame) -> DataFrame:
    """(``sorted_``, key): a key for every two of the rarest bigrams of a string.

    Two strings that share s bigrams share two of the rarest n - s + 2 of either,
    as both are in one order of frequency.
    """
    ranked = _grams(titles, sorted_).join(frequency, "g").groupBy(sorted_).agg(
        F.sort_array(F.collect_list(F.struct("f", "g"))).alias("r")
    )
    rare = F.transform(F.slice("r", F.lit(1), (F.size("r") - needed + 2).cast("int")), lambda x: x["g"])
    pairs = F.transform(rare, lambda x, i: F.transform(F.slice(rare, i + 2, F.size(rare)), lambda y: F.xxhash64(x, y)))
    return ranked.select(sorted_, F.explode(F.flatten(pairs)).alias("key")).distinct()


def _grams(titles: DataFrame, sorted_: str) -> DataFrame:
    """(``sorted_``, g): bigrams, the repeats of one told apart by a number."""
    text = F.col(sorted_)
    plain = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2))))
    numbered = F.transform(plain, lambda g, i: F.concat(g, (i - F.array_position(plain, g)).cast("string")))
    return titles.select(sorted_, F.explode(numbered).alias("g"))


def title_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs (n_sorted, s_sorted) of distinct strings that may reach ``threshold``.

    Strings that share two bigrams with any match, which is all but the shortest ones, meet in an inverted index: of each
    string every two of its rarest bigrams, by their number in both dictionaries, are a key. How
    rare is enough follows from how many any match must share. Pairs with a short
    string meet by length, among strings of few characters.
    """
    n_needed, s_needed = (_shared_grams(threshold, F.length(c)) for c in ("n_sorted", "s_sorted"))
    frequency = _grams(left, "n_sorted").select("g").union(_grams(right, "s_sorted").select("g")).groupBy("g").agg(F.count("*").alias("f"))
    met = _gram_keys(left.where(n_needed >= 2), "n_sorted", n_needed, frequency).join(
        _gram_keys(right.where(s_needed >= 2), "s_sorted", s_needed, frequency), "key"
    )
    # A string has one row per key; the pairs lose their repeats before anything is compared.
    long = met.select("n_sorted", "s_sorted").distinct()
    n_short, s_short = left.withColumn("_short", n_needed < 2), right.withColumn("_short", s_needed < 2)
    near = _by_length(n_short, s_short, threshold).where(F.col("n_short") | F.col("s_short"))
    return long.union(near.select("n_sorted", "s_sorted"))


def _by_length(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of strings whose lengths may fit."""
    ratio = _length_ratio(threshold)
    if ratio == math.inf:
        bands, band = F.array(F.lit(0)), F.lit(0)
    else:
        own = _band(F.length("n_sorted"), ratio)
        bands = F.when(own == -1, F.array(F.lit(-1))).otherwise(F.array(own - 1, own, own + 1))
        band = _band(F.length("s_sorted"), ratio)
    short = lambda df, p: df.withColumnRenamed("_short", f"{p}_short") if "_short" in df.columns else df
    return short(left, "n").withColumn("_band", F.explode(bands)).join(short(right, "s").withColumn("_band", band), "_band")


def similar_titles(ours: DataFrame, theirs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of distinct normal titles with their token-sorted score.

    At thresholds of two thirds or less no bigram needs to be shared, so all titles of fitting lengths are compared.
    """
    left = ours.distinct().withColumn("n_sorted", token_sort(F.col("n_title")))
    right = theirs.distinct().withColumn("s_sorted", token_sort(F.col("s_title")))
    n_words, s_words = left.select("n_sorted").distinct(), right.select("s_sorted").distinct()
    indexed = 1.5 * threshold / 100 - 1 > 1e-6
    met = title_pairs(n_words, s_words, threshold) if indexed else _by_length(n_words, s_words, threshold)
    possible = met.where(similar_titles_possible(F.col("n_sorted"), F.col("s_sorted"), threshold)).select("n_sorted", "s_sorted")
    scored = possible.withColumn("title_score", indel_ratio(F.col("n_sorted"), F.col("s_sorted")))
    passed = scored.where(F.col("title_score") >= threshold)
    return passed.join(left, "n_sorted").join(right, "s_sorted").select("n_title", "s_title", "title_score")


def verify_text(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose texts ``n_text`` and ``s_text`` (lower case) reach ``threshold``."""
    score = indel_ratio_at_least(F.col("n_text"), F.col("s_text"), threshold)
    return pairs.withColumn("description_score", score).where(
        F.col("description_score") >= threshold
    )


def similar_texts(new: DataFrame, stored: DataFrame, threshold: float, first_only: bool = False) -> DataFrame:
    """(nid, sid, description_score) of different texts at ``threshold``, found by their pieces.

    Both sides come from ``distinct_texts``. Only for thresholds with ``piece_tiers``. With ``first_only``,
    pairs of a new text and any but the first stored text of one company and title may be left out.
    """
    return similar_in_cells(new, stored, threshold, piece_tiers(threshold), first_only)


def _compare(pairs: DataFrame, new: DataFrame, stored: DataFrame, threshold: float) -> DataFrame:
    """Fetch the texts of (nid, sid) pairs and compare the ones that differ."""
    texts = pairs.join(new.select("nid", F.col("_text").alias("n_text")), "nid").join(
        stored.select("sid", F.col("_text").alias("s_text")), "sid"
    )
    # The comparison costs far more than a shuffle, and one text may be in very many pairs.
    n_tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    different = texts.where(F.col("n_text") != F.col("s_text")).repartition(n_tasks, "nid", "sid")
    return verify_text(different, threshold).select("nid", "sid", "description_score")


def match_variants(new: DataFrame, stored: DataFrame, thresholds: Thresholds) -> DataFrame:
    """First match of each distinct (text, company, title) of the new side among equal texts and, at low thresholds, all texts.

    ``new`` and ``stored`` come from ``with_keys`` and carry ``pos`` and ``seq``.
    """
    ours, theirs = _variants(new, "pos", "n_"), _variants(stored, "seq", "s_")
    titles_fit = similar_titles_possible(F.col("n_sorted"), F.col("s_sorted"), thresholds.title)
    equal = _score_pairs(
        ours.join(theirs, F.col("n_digest") == F.col("s_digest")).where(titles_fit), thresholds
    ).withColumn("description_score", F.lit(100.0))
    matches = [equal]
    if _by_titles_first(thresholds):
        new_texts, stored_texts = _one_per_text(new, "pos", "nid"), _one_per_text(stored, "seq", "sid")
        n_ids = new_texts.select("nid", F.col("_digest").alias("n_digest"))
        s_ids = stored_texts.select("sid", F.col("_digest").alias("s_digest"))
        # Titles and companies come before the texts, and each pair of texts
        # is compared once however many titles and companies it has.
        pairs = _pairs_by_forms(ours, theirs, thresholds).where(F.col("n_digest") != F.col("s_digest"))
        scored = pairs.join(n_ids, "n_digest").join(s_ids, "s_digest")
        texts = _compare(
            scored.select("nid", "sid").distinct(), new_texts, stored_texts, thresholds.description
        )
        matches.append(scored.join(texts, ["nid", "sid"]))
    return _first_of(matches)


def _one_per_text(keyed: DataFrame, order: str, out: str) -> DataFrame:
    """One row per distinct text, written once, since several joins read it."""
    texts = keyed.groupBy("_digest").agg(F.min(order).alias(out), F.any_value("_text").alias("_text"))
    return materialize(texts, "texts")


def near_variants(new: DataFrame, stored: DataFrame, thresholds: Thresholds) -> DataFrame:
    """First match of each distinct (text, company, title) of the new side among different texts, at high thresholds.

    Few pairs of texts are left by the search, so texts are compared first, and titles and companies are added.
    """
    new_texts, stored_texts = distinct_texts(new, "pos", "nid"), distinct_texts(stored, "seq", "sid")
    texts = materialize(similar_texts(new_texts, stored_texts, thresholds.description, first_only=True), "similar")
    ids = lambda keyed, order, p: keyed.groupBy(F.col("_digest").alias(f"{p}_digest")).agg(F.min(order).alias(f"{p}id"))
    ours, theirs = _variants(new, "pos", "n_"), _variants(stored, "seq", "s_")
    pairs = (
        texts.join(ids(new, "pos", "n"), "nid").join(ours, "n_digest")
        .join(ids(stored, "seq", "s"), "sid").join(theirs, "s_digest")
        .where(similar_titles_possible(F.col("n_sorted"), F.col("s_sorted"), thresholds.title))
    )
    return _first_of([_score_pairs(pairs, thresholds)])


def _by_titles_first(thresholds: Thresholds) -> bool:
    """Whether the threshold is so low that texts have no key of their own."""
    return thresholds.description < 100 and not piece_tiers(thresholds.description)


def _first_of(matches: list[DataFrame]) -> DataFrame:
    """The match with the smallest ``s_first`` for each (text, company, title) of the new side."""
    columns = [
        "n_digest", "n_company", "n_title", "s_first", "company_score", "title_score", "description_score",
    ]
    every = reduce(lambda a, b: a.unionByName(b), [m.select(*columns) for m in matches])
    first = F.min_by(F.struct("s_first", "company_score", "title_score", "description_score"), "s_first")
    return every.groupBy("n_digest", "n_company", "n_title").agg(first.alias("m")).select(
        F.col("n_digest").alias("_digest"), "n_company", "n_title", "m.*"
    )


def _slices(stored: DataFrame, first: int | None = None, growth: int | None = None) -> list[tuple[int, int]]:
    """Ranges of ``seq`` to search one after the other, short ones first."""
    size = stored.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    if size.low is None:
        return [(0, 0)]
    slices, low, width = [], size.low, first or FIRST_SLICE
    while low <= size.high:
        slices.append((low, low + width))
        low, width = low + width, width * (growth or SLICE_GROWTH)
    return slices


def find_matches(new: DataFrame, stored: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """(pos, matched seq, three scores): one row per new listing that was seen before.

    The store is searched for equal texts, and at low thresholds for all, in slices of store order that are each many
    times longer than the one before. A listing that has matched leaves the search, since
    its first match cannot be in a later slice. So a family that is large on
    both sides meets in a short slice and is gone from the rest. At low thresholds very many texts meet, so the slices begin
    much shorter. At high thresholds similar texts are searched once, in cells of like length.
    """
    keys = ["_digest", "n_company", "n_title"]
    ours = with_keys(new.select("pos", "company", "title", "description"))
    theirs = with_keys(stored.select("seq", "company", "title", "description"))
    low_threshold = _by_titles_first(thresholds)
    found = []
    if thresholds.description < 100 and not low_threshold:
        # The search reads the store several times, which may be a join of whole texts; the new listings may be many more.
        theirs = materialize(theirs, "stored")
        found.append(materialize(near_variants(ours, theirs, thresholds), "variants"))
    if not low_threshold:
        # Equal texts need no text: their digests meet.
        ours = materialize(ours.select("pos", *keys, "_len"), "keys")
        theirs = materialize(theirs.select("seq", *keys, "_len"), "keys")
    slices = _slices(stored, LOW_SLICE, LOW_GROWTH) if low_threshold else _slices(stored)
    still_open = ours
    for low, high in slices:
        part = theirs.where((F.col("seq") >= low) & (F.col("seq") < high))
        found.append(materialize(match_variants(still_open, part, thresholds), "variants"))
        still_open = still_open.join(found[-1].select(*keys), keys, "left_anti")
        if low_threshold and high != slices[-1][1] and still_open.isEmpty():
            break
    first = F.min_by(F.struct("s_first", "company_score", "title_score", "description_score"), "s_first")
    variants = reduce(lambda a, b: a.unionByName(b), found).groupBy(*keys).agg(first.alias("m")).select(*keys, "m.*")
    return ours.select("pos", *keys).join(variants, keys).select(
        "pos",
        F.col("s_first").alias("matched_seq"),
        "company_score",
        "title_score",
        "description_score",
    )


def match_details(matches: DataFrame, stored: DataFrame) -> DataFrame:
    """Matches with the fields of the stored listing."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    details = stored.select(
        F.col("seq").alias("matched_seq"),
        F.col("company").alias("matched_company"),
        F.col("title").alias("matched_title"),
        F.col("description").alias("matched_description"),
        text("url").alias("matched_url"),
        text("first_seen").alias("matched_first_seen"),
    )
    return matches.join(details, "matched_seq")


def deduplicate(
    new: DataFrame, stored: DataFrame, thresholds: Thresholds = Thresholds()
) -> tuple[DataFrame, DataFrame]:
    """New listings that match nothing in the store, and the matches of the others.

    Listings of the same run are not compared with each other.
    """
    matches = find_matches(new, stored, thresholds)
    return new.join(matches.select("pos"), "pos", "left_anti"), matches
