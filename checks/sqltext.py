"""DuckDB expressions for the scalars that need long ones."""

from __future__ import annotations

# Company suffixes in their order.
SUFFIXES = [
    "inc", "llc", "corp", "corporation", "ltd", "limited",
    "co", "company", "group", "technologies", "tech",
    "solutions", "holdings", "enterprises", "services",
]


def norm_company(c: str) -> str:
    text = f"lower({c})"
    for suffix in SUFFIXES:
        text = f"regexp_replace({text}, '{suffix}[.,]?\\s*$', '')"
    text = f"regexp_replace({text}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def norm_title(c: str) -> str:
    return f"trim(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), '.,;:')"


def token_sort(c: str) -> str:
    return f"array_to_string(list_sort(string_split_regex(trim({c}), '\\s+')), ' ')"


def indel(a: str, b: str) -> str:
    """Indel distance by a bit vector in one HUGEINT, for up to 120 characters in ``a``."""
    mask = (
        f"list_aggregate(list_transform(range(length({a})), lambda i: "
        f"CASE WHEN substring({a}, CAST(i + 1 AS INT), 1) = ch THEN 1::HUGEINT << CAST(i AS INT) ELSE 0::HUGEINT END), 'bit_or')"
    )
    full = f"((1::HUGEINT << length({a})) - 1)"
    step = f"list_transform([s & {mask}], lambda u: ((s + u) | (s - u)) & {full})[1]"
    last = f"list_reduce(string_split({b}, ''), lambda s, ch: {step}, {full})"
    lcs = f"(length({a}) - bit_count({last}))"
    return f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN length({a}) + length({b}) ELSE length({a}) + length({b}) - 2 * {lcs} END)"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE ELSE 100 * (1 - {indel(a, b)}::DOUBLE / (length({a}) + length({b}))) END)"


def token_set_ctes(source: str, keep: str, a: str, b: str) -> dict[str, str]:
    """CTEs that end in ``token_sets``: ``keep`` columns and ``token_set_ratio``."""
    return {
        "token_lists": (
            f"SELECT {keep}, list_distinct(list_filter(string_split_regex({a}, '\\s+'), lambda x: x <> '')) AS la, "
            f"list_distinct(list_filter(string_split_regex({b}, '\\s+'), lambda x: x <> '')) AS lb FROM {source}"
        ),
        "token_parts": (
            f"SELECT {keep}, len(la) AS na, len(lb) AS nb, "
            "array_to_string(list_sort(list_filter(la, lambda x: list_contains(lb, x))), ' ') AS sect, "
            "array_to_string(list_sort(list_filter(la, lambda x: NOT list_contains(lb, x))), ' ') AS xa, "
            "array_to_string(list_sort(list_filter(lb, lambda x: NOT list_contains(la, x))), ' ') AS xb FROM token_lists"
        ),
        "token_lengths": (
            f"SELECT *, length(sect) AS s, length(xa) AS x, length(xb) AS y, CASE WHEN length(sect) > 0 THEN 1 ELSE 0 END AS e, "
            f"{indel('xa', 'xb')} AS d FROM token_parts"
        ),
        "token_sets": (
            f"SELECT {keep}, CASE WHEN na = 0 OR nb = 0 THEN 0.0::DOUBLE WHEN s > 0 AND (x = 0 OR y = 0) THEN 100.0::DOUBLE "
            "WHEN s = 0 THEN 100 - 100 * d::DOUBLE / (x + y) "
            "ELSE greatest(100 - 100 * d::DOUBLE / (2 * s + 2 * e + x + y), 100 - 100 * (e + x)::DOUBLE / (2 * s + e + x), "
            "100 - 100 * (e + y)::DOUBLE / (2 * s + e + y)) END AS token_set_ratio FROM token_lengths"
        ),
    }


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    )
    return f"(12742.0 * asin(sqrt(CASE WHEN {a} > 1 THEN 1.0 ELSE {a} END)))"


def age(c: str, dialect: str) -> str:
    if dialect == "short":
        text, pattern = f"lower(trim({c}))", "^(\\d+)\\s*(mo|d|w|h)"
        units = "WHEN 'h' THEN n / 24 WHEN 'd' THEN n WHEN 'w' THEN n * 7 WHEN 'mo' THEN n * 30"
    else:
        text, pattern = f"lower({c})", "(\\d+)\\s+(hour|day|week|month)"
        units = "WHEN 'hour' THEN n / 24 WHEN 'day' THEN n WHEN 'week' THEN n * 7 WHEN 'month' THEN n * 30"
    n = f"TRY_CAST(regexp_extract({text}, '{pattern}', 1) AS DOUBLE)"
    value = f"CASE regexp_extract({text}, '{pattern}', 2) {units.replace('n ', n + ' ').replace('THEN n', 'THEN ' + n)} END"
    if dialect == "today":
        return f"CASE WHEN contains(lower({c}), 'just posted') OR contains(lower({c}), 'today') THEN 0.0::DOUBLE ELSE {value} END"
    return f"({value})"


def strip_text(c: str) -> str:
    """Visible text of an HTML fragment."""
    text = f"regexp_replace({c}, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g')"
    text = f"regexp_replace({text}, '(?i)<br[^>]*>|</(?:p|div|li|h[1-6]|tr|ul|ol)>', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for entity, plain in [("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&#x27;", "chr(39)"), ("&amp;", "'&'")]:
        text = f"replace({text}, '{entity}', {plain})"
    text = f"regexp_replace({text}, '[ \\t]+', ' ', 'g')"
    text = f"regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"
