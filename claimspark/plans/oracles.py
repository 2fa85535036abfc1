"""The same queries as SQL that DuckDB runs on the driver tables."""

from __future__ import annotations

from claimspark.functions.constants import ANAPHORA, KEYWORDS, METRIC_TERMS, PREDICATE_TERMS, STATUS_PREDICATES, STATUS_STEMS, VINTAGE_TERMS
from claimspark.functions.normalize import LEGAL_SUFFIX, MONTH_YEAR, QUARTER, SINGLE, SOVEREIGN, SPAN, TITLE
from claimspark.operators.geometry import MARKERS, NUMERIC, PERIOD, PLACEHOLDERS
from claimspark.operators.store import SEARCHED


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def group(x: str, pattern: str, n: int) -> str:
    return f"nullif(regexp_extract({x}, {q(pattern)}, {n}), '')"


def rnd(x: str, places: int) -> str:
    return f"(floor(({x}) * 1e{places} + 0.5) / 1e{places})"


_VALUES = (("A", "v", "INR million", "'FY' || fy[3:4]", "consolidated", "[]"), ("P", "floor(v / 10 + 0.5)", "₹ crore", "'FY ' || fy", "consolidated", "[]"), ("S", "w", "INR million", "fy0 || '-' || fy[3:4]", "standalone", "[]"),
    ("E", "v * 0.98::DOUBLE", "INR million", "'FY' || fy[3:4]", "consolidated", "['First Advance Estimate', 'estimated']"), ("F", "v * 1.03::DOUBLE", "INR million", "'FY' || fy0 || '/' || fy[3:4]", "consolidated", "['forecast']"),
    ("R", "v * 1.1::DOUBLE", "INR million", "'FY' || fy[3:4]", "consolidated", "[]"), ("C", "v", "INR million", "'FY' || fy[3:4]", "consolidated", "[]"), ("U", "v", "INR million", "NULL", "consolidated", "[]"))

_NUMERIC = " UNION ALL ".join(
    f"SELECT n_name || '-' || fy || '-{s}' AS key, 'doc_{s}' AS document_id, fy::INT % 50 + 1 AS page, n_name || ' Limited revenue' AS subject, 'revenue' AS predicate, NULL::VARCHAR AS value_raw, ({v})::DOUBLE AS value_num, {q(unit)} AS unit, {period} AS period, NULL::VARCHAR AS as_of, {q(scope)} AS scope, {quals}::VARCHAR[] AS qualifiers FROM sums WHERE ({v}) IS NOT NULL"
    for s, v, unit, period, scope, quals in _VALUES
)

FACTS = f"""
sums AS (
  SELECT n_name, (y + 20)::VARCHAR AS fy, (y + 19)::VARCHAR AS fy0, v, w FROM (
    SELECT n_name, year(o_orderdate) AS y, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(18,2)::DOUBLE / 1000.0 AS v,
      sum(CASE WHEN c_mktsegment = 'BUILDING' THEN l_extendedprice::DECIMAL(18,2) END)::DECIMAL(18,2)::DOUBLE / 1000.0 AS w
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
), dates AS (SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l FROM orders GROUP BY ALL
), once AS (
  {_NUMERIC}
  UNION ALL SELECT c_name || '-' || s, 'doc_D', (c_custkey % 50 + 1)::INT, 'Mr. ' || c_name, 'board status', s, NULL, NULL, NULL, strftime(d, '%B %d, %Y'), NULL, []
  FROM (SELECT o_custkey, 'resigned from the Board' AS s, f AS d FROM dates UNION ALL SELECT o_custkey, 'ceased to be a Director', l FROM dates) JOIN customer ON o_custkey = c_custkey
), numbered AS (SELECT *, ('0x' || md5(key)[1:8])::BIGINT AS number FROM once
), facts AS (
  SELECT sha256(key || '|' || copy)[1:12] AS id, number * 2 + copy AS seq, document_id, document_id || '.pdf' AS document_name, page + copy AS page_number, subject, predicate, value_raw, value_num, unit, period, as_of, scope, qualifiers,
    0.9 AS confidence, 'evidence ' || key AS evidence_text
  FROM numbered, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR number % 7 = 0
)"""


def entity(subject: str, context: str) -> tuple[str, str]:
    """SQL of the canonical entity and of the remainder."""
    raw = strip(subject)
    low = f"lower({raw})"
    metric = lambda t: rf"(?i)^(.*?)\s+(?:on\s+)?(?:the\s+)?({t}.*)$"
    terms = sorted(METRIC_TERMS, key=len, reverse=True)
    no_scope = r"(?i)\b(?:net|standalone|consolidated)\b$"
    tidy = lambda x: strip(f"regexp_replace({strip(x)}, {q(no_scope)}, '')")
    head = "CASE " + " ".join(f"WHEN regexp_matches({raw}, {q(metric(t))}) THEN {tidy(f'regexp_extract({raw}, {q(metric(t))}, 1)')}" for t in terms) + f" ELSE {raw} END"
    rest = "CASE " + " ".join(f"WHEN regexp_matches({raw}, {q(metric(t))}) THEN {strip(f'regexp_extract({raw}, {q(metric(t))}, 2)')}" for t in terms) + " END"
    untitled = strip(f"regexp_replace({head}, {q(TITLE)}, '')")
    cleaned = strip(rf"regexp_replace({strip(f'''regexp_replace({untitled}, {q(LEGAL_SUFFIX)}, '', 'g')''')}, '[\s,.\-]+$', '')")
    clean = f"regexp_replace({context}, '[-_]', ' ', 'g')"
    named = rf"""CASE WHEN coalesce({context}, '') = '' THEN {raw} WHEN regexp_matches({clean}, '(?i)\bdelhivery\b') THEN 'Delhivery' WHEN regexp_matches({clean}, '(?i)\brbi\b|reserve bank') THEN 'Reserve Bank of India'
      ELSE coalesce({group(clean, chr(40) + "?:^|" + chr(92) + "s)(" + chr(92) + "p{Lu}" + chr(92) + "S{2,})", 1)}, {raw}) END"""
    cases = [
        (f"coalesce({subject}, '') = ''", "''", "NULL"),
        (f"{low} IN {ANAPHORA}", named, "NULL"),
        (f"starts_with({low}, 'reserve bank of india')", "'Reserve Bank of India'", f"nullif({strip(f'{raw}[22:]')}, '')"),
        (f"{low} = 'rbi'", "'Reserve Bank of India'", "NULL"),
        (f"starts_with({low}, 'international monetary fund')", "'IMF'", f"nullif({strip(f'{raw}[28:]')}, '')"),
        (f"{low} = 'imf'", "'IMF'", "NULL"),
        (f"regexp_matches({low}, '^(government of india|govt\\.? of india)')", "'Government of India'", "NULL"),
        (f"regexp_matches({raw}, {q(SOVEREIGN)})", "'India'", strip(f"regexp_extract({raw}, {q(SOVEREIGN)}, 2)")),
        (f"{low} IN ('india', 'india''s', 'indian economy')", "'India'", "NULL"),
    ]
    case = lambda i, other: "CASE " + " ".join(f"WHEN {c[0]} THEN {c[i]}" for c in cases) + f" ELSE {other} END"
    return case(1, f"coalesce(nullif({cleaned}, ''), {head})"), case(2, rest)


def predicate(text: str, rest: str) -> str:
    low = f"lower(coalesce({text}, ''))"
    t = f"regexp_replace(CASE WHEN coalesce({rest}, '') = '' THEN {low} ELSE trim(lower({rest}) || ' ' || {low}) END, '[-_/]', ' ', 'g')"
    tests = [(name, any_of(t, terms) + (f" OR (contains({t}, 'gdp') AND contains({t}, 'growth'))" if name == "gdp_growth" else "")) for name, terms in PREDICATE_TERMS]
    slug = rf"regexp_replace(regexp_replace({strip(t)}, '\s+', '_', 'g'), '[^a-z0-9_]', '', 'g')"
    return "CASE " + " ".join(f"WHEN {test} THEN {q(name)}" for name, test in tests) + f" ELSE coalesce(nullif({slug}, ''), 'unknown_predicate') END"


_FORMATS = ("%B %d, %Y", "%B %d %Y", "%b %d, %Y", "%b %d %Y", "%d %B %Y", "%d %b %Y", "%d %B, %Y", "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y")


def fiscal(x: str) -> str:
    n = f"try_cast(regexp_extract({x}, {q(SINGLE)}, 1) AS INT)"
    end = f"(CASE WHEN {n} < 100 THEN {n} + 2000 ELSE {n} END)"
    return f"CASE WHEN regexp_matches({x}, {q(SPAN)}) THEN 'FY20' || regexp_extract({x}, {q(SPAN)}, 1) || '-' || regexp_extract({x}, {q(SPAN)}, 2) WHEN {n} IS NOT NULL THEN 'FY' || ({end} - 1) || '-' || right({end}::VARCHAR, 2) END"


def period(p: str, a: str) -> tuple[str, str]:
    raw, other = strip(f"coalesce({p}, '')"), strip(f"coalesce({a}, '')")
    target = f"coalesce(nullif({raw}, ''), {other})"
    part = f"regexp_extract({target}, {q(QUARTER)}, 2)"
    part = f"(CASE WHEN length({part}) IN (2, 4) THEN 'FY' || {part} ELSE {part} END)"
    label = f"upper(coalesce({group(target, QUARTER, 1)}, 'Q' || {target}[1:1]))"
    plain = strip(rf"regexp_replace({target}, '(\d+)(?:st|nd|rd|th)\b', '\1', 'g')")
    date = "coalesce(" + ", ".join(f"try_strptime({plain}, {q(f)})" for f in _FORMATS) + ")"
    month = f"try_strptime(regexp_extract({plain}, {q(MONTH_YEAR)}, 1)[1:3] || ' ' || regexp_extract({plain}, {q(MONTH_YEAR)}, 2), '%b %Y')"
    year = group(target, r"\b(20\d\d)\b", 1)
    kind = f"CASE WHEN {raw} <> '' THEN 'date' ELSE 'as_of' END"
    cases = [
        (f"{target} = ''", "NULL", "'unknown'"),
        (f"regexp_matches({target}, {q(QUARTER)})", f"coalesce({fiscal(part)}, {part}) || '-' || {label}", "'quarter'"),
        (f"({fiscal(target)}) IS NOT NULL", fiscal(target), "'fiscal_year'"),
        (f"{date} IS NOT NULL", f"strftime({date}, '%Y-%m-%d')", kind),
        (f"regexp_matches({plain}, {q(MONTH_YEAR)})", f"strftime({month}, '%Y-%m-%d')", kind),
        (f"{year} IS NOT NULL", year, f"CASE WHEN {other} <> '' OR contains(lower({target}), 'as of') THEN 'as_of' ELSE 'date' END"),
    ]
    case = lambda i, e: "CASE " + " ".join(f"WHEN {c[0]} THEN {c[i]}" for c in cases) + f" ELSE {e} END"
    return case(1, target), case(2, "'unknown'")


def value(num: str, raw: str, unit: str) -> tuple[str, str]:
    text = strip(f"replace({raw}, ',', '')")
    v = f"coalesce({num}, CASE WHEN regexp_full_match({text}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN {text}::DOUBLE END)"
    u = f"lower({strip(unit)})"
    words = rf"regexp_split_to_array({u}, '\s+')"
    cases = [
        (f"{v} IS NULL", "NULL", "NULL"),
        (f"{unit} IS NULL", rnd(v, 4), "NULL"),
        (f"regexp_matches({u}, '^(%|percent|per cent|pct)')", rnd(v, 4), "'percent'"),
        (f"contains({u}, 'crore') OR list_contains({words}, 'cr') OR {u} = 'cr.'", rnd(f"{v} * 10.0::DOUBLE", 4), "'INR million'"),
        (f"contains({u}, 'million') OR list_contains({words}, 'mn') OR contains({u}, 'inr m')", rnd(v, 4), "'INR million'"),
        (f"contains({u}, 'lakh') OR contains({u}, 'lac')", rnd(f"{v} * 0.1::DOUBLE", 4), "'INR million'"),
        (f"contains({u}, 'billion')", rnd(f"{v} * 1000.0::DOUBLE", 4), "'INR million'"),
        (f"{u} IN ('inr', '₹', 'rs', 'rs.', 'rupees')", rnd(f"{v} / 1000000.0::DOUBLE", 6), "'INR million'"),
    ]
    case = lambda i, e: "CASE " + " ".join(f"WHEN {c[0]} THEN {c[i]}" for c in cases) + f" ELSE {e} END"
    return case(1, rnd(v, 4)), case(2, u)


def _norm() -> str:
    e, r = entity("subject", "document_name")
    v, u = value("value_num", "value_raw", "unit")
    p, t = period("period", "as_of")
    return f"""{FACTS}, named AS (SELECT *, {e} AS canonical_subject, {r} AS remainder FROM facts
), norm AS (
  SELECT * EXCLUDE (remainder), {predicate('predicate', 'remainder')} AS canonical_predicate, {v} AS normalized_value, {u} AS normalized_unit, {p} AS normalized_period, {t} AS period_type FROM named
)"""


NORM = _norm()


def _low(*c: str) -> str:
    return f"lower(trim(coalesce({', '.join(f'nullif({x}, {chr(39) * 2})' for x in c)})))"


VALUE_TEXT = "CASE WHEN {v} IS NULL THEN {r} ELSE regexp_replace(regexp_replace(printf('%.6f', floor(({v}) * 1e6 + 0.5) / 1e6), '0+$', ''), '\\.$', '') END"
FINGERPRINT = "sha256(concat_ws(chr(1), " + ", ".join(f"coalesce({x}, '')" for x in (
    _low("document_name", "document_id"), _low("canonical_subject", "subject"), _low("canonical_predicate", "predicate"), _low(VALUE_TEXT.format(v="coalesce(normalized_value, value_num)", r="value_raw")),
    _low("normalized_unit", "unit"), _low("normalized_period", "period"), _low("as_of"), _low("scope"))) + "))"

DEDUPED = f"""{NORM}, printed AS (SELECT *, {FINGERPRINT} AS fingerprint FROM norm
), groups AS (SELECT fingerprint, min(seq) AS first, list(page_number ORDER BY seq) AS pages FROM printed GROUP BY ALL
), deduped AS (
  SELECT p.* REPLACE (list_concat(qualifiers, list_filter(list_transform(pages[2:], lambda x: 'duplicate-evidence: p.' || x), lambda n: NOT list_contains(qualifiers, n))) AS qualifiers)
  FROM printed p JOIN groups g ON p.fingerprint = g.fingerprint AND seq = first
)"""

PAIRS = f"""{DEDUPED}, blocked AS (SELECT *, coalesce({_low("canonical_subject", "subject")}, '') AS subject_key, coalesce({_low("canonical_predicate", "predicate")}, '') AS predicate_key FROM deduped
), pairs AS (
  SELECT a, b FROM blocked a JOIN blocked b ON a.subject_key = b.subject_key AND a.predicate_key = b.predicate_key AND a.id < b.id
  WHERE NOT (a.document_id IS NOT DISTINCT FROM b.document_id AND a.page_number IS NOT DISTINCT FROM b.page_number AND trim(a.evidence_text) IS NOT DISTINCT FROM trim(b.evidence_text) AND a.value_raw IS NOT DISTINCT FROM b.value_raw AND a.value_num IS NOT DISTINCT FROM b.value_num)
    AND (a.normalized_value IS NULL) = (b.normalized_value IS NULL)
    AND NOT (a.normalized_value IS NOT NULL AND coalesce(a.normalized_unit, '') <> '' AND coalesce(b.normalized_unit, '') <> '' AND a.normalized_unit <> b.normalized_unit)
)"""

_V, _U = "coalesce({0}.normalized_value, {0}.value_num)", "coalesce({0}.normalized_unit, {0}.unit)"
_SET = "list_sort(list_distinct(list_transform({0}.qualifiers, lambda x: lower(trim(x)))))"


def _known(a: str, b: str, none: str) -> str:
    return f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN '{none}' WHEN {a} IS NULL OR {b} IS NULL THEN 'unknown' WHEN {a} = {b} THEN 'same' ELSE 'different' END"


def _two(*c: str) -> tuple[str, str]:
    return tuple(_low(*[f"{p}.{x}" for x in c]) for p in "ab")


COMPARED = f"""{PAIRS}, measured AS (
  SELECT *, {_V.format('a')} AS v1, {_V.format('b')} AS v2, {_U.format('a')} AS u1, {_U.format('b')} AS u2, {rnd(f"abs({_V.format('a')} - {_V.format('b')})", 6)} AS diff, greatest(abs({_V.format('a')}), abs({_V.format('b')})) AS most FROM pairs
), relative AS (SELECT *, CASE WHEN most > 0 THEN {rnd('diff / most', 6)} ELSE 0.0 END AS rel FROM measured
), numbers AS (
  SELECT *, CASE WHEN v1 IS NULL OR v2 IS NULL THEN 'categorical' WHEN u1 IS DISTINCT FROM u2 THEN 'incompatible_units' WHEN diff < 1e-5 THEN 'exact' WHEN rel <= 0.005 THEN 'close_rounding' ELSE 'different' END AS status,
    coalesce(a.normalized_period, '') <> '' AND coalesce(b.normalized_period, '') <> '' AS known, a.period_type IS NOT DISTINCT FROM b.period_type AS one_type FROM relative
), dims AS (
  SELECT *, status <> 'categorical' AS is_numeric, known AND one_type AS same_type, known AND one_type AND lower(trim(a.normalized_period)) = lower(trim(b.normalized_period)) AS same_period FROM numbers
), compared AS (
  SELECT *, CASE WHEN coalesce({_two('canonical_subject', 'subject')[0]} = {_two('canonical_subject', 'subject')[1]}, false) THEN 'same' ELSE 'different' END AS d_subject,
    CASE WHEN coalesce({_two('canonical_predicate', 'predicate')[0]} = {_two('canonical_predicate', 'predicate')[1]}, false) THEN 'same' ELSE 'different' END AS d_predicate,
    CASE WHEN is_numeric THEN CASE WHEN status IN ('exact', 'close_rounding') THEN 'same' ELSE 'different' END WHEN a.value_num IS NULL AND b.value_num IS NULL AND lower(trim(a.value_raw)) IS NOT DISTINCT FROM lower(trim(b.value_raw)) THEN 'same' ELSE 'different' END AS d_value,
    {_known(*_two('normalized_unit', 'unit'), 'same')} AS d_unit,
    CASE WHEN known THEN CASE WHEN same_period THEN 'same' ELSE 'different' END ELSE {_known(*_two('normalized_period', 'period'), 'unknown')} END AS d_period,
    {_known(*_two('scope'), 'same')} AS d_scope,
    CASE WHEN len(a.qualifiers) = 0 AND len(b.qualifiers) = 0 THEN 'same' WHEN len(a.qualifiers) = 0 OR len(b.qualifiers) = 0 THEN 'different' WHEN {_SET.format('a')} = {_SET.format('b')} THEN 'same' ELSE 'different' END AS d_qualifiers
  FROM dims
)"""

_FORECAST = " OR ".join(f"len(list_filter({p}.qualifiers, lambda q: contains(lower(q), 'forecast') OR contains(lower(q), 'project'))) > 0 OR contains(lower(coalesce({p}.predicate, '')), 'project')" for p in "ab")
_PROGRESS = " AND ".join(f"{p}.value_num IS NULL AND coalesce({any_of(f'lower(trim({p}.value_raw))', STATUS_STEMS)}, false)" for p in "ab")
_VINTAGE = f"len(list_filter(list_concat(a.qualifiers, b.qualifiers), lambda q: {any_of('lower(q)', VINTAGE_TERMS)})) > 0"
RULES = (
    ("ambiguous_period", "d_period = 'unknown' OR (NOT same_period AND NOT same_type AND (coalesce(a.period, '') = '' OR coalesce(b.period, '') = ''))", "UNCERTAIN", 0.75),
    ("predicate", "d_predicate = 'different'", "UNRELATED", 0.90),
    ("forecast", "forecast AND d_value = 'different'", "RECONCILABLE", 0.88),
    ("temporal", "NOT is_numeric AND (d_period = 'different' OR a.as_of IS DISTINCT FROM b.as_of)", "RECONCILABLE", 0.92),
    ("progression", f"NOT is_numeric AND d_subject = 'same' AND d_predicate = 'same' AND d_value = 'different' AND {_two('canonical_predicate', 'predicate')[0]} IN {STATUS_PREDICATES} AND {_PROGRESS}", "RECONCILABLE", 0.93),
    ("vintage", f"d_value = 'different' AND d_qualifiers = 'different' AND {_VINTAGE}", "RECONCILABLE", 0.95),
    ("scope", "d_scope = 'different'", "RECONCILABLE", 0.95),
    ("rounding", "status = 'close_rounding' AND d_period = 'same'", "CORROBORATES", 0.92),
    ("exact", "d_value = 'same' AND d_period = 'same' AND d_scope = 'same'", "CORROBORATES", 0.96),
    ("period_difference", "is_numeric AND d_subject = 'same' AND d_predicate = 'same' AND d_period = 'different' AND d_scope = 'same' AND d_value = 'different' AND NOT forecast", "RECONCILABLE", 0.90),
    ("contradiction", "d_subject = 'same' AND d_predicate = 'same' AND d_period = 'same' AND d_scope = 'same' AND d_value = 'different' AND NOT forecast", "CONTRADICTS", 0.85),
)
_RULE = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test, _, _ in RULES) + " ELSE 'default' END"
RELATED = f"""{COMPARED}, foreseen AS (SELECT *, ({_FORECAST}) AS forecast FROM compared
), ruled AS (SELECT *, {_RULE} AS rule FROM foreseen
), related AS (
  SELECT *, a.id || '_' || b.id AS id, a.id AS fact_a_id, b.id AS fact_b_id, CASE rule {' '.join(f"WHEN '{n}' THEN '{label}'" for n, _, label, _ in RULES)} ELSE 'UNCERTAIN' END AS relationship,
    (CASE rule {' '.join(f"WHEN '{n}' THEN {c}" for n, _, _, c in RULES)} ELSE 0.5 END)::DOUBLE AS confidence FROM ruled
)"""

# pages -------------------------------------------------------------------------------------------------------------
_ASCII = "regexp_replace({0}, '[À-ÖØ-öø-ÿĀ-ɏ]', 'a', 'g')"
_N = r"\b\d+(?:\.\d+)?\b"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


_TITLE = r"regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{L}\p{Lu}') AND NOT regexp_matches(x, '(^|[^\p{L}])\p{Ll}')"
_UPPER = r"regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}')"
_HITS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, '\\b{k}\\b') THEN '{k}' END" for k in KEYWORDS) + "], lambda k: k IS NOT NULL)"
_REPORT = f"""coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'REVENUE GROWTH' || chr(10) || '1 2 3' || chr(10) || '4 5 6' || chr(10) || 'The board said that real GDP growth moderated to ' || doc_id % 10 || '.5 per cent in 2024-25, by second advance figures.' || chr(10)
  || 'That year headline inflation had declined to ' || doc_id % 7 || '.2 percent in September 2025.' || chr(10) || 'Then revenue from services stood at ₹' || (doc_id + 1) || ' cr for FY24' || chr(10) || 'net loss for FY24 was ₹' || (doc_id + 2) || ' cr; Ms. Ann Lee ceased to be a Director with effect from May 01, 2024.'
  WHEN 1 THEN chr(10) || 'Notice Of Meeting' || chr(10) || 'A director was appointed to the board.' ELSE '' END"""
SCORED = rf"""written_in AS (SELECT doc_id, source, {_REPORT} AS t FROM documents
), pages_in AS (SELECT doc_id::VARCHAR AS document_id, t, {_ASCII.format("t")} AS ascii FROM written_in
), counted AS (
  SELECT document_id, trim(regexp_replace(t, '\s+', ' ', 'g')) = '' AS blank, greatest({_count('t', '[\\p{L}\\p{N}_]+')}, 1) AS tokens, {_count('ascii', _N)} AS numbers, {_count('ascii', '(?i)%\\b|\\bpercent\\b|\\bper cent\\b')} AS percentage_count,
    {_count('ascii', '(?i)₹|\\$|INR\\b|USD\\b|Rs\\.?|crore\\b|million\\b|billion\\b|lakh\\b')} AS currency_count,
    {_count('ascii', '(?i)\\bFY\\d{2,4}\\b|\\b20\\d{2}-\\d{2,4}\\b|\\bQ[1-4]\\b|\\bMarch \\d{1,2}\\b|\\bApril\\b|\\bDecember\\b')} AS date_fiscal_count,
    len(list_filter(regexp_split_to_array(ascii, '\r\n|[\n\x0b\x0c\r]'), lambda x: {_count('x', _N)} >= 3)) AS tabular_lines,
    len(list_filter(regexp_split_to_array(t, '\r\n|[\n\x0b\x0c\r]'), lambda x: {_count('x', '[^' + chr(92) + 's]+')} BETWEEN 2 AND 8 AND (({_UPPER}) OR ({_TITLE})))) AS headings,
    lower(ascii) AS low FROM pages_in
), parts AS (
  SELECT *, {rnd('numbers / tokens', 4)} AS density, (CASE WHEN tabular_lines >= 2 THEN 2.0 ELSE 0.0 END)::DOUBLE + least(tabular_lines * 0.2::DOUBLE, 1.5) AS tables, least(headings * 0.3::DOUBLE, 1.5) AS heads, {_HITS} AS hits FROM counted
), scored AS (
  SELECT document_id, 1 AS page_number, CASE WHEN blank THEN 0 ELSE density END AS numeric_density, (CASE WHEN blank THEN 0 ELSE percentage_count END)::INT AS percentage_count, (CASE WHEN blank THEN 0 ELSE currency_count END)::INT AS currency_count,
    (CASE WHEN blank THEN 0 ELSE date_fiscal_count END)::INT AS date_fiscal_count, (CASE WHEN blank THEN 0 ELSE tabular_lines END)::INT AS tabular_lines, CASE WHEN blank THEN 0 ELSE {rnd('tables', 2)} END AS table_score, CASE WHEN blank THEN 0 ELSE {rnd('heads', 2)} END AS heading_score,
    CASE WHEN blank THEN 0 ELSE {rnd('least(len(hits) * 0.8::DOUBLE, 4.0)', 2)} END AS keyword_score, CASE WHEN blank THEN [] ELSE hits END AS keyword_matches,
    CASE WHEN blank THEN 0 ELSE {rnd('least(density * 10.0::DOUBLE, 3.0) + least(percentage_count * 0.5::DOUBLE, 2.0) + least(currency_count * 0.4::DOUBLE, 2.0) + least(date_fiscal_count * 0.5::DOUBLE, 2.0) + tables + heads + least(len(hits) * 0.8::DOUBLE, 4.0)', 2)} END AS total_score FROM parts
)"""

_COLLAPSED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
GROUNDED = f"""texts AS (SELECT doc_id, {_COLLAPSED.format("coalesce(text, '')")} AS t FROM documents
), claims AS (SELECT doc_id::VARCHAR AS id, doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS page_number, CASE WHEN doc_id % 3 = 0 THEN reverse(t[5:44]) ELSE t[5:44] END AS evidence_text FROM texts
), grounded AS (SELECT c.*, page_number = 1 AND {_COLLAPSED.format('evidence_text')} <> '' AND contains(t, {_COLLAPSED.format('evidence_text')}) AS verified FROM claims c JOIN texts ON document_id = doc_id::VARCHAR)"""

# words -------------------------------------------------------------------------------------------------------------
PLACED = """placed AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INT AS r FROM lineitem
)"""
#: Lines by a running mean: words of a page in order, one at a time, with the sums and counts of the lines so far.
WORDS = f"""RECURSIVE {PLACED}, four AS (
  SELECT l_orderkey AS page, r, 0 AS k, NULL::DOUBLE AS edge, 'Item' || l_partkey AS text FROM placed
  UNION ALL SELECT l_orderkey, r, 1, 250 + (l_partkey % 5 - 2) * 0.5::DOUBLE, printf('%.2f', l_quantity) FROM placed
  UNION ALL SELECT l_orderkey, r, 2, 350 + (l_partkey % 5 - 2) * 0.5::DOUBLE, printf('%.2f', l_extendedprice) FROM placed
  UNION ALL SELECT l_orderkey, r, 3, 450 + (l_partkey % 5 - 2) * 0.5::DOUBLE, printf('%.2f', l_discount) FROM placed
), words AS (
  SELECT page, coalesce(edge - length(text) * 5.0::DOUBLE, 30.0::DOUBLE) AS x0, coalesce(edge, 30.0::DOUBLE + length(text) * 5.0::DOUBLE) AS x1, text, (r * 4 + k)::INT AS word_no,
    40.0::DOUBLE + 12 * r + 30 * (r // 4) + ((r * 4 + k) * 7 % 5) * 0.75::DOUBLE - 1.5::DOUBLE + CASE WHEN r % 3 = 2 THEN k * 2.5::DOUBLE ELSE 0 END AS y0 FROM four
), centred AS (
  SELECT *, y0 + 9 AS y1, 9.0::DOUBLE AS h, greatest(1.0::DOUBLE, 0.45::DOUBLE * 9) AS tol, y0 + 4.5::DOUBLE AS c, row_number() OVER (PARTITION BY page ORDER BY y0, x0, word_no) AS n FROM words
), fold AS (
  SELECT page, n, 1::BIGINT AS g, [c] AS sums, [1] AS counts FROM centred WHERE n = 1
  UNION ALL
  SELECT page, n, coalesce(i, len(sums) + 1), CASE WHEN i IS NULL THEN list_append(sums, c) ELSE list_transform(sums, lambda s, k: CASE WHEN k = i THEN s + c ELSE s END) END,
    CASE WHEN i IS NULL THEN list_append(counts, 1) ELSE list_transform(counts, lambda s, k: CASE WHEN k = i THEN s + 1 ELSE s END) END
  FROM (SELECT w.page, w.n, w.c, f.sums, f.counts, nullif(list_position(list_transform(f.sums, lambda s, k: abs(w.c - s / f.counts[k]) <= w.tol), true), 0) AS i FROM fold f JOIN centred w ON w.page = f.page AND w.n = f.n + 1)
), final AS (SELECT page, arg_max(sums, n) AS sums, arg_max(counts, n) AS counts FROM fold GROUP BY page
), ranked AS (
  SELECT page, g, row_number() OVER (PARTITION BY page ORDER BY mean, g) - 1 AS line FROM (SELECT page, unnest(range(1, len(sums) + 1)) AS g, unnest(list_transform(sums, lambda s, k: s / counts[k])) AS mean FROM final)
), lined AS MATERIALIZED (SELECT w.page, x0, y0, x1, y1, text, word_no, h, line FROM centred w JOIN fold f USING (page, n) JOIN ranked r ON r.page = w.page AND r.g = f.g
), gaps AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page, line ORDER BY x0, word_no) < greatest(7.0, 1.25 * h) THEN 0 ELSE 1 END AS n FROM lined
), numbered AS (SELECT *, (sum(n) OVER (PARTITION BY page, line ORDER BY x0, word_no) - 1)::BIGINT AS cell FROM gaps
), line_cells AS MATERIALIZED (SELECT page, line, cell, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, string_agg(text, ' ' ORDER BY x0, word_no) AS text FROM numbered GROUP BY page, line, cell
)"""


def token_class(x: str) -> str:
    unmarked = lambda t: f"trim(regexp_replace({t}, {q(MARKERS)}, ''))"
    bare = unmarked(f"trim(trim({x}), '()[]{{}}.,;:')")
    number = f"regexp_replace({unmarked(f'trim({x})')}, '[−–]', '-', 'g')"
    return f"CASE WHEN lower(trim({x})) IN {PLACEHOLDERS} THEN 'placeholder' WHEN regexp_matches({bare}, {q('(?i)' + PERIOD)}) THEN 'period' WHEN lower({unmarked(f'trim({x})')}) NOT IN {PLACEHOLDERS} AND regexp_matches({number}, {q('(?i)' + NUMERIC)}) THEN 'numeric' ELSE 'text' END"


#: Right edges by a running median, one number of a page at a time.
ANCHORS = f"""{WORDS}, numeric_words AS (
  SELECT page, line, word_no, x0, x1, text, row_number() OVER (PARTITION BY page ORDER BY x1, line, word_no) AS n FROM lined WHERE {token_class('text')} = 'numeric'
), grown AS (
  SELECT page, n, 1 AS cluster, [x1] AS held FROM numeric_words WHERE n = 1
  UNION ALL
  SELECT w.page, w.n, cluster + new::INT, CASE WHEN new THEN [w.x1] ELSE list_append(held, w.x1) END FROM grown g JOIN numeric_words w ON w.page = g.page AND w.n = g.n + 1, LATERAL (SELECT w.x1 - list_median(held) > greatest(2.5::DOUBLE, 0.45::DOUBLE * 9) AS new)
), anchors AS (
  SELECT page, edge, lines, row_number() OVER (PARTITION BY page ORDER BY edge) - 1 AS anchor
  FROM (SELECT page, cluster, median(x1) AS edge, count(DISTINCT line) AS lines FROM numeric_words JOIN grown USING (page, n) GROUP BY ALL HAVING count(DISTINCT line) >= 3)
)"""

CELLS = f"""{PLACED}, table_cells AS (
  SELECT 't' || l_orderkey AS table_id, l_orderkey AS page, 0 AS row, 1 AS col, 1 AS row_span, 3 AS col_span, 200::DOUBLE AS x0, 20::DOUBLE AS y0, 450::DOUBLE AS x1, 29::DOUBLE AS y1, 'Amounts' AS text FROM placed WHERE r = 0
  UNION ALL SELECT 't' || l_orderkey, l_orderkey, r + 1, col, CASE WHEN l_partkey % 97 = 0 THEN 0 WHEN l_suppkey % 31 = 0 AND col = 2 THEN 2 ELSE 1 END, CASE WHEN l_suppkey % 37 = 0 AND col = 1 THEN 2 ELSE 1 END,
    50 + 100 * col, 40 + 12 * r, CASE WHEN l_partkey % 83 = 0 AND col = 3 THEN 'Infinity'::DOUBLE ELSE 90 + 100 * col END, CASE WHEN l_partkey % 89 = 0 THEN 30 ELSE 49 + 12 * r END, text
  FROM placed, (VALUES (0, 'label'), (1, 'quantity'), (2, 'price'), (3, 'discount')) v(col, text)
)"""
_STATUS = [(d, n) for d, n in zip(("row_value_association", "header_association", "entity", "period", "unit"), (41, 43, 47, 53, 59))]
CONTEXTS = f"""{CELLS}, said AS (
  {" UNION ALL ".join(f"SELECT l_orderkey * 1000 + r AS context_id, '{d}' AS dimension, l_partkey % {n} <> 0 AS ok, l_suppkey % 2 = 0 AS reasoned, {k} AS place FROM placed" for k, (d, n) in enumerate(_STATUS))}
  UNION ALL SELECT l_orderkey * 1000 + r, CASE WHEN l_partkey % 31 = 0 THEN 'unit' ELSE 'scale' END, l_partkey % CASE WHEN l_partkey % 31 = 0 THEN 2 ELSE 37 END <> 0, l_suppkey % 2 = 0, 9 FROM placed
), first_said AS (SELECT context_id, dimension, arg_min(ok, place) AS ok FROM said GROUP BY ALL
), status AS (
  SELECT context_id, bool_and(ok) AND count(*) = 6 AS is_resolved, coalesce(bool_or(ok) FILTER (dimension = 'row_value_association'), false) AS joined, coalesce(bool_or(ok) FILTER (dimension = 'header_association'), false) AS headed,
    coalesce(bool_or(ok) FILTER (dimension = 'unit'), false) AS unit_ok, coalesce(bool_or(ok) FILTER (dimension = 'scale'), false) AS scale_ok FROM first_said GROUP BY ALL
), ctx AS (
  SELECT l_orderkey * 1000 + r AS context_id, l_orderkey + (l_partkey % 61 = 0)::INT AS page, 't' || l_orderkey AS table_id, r + 1 AS row, l_partkey AS p, l_suppkey AS s, l_partkey % 11 = 0 OR l_partkey % 71 = 0 OR l_partkey % 73 = 0 AS incomplete,
    CASE WHEN s % 19 = 0 THEN 'NaN'::DOUBLE WHEN s % 23 <> 0 THEN l_extendedprice END AS number, CASE WHEN s % 5 = 0 THEN 'percent' WHEN s % 7 <> 0 THEN 'currency' END AS kind, CASE WHEN s % 11 = 0 THEN 'inr' WHEN s % 13 <> 0 THEN 'INR' END AS currency, p % 29 <> 0 AS valued
  FROM placed JOIN status ON status.context_id = l_orderkey * 1000 + r
)"""
_WRONG = {
    "association_incomplete": "joined AND incomplete", "association_without_value": "joined AND NOT valued", "header_path_missing": "headed AND p % 7 = 0", "unit_unresolved": "valued AND number IS NOT NULL AND NOT unit_ok", "scale_unresolved": "valued AND number IS NOT NULL AND NOT scale_ok",
    "value_text_missing": "valued AND s % 17 = 0", "number_without_unit": "valued AND (number IS NULL) <> (kind IS NULL)", "number_not_finite": "valued AND isnan(number)", "currency_missing": "valued AND kind = 'currency' AND currency IS NULL",
    "currency_not_allowed": "valued AND kind <> 'currency' AND currency IS NOT NULL", "currency_code_bad": "valued AND currency = 'inr'",
}
_REFS = """refs AS (
  SELECT *, 'label' AS use, row + (p % 67 = 0)::INT AS rr, 0 AS rc FROM ctx WHERE p % 11 <> 0 UNION ALL SELECT *, 'value', row, 2 + (p % 13 = 0)::INT FROM ctx WHERE p % 71 <> 0
  UNION ALL SELECT *, 'header', CASE WHEN p % 19 = 0 THEN row ELSE 0 END, 1 FROM ctx WHERE p % 7 <> 0 UNION ALL SELECT *, 'source', 99, 0 FROM ctx WHERE p % 23 = 0
), pointed AS (SELECT r.*, c.page AS cell_page, c.col_span AS wide FROM refs r LEFT JOIN table_cells c ON c.table_id = r.table_id AND c.row = rr AND c.col = rc)"""

SEARCH_SQL = " OR ".join(f"coalesce(lower({c}) LIKE '%nation_7 %', false)" for c in SEARCHED)
TOKENS = ("Q4 2024", "Q1 FY24", "Q5 2024", "1200", "£38m", "12.5%", "(1,234)", "FY2023/24", "2019-20", "n/a", "—", "31/12/2024", "Revenue", "USD 12.5", "₹ 8142 cr", "−5", "2024*")
ENTITIES = (("the Company", "delhivery-annual-report.pdf"), ("The Group", "rbi_report.pdf"), ("company", "Acme-2024.pdf"), ("RBI", ""), ("Reserve Bank of India repo rate", ""), ("IMF", ""), ("Govt. of India", ""), ("India's real GDP growth", ""), ("Indian economy", ""), ("Delhivery Limited revenue from operations", ""), ("Delhivery standalone net loss", ""), ("Mr. Sandeep Kumar Barasia", ""), ("Acme Pvt. Ltd., ", ""), ("Anil Patel", ""), ("", ""))
PREDICATES = (("growth rate", "real GDP growth"), ("board status", ""), ("loss for the year", "net loss"), ("CPI print", ""), ("pin-code reach", ""), ("EBITDA margin", ""), ("unemployment rate", "unemployment"), ("", ""), ("fiscal_deficit", ""))
PERIODS = (("Q4 FY24", ""), ("4Q FY24", ""), ("Q4 2023-24", ""), ("FY95", ""), ("2024/25", ""), ("September 2025", ""), ("", "July 01, 2024"), ("", "2022"), ("as of the 2022 Prospectus", ""), ("August 24th, 2023", ""), ("2023-08-24", ""), ("24/08/2023", ""), ("September", ""), ("", ""), ("Sept 2021", ""))
UNITS = ((5.0, "", "lakh"), (2.0, "", "billion"), (1500000.0, "", "₹"), (8142.0, "", "₹ crore"), (6.5, "", "per cent"), (None, "1,234.5", "INR million"), (None, "resigned", ""), (7.123456, "", "basis points"), (3.0, "", "cr"), (None, "1d", "INR million"), (None, "nan", ""), (None, "-1.5e2", "crore"))


def _rows(rows, names: str) -> str:
    lit = lambda x: "NULL" if x is None or x == "" else (q(x) if isinstance(x, str) else f"{x}::DOUBLE")
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


def _sql(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


_E, _R = entity("subject", "context")
_P, _T = period("p", "a")
_VAL, _UNIT = value("n::DOUBLE", "r", "u")
_CORE = "id, relationship, confidence, fact_a_id, fact_b_id"
_LISTED = "SELECT id, relationship, confidence, a.subject AS a_subject, b.subject AS b_subject, a.document_id AS a_document_id, b.document_id AS b_document_id FROM related"
_FACTS_N = FACTS.replace("SELECT sha256(key || '|' || copy)[1:12] AS id", "SELECT number, sha256(key || '|' || copy)[1:12] AS id")
_CLAIM = "lower(concat_ws(chr(1), trim(subject), {p}, " + VALUE_TEXT.format(v="value_num", r="value_raw") + ", coalesce({u}, ''), coalesce(as_of, '')))"
_OUTCOMES = f"""{_FACTS_N}, gold AS (
  SELECT document_id AS source, period, scope, key, row_number() OVER (PARTITION BY key ORDER BY seq) AS k
  FROM (SELECT *, {_CLAIM.format(p="predicate", u="CASE WHEN number % 3 = 0 THEN concat_ws(' ', unit, 'restated') ELSE unit END")} AS key FROM facts)
), predicted AS (
  SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) AS k, CASE WHEN number % 7 <> 0 THEN period END AS period, CASE WHEN number % 4 = 0 THEN 'group' ELSE scope END AS scope
  FROM (SELECT *, {_CLAIM.format(p="CASE WHEN number % 5 = 0 THEN 'turnover' ELSE predicate END", u="unit")} AS key FROM facts)
), outcomes AS (
  SELECT g.source, CASE WHEN p.key IS NULL THEN 'fn' WHEN g.key IS NOT NULL THEN 'tp' WHEN p.key IN (SELECT key FROM gold) THEN 'duplicate' ELSE 'unknown' END AS outcome,
    p.period AS pp, g.period AS gp, p.scope AS ps, g.scope AS gs
  FROM predicted p FULL JOIN gold g ON p.key = g.key AND p.k = g.k
), tally AS (
  SELECT count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'duplicate') AS fp_duplicate, count(*) FILTER (outcome = 'unknown') AS fp_unknown, count(*) FILTER (outcome = 'fn') AS fn,
    count(*) FILTER (outcome = 'tp' AND gp <> '') AS asked_p, count(*) FILTER (outcome = 'tp' AND gp <> '' AND lower(pp) = lower(gp)) AS had_p,
    count(*) FILTER (outcome = 'tp' AND gs <> '') AS asked_s, count(*) FILTER (outcome = 'tp' AND gs <> '' AND lower(ps) = lower(gs)) AS had_s FROM outcomes
), rates AS (SELECT *, CASE WHEN tp + fp_duplicate + fp_unknown > 0 THEN tp / (tp + fp_duplicate + fp_unknown) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM tally)"""
_KEY = "(lower(trim({0}.subject)) || chr(1) || lower({0}.predicate) || chr(1) || lower(" + VALUE_TEXT.format(v="{0}.value_num", r="{0}.value_raw") + ") || coalesce(chr(1) || lower({0}.unit), chr(1)))"
_UNIQUE = f"""{RELATED}, keyed AS (SELECT id, confidence, relationship, least({_KEY.format('a')}, {_KEY.format('b')}) || chr(2) || greatest({_KEY.format('a')}, {_KEY.format('b')}) AS pair FROM related
), best AS (SELECT pair, arg_min(relationship, (-confidence, id)) AS relationship FROM keyed GROUP BY pair
), gold_pairs AS (SELECT CASE WHEN ascii(md5(pair)[3:3]) % 6 = 0 THEN pair || '?' ELSE pair END AS pair, CASE WHEN ascii(md5(pair)[1:1]) % 4 = 0 THEN 'absent' ELSE 'label' END AS expectation, CASE WHEN ascii(md5(pair)[2:2]) % 5 = 0 THEN 'CONTRADICTS' ELSE relationship END AS expected FROM best
), judged AS (
  SELECT g.*, p.relationship AS produced, CASE WHEN expectation = 'absent' THEN CASE WHEN p.pair IS NULL THEN 'ok(absent)' ELSE 'VIOLATION' END
    WHEN p.pair IS NULL THEN 'missed' WHEN p.relationship = expected THEN 'ok' ELSE 'wrong(' || p.relationship || ')' END AS outcome
  FROM gold_pairs g LEFT JOIN best p USING (pair))"""

ORACLES: dict[str, str] = {
    "page_score_components": _sql(SCORED, "SELECT document_id, numeric_density, percentage_count, currency_count, date_fiscal_count, tabular_lines, table_score, heading_score, keyword_score FROM scored"),
    "page_score_total": _sql(SCORED, "SELECT document_id, total_score, total_score >= 8.0 AS is_candidate FROM scored"),
    "candidate_pages": _sql(SCORED, "SELECT document_id, total_score FROM scored WHERE total_score >= 8.0"),
    "candidate_claims": _sql(SCORED, """SELECT document_id, c.* FROM scored JOIN (SELECT doc_id AS d FROM documents WHERE doc_id % 4 = 0) ON document_id = d::VARCHAR, LATERAL (VALUES
  ('gdp_growth', 'India real GDP growth', 'growth rate', NULL, d % 10 + 0.5::DOUBLE, 'per cent', '2024-25', NULL, NULL, 'Second Advance Estimates'), ('macro_headline_inflation', 'India headline inflation', 'inflation rate', NULL, round(d % 7 + 0.2::DOUBLE, 1), 'per cent', 'September 2025', NULL, NULL, ''),
  ('revenue_broad', 'doc' || d || ' revenue', 'revenue', NULL, d + 1, '₹ crore', NULL, NULL, NULL, ''), ('revenue_services', 'doc' || d || ' revenue from services', 'revenue', NULL, d + 1, '₹ crore', 'FY24', NULL, 'consolidated', ''),
  ('net_loss', 'doc' || d || ' net loss', 'loss for the year', NULL, d + 2, '₹ crore', 'FY24', NULL, 'consolidated', ''), ('director_ceased', 'Ann Lee', 'board status', 'ceased to be a Director', NULL, NULL, NULL, 'May 01, 2024', NULL, '')
) c(rule, subject, predicate, value_raw, value_num, unit, period, as_of, scope, qualifiers) WHERE total_score >= 8.0"""),
    "keyword_hits": _sql(SCORED, "SELECT document_id, keyword FROM (SELECT document_id, unnest(keyword_matches) AS keyword FROM scored)"),
    "document_rollup": _sql(SCORED, f"SELECT d.source AS document_id, count(*) AS total_pages, sum((total_score >= 8.0)::INT)::BIGINT AS candidate_pages, {rnd('sum((total_score >= 8.0)::INT) / count(*)', 4)} AS candidate_rate FROM scored s JOIN documents d ON s.document_id = d.doc_id::VARCHAR GROUP BY d.source"),
    "canonical_entity": f"SELECT subject, context, {_E} AS entity, {_R} AS remainder FROM {_rows(ENTITIES, 'subject, context')}",
    "canonical_predicate": f"SELECT predicate, rest, {predicate('predicate', 'rest')} AS canonical FROM {_rows(PREDICATES, 'predicate, rest')}",
    "normalized_period": f"SELECT p, a, {_P} AS period, {_T} AS kind FROM {_rows(PERIODS, 'p, a')}",
    "normalized_unit_value": f"SELECT n, r, u, {_VAL} AS value, {_UNIT} AS unit FROM {_rows(UNITS, 'n, r, u')}",
    "normalized_facts": _sql(NORM, "SELECT id, canonical_subject, canonical_predicate, normalized_value, normalized_unit, normalized_period, period_type FROM norm"),
    "fact_fingerprint": _sql(DEDUPED, "SELECT id, fingerprint FROM printed"),
    "dedupe_facts": _sql(DEDUPED, "SELECT id, array_to_string(qualifiers, '; ') AS qualifiers FROM deduped"),
    "grounded_facts": _sql(GROUNDED, "SELECT id FROM grounded WHERE verified"),
    "rejected_facts": _sql(GROUNDED, "SELECT id FROM grounded WHERE NOT verified"),
    "candidate_blocks": _sql(PAIRS, "SELECT subject_key, predicate_key, count(*) AS facts FROM blocked GROUP BY ALL"),
    "candidate_pairs": _sql(PAIRS, "SELECT a.id AS a_id, b.id AS b_id FROM pairs"),
    "number_comparison": _sql(COMPARED, "SELECT a.id AS a_id, b.id AS b_id, status, CASE WHEN status NOT IN ('categorical', 'incompatible_units') THEN diff END AS absolute_diff, CASE WHEN status NOT IN ('categorical', 'incompatible_units') THEN rel END AS relative_diff FROM compared"),
    "period_comparison": _sql(COMPARED, "SELECT a.id AS a_id, b.id AS b_id, same_period AS is_same_period, same_type AS is_same_type FROM compared"),
    "dimension_diff": _sql(COMPARED, "SELECT a.id AS a_id, b.id AS b_id, d_subject AS subject, d_predicate AS predicate, d_value AS value, d_unit AS unit, d_period AS period, d_scope AS scope, d_qualifiers AS qualifiers FROM compared"),
    "candidate_stats": _sql(PAIRS, f"SELECT *, CASE WHEN naive_pairs > 0 THEN {rnd('1 - candidate_pairs / naive_pairs', 4)} ELSE 0 END AS reduction_ratio FROM (SELECT (SELECT count(*) FROM blocked) AS total_facts, (SELECT count(*) * (count(*) - 1) // 2 FROM blocked)::BIGINT AS naive_pairs, (SELECT count(*) FROM (SELECT DISTINCT subject_key, predicate_key FROM blocked)) AS candidate_groups, (SELECT count(*) FROM pairs) AS candidate_pairs)"),
    "reason_relationships": _sql(RELATED, f"SELECT {_CORE} FROM related"),
    "relationship_breakdown": _sql(RELATED, "SELECT relationship, count(*) AS n FROM related GROUP BY ALL"),
    **{f"rule_{name}": _sql(RELATED, f"SELECT id FROM related WHERE rule = '{name}'") for name in [*(r[0] for r in RULES), "default"]},
    "fact_search": _sql(NORM, f"SELECT id, subject FROM norm WHERE {SEARCH_SQL}"),
    "facts_paged": _sql(NORM, "SELECT id, seq FROM norm ORDER BY seq DESC, id LIMIT 200 OFFSET 50"),
    "relationship_listing": _sql(RELATED, _LISTED),
    "relationships_by_document": _sql(RELATED, f"{_LISTED} WHERE a.document_id = 'doc_P' OR b.document_id = 'doc_P'"),
    "relationships_top": _sql(RELATED, "SELECT id, confidence FROM related ORDER BY confidence DESC, id LIMIT 100"),
    "fact_detail_edges": _sql(RELATED, "SELECT id, relationship, confidence, other_id FROM (SELECT *, CASE WHEN fact_a_id = f THEN fact_b_id ELSE fact_a_id END AS other_id FROM related, (SELECT min(id) AS f FROM deduped) WHERE fact_a_id = f OR fact_b_id = f)"),
    "raw_dimension_diff": _sql(PAIRS, "SELECT a.id AS a_id, b.id AS b_id, " + ", ".join(f"CASE WHEN {x.format('a')} IS NULL OR {x.format('b')} IS NULL THEN 'unknown' WHEN lower(trim({x.format('a')})) = lower(trim({x.format('b')})) THEN 'same' ELSE 'different' END AS {n}"
      for n, x in (("subject", "{0}.subject"), ("predicate", "{0}.predicate"), ("value", "coalesce({0}.value_num::VARCHAR, {0}.value_raw)"), ("unit", "{0}.unit"), ("period", "{0}.period"), ("scope", "{0}.scope"))) + f", CASE WHEN len(a.qualifiers) = 0 AND len(b.qualifiers) = 0 THEN 'same' WHEN len(a.qualifiers) = 0 OR len(b.qualifiers) = 0 THEN 'unknown' WHEN {_SET.format('a')} = {_SET.format('b')} THEN 'same' ELSE 'different' END AS qualifiers FROM pairs"),
    "decoded_facts": _sql(NORM, f"SELECT id, {VALUE_TEXT.format(v='value_num', r='value_raw')} AS value FROM norm"),
    "demo_top_corroborate": _sql(RELATED, "SELECT id, confidence FROM related WHERE relationship = 'CORROBORATES' AND contains(lower(a.subject), 'nation_1') AND contains(lower(b.subject), 'nation_1') ORDER BY confidence DESC, id LIMIT 3"),
    "documents_with_fact_counts": _sql(NORM, "SELECT document_id, count(*) AS facts_count FROM norm GROUP BY ALL UNION ALL SELECT 'doc_none', 0"),
    "store_stats": _sql(RELATED, "SELECT 'documents' AS name, (SELECT count(DISTINCT document_id) FROM deduped) AS n UNION ALL SELECT 'pages', (SELECT count(*) FROM documents) UNION ALL SELECT 'facts', (SELECT count(*) FROM deduped) UNION ALL SELECT 'comparisons', (SELECT count(*) FROM related) UNION ALL SELECT 'relationship:' || relationship, count(*) FROM related GROUP BY relationship"),
    "demo_case_corroborate": _sql(RELATED, "SELECT id FROM related WHERE relationship = 'CORROBORATES' AND contains(lower(a.subject), 'nation_1') AND contains(lower(b.subject), 'nation_1')"),
    "demo_case_investigate": _sql(RELATED, "SELECT id FROM related WHERE contains(lower(a.subject), 'nation_2 ') OR contains(lower(b.subject), 'nation_2 ')"),
    "demo_case_vintage_reconcile": _sql(RELATED, "SELECT id FROM related WHERE rule = 'vintage'"),
    "demo_case_director_reconcile": _sql(RELATED, "SELECT id FROM related WHERE rule IN ('temporal', 'progression', 'scope')"),
    "demo_case_scope_failure": _sql(RELATED, "SELECT id FROM related WHERE relationship = 'RECONCILABLE' AND d_scope = 'different'"),
    "extraction_scores": _sql(_OUTCOMES, f"""SELECT tp, fp_duplicate, fp_unknown, fn, {rnd('p', 4)} AS precision, {rnd('r', 4)} AS recall, CASE WHEN p + r > 0 THEN {rnd('2 * p * r / (p + r)', 4)} ELSE 0 END AS f1,
      {rnd('had_p / nullif(asked_p, 0)', 4)} AS period_capture, {rnd('had_s / nullif(asked_s, 0)', 4)} AS scope_capture FROM rates"""),
    "extraction_gold_by_source": _sql(_OUTCOMES, "SELECT source, count(*) AS total, count(*) FILTER (outcome = 'tp') AS matched FROM outcomes WHERE source IS NOT NULL GROUP BY source"),
    "unique_predicted_pairs": _sql(_UNIQUE, "SELECT md5(pair) AS pair, relationship FROM best"),
    "judged_gold_pairs": _sql(_UNIQUE, "SELECT md5(pair) AS pair, expectation, expected, produced, outcome FROM judged"),
    "relationship_scores": _sql(_UNIQUE, f"""SELECT count(*) AS gold_items, count(*) FILTER (outcome IN ('ok', 'ok(absent)')) AS correct, count(*) FILTER (starts_with(outcome, 'wrong')) AS incorrect_label, count(*) FILTER (outcome = 'missed') AS missed_required,
      count(*) FILTER (outcome = 'VIOLATION') AS absent_violations, {rnd("count(*) FILTER (outcome IN ('ok', 'ok(absent)')) / count(*)", 4)} AS accuracy,
      {rnd("count(*) FILTER (outcome = 'ok(absent)') / nullif(count(*) FILTER (expectation = 'absent'), 0)", 4)} AS absent_compliance, (SELECT count(*) FROM best) AS predicted_unique_pairs FROM judged"""),
    "per_class_scores": _sql(_UNIQUE, f"""SELECT c AS class, predicted, gold_required, {rnd('hits / nullif(predicted, 0)', 4)} AS precision, {rnd('hits / nullif(gold_required, 0)', 4)} AS recall FROM (
      SELECT c, (SELECT count(*) FROM best WHERE relationship = c) AS predicted, (SELECT count(*) FROM judged WHERE expectation = 'label' AND expected = c) AS gold_required,
        (SELECT count(*) FROM judged WHERE outcome = 'ok' AND expected = c) AS hits FROM (VALUES ('CORROBORATES'), ('CONTRADICTS'), ('RECONCILABLE'), ('UNCERTAIN')) k(c))"""),
    "word_lines": _sql(WORDS, "SELECT page, word_no, line FROM lined"),
    "line_cells": _sql(WORDS, "SELECT page, line, cell, x0, x1, text FROM line_cells"),
    "numeric_anchors": _sql(ANCHORS, "SELECT page, anchor, edge, lines FROM anchors"),
    "aligned_grid": _sql(ANCHORS, "SELECT page, line, word_no, a.anchor, text FROM numeric_words JOIN anchors a USING (page) QUALIFY row_number() OVER (PARTITION BY page, line, word_no ORDER BY abs(x1 - edge), a.anchor) = 1 AND abs(x1 - edge) <= greatest(2.5::DOUBLE, 0.45::DOUBLE * 9)"),
    "shared_columns": _sql(ANCHORS, """, grid AS (
  SELECT page, line, a.anchor FROM numeric_words JOIN anchors a USING (page) QUALIFY row_number() OVER (PARTITION BY page, line, word_no ORDER BY abs(x1 - edge), a.anchor) = 1 AND abs(x1 - edge) <= greatest(2.5::DOUBLE, 0.45::DOUBLE * 9)
), sets AS (SELECT page, line, list(DISTINCT anchor) AS own FROM grid GROUP BY ALL)
SELECT a.page, a.line, len(list_intersect(a.own, b.own)) AS columns FROM sets a JOIN sets b ON a.page = b.page AND b.line = a.line + 1 WHERE len(list_intersect(a.own, b.own)) >= 2"""),
    "row_pitch_runs": _sql(WORDS, """, tops AS (SELECT page, line, min(y0) AS top FROM lined GROUP BY page, line
), pitched AS (SELECT *, top - lag(top) OVER (PARTITION BY page ORDER BY line) AS pitch FROM tops
), near AS (SELECT *, lag(pitch) OVER w AS a, lead(pitch) OVER w AS b FROM pitched WINDOW w AS (PARTITION BY page ORDER BY line)
), cut AS (SELECT *, coalesce(pitch > 3 * coalesce(least(CASE WHEN a > 0 THEN a END, CASE WHEN b > 0 THEN b END), 36) AND pitch > 13.5, false)::INT AS n FROM near)
SELECT page, line, top, (sum(n) OVER (PARTITION BY page ORDER BY line))::BIGINT AS run FROM cut"""),
    "token_classification": _sql(PLACED, f"""SELECT t, {token_class('t')} AS kind FROM (SELECT unnest(['Item' || l_partkey, printf('%.2f', l_quantity), printf('%.2f', l_extendedprice), printf('%.2f', l_discount)]) AS t FROM placed
  UNION SELECT * FROM (VALUES {', '.join(f'({q(t)})' for t in TOKENS)}) v(t))"""),
    "provider_response_parse": """SELECT doc_id, CASE WHEN bad THEN 'UNCERTAIN' ELSE ['CORROBORATES', 'CONTRADICTS', 'UNCERTAIN', 'UNRELATED', 'UNCERTAIN', 'RECONCILABLE'][doc_id % 6 + 1] END AS relationship,
  CASE WHEN bad OR doc_id % 13 = 0 THEN 0 ELSE least(1, (doc_id % 3 || '.' || doc_id % 10)::DOUBLE) END AS confidence,
  CASE WHEN bad THEN 'Malformed reasoning response.' WHEN doc_id % 5 <> 0 THEN 'r' || doc_id ELSE 'No reason provided by reasoning provider.' END AS reason
FROM (SELECT doc_id, doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 23 = 0 AS bad FROM documents)""",
    "layout_order_ids": _sql(WORDS, "SELECT page, text, printf('p%d-t%02d', page, row_number() OVER (PARTITION BY page ORDER BY y0, x0, text) - 1) AS table_id FROM line_cells"),
    "bbox_overlap": _sql(WORDS, """, beside AS (SELECT *, lag(cell) OVER w AS other, lag(x0) OVER w AS l0, lag(x1) OVER w + 60 AS l1, lag(y0) OVER w AS m0, lag(y1) OVER w AS m1 FROM line_cells WINDOW w AS (PARTITION BY page, line ORDER BY cell))
SELECT page, line, cell, other, CASE WHEN (x1 - x0) * (y1 - y0) > 0 THEN greatest(0.0, least(x1, l1) - greatest(x0, l0)) * greatest(0.0, least(y1, m1) - greatest(y0, m0)) / ((x1 - x0) * (y1 - y0)) ELSE 0 END AS share FROM beside WHERE other IS NOT NULL"""),
    "contract_violations": _sql(CELLS, """, good AS (SELECT * FROM table_cells WHERE row_span >= 1 AND col_span >= 1 AND row >= 0 AND col >= 0
), covered AS (SELECT table_id, unnest(range(row, row + row_span)) AS row, col, col_span FROM good), each_one AS (SELECT table_id, row, unnest(range(col, col + col_span)) AS col FROM covered)
SELECT table_id, 'bad_span' AS kind, row, col FROM table_cells WHERE row_span < 1 OR col_span < 1 OR row < 0 OR col < 0
UNION ALL SELECT table_id, 'bad_box', row, col FROM table_cells WHERE NOT (isfinite(x0) AND isfinite(y0) AND isfinite(x1) AND isfinite(y1) AND x1 >= x0 AND y1 >= y0)
UNION ALL SELECT table_id, 'repeated_origin', row, col FROM good GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT table_id, 'overlap', row, col FROM each_one GROUP BY ALL HAVING count(*) > 1"""),
    "cell_lookup": _sql(CELLS, "SELECT t.table_id, t.row, t.col, c.text FROM (SELECT DISTINCT table_id, 1 AS row, unnest([1, 9]) AS col FROM table_cells) t LEFT JOIN table_cells c USING (table_id, row, col)"),
    "context_violations": _sql(CONTEXTS, "SELECT context_id, 'reason_missing' AS kind FROM said GROUP BY context_id HAVING bool_or(NOT ok AND NOT reasoned) UNION ALL SELECT context_id, 'dimension_repeated' FROM said GROUP BY context_id HAVING count(*) > count(DISTINCT dimension) UNION ALL SELECT context_id, 'missing_scale' FROM said GROUP BY context_id HAVING NOT bool_or(dimension = 'scale') UNION ALL "
      + " UNION ALL ".join(f"SELECT context_id, '{k}' FROM ctx JOIN status USING (context_id) WHERE {v}" for k, v in _WRONG.items())),
    "context_resolved": _sql(CONTEXTS, "SELECT context_id, is_resolved FROM status"),
    "provenance_violations": _sql(f"{CONTEXTS}, {_REFS}", "SELECT DISTINCT context_id, kind FROM (SELECT context_id, 'cell_absent' AS kind FROM pointed WHERE wide IS NULL UNION ALL SELECT context_id, 'other_page' FROM pointed WHERE page <> cell_page UNION ALL SELECT context_id, 'label_on_other_row' FROM pointed WHERE use = 'label' AND rr <> row "
      "UNION ALL SELECT context_id, 'value_in_other_column' FROM pointed WHERE use = 'value' AND rc <> 2 UNION ALL SELECT context_id, 'header_not_governing' FROM pointed WHERE use = 'header' AND wide IS NOT NULL AND NOT (rc <= 2 AND 2 < rc + wide AND rr < row))"),
    "workload_guard": "SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'measurement_unavailable' WHEN n_chars // 6 > 3000 THEN 'too_many_words' WHEN n_chars > 20000 THEN 'too_many_characters' WHEN doc_id % 40 = 0 THEN 'no_drawings' WHEN doc_id % 40 > 30 THEN 'too_many_drawings' END AS reason FROM documents",
    "incremental_match_equals_batch": _sql(PAIRS, "SELECT a.id AS a_id, b.id AS b_id FROM pairs"),
}
