"""Claims from page texts, by a catalogue of rules.

A rule is data: a pattern, and which group or constant fills each field. One pass in Arrow batches finds the matches,
because rules need the places of matches and what earlier rules found on the page; all else stays in expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.text import filled

# Patterns of claims.
_FY = r"FY\d{2,4}"
_GDP = r"((?:[A-Z][\w\s\']+?)?\s*real\s+GDP\s+(?:{verb})\s+(\d+\.?\d*)\s*(?:per\s*cent|percent|%)\s*(?:in\s+)?(FY\d{{2,4}}(?:[-/]\d{{2,4}})?|\b20\d{{2}}-\d{{2}}\b)?)"
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)(?:\s+20\d{2})?"
_MACRO_PERIOD = rf"(?:{_MONTH}|FY\d{{2,4}}(?:[-/]\d{{2,4}})?|\b\d{{4}}-\d{{2}}\b)"
_MACRO = r"(?:In\s+(FY\d{{2,4}}(?:[-/]\d{{2,4}})?)\s*,?\s+)?\b{phrase}\s+\w+(?:\s+\w+){{0,4}}\s+(?:at|to)\s+(\d+(?:\.\d+)?)\s*(?:per\s*cent|percent|%)(?:\s+in\s+({period}))?"
_AMOUNT = r"([\d,]+\.?\d*)"
_MONEY = r"(?:INR|₹)\s*"
_DATE = r"([A-Za-z]+\s+\d{1,2},\s*\d{4})"
_NOT_NAMES = frozenset("the to for and or of in on by our non none".split())
# Words of file names that name no entity.
_BOILERPLATE = r"\b(excerpt|annual|report|prospectus|presentation|document|pdf|economy|economic|survey|article|iv|consultation)\b"
_UNITS = {"million": "INR million", "mn": "INR million", "crore": "₹ crore", "cr": "₹ crore", "lakh": "lakh", "lac": "lakh", "billion": "billion"}


def entity_name(filename: Column) -> Column:
    """The entity that a file name suggests: its first three words of three letters or more, without boilerplate and years."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(filename, F.lit("")), r"\.[^.]*$", ""), r"^\d+[-_]", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[-_]+", " "), f"(?i){_BOILERPLATE}", "")
    words = F.split(F.regexp_replace(plain, r"(?i)\b(fy\d{2,4}|\d{4}[-/]\d{2,4}|\d{4})\b", ""), r"\s+")
    return F.coalesce(filled(F.array_join(F.slice(F.filter(words, lambda w: F.length(w) > 2), 1, 3), " ")), F.lit("Unknown Entity"))


# Phrases around a match and the qualifiers that they give, in order; of those of one group only the first.
NEARBY = (
    ("first advance", "First Advance Estimate", "advance"), ("second advance", "Second Advance Estimates", "advance"), ("provisional", "provisional", None), ("revised", "revised", None),
    ("preliminary", "preliminary", None), ("final", "final", None), ("estimated", "estimated", None), ("projected", "forecast", None),
)
#: Characters on either side of a match that qualifiers are looked for in.
AROUND = 300


def qualifiers_in(near: Column) -> Column:
    """Qualifiers that the lower-cased text around a match gives; a null text gives none."""
    picked, groups = [], {}
    for phrase, name, group in NEARBY:
        test = near.contains(phrase)
        picked.append(F.when(test & ~groups.get(group, F.lit(False)), name))
        if group:
            groups[group] = groups.get(group, F.lit(False)) | test
    return F.when(near.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*picked)))


def number(text: str) -> float:
    return float(text.replace(",", ""))


@dataclass
class Page:
    text: str
    filename: str
    entity: str
    claims: list[dict] = field(default_factory=list)
    #: Revenues of the first ``read`` claims, in INR million, sorted.
    revenues: list[float] = field(default_factory=list)
    read: int = 0

    @cached_property
    def bases(self) -> tuple[list[int], list[str], list[str]]:
        """Of each basis that is named: where its name ends, the basis, and the character that follows."""
        named = list(re.finditer(r"\bon\s+(standalone|consolidated)\s+basis", self.text, re.I))
        return [m.end() for m in named], [m[1].lower() for m in named], [self.text[m.end() : m.end() + 1] for m in named]

    def scope_before(self, at: int) -> str | None:
        """The basis that is named last before a place."""
        ends, names, after = self.bases
        k = bisect_right(ends, at) - 1
        while k >= 0 and ends[k] < at and re.match(r"\w", after[k]):
            k -= 1
        return names[k] if k >= 0 else None

    def revenue_known(self, value: float) -> bool:
        """Whether an earlier claim gives this revenue, within 0.01."""
        for c in self.claims[self.read :]:
            if c["predicate"] == "revenue":
                insort(self.revenues, c["value"] * (10 if c["unit"] == "₹ crore" else 1))
        self.read = len(self.claims)
        k = bisect_left(self.revenues, value)
        return any(abs(value - v) < 0.01 for v in self.revenues[max(0, k - 1) : k + 1])


@dataclass
class Rule:
    name: str
    pattern: re.Pattern
    #: From a match and its page: claims as dicts; what is left out is null.
    claims: Callable[[re.Match, Page], list[dict]]
    confidence: float
    #: The matches of the pattern in a text, where finditer would be quadratic.
    find: Callable[[re.Pattern, str], Iterator[re.Match]] = re.Pattern.finditer


def _upper(text: str | None) -> str | None:
    return text.upper() if text else None


def _gdp(m: re.Match, page: Page) -> list[dict]:
    return [{"subject": "India real GDP growth", "predicate": "growth rate", "value": float(m[2]), "unit": "per cent", "period": m[3], "near": page.text[max(0, m.start() - AROUND) : m.end() + AROUND].lower(), "evidence": m[1]}]


def _macro(subject: str, predicate: str, qualifier: str | None) -> Callable:
    def claims(m: re.Match, page: Page) -> list[dict]:
        ahead = re.search(r"\b(?:expected|projected|forecast)\b", m[0], re.I)
        return [{"subject": subject, "predicate": predicate, "value": float(m[2]), "unit": "per cent", "period": m[1] or m[3], "qualifiers": [q for q in (qualifier, "forecast" if ahead else None) if q]}]

    return claims


def _revenue(subject: str, value: int, period: int, scope: int | str, unit: str) -> Callable:
    def claims(m: re.Match, page: Page) -> list[dict]:
        basis = m[scope].lower() if isinstance(scope, int) else scope
        return [{"subject": subject.format(page.entity), "predicate": "revenue", "value": number(m[value]), "unit": unit, "period": m[period].upper(), "scope": basis, "evidence": m[1]}]

    return claims


def _revenue_broad(m: re.Match, page: Page) -> list[dict]:
    value, unit = number(m[2]), _UNITS[m[3].lower()]
    if page.revenue_known(value):
        return []
    period = re.search(rf"\b({_FY})\b", m[1], re.I)
    basis = re.search(r"\bon\s+(standalone|consolidated)\s+basis\b", m[1], re.I)
    return [{"subject": f"{page.entity} revenue", "predicate": "revenue", "value": value, "unit": unit, "period": _upper(period and period[1]), "scope": basis and basis[1].lower(), "evidence": m[1]}]


def _loss_compared(m: re.Match, page: Page) -> list[dict]:
    both = [(m[3], m[2]), (m[4], m[5])]
    return [{"subject": f"{page.entity} loss", "predicate": "loss", "value": number(v), "unit": "INR million", "period": p.upper(), "scope": page.scope_before(m.start()), "evidence": m[1]} for v, p in both if v]


def _net_loss(value: int, period: int | None) -> Callable:
    def claims(m: re.Match, page: Page) -> list[dict]:
        unit = "₹ crore" if "cr" in m[1].lower() else "INR million"
        return [{"subject": f"{page.entity} net loss", "predicate": "loss for the year", "value": number(m[value]), "unit": unit, "period": m[period].upper() if period else None, "scope": "consolidated", "evidence": m[1]}]

    return claims


def _person(text: str, most: int = 1 << 30) -> str | None:
    name = text.strip().replace("Mr.", "").replace("Ms.", "").strip()
    words = name.split()
    return name if 2 <= len(words) <= most and words[-1].lower() not in _NOT_NAMES else None


def _director(m: re.Match, page: Page) -> list[dict]:
    person, date = _person(m[1]), m[3].strip() if m.re.groups >= 3 else None
    in_prospectus = "2022" if "prospectus" in page.filename.lower() else None
    return [{"subject": person, "predicate": "board status" if date else "role", "value": m[2].strip(), "as_of": date or in_prospectus}] if person else []


def _appointed(m: re.Match, page: Page) -> list[dict]:
    person = _person(m[1], 6)
    return [{"subject": person, "predicate": "board status", "value": f"appointed as {m[2]}", "as_of": m[4], "qualifiers": [f"{m[3]} year term"] if m[3] else []}] if person else []


# A pattern that begins with any run of letters is tried from each of them to the run's end, quadratic in a text without
# punctuation. What follows the run is rare and is looked for first; then the run's first place is where a match begins.
def _after_run(run: str, *anchors: str, first: str = "", bare: bool = False, holds: Callable[[str], Callable[[re.Match], bool]] | None = None) -> Callable[[re.Pattern, str], Iterator[re.Match]]:
    """The matches of a pattern that begins with a lazy run of the characters ``run``, one that is ``first`` and one or more
    others (any two with no ``first``), up to an anchor. ``bare``: whitespace or nothing may stand for that run. ``holds``: of
    a text, a test that an anchor's match has to pass."""
    whole, begin, after = re.compile(f"{run}+", re.I), re.compile(first or run, re.I), [re.compile(a, re.I) for a in anchors]

    def find(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
        found = [m for a in after for m in a.finditer(text)]
        if holds and found:
            test = holds(text)
            found = [m for m in found if test(m)]
        places = sorted(m.start() for m in found)
        runs, k, pos = whole.finditer(text), 0, 0
        own = next(runs, None)
        while k < len(places):
            while own and own.end() < places[k]:
                own = next(runs, None)
            near = own and own.start() <= places[k]
            begins, ends = (own.start(), own.end()) if near else (places[k], places[k])
            last = bisect_right(places, ends, k)  # the anchors of this run
            while k < last:
                low, starts = max(begins, pos), []
                letter = begin.search(text, low, ends) if low < ends else None
                if letter and letter.start() <= places[last - 1] - 2:
                    starts.append(letter.start())
                if bare and low <= places[k]:
                    starts.append(low + len(text[low : places[k]].rstrip()))
                m = pattern.match(text, min(starts)) if starts else None
                if m:
                    yield m
                    pos = m.end()
                    k = max(k + 1, bisect_left(places, pos))
                else:
                    k = k + 1 if bare else last

    return find


def _sold(text: str) -> Callable[[re.Match], bool]:
    """Of a match of revenue from: whether an amount comes in the same run of words."""
    amounts = [m.start() for m in re.finditer(rf"(?<=\s)(?:stood\s+at|was|is)\s+{_MONEY}{_AMOUNT}\s*(?:million|mn|crore|cr|lakh|lac|billion)\b", text, re.I)]
    breaks = [m.start() for m in re.finditer(r"[^\w\s]", text)]

    def test(m: re.Match) -> bool:
        if not m[1]:
            return True
        k, b = bisect_left(amounts, m.end(1) + 3), bisect_left(breaks, m.end(1))
        return k < len(amounts) and (b == len(breaks) or amounts[k] < breaks[b])

    return test


_NAMES = r"[A-Z][a-z]+(?:\s+(?:de\s+|di\s+|van\s+|von\s+)?[A-Z][a-z]+)+"
_NAMES_BACK = re.compile(r"\s*(?:[a-z]+[A-Z]\s+(?:(?:ed|id|nav|nov)\s+)?)+[a-z]+[A-Z]")
_ROLE = re.compile(r"[—–-]\s*(?:Executive\s+Director|Non-Executive\s+Nominee\s+Director)")


def _after_names(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """The matches of a pattern that begins with names: a role first, then the names before it, read backwards."""
    back, pos = "", 0
    for role in _ROLE.finditer(text):
        back = back or text[::-1]
        names = _NAMES_BACK.match(back, len(text) - role.start(), len(text) - pos) if role.start() > pos else None
        m = pattern.match(text, len(text) - names.end()) if names else None
        if m:
            yield m
            pos = m.end()


_BEFORE_GDP = lambda verb: _after_run(r"[\w\s']", rf"real\s+GDP\s+(?:{verb})\s+\d+\.?\d*\s*(?:per\s*cent|percent|%)", first="[A-Z]", bare=True)
_CEASED = rf"ceased\s+to\s+be\s+a\s+Director\s+with\s+effect\s+from\s+{_DATE}"
_GREW, _GROWTH = r"grew\s+by|is\s+estimated\s+to\s+grow\s+by", r"growth\s+(?:moderated\s+to|stood\s+at|projected\s+at)"


def _rule(name: str, pattern: str, claims: Callable, confidence: float, flags: int = re.I, find: Callable = re.Pattern.finditer) -> Rule:
    return Rule(name, re.compile(pattern, flags), claims, confidence, find)


#: In the order in which claims are emitted.
RULES = (
    _rule("gdp_grew", _GDP.format(verb=_GREW), _gdp, 0.95, find=_BEFORE_GDP(_GREW)),
    _rule("gdp_growth", _GDP.format(verb=_GROWTH), _gdp, 0.95, find=_BEFORE_GDP(_GROWTH)),
    *(
        _rule("macro_" + phrase.replace(" ", "_"), _MACRO.format(phrase=phrase, period=_MACRO_PERIOD), _macro(f"India {phrase}", predicate, qualifier), 0.9)
        for phrase, predicate, qualifier in (("private consumption growth", "growth rate", None), ("headline inflation", "inflation rate", None), ("core inflation", "inflation rate", "core"), ("unemployment", "unemployment rate", None))
    ),
    _rule("revenue_exact", rf"(revenue\s+from\s+operations\s+on\s+(standalone|consolidated)\s+basis\s+for\s+({_FY})\s+stood\s+at\s+INR\s+{_AMOUNT}\s+million)", _revenue("Delhivery revenue from operations", 4, 3, 2, "INR million"), 0.95),
    _rule("revenue_broad", rf"((?:[\w\s]+?)\s+revenue\s+(?:from\s+[\w\s]+?\s+)?(?:stood\s+at|was|is)\s+{_MONEY}{_AMOUNT}\s*(million|mn|crore|cr|lakh|lac|billion)\b)", _revenue_broad, 0.85, find=_after_run(r"[\w\s]", r"(?<=\s)revenue\s+(?:(from)\s|(?:stood\s+at|was|is)\s)", holds=_sold)),
    _rule("revenue_services", rf"(revenue\s+from\s+services\s+stood\s+at\s+(?:approximately\s+)?₹?{_AMOUNT}\s*(?:cr|crore)\s+for\s+({_FY}))", _revenue("{} revenue from services", 2, 3, "consolidated", "₹ crore"), 0.92),
    _rule("revenue_compared", rf"(revenue\s+from\s+operations\s+on\s+(standalone|consolidated)\s+basis\s+for\s+({_FY})\s+stood\s+at\s+{_MONEY}[\d,]+\.?\d*\s+million\s+as\s+against\s+{_MONEY}{_AMOUNT}\s+million\s+for\s+({_FY}))", _revenue("{} revenue", 4, 5, 2, "INR million"), 0.95),
    _rule("loss_compared", rf"((?:the\s+)?loss\s+for\s+({_FY})\s+stood\s+at\s+{_MONEY}{_AMOUNT}\s+million(?:\s+as\s+against\s+{_MONEY}{_AMOUNT}\s+million\s+for\s+({_FY}))?)", _loss_compared, 0.95),
    _rule("loss_of_year", rf"(loss\s+for\s+the\s+year\s+was\s+INR\s+{_AMOUNT}\s+million)", _net_loss(2, None), 0.92),
    _rule("net_loss", rf"(net\s+loss\s+for\s+({_FY})\s+was\s+₹?{_AMOUNT}\s*(?:cr|crore))", _net_loss(3, 2), 0.92),
    _rule("director_resigned", rf"([A-Z][a-zA-Z\.\s]+?),\s*(?:Non-Executive\s+Director|Director),\s*(resigned\s+from\s+the\s+Board)\s+with\s+effect\s+from\s+{_DATE}", _director, 0.95, find=_after_run(r"[a-zA-Z\.\s]", r",\s*(?:Non-Executive\s+Director|Director),\s*resigned\s", first="[A-Z]")),
    _rule("director_ceased", rf"([A-Z][a-zA-Z\.\s]+?)(?:,\s*Non-Executive\s+Director)?\s*(ceased\s+to\s+be\s+a\s+Director)\s+with\s+effect\s+from\s+{_DATE}", _director, 0.95, find=_after_run(r"[a-zA-Z\.\s]", _CEASED, rf",\s*Non-Executive\s+Director\s*{_CEASED}", first="[A-Z]")),
    _rule("director_role", rf"({_NAMES})\s*[—–-]\s*(Executive\s+Director(?:\s+and\s+[A-Za-z\s]+)?|Non-Executive\s+Nominee\s+Director)", _director, 0.95, 0, find=_after_names),
    _rule("director_appointed", rf"([A-Z][a-zA-Z\.\s]{{2,48}}?)\s+(?:was|has\s+been)\s+appointed\s+as\s+(Non-Executive\s+Independent\s+Director)(?:\s+for\s+a\s+period\s+of\s+(\d+)\s+years?)?\s+with\s+effect\s+from\s+{_DATE}", _appointed, 0.95, 0),
)


def claims_of(text: str | None, filename: str | None, entity: str = "Unknown Entity", rules: tuple[Rule, ...] = RULES) -> list[dict]:
    """Claims of one page in the order of the rules, each with rule and confidence; near: the text around, where qualifiers depend on it."""
    page = Page(" ".join(x.strip() for x in (text or "").splitlines() if x.strip()), filename or "", entity)
    for rule in rules:
        for m in rule.find(rule.pattern, page.text):
            for claim in rule.claims(m, page):
                claim["evidence"] = (claim.get("evidence") or m[0]).strip()
                page.claims.append(claim | {"rule": rule.name, "confidence": rule.confidence})
    return page.claims


CLAIMS = (
    "document_id string, document_name string, page_number int, number int, rule string, subject string, predicate string, value_raw string, value_num double, "
    "unit string, period string, as_of string, scope string, qualifiers array<string>, confidence double, evidence_text string, near string"
)


def extract(pages: DataFrame, candidate_only: bool = True, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Facts of pages, with deterministic ids and seq by document, page and emission. Blank pages give none.

    ``pages`` needs document_id, filename, page_number, raw_text and, for ``candidate_only``, is_candidate.
    """
    if candidate_only:
        pages = pages.where("is_candidate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4, pa.float64(), *[pa.string()] * 4, pa.list_(pa.string()), pa.float64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in CLAIMS.split(", ")]
        for b in batches:
            rows = []
            for doc, name, page, text, entity in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                for n, c in enumerate(claims_of(text, name, entity, rules)):
                    textual = isinstance(c["value"], str)
                    rows.append((doc, name, page, n, c["rule"], c["subject"], c["predicate"], c["value"] if textual else None, None if textual else c["value"], c.get("unit"), c.get("period"), c.get("as_of"), c.get("scope"), c.get("qualifiers") or [], c["confidence"], c["evidence"], c.get("near")))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    found = pages.select(F.col("document_id").cast("string"), F.col("filename").cast("string"), F.col("page_number").cast("int"), "raw_text", entity_name(F.col("filename")).alias("entity")).mapInArrow(run, CLAIMS)
    return identified(found.withColumn("qualifiers", F.concat(qualifiers_in(F.col("near")), "qualifiers")).drop("near"))


def identified(found: DataFrame) -> DataFrame:
    """Claims with seq, by document, page and emission, and an id that follows from their content."""
    key = F.concat_ws("\u0001", "document_id", "page_number", "number", "rule", "evidence_text")
    return found.withColumn("seq", F.col("page_number").cast("long") * 100_000 + F.col("number")).withColumn("id", F.substring(F.sha2(key, 256), 1, 12))
