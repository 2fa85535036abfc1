"""Toxicity scores: a lexicon trie intersected with Levenshtein automata, and context windows.

The lexicon is learned from labelled documents: words, and stems that many words extend, whose odds of being in a toxic
document are high. Words of a text run through one automaton: the product of the lexicon's trie with the Levenshtein
automaton of each term (one edit), made deterministic state by state when first needed. A window around each hit tells
quotation from abuse: quotation marks and words of reporting lower the hit's weight, second-person words raise it. A
logistic regression over the sums of those weights gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import LABELLED_ROWS, fold_of, labelled_texts, logistic, small_batches, table

#: A term stands in so many toxic documents at least, a stem in so many toxic occurrences of words that extend it in so many
#: ways; a stem has from SHORTEST to LONGEST letters, which is what makes it a stem and not a word or a string.
TERM_DOCS, STEM_DOCS, FORMS, SHORTEST, LONGEST = 5, 8, 4, 4, 32
#: Known-harmless words that one worker remembers before it starts afresh.
REMEMBERED = 300_000
#: Words on either side of a hit that its context is judged by.
WINDOW = 6
WORD = re.compile(r"\w+")
QUOTES = re.compile(r"[\"“”„«»‹›]")
REPORTING = frozenset("said says say quoted quote wrote writes called term word slur insult meaning sagte schrieb wort dit mot dijo palabra".split())
SECOND_PERSON = frozenset("you your youre u du dich dein ihr tu toi ton vous eres usted".split())


@dataclass
class Lexicon:
    words: dict[str, float]  # a term and its log odds
    stems: dict[str, float]
    ordinary: frozenset[str] = frozenset()
    edits: int = 1
    shortest_fuzzy: int = 5


@dataclass
class Automaton:
    """Lazily determinized intersection of the trie with the terms' Levenshtein automata.

    A state is a set of (trie node, edits so far); ``step`` is computed once for a state and a character.
    """

    lexicon: Lexicon
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    word: dict[int, str] = field(default_factory=dict)
    stem: dict[int, str] = field(default_factory=dict)
    states: dict[frozenset, int] = field(default_factory=dict)
    sets: list[frozenset] = field(default_factory=list)
    moves: list[dict[str, int]] = field(default_factory=list)
    stems_at: list[str | None] = field(default_factory=list)
    ends_at: list[tuple[str, int] | None] = field(default_factory=list)

    def __post_init__(self) -> None:
        for terms, ends in ((self.lexicon.words, self.word), (self.lexicon.stems, self.stem)):
            for term in sorted(terms):
                node = 0
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                    node = self.children[node][c]
                ends[node] = term
        self.state({(0, 0)})

    def state(self, pairs: set[tuple[int, int]]) -> int:
        todo, best = list(pairs), {}
        while todo:  # a term's character may be missing
            node, e = todo.pop()
            if best.get(node, 99) <= e:
                continue
            best[node] = e
            if e < self.lexicon.edits:
                todo += [(child, e + 1) for child in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.stems_at.append(min((self.stem[n] for n, e in key if e == 0 and n in self.stem), default=None))
            ends = [(e, self.word[n]) for n, e in key if n in self.word and (e == 0 or len(self.word[n]) >= self.lexicon.shortest_fuzzy)]
            self.ends_at.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.states[key]

    def step(self, at: int, c: str) -> int:
        pairs = set()
        for node, e in self.sets[at]:
            if c in self.children[node]:
                pairs.add((self.children[node][c], e))
            if e < self.lexicon.edits:
                pairs.add((node, e + 1))
                pairs.update((child, e + 1) for child in self.children[node].values())
        self.moves[at][c] = to = self.state(pairs) if pairs else -1
        return to

    def match(self, word: str) -> tuple[str, int, float] | None:
        """Kind of match ('word', 'stem' or 'fuzzy'), edits and weight; None: not in the lexicon's reach."""
        at, moves, stems = 0, self.moves, self.stems_at
        for c in word:
            to = moves[at].get(c)
            if to is None:
                to = self.step(at, c)
            if to < 0:
                return None
            at = to
            if stems[at] is not None:
                return "stem", 0, self.lexicon.stems[stems[at]]
        end = self.ends_at[at]
        if end is None or end[1] and word in self.lexicon.ordinary:
            return None
        return ("fuzzy" if end[1] else "word"), end[1], self.lexicon.words[end[0]]


def quotation(text: str, words: list[tuple[int, int]], k: int) -> float:
    """From 0, abuse, to 1, quotation, by WINDOW words on either side of word ``k``; words: start and end of each."""
    start, end = words[k]
    low, high = max(0, k - WINDOW), min(len(words) - 1, k + WINDOW)
    left, right = text[words[low][0] : start], text[end : words[high][1]]
    quoted = len(QUOTES.findall(left)) % 2 == 1 and bool(QUOTES.search(right))
    around = {text[a:b] for n, (a, b) in enumerate(words[low : high + 1], low) if n != k}
    score = 0.6 * quoted + 0.3 * bool(around & REPORTING) - 0.3 * bool(around & SECOND_PERSON)
    return min(1.0, max(0.0, score))


#: Of one text: weights of exact, stem and fuzzy hits that aren't quotations, of quotations, the largest, the share of words.
N_FEATURES = 6


class Scorer:
    """Features of whole texts; one for each Python worker."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.automaton, self.harmless, self.hits = Automaton(lexicon), set(), {}

    def find(self, text: str) -> list[tuple[int, int, str, float, float]]:
        """start, end, kind, weight and quotation of each hit in a lower-cased text."""
        words = WORD.findall(text)
        fresh = set(words) - self.harmless
        found = False
        for w in fresh:
            if w in self.hits:
                found = True
            elif hit := self.automaton.match(w):
                self.hits[w], found = hit, True
            else:
                self.harmless.add(w)
        if len(self.harmless) > REMEMBERED:
            self.harmless.clear()
        if len(self.hits) > REMEMBERED:
            self.hits = {w: self.hits[w] for w in fresh if w in self.hits}
        if not found:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        return [(*spans[k], h[0], h[2], quotation(text, spans, k)) for k, w in enumerate(words) if (h := self.hits.get(w))]

    def features(self, text: str | None) -> list[float]:
        text = (text or "").lower()
        hits = self.find(text)
        if not hits:
            return [0.0] * N_FEATURES
        sums = {"word": 0.0, "stem": 0.0, "fuzzy": 0.0}
        quoted = most = 0.0
        for _, _, kind, weight, q in hits:
            sums[kind] += weight * (1 - q)
            quoted += weight * q
            most = max(most, weight * (1 - q) * (0.5 if kind == "fuzzy" else 1))
        return [math.log1p(sums["word"]), math.log1p(sums["stem"]), math.log1p(sums["fuzzy"]), math.log1p(quoted), most, min(1.0, 100 * len(hits) / (len(text) + 1))]


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, features: list[list[float]]) -> np.ndarray:
        x = np.column_stack([np.ones(len(features)), np.array(features).reshape(-1, N_FEATURES)])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _odds(toxic: str, clean: str, n_toxic: int, n_clean: int):
    return F.log((F.col(toxic) + 0.5) / (n_toxic + 1)) - F.log((F.col(clean) + 0.5) / (n_clean + 1))


def learn(texts: DataFrame, least_odds: float = 3.0) -> Model:
    """From doc_id, text and y (1: toxic), a bounded table of labelled texts. With no rows, every score is one half.

    All terms, stems and ordinary words that the labelled texts give are taken, so the lexicon is bounded by those texts.
    """
    small_batches(texts.sparkSession)
    texts = texts.select("text", "y").persist()
    counts = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    n1, n0 = counts.get(1, 0), sum(v for k, v in counts.items() if k != 1)
    words = texts.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), 1))).alias("w"))
    words = words.groupBy("w").agg(F.sum((F.col("y") == 1).cast("long")).alias("t"), F.sum((F.col("y") != 1).cast("long")).alias("c")).persist()
    odds = _odds("t", "c", n1, n0).alias("odds")
    best = words.where(F.col("t") >= TERM_DOCS).select("w", odds).where(F.col("odds") >= least_odds).orderBy("w").collect()
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.length("w") - 1, F.lit(LONGEST)))
    begun = words.where(F.length("w") > SHORTEST).select("t", "c", F.explode(F.transform(lengths, lambda n: F.col("w").substr(F.lit(1), n))).alias("s"))
    known = begun.groupBy("s").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum((F.col("t") > 0).cast("long")).alias("forms"))
    stem_rows = known.where((F.col("t") >= STEM_DOCS) & (F.col("forms") >= FORMS)).select("s", odds).where(F.col("odds") >= least_odds).orderBy("s").collect()
    lexicon = Lexicon({r[0]: r[1] for r in best}, {r[0]: r[1] for r in stem_rows})
    matcher = Lexicon(lexicon.words, lexicon.stems)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(matcher)
        for b in batches:
            keep = [w for w in b.column(0).to_pylist() if (m := automaton.match(w)) and m[0] == "fuzzy"]
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], ["w"])

    clean = words.where((F.col("c") > 0) & (odds < 1.0)).select("w")
    ordinary = clean.mapInArrow(near, "w string").collect()
    lexicon.ordinary = frozenset(r[0] for r in ordinary)
    rows = features(texts, lexicon, keep=["y"]).select("y", "f").collect()  # as many as the labelled rows, which are bounded
    x = np.array([r["f"] for r in rows]).reshape(-1, N_FEATURES)
    y = np.array([float(r["y"] == 1) for r in rows])
    words.unpersist()
    texts.unpersist()
    return Model(lexicon, logistic(np.column_stack([np.ones(len(x)), x]), y))


def features(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(lexicon)
        for texts in batches:
            yield pa.array([scorer.features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return docs.select(*keep, of("text").alias("f"))


def with_score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """docs and a column of scores from 0 to 1 of whole texts. A null or empty text has no hits and gets the base score.

    A score follows from the text alone: equal texts have equal scores, each repeated row has its own, and a null doc_id
    makes no difference. A column named as the new one is replaced, others stay. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model.lexicon)
        for texts in batches:
            yield pa.array(model.scores([scorer.features(t) for t in texts.to_pylist()]), pa.float64())

    return docs.withColumn(column, score(F.col("text")))


THRESHOLD = 0.7


def fit(docs: DataFrame, labels: DataFrame, cap: int = LABELLED_ROWS) -> Model:
    """Learn from at most ``cap`` labelled documents outside the held-out third."""
    return learn(labelled_texts(docs, labels, "toxic", fold_of(F.col("doc_id"), 3) != 1, cap))


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, nulls and repeats included, as ``with_score`` has it; a null doc_id isn't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, fit(docs, table(spark, sf_dir, "labels")), "score")
    held = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold, with their columns; rows are judged one by one, by text alone."""
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rows = docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))  # whatever they are named
    kept = with_score(rows, model, "score").where(F.col("score") < THRESHOLD)
    return kept.select(*[(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
