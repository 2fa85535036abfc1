"""What a user of the engine calls: load pages, look at documents, facts and relationships, evaluate."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from claimspark.operators import evaluation
from claimspark.operators.providers import Provider
from claimspark.operators.store import ClaimStore, decoded, demo_top, documents_with_counts, fact_edges, listed_relationships, page_of, search_facts
from claimspark.sources.pages import discovered, gold_facts, gold_pairs, pdf_pages, verified_files
from claimspark.streaming.ingest import ingest

#: Results of evaluations that are kept: the latest and those before it.
HISTORY = 20


class NotFound(LookupError):
    """What was asked for by its id isn't in the store."""


class Engine:
    """A store, by path, or by the setting that names one, and what is asked of it. Listings are DataFrames."""

    def __init__(self, spark: SparkSession, path: str | None = None, provider: Provider | None = None, reasoning_mode: str = "heuristic") -> None:
        self.spark, self.store, self.provider, self.mode = spark, ClaimStore(spark, path), provider, reasoning_mode

    def _table(self, name: str) -> DataFrame:
        rows = self.store.read(name)
        if rows is None:
            raise NotFound(f"the store has no {name} yet")
        return rows

    def _one(self, rows: DataFrame, what: str) -> Row:
        found = rows.first()
        if found is None:
            raise NotFound(what)
        return found

    def load(self, pages: DataFrame, reset: bool = False) -> dict:
        """Ingest pages, into an empty store if asked; counts of what there is now."""
        if reset:
            self.store.reset()
        if pages.isEmpty():
            raise ValueError("there are no pages to load")
        ingest(pages, self.store, self.provider, self.mode)
        return self.health()

    def load_files(self, folder: str, expected: DataFrame | None = None, reset: bool = False) -> dict:
        """Ingest all PDF files below a folder; with ``expected`` (name, length, sha256) only if they are these files."""
        paths = [r["path"] for r in discovered(self.spark, folder).select("path").collect()]  # names of files
        if expected is not None and (other := verified_files(self.spark, folder, expected).first()) is not None:
            raise ValueError(f"{other['name']} is missing or differs")
        return self.load(pdf_pages(self.spark, paths), reset)

    def health(self) -> dict:
        return self.store.health()

    stats = health

    def documents(self) -> DataFrame:
        """With facts_count; the latest upload first."""
        return documents_with_counts(self._table("documents"), self._table("facts")).orderBy(F.desc("uploaded_at"), "document_id")

    def document(self, document_id: str) -> Row:
        return self._one(self.documents().where(F.col("document_id") == document_id), f"no document {document_id}")

    def pages(self, document_id: str) -> DataFrame:
        """In order."""
        self.document(document_id)
        return self._table("pages").where(F.col("document_id") == document_id).orderBy("page_number")

    def facts(self, document_id: str | None = None, search: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        return page_of(decoded(search_facts(self._table("facts"), document_id, search)), [F.desc("seq"), "id"], limit, offset)

    def fact(self, fact_id: str) -> dict:
        """The fact, and its relationships, those of highest confidence first, as ``edges``."""
        facts = self._table("facts")
        own = self._one(decoded(facts.where(F.col("id") == fact_id)), f"no fact {fact_id}")
        return own.asDict(True) | {"edges": [r.asDict(True) for r in fact_edges(fact_id, self._table("comparisons"), facts).collect()]}

    def relationships(self, relationship: str | None = None, fact_id: str | None = None, document_id: str | None = None, limit: int = 200) -> DataFrame:
        rows = listed_relationships(self._table("comparisons"), self._table("facts"), relationship, fact_id, document_id)
        return page_of(rows, [F.desc("confidence"), "id"], limit)

    def demo_case(self, name: str) -> DataFrame:
        return demo_top(listed_relationships(self._table("comparisons"), self._table("facts")), name)

    def evaluate(self, extraction_gold: str, relationship_gold: str, label: str = "unlabeled", write: bool = True) -> dict:
        """Scores of what is stored against gold files; kept with the store, the latest HISTORY of them, unless told not to."""
        facts, found = self._table("facts"), self._table("comparisons")
        own = lambda df, source: evaluation.keyed(df, dated=True).select("key", "seq", F.col(source).alias("source"), *evaluation.CAPTURED)
        outcomes = evaluation.matched(own(facts, "document_id"), own(gold_facts(self.spark, extraction_gold), "source"))
        predicted = evaluation.unique_pairs(found, facts)
        judged = evaluation.judged_pairs(predicted, gold_pairs(self.spark, relationship_gold))
        rows = lambda df: [r.asDict() for r in df.collect()]  # a few rows each
        result = {
            "label": label,
            "counts": self.health(),
            "extraction": rows(evaluation.extraction_scores(outcomes))[0] | {"gold_by_source": rows(evaluation.gold_by_source(outcomes))},
            "relationships": rows(evaluation.relationship_scores(judged, predicted))[0] | {"per_class": rows(evaluation.per_class_scores(judged, predicted)), "details": rows(judged.select("pair", "expectation", "expected", "produced", "outcome"))},
        }
        if write:
            self.store.save("results", self.spark.createDataFrame([(json.dumps(result),)], "result string").withColumn("at", F.current_timestamp()))
            old = self.results(HISTORY + 1).collect()[HISTORY:]
            if old:
                self.store.remove("results", self.spark.createDataFrame(old, self.store.read("results").schema))
        return result

    def results(self, most: int = HISTORY) -> DataFrame:
        """The latest first."""
        return self._table("results").orderBy(F.desc("at")).limit(most)
