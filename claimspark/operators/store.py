"""The claim store, and the queries that it answers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimspark.functions.text import filled, has_any
from claimspark.operators.facts import value_text

KEYS = {"documents": ["document_id"], "pages": ["document_id", "page_number"], "facts": ["id"], "comparisons": ["id"], "results": ["at"]}
#: The setting that names a store's folder, where none is given, and the folder where that is unset too.
SETTING, DEFAULT = "spark.claimspark.store", "claims"
#: So many saves lie beside a table's base before they are merged into a new one.
DELTAS = 8


class ClaimStore:
    """Parquet tables under a folder: of each a base, and a part for each save since, of which the latest row of a key holds.

    A save costs what it saves, and now and then a merge. A part counts once it is committed, so readers see all or nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, (path or spark.conf.get(SETTING, DEFAULT)).rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _parts(self, name: str) -> list[str]:
        """Committed parts since the last base, that first."""
        root = self._path(f"{self.path}/{name}")
        if not self._fs.exists(root):
            return []
        every = sorted(str(s.getPath()) for s in self._fs.listStatus(root) if self._fs.exists(self._path(str(s.getPath()) + "/_SUCCESS")))
        bases = [n for n, p in enumerate(every) if p.endswith("-base")]
        return every[bases[-1] if bases else 0 :]

    def read(self, name: str) -> DataFrame | None:
        parts = self._parts(name)
        if not parts:
            return None
        rows = None
        for n, part in enumerate(parts):
            own = self.spark.read.parquet(part).withColumn("__n", F.lit(n))
            rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        if len(parts) > 1:
            latest = W.partitionBy(*KEYS[name]).orderBy(F.desc("__n"))
            rows = rows.withColumn("__k", F.row_number().over(latest)).where("__k = 1").drop("__k")
        return rows.where("NOT __gone").drop("__n", "__gone")

    def _write(self, name: str, rows: DataFrame, kind: str) -> None:
        parts = self._parts(name)
        number = int(parts[-1].rpartition("/v")[2].split("-")[0]) + 1 if parts else 0
        rows.write.parquet(f"{self.path}/{name}/v{number:08d}-{uuid.uuid4().hex[:8]}-{kind}")

    def save(self, name: str, rows: DataFrame, gone: bool = False) -> None:
        """Upsert by the table's key: a row replaces that of the same key, or takes it away. Of equal keys in ``rows`` one is kept."""
        parts = self._parts(name)
        self._write(name, rows.dropDuplicates(KEYS[name]).withColumn("__gone", F.lit(gone)), "part" if parts else "base")
        if len(parts) >= DELTAS:
            self.merge(name)

    def remove(self, name: str, rows: DataFrame) -> None:
        self.save(name, rows, gone=True)

    def merge(self, name: str) -> None:
        """One base of all parts; what the base before it was made of goes, that base stays for those who read it."""
        parts = self._parts(name)
        self._write(name, self.read(name).withColumn("__gone", F.lit(False)), "base")
        for stale in parts[1:]:
            self._fs.delete(self._path(stale), True)

    def reset(self) -> None:
        """An empty store."""
        self._fs.delete(self._path(self.path), True)

    def health(self) -> dict:
        counts = {name: (0 if (df := self.read(name)) is None else df.count()) for name in KEYS if name != "results"}
        found = self.read("comparisons")
        by = {} if found is None else {r[0]: r[1] for r in found.groupBy("relationship").count().collect()}  # as many as labels
        return {"status": "ok", **counts, "relationships": by}


def documents_with_counts(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """documents with facts_count, 0 where there are none."""
    counts = facts.groupBy("document_id").agg(F.count(F.lit(1)).alias("facts_count"))
    return documents.join(counts, "document_id", "left").withColumn("facts_count", F.coalesce("facts_count", F.lit(0)).cast("long"))


SEARCHED = ("subject", "predicate", "value_raw", "evidence_text", "canonical_subject", "canonical_predicate")


def search_facts(facts: DataFrame, document_id: str | None = None, search: str | None = None) -> DataFrame:
    """Facts of a document, and those of which a column is like ``%search%``, case aside; ``%`` and ``_`` are wildcards."""
    if document_id is not None:
        facts = facts.where(F.col("document_id") == document_id)
    if search:
        test = F.lit(False)
        for c in SEARCHED:
            test = test | F.coalesce(F.lower(F.col(c)).like(f"%{search.lower()}%"), F.lit(False))
        facts = facts.where(test)
    return facts


def page_of(facts: DataFrame, order: list, limit: int = 200, offset: int = 0) -> DataFrame:
    """The feature is a page of an ordered listing; ``order`` should end in a unique column."""
    return facts.orderBy(*order).offset(offset).limit(limit)


def listed_relationships(comparisons: DataFrame, facts: DataFrame, relationship: str | None = None, fact_id: str | None = None, document_id: str | None = None) -> DataFrame:
    """comparisons with both facts' columns (a_*, b_*); edges whose facts are missing vanish."""
    of = lambda p: facts.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "document_id", "document_name", "page_number", "subject", "predicate", "value_raw", "value_num", "unit", "period", "as_of", "scope", "evidence_text")])
    if relationship:
        comparisons = comparisons.where(F.col("relationship") == relationship.strip().upper())
    if fact_id:
        comparisons = comparisons.where((F.col("fact_a_id") == fact_id) | (F.col("fact_b_id") == fact_id))
    out = comparisons.join(of("a"), F.col("fact_a_id") == F.col("a_id")).join(of("b"), F.col("fact_b_id") == F.col("b_id"))
    if document_id:
        out = out.where((F.col("a_document_id") == document_id) | (F.col("b_document_id") == document_id))
    return out


def fact_edges(fact_id: str, comparisons: DataFrame, facts: DataFrame) -> DataFrame:
    """Comparisons of one fact with the fact at their other end, which may be missing."""
    own = comparisons.where((F.col("fact_a_id") == fact_id) | (F.col("fact_b_id") == fact_id))
    own = own.withColumn("other_id", F.when(F.col("fact_a_id") == fact_id, F.col("fact_b_id")).otherwise(F.col("fact_a_id")))
    other = facts.select(F.col("id").alias("other_id"), F.col("subject").alias("other_subject"), F.col("document_id").alias("other_document_id"))
    return own.join(other, "other_id", "left").orderBy(F.desc("confidence"), "id").select("id", "relationship", "confidence", "other_id", "other_subject", "other_document_id")


def store_stats(documents: DataFrame, pages: DataFrame, facts: DataFrame, comparisons: DataFrame) -> DataFrame:
    """name and n: rows of each table, and comparisons of each relationship."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in (("documents", documents), ("pages", pages), ("facts", facts), ("comparisons", comparisons))]
    by = comparisons.groupBy("relationship").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("relationship:"), "relationship").alias("name"), "n")
    out = by
    for df in counts:
        out = out.unionByName(df)
    return out


def demo_cases(agree: tuple[str, ...] = ("gdp",), examine: tuple[str, ...] = ("cpi", "inflation")) -> dict[str, Column]:
    """Named views of listed relationships: terms of both subjects, terms of either, and texts of the reason.

    ``date`` is looked for anywhere in a reason, so it's also found in "consolidated".
    """
    a, b, reason = F.lower("a_subject"), F.lower("b_subject"), F.lower("reason")
    reconcilable = F.col("relationship") == "RECONCILABLE"
    return {
        "corroborate": (F.col("relationship") == "CORROBORATES") & has_any(a, agree) & has_any(b, agree),
        "investigate": has_any(a, examine) | has_any(b, examine),
        "vintage_reconcile": reconcilable & has_any(reason, ("vintage", "advance estimate")),
        "director_reconcile": reconcilable & has_any(reason, ("temporal", "resignation", "cessation", "date")),
        "scope_failure": reconcilable & (F.col("dimensions.scope") == "different"),
    }


def demo_case(listed: DataFrame, name: str, **terms: tuple[str, ...]) -> DataFrame:
    return listed.where(demo_cases(**terms)[name])


def demo_top(listed: DataFrame, name: str, most: int = 3, **terms: tuple[str, ...]) -> DataFrame:
    """The view's rows that are shown: those of highest confidence."""
    return page_of(demo_case(listed, name, **terms), [F.desc("confidence"), "id"], most)


def decoded(facts: DataFrame) -> DataFrame:
    """facts with value, as text: the number if there is one, else the raw text."""
    return facts.withColumn("value", value_text(F.col("value_num"), filled(F.col("value_raw"))))
