"""Pages as a stream: each micro-batch is scored, extracted, deduplicated, grounded and stored, then matched with the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimspark.operators.extraction import extract
from claimspark.operators.facts import dedupe, ground, normalize
from claimspark.operators.matching import candidate_pairs, compared
from claimspark.operators.providers import Provider, compare_with, extract_with
from claimspark.operators.reasoning import comparisons
from claimspark.operators.scoring import document_rollup, score_pages
from claimspark.operators.store import ClaimStore


def ingest(pages: DataFrame, store: ClaimStore, provider: Provider | None = None, reasoning_mode: str = "heuristic", candidate_only: bool = True) -> None:
    """One batch. Ids follow from content, so a batch that is run again changes nothing.

    Facts are extracted by rules, or by the provider if there is one; pairs are labelled by rules, unless ``reasoning_mode`` is
    "provider". A claim that a document makes on pages of several batches is stored once, as if they had come together.
    """
    scored = score_pages(pages)
    store.save("pages", scored)
    ids = pages.select("document_id").distinct()
    rollup = document_rollup(store.read("pages").join(ids, "document_id", "left_semi"))
    names = pages.groupBy("document_id").agg(F.min("filename").alias("filename"))
    store.save("documents", rollup.join(names, "document_id").withColumn("uploaded_at", F.current_timestamp()))
    extracted = extract(scored, candidate_only) if provider is None else extract_with(scored, provider, candidate_only)
    found = ground(normalize(extracted), pages).where("verified").drop("verified", "number", "rule")
    known = store.read("facts")
    if known is None:
        store.save("facts", dedupe(found).drop("fingerprint"))
    else:
        own = known.join(ids, "document_id", "left_semi")
        kept = dedupe(found.unionByName(own.join(found.select("id"), "id", "left_anti").select(*found.columns))).drop("fingerprint").persist()
        store.save("facts", kept)
        store.remove("facts", own.join(kept.select("id"), "id", "left_anti"))
        kept.unpersist()
    known = store.read("facts")
    pairs = compared(candidate_pairs(known, new=known.join(ids, "document_id", "left_semi")))
    if provider is not None and reasoning_mode == "provider":
        store.save("comparisons", comparisons(pairs, compare_with(pairs, provider), reasoning_mode))
    else:
        store.save("comparisons", comparisons(pairs))


def start(pages: DataFrame, store: ClaimStore, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """pages: a streaming DataFrame. State is the store itself."""

    def run(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            ingest(batch, store, **options)
        finally:
            batch.unpersist()

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
