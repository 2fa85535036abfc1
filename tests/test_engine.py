"""The engine as a user calls it: load, list, look up, evaluate; providers; the store's parts."""

import hashlib
import json

import pytest

from claimspark.engine import HISTORY, Engine, NotFound
from claimspark.operators import evaluation, providers
from claimspark.operators.store import DELTAS, ClaimStore
from claimspark.plans.fixtures import PAGE_TEXTS
from claimspark.sources.pages import PAGES, discovered, pdf_pages, verified_files

TEXT = PAGE_TEXTS[0][1] + "\nProfit growth of 12 per cent, board director appointed, FY24 margin crore million."


def pages(spark, *rows):
    return spark.createDataFrame([(d, "northmoor-annual-report.pdf", n, t, False) for d, n, t in rows], PAGES)


def test_engine(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/store")
    with pytest.raises(NotFound):
        engine.documents()
    with pytest.raises(ValueError):
        engine.load(pages(spark))
    first = engine.load(pages(spark, ("d1", 2, TEXT), ("d1", 1, "nothing here")))
    assert first["documents"] == 1 and first["pages"] == 2 and first["facts"] >= 6 and sum(first["relationships"].values()) == first["comparisons"] > 0
    assert engine.load(pages(spark, ("d1", 2, TEXT))) == first  # again: nothing new
    assert engine.load(pages(spark, ("d1", 3, TEXT)))["facts"] == first["facts"]  # the same claims on a later page of a later batch
    assert any("duplicate-evidence: p.3" in r["qualifiers"] for r in engine.facts().collect())
    assert engine.document("d1")["facts_count"] == first["facts"] and [r["page_number"] for r in engine.pages("d1").collect()] == [1, 2, 3]
    with pytest.raises(NotFound):
        engine.pages("d9")
    fact = engine.facts(search="REVENUE", limit=1).first()
    edges = engine.fact(fact["id"])["edges"]
    assert edges == sorted(edges, key=lambda e: (-e["confidence"], e["id"])) and engine.fact(fact["id"])["value"] == fact["value"]
    with pytest.raises(NotFound):
        engine.fact("none")
    both = engine.relationships(fact_id=fact["id"]).collect()
    assert len(both) == len(edges) and engine.relationships(document_id="none").count() == 0
    assert engine.demo_case("scope_failure").count() <= 3
    assert engine.load(pages(spark, ("d2", 1, "x")), reset=True)["facts"] == 0


def test_evaluate_with_gold_files(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/store")
    engine.load(pages(spark, ("d1", 1, TEXT)))
    facts = [r.asDict() for r in engine.facts().collect()]
    item = lambda f, n: {"id": f"g{n}", "source": "current_pipeline", "value": str(f["value"])} | {k: f[k] for k in ("subject", "predicate", "unit", "period", "as_of", "scope")}
    gold = [item(f, n) for n, f in enumerate(facts)]
    gold[0]["unit"] = "boxes"
    (tmp_path / "facts.json").write_text(json.dumps({"items": gold}))
    claim = lambda f: {"subject": f["subject"], "predicate": f["predicate"], "value": str(f["value"]), "unit": f["unit"]}
    by = {f["id"]: f for f in facts}
    found = engine.relationships().collect()
    items = [{"id": f"p{n}", "expectation": "label", "expected": r["relationship"], "fact_a": claim(by[r["fact_b_id"]]), "fact_b": claim(by[r["fact_a_id"]])} for n, r in enumerate(found)]
    items.append({"id": "none", "expectation": "absent", "fact_a": claim(facts[0]), "fact_b": {"subject": "no", "predicate": "no", "value": "1"}})
    (tmp_path / "pairs.json").write_text(json.dumps({"items": items}))
    got = engine.evaluate(f"{tmp_path}/facts.json", f"{tmp_path}/pairs.json", "first")
    n = len(facts)
    scores = got["extraction"]
    assert (scores["tp"], scores["fp_unknown"], scores["fn"]) == (n - 1, 1, 1) and scores["precision"] == scores["recall"] == round((n - 1) / n, 4)
    assert scores["period_capture"] == 1.0 and scores["gold_by_source"] == [{"source": "current_pipeline", "total": n, "matched": n - 1}]
    assert got["relationships"]["accuracy"] == got["relationships"]["absent_compliance"] == 1.0
    for k in range(HISTORY + 1):
        engine.evaluate(f"{tmp_path}/facts.json", f"{tmp_path}/pairs.json", f"n{k}") if k > HISTORY - 2 else engine.store.save("results", engine.results(1).selectExpr("result", f"at + INTERVAL {k + 1} MICROSECONDS AS at"))
    assert engine.results().count() == HISTORY


def test_files(spark, tmp_path):
    folder = tmp_path / "files"
    (folder / "sub").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        discovered(spark, str(folder))
    for name in ("a.pdf", "sub/b.pdf", "c.txt"):
        (folder / name).write_bytes(name.encode())
    found = discovered(spark, str(folder)).collect()
    assert sorted((r["path"].rpartition("/")[2], r["length"]) for r in found) == [("a.pdf", 5), ("b.pdf", 9)]
    good = hashlib.sha256(b"a.pdf").hexdigest()
    expect = lambda *rows: spark.createDataFrame(rows, "name string, length long, sha256 string")
    assert verified_files(spark, str(folder), expect(("a.pdf", 5, good))).count() == 0
    assert verified_files(spark, str(folder), expect(("a.pdf", 5, "x"), ("z.pdf", 1, good), ("a.pdf", 6, good))).count() == 3
    with pytest.raises(ValueError, match="z.pdf"):
        Engine(spark, f"{tmp_path}/store").load_files(str(folder), expect(("z.pdf", 1, good)))
    with pytest.raises(FileNotFoundError):
        pdf_pages(spark, [f"{folder}/none.pdf"])


def test_scores_on_empty_sides(spark):
    schema = "key string, seq long, source string, period string, scope string"
    none, some = spark.createDataFrame([], schema), spark.createDataFrame([("k", 1, "s", None, ""), ("k", 2, "t", "FY24", "x")], schema)
    score = lambda p, g: evaluation.extraction_scores(evaluation.matched(p, g)).first().asDict()
    assert score(none, none) == {"tp": 0, "fp_duplicate": 0, "fp_unknown": 0, "fn": 0, "period_capture": None, "scope_capture": None, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    assert score(some, some.limit(0))["fp_unknown"] == 2 and score(none, some)["fn"] == 2
    one = score(some, some.where("seq = 2"))
    assert one["fp_duplicate"] == 1 and one["period_capture"] == 0.0  # the first prediction takes the item
    pairs = spark.createDataFrame([], "pair string, expectation string, expected string, relationship string")
    judged = evaluation.judged_pairs(pairs.select("pair", "relationship"), pairs.select("pair", "expectation", "expected"))
    row = evaluation.relationship_scores(judged, pairs).first()
    assert row["accuracy"] == 0.0 and row["absent_compliance"] is None
    assert {r["precision"] for r in evaluation.per_class_scores(judged, pairs).collect()} == {None}


def test_providers(spark, tmp_path):
    claims = [
        {"subject": "Acme", "predicate": "revenue", "value": 12.5, "unit": "crore", "period": "FY24", "evidence_text": "12.5 crore"},
        {"subject": "Acme", "predicate": "status", "value": "12.5", "qualifiers": ["x"], "confidence": 0.4, "evidence_text": "in FY24"},
        {"subject": "Acme", "predicate": "revenue", "value": 1, "evidence_text": "  "},
    ]
    provider = providers.MockProvider(claims, first='{"relationship": "corroborates", "confidence": 0.7, "reason": "both say so"}')
    page = spark.createDataFrame([("d1", "a.pdf", 3, "revenue of 12.5 crore in FY24", True), ("d1", "a.pdf", 4, " ", True), ("d1", "a.pdf", 5, "skipped", False)], "document_id string, filename string, page_number int, raw_text string, is_candidate boolean")
    got = {r["predicate"]: r for r in providers.extract_with(page, provider).collect()}
    assert set(got) == {"revenue", "status"} and got["revenue"]["value_num"] == 12.5 and got["revenue"]["value_raw"] is None and got["revenue"]["confidence"] == 1.0
    assert got["status"]["value_raw"] == "12.5" and got["status"]["value_num"] is None and got["status"]["page_number"] == 3 and got["status"]["qualifiers"] == ["x"]
    engine = Engine(spark, f"{tmp_path}/store", providers.MockProvider(), "provider")
    text = "Revenue growth profit loss director board FY24 10 per cent crore. 12.5 crore in FY24"
    two = [{"subject": "Acme", "predicate": "revenue", "value": v, "unit": "crore", "period": "FY24", "evidence_text": e} for v, e in ((12.5, "12.5 crore"), (13.5, "in FY24"))]
    engine.provider = providers.MockProvider(two, first='{"relationship": "corroborates", "confidence": 0.7, "reason": "both say so"}')
    engine.load(spark.createDataFrame([("d1", "a.pdf", 1, "REVENUE GROWTH\n1 2 3\n4 5 6\n" + text, False)], PAGES))
    (row,) = engine.relationships().collect()
    assert (row["relationship"], row["reasoning_mode"], row["reason"]) == ("CORROBORATES", "provider", "both say so")
    mock = providers.MockProvider(claims, {("a", "b"): "first"})
    assert mock.compare("b", "a", "") == "first" and "UNCERTAIN" in mock.compare("a", "c", "") and mock.compare_calls == [("b", "a"), ("a", "c")]
    mock.extract("t", "c")[0]["subject"] = "changed"
    assert mock.extract("t", "c")[0]["subject"] == "Acme" and len(mock.extract_calls) == 2


def test_store_parts(spark, tmp_path):
    store = ClaimStore(spark, f"{tmp_path}/s")
    row = lambda *r: spark.createDataFrame([r], "id string, n int")
    for k in range(DELTAS + 3):
        store.save("facts", row(str(k % 4), k))
    assert {(r["id"], r["n"]) for r in store.read("facts").collect()} == {(str(k % 4), k) for k in range(DELTAS - 1, DELTAS + 3)}
    assert len(store._parts("facts")) <= 4
    store.remove("facts", row("1", 0))
    assert store.read("facts").count() == 3
    spark.conf.set("spark.claimspark.store", f"{tmp_path}/s")
    assert ClaimStore(spark).read("facts").count() == 3
    spark.conf.unset("spark.claimspark.store")
    store.reset()
    assert store.read("facts") is None
