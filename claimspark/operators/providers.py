"""Providers: another way to extract claims and to compare them, off by default; nothing here reaches a network."""

from __future__ import annotations

import copy
import json
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.text import stripped
from claimspark.operators.extraction import identified
from claimspark.operators.reasoning import parsed_response, related

#: What a provider is asked for, as schemas of its JSON answers.
EXTRACTION = "array<struct<subject:string,predicate:string,value:string,unit:string,period:string,as_of:string,scope:string,qualifiers:array<string>,evidence_text:string,confidence:double>>"
EXTRACTION_ASK = "List the claims that the page makes, each with the text on the page that shows it. Leave out what the page doesn't state."
COMPARISON_ASK = "Say how the two facts relate, how sure that is, and why. The dimensions are hints, not the verdict."


class Provider(ABC):
    """Must be picklable; each Python worker has its own copy."""

    @abstractmethod
    def extract(self, text: str, context: str) -> list[dict]:
        """Claims of a page, as EXTRACTION has them; a value is a number or a text."""

    @abstractmethod
    def compare(self, a_id: str, b_id: str, prompt: str) -> str:
        """JSON text with relationship, confidence and reason."""


class MockProvider(Provider):
    """Answers from given tables, for tests: the same claims for each page, comparisons by the two ids in either order, else the
    first answer, else UNCERTAIN."""

    def __init__(self, claims: list[dict] | None = None, answers: dict[tuple[str, str], str] | None = None, first: str | None = None) -> None:
        self.claims, self.answers, self.first = claims or [], answers or {}, first
        self.extract_calls: list[str] = []
        self.compare_calls: list[tuple[str, str]] = []

    def extract(self, text: str, context: str) -> list[dict]:
        self.extract_calls.append(context)
        return copy.deepcopy(self.claims)

    def compare(self, a_id: str, b_id: str, prompt: str) -> str:
        self.compare_calls.append((a_id, b_id))
        found = self.answers.get((a_id, b_id)) or self.answers.get((b_id, a_id)) or self.first
        return found or '{"relationship": "UNCERTAIN", "confidence": 0.0, "reason": "No answer is prepared."}'


def parsed_claims(response: Column) -> Column:
    """Array of claims of a provider's JSON text: value_num where the value is a number, else value_raw; claims without evidence are
    dropped, confidence is 1 and qualifiers are none where they aren't given. Malformed text has no claims."""
    texts = F.from_json(response, EXTRACTION)
    numbers = F.from_json(response, "array<struct<value:double>>")
    both = F.filter(F.zip_with(texts, numbers, lambda t, n: F.struct(t.alias("t"), n["value"].alias("n"))), lambda r: F.coalesce(stripped(r["t"]["evidence_text"]), F.lit("")) != "")
    of = lambda r, *names: [r["t"][n].alias(n) for n in names]
    return F.transform(
        F.coalesce(both, F.array().cast(f"array<struct<t:{EXTRACTION[6:-1]},n:double>>")),
        lambda r: F.struct(
            *of(r, "subject", "predicate"), F.when(r["n"].isNull(), r["t"]["value"]).alias("value_raw"), r["n"].alias("value_num"), *of(r, "unit", "period", "as_of", "scope"),
            F.coalesce(r["t"]["qualifiers"], F.array().cast("array<string>")).alias("qualifiers"), F.coalesce(r["t"]["confidence"], F.lit(1.0)).alias("confidence"), *of(r, "evidence_text"),
        ),
    )


def extract_with(pages: DataFrame, provider: Provider, candidate_only: bool = True) -> DataFrame:
    """Facts of pages, as ``extraction.extract`` has them, from a provider's answers."""
    if candidate_only:
        pages = pages.where("is_candidate")

    @F.arrow_udf("string")
    def ask(texts: pa.Array, contexts: pa.Array) -> pa.Array:
        return pa.array([json.dumps(provider.extract(t, c)) for t, c in zip(texts.to_pylist(), contexts.to_pylist(), strict=True)], pa.string())

    pages = pages.where(F.trim(F.coalesce("raw_text", F.lit(""))) != "")
    asked = pages.withColumn("__r", ask("raw_text", F.format_string("%s p.%d", "filename", "page_number")))
    found = asked.select(F.col("document_id").cast("string"), F.col("filename").cast("string").alias("document_name"), F.col("page_number").cast("int"), F.posexplode(parsed_claims(F.col("__r"))).alias("number", "c"))
    return identified(found.select("document_id", "document_name", "page_number", "number", F.lit("provider").alias("rule"), "c.*"))


def prompts(compared: DataFrame) -> DataFrame:
    """compared pairs with prompt: both facts, their dimensions and notes as text."""
    side = lambda p: F.format_string("%s | %s | %s %s | period %s | as of %s | scope %s | %s", *[F.coalesce(F.col(f"{p}_{c}").cast("string"), F.lit("-")) for c in ("subject", "predicate")], F.coalesce(F.col(f"{p}_value_raw"), F.col(f"{p}_value_num").cast("string"), F.lit("-")), *[F.coalesce(F.col(f"{p}_{c}").cast("string"), F.lit("-")) for c in ("unit", "period", "as_of", "scope", "evidence_text")])
    names = ("subject", "predicate", "value", "unit", "period", "scope", "qualifiers")
    dims = F.concat_ws(", ", *[F.concat(F.lit(f"{n}: "), F.col(f"dims.{n}")) for n in names])
    return compared.withColumn("prompt", F.concat_ws("\n", F.lit(COMPARISON_ASK), F.concat(F.lit("Fact A: "), side("a")), F.concat(F.lit("Fact B: "), side("b")), F.concat(F.lit("Dimensions: "), dims), F.concat(F.lit("Numbers: "), F.col("num.status")), F.concat(F.lit("Periods: "), F.col("per.note"))))


def compare_with(compared: DataFrame, provider: Provider | None) -> DataFrame:
    """The provider's labels, parsed; without one those of the rules. An error in a call is UNCERTAIN with its text."""
    if provider is None:
        return related(compared)

    @F.arrow_udf("struct<response:string,error:string>")
    def ask(a: pa.Array, b: pa.Array, prompts: pa.Array) -> pa.Array:
        out = []
        for row in zip(a.to_pylist(), b.to_pylist(), prompts.to_pylist(), strict=True):
            try:
                out.append({"response": provider.compare(*row), "error": None})
            except Exception as e:
                out.append({"response": None, "error": f"Reasoning provider failed: {e}"})
        return pa.array(out, pa.struct([("response", pa.string()), ("error", pa.string())]))

    asked = prompts(compared).withColumn("__a", ask("a_id", "b_id", "prompt"))
    parsed = parsed_response(F.col("__a.response"))
    return asked.withColumn("__p", parsed).select(*compared.columns, F.lit("provider").alias("rule"), "__p.relationship", "__p.confidence", F.coalesce("__a.error", "__p.reason").alias("reason"))
