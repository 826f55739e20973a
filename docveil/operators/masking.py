"""The whole of masking, from documents to masked documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.operators import filters, resolve, rules, terms, vault
from docveil.operators.match import let
from docveil.operators.rules import Rule
from docveil.operators.staging import kept


def resolved(docs: DataFrame, chosen: list[Rule], text: str = "text", entries: list[tuple[str, str]] = (), allow: list[str] = (), threshold: int = rules.THRESHOLD, citations: bool = True, definitions: bool = True, propagation: bool = True, once: bool = False) -> DataFrame:
    """docs with `candidates`, `kept` (disjoint findings in order of place) and `suspects`. docs that have `candidates` of the chosen
    rules are not scanned. With `once`, candidates are written before they are filtered, and only documents that have some come back."""
    out = scanned(docs, chosen, text, entries)
    return filtered(written(out, text) if once else out, chosen, text, entries, allow, threshold, citations, definitions, propagation)


def scanned(docs: DataFrame, chosen: list[Rule], text: str = "text", entries: list[tuple[str, str]] = ()) -> DataFrame:
    """docs with `candidates`: what the rules and a dictionary find."""
    out = docs if "candidates" in docs.columns else rules.detect(docs, chosen, text)
    return out.withColumn("candidates", F.concat("candidates", filters.dictionary(F.col(text), entries))) if entries else out


def filtered(out: DataFrame, chosen: list[Rule], text: str = "text", entries: list[tuple[str, str]] = (), allow: list[str] = (), threshold: int = rules.THRESHOLD, citations: bool = True, definitions: bool = True, propagation: bool = True) -> DataFrame:
    """`resolved` of docs that were scanned."""
    t, c = F.col(text), F.col("candidates")
    if allow:
        out = out.withColumn("__allowed", filters.allowed(t, allow)).withColumn("candidates", filters.outside(c, F.col("__allowed"), "SOZLUK"))
    people = any(r.entity in ("PERSON", "TR_TUZEL_KISI") for r in chosen)
    if definitions and people:
        out = out.withColumn("candidates", let(terms.definitions(t), lambda d: terms.without_defined(c, d)))
    if citations and people:
        out = out.withColumn("candidates", let(terms.foreign_citations(t), lambda a: filters.outside(c, a, "SOZLUK")))
    if citations and any(r.entity == "TR_DOSYA_NO" for r in chosen):
        out = out.withColumn("candidates", filters.without_citations(t, c))
    out = out.withColumn("candidates", F.when(F.size(c) > 0, c).otherwise(F.array().cast(rules.FINDINGS)))
    out = out.withColumn("kept", let(c, lambda found: resolve.resolve(filters.certain(found, threshold))))
    if propagation and (entries or people):
        wider = lambda k: F.concat(k, filters.outside(resolve.propagate(t, k), F.col("__allowed")) if allow else resolve.propagate(t, k))
        out = out.withColumn("kept", let(let(F.col("kept"), wider), resolve.resolve))
    both = F.struct("candidates", "kept")
    return out.withColumn("suspects", let(both, lambda b: resolve.resolve(filters.suspects(b["candidates"], b["kept"], threshold)))).drop("__allowed")


def written(detected: DataFrame, text: str = "text") -> DataFrame:
    """Documents with `candidates`, written once: only those that have some come back."""
    # without a filter before the writing, which would scan each text twice
    both = let(F.col("candidates"), lambda k: F.struct(k.alias("candidates"), F.when(F.size(k) > 0, F.col(text)).alias(text)))
    others = [x for x in detected.columns if x not in ("candidates", text)]
    return kept(detected.select(*others, both.alias("__both")).select(*others, "__both.*"), "candidates").where(F.size("candidates") > 0)


def mask_documents(docs: DataFrame, chosen: list[Rule], matter: str = "source", known: DataFrame | None = None, **options) -> DataFrame:
    """docs (doc_id, text, matter) with `masked`, `n_findings` and `n_suspects`. Texts are scanned once and written with what was
    found; those without candidates are given back from there, and only the others meet their labels."""
    rows = docs.select("doc_id", F.col(matter).alias("matter_id"), "text")
    every = kept(scanned(rows, chosen, entries=options.get("entries", ())), "scanned")
    some = F.coalesce(F.size("candidates") > 0, F.lit(False))
    counts = [F.size("kept").alias("n_findings"), F.size("suspects").alias("n_suspects")]
    found = kept(filtered(every.where(some), chosen, **options).select(*rows.columns, "kept", *counts), "findings")
    findings = found.select("doc_id", "matter_id", F.inline("kept"))
    labels = vault.number_values(findings.select("matter_id", "doc_id", "start", "label_type", "canonical", "text"), known)
    masked = vault.mask(found.drop("kept"), findings.drop("text"), labels)
    others = every.where(~some).select(*rows.columns, F.col("text").alias("masked"), F.lit(0).alias("n_findings"), F.lit(0).alias("n_suspects"))
    return others.unionByName(masked)
