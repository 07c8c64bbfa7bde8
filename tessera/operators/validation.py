"""Which rules of a record a row breaks: one array of names per row, empty for a valid one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Where a record may come from, what links evidence, how a judgement may fall.
PROVENANCES = ["declared", "inferred", "imported"]
RELATIONS = ["informed", "records", "contradicts"]
VERDICTS = ["relevant", "not_relevant", "missing"]


def broken(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in the given order; a rule that comes out null is broken."""
    return F.filter(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(n)) for n, ok in rules.items()]), lambda x: x.isNotNull())


def _said(c: str) -> Column:
    return F.trim(F.col(c)) != ""


def decision_rules(question: str, chosen: str, alternatives: str, confidence: str, provenance: str) -> dict[str, Column]:
    """A decision asks something, chooses something, from at least one alternative that is not what was chosen
    (case aside), with a confidence from 0 to 1 and a known provenance."""
    other = F.exists(F.col(alternatives), lambda a: (F.lower(F.trim(a)) != F.lower(F.trim(F.col(chosen)))) & (F.trim(a) != ""))
    return {
        "no question": _said(question), "nothing chosen": _said(chosen), "no alternative": other,
        "confidence out of range": F.col(confidence).between(0, 1), "unknown provenance": F.col(provenance).isin(PROVENANCES),
    }


def outcome_rules(provenance: str, confidence: str) -> dict[str, Column]:
    """A declared outcome is certain (1), an inferred one may not claim to be."""
    p, c = F.col(provenance), F.col(confidence)
    return {
        "unknown provenance": p.isin(PROVENANCES), "declared but not certain": (p != "declared") | (c == 1.0),
        "inferred but certain": (p != "inferred") | (c < 1.0), "confidence out of range": c.between(0, 1),
    }


def judgement_rules(verdict: str, rank: str) -> dict[str, Column]:
    """A judgement has a known verdict; what is missing has no rank, what was found has one from 1."""
    v, r = F.col(verdict), F.col(rank)
    return {"unknown verdict": v.isin(VERDICTS), "missing but ranked": (v != "missing") | r.isNull(), "no rank": (v == "missing") | (r >= 1)}


def evidence_rules(memory: str, source: str, key: str, ordinal: str, relation: str) -> dict[str, Column]:
    """Evidence names a version, or a source and a key; a chunk is numbered from 0; the relation is known."""
    return {
        "names nothing": F.col(memory).isNotNull() | (_said(source) & _said(key)), "key without source": F.col(key).isNull() | F.col(source).isNotNull(),
        "ordinal below 0": F.col(ordinal).isNull() | (F.col(ordinal) >= 0), "unknown relation": F.col(relation).isin(RELATIONS),
    }


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the others with ``violations``."""
    said = df.withColumn("violations", broken(rules))
    return said.where(F.size("violations") == 0).drop("violations"), said.where(F.size("violations") > 0)
