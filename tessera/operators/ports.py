"""What a model does, as small protocols, with deterministic stand-ins that need no weights.

A port is called with whole batches inside ``mapInPandas``, so a real model loads
once per worker. Ports are handed over as factories, since models do not pickle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Extractor(Protocol):
    def extract(self, text: str) -> list[tuple[str, str, float]]: ...


class HashEmbedder:
    """Unit vectors seeded by the words of a text: texts that share words lie near each other."""

    def __init__(self, dim: int = 64):
        self.name, self.dim = f"hash-{dim}", dim

    def _word(self, w: str) -> np.ndarray:
        return np.random.default_rng(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")).normal(size=self.dim)

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        seen: dict[str, np.ndarray] = {}
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                if w not in seen:
                    seen[w] = self._word(w)
                out[i] += seen[w]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


class OverlapReranker:
    """Share of the query's words that a text has."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        q = set(re.findall(r"\w+", query.lower()))
        return [len(q & set(re.findall(r"\w+", t.lower()))) / len(q) if q else 0.0 for t in texts]


class PatternExtractor:
    """Entities by shape: files, code names and capitalised words inside a sentence."""

    SHAPES = (("file", r"\b[\w./-]+\.(?:py|md|txt|pdf|json)\b", 0.9), ("technology", r"\b[a-z]+_[a-z_]+\b", 0.7), ("concept", r"(?<=[a-z] )[A-Z][a-z]{3,}\b", 0.4))

    def extract(self, text: str) -> list[tuple[str, str, float]]:
        return [(m.group(), kind, score) for kind, shape, score in self.SHAPES for m in re.finditer(shape, text)]


def embed(texts: DataFrame, text: str, model: Callable[[], Embedder], cache: DataFrame | None = None) -> DataFrame:
    """One vector per distinct text: hash, model, vector. What the cache has is not computed again.

    Null and blank texts have no vector. The key is the hash of model and text.
    """
    name = model().name
    todo = texts.select(F.col(text).alias("text")).where("trim(text) <> ''").distinct()
    todo = todo.select(F.sha2(F.concat(F.lit(name + "|"), "text"), 256).alias("hash"), "text")
    if cache is not None:
        todo = todo.join(cache.where(F.col("model") == name).select("hash"), "hash", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model()
        for f in frames:
            yield pd.DataFrame({"hash": f["hash"], "model": m.name, "vector": list(m.embed(f["text"].tolist()))})

    return todo.mapInPandas(run, "hash string, model string, vector array<double>")


def extract(chunks: DataFrame, id_col: str, text: str, model: Callable[[], Extractor]) -> DataFrame:
    """Raw proposals of an extractor: id, text, name, kind, confidence."""
    kind = dict(chunks.dtypes)[id_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model()
        for f in frames:
            rows = [(i, t, *e) for i, t in zip(f[id_col], f["_t"]) for e in m.extract(t)]
            yield pd.DataFrame(rows, columns=[id_col, "text", "name", "kind", "confidence"])

    return chunks.select(id_col, F.col(text).alias("_t")).where("_t IS NOT NULL").mapInPandas(run, f"{id_col} {kind}, text string, name string, kind string, confidence double")


def scored_pairs(pairs: DataFrame, id_col: str, query: str, text: str, model: Callable[[], Reranker]) -> DataFrame:
    """The model's score of every (query, text) pair: id, score. Bring only as many as are to be reranked."""
    kind = dict(pairs.dtypes)[id_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model()
        for f in frames:
            scores = pd.Series(0.0, index=f.index)
            for q, g in f.groupby("_q"):
                scores[g.index] = m.score(q, g["_t"].tolist())
            yield pd.DataFrame({id_col: f[id_col], "score": scores})

    filled = pairs.select(id_col, F.coalesce(query, F.lit("")).alias("_q"), F.coalesce(text, F.lit("")).alias("_t"))
    return filled.mapInPandas(run, f"{id_col} {kind}, score double")


KINDS = ("person", "organisation", "technology", "file", "project", "place", "concept")


def verified(proposals: DataFrame, id_col: str, least: float = 0.5) -> DataFrame:
    """Proposals that hold: id, name as the text spells it, kind, start (from 0), fate.

    Fates other than ``kept`` say why not: low confidence, unknown kind, not in the
    text. Of equal (id, name, start) one stays.
    """
    exact, loose = F.expr("locate(name, text)"), F.expr("locate(lower(name), lower(text))")
    at = F.when(exact > 0, exact).otherwise(loose)
    fate = F.when(F.col("confidence") < least, "low confidence").when(~F.col("kind").isin(*KINDS), "unknown kind").when(at == 0, "not in the text").otherwise("kept")
    named = F.when(at > 0, F.expr("substring(text, CASE WHEN locate(name, text) > 0 THEN locate(name, text) ELSE locate(lower(name), lower(text)) END, length(name))")).otherwise(F.col("name"))
    return proposals.select(id_col, named.alias("name"), "kind", (at - 1).alias("start"), fate.alias("fate")).dropDuplicates([id_col, "name", "start"])
