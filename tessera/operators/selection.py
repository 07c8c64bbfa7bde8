"""Selections in which each choice depends on those before: diversity, budgets, compaction.

Each works on one request at a time; diversity holds the vectors of all candidates of a request.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LAMBDA, CATEGORY_SHARE = 0.5, 0.5


def mmr_order(relevance: np.ndarray, vectors: list[np.ndarray | None], trade: float = LAMBDA, window: int = 2048) -> list[int]:
    """Indices in the order of maximal marginal relevance; the first of equals wins.

    Exact over all candidates: scores only fall as more is taken, so the best
    ``window`` of them are followed alone until one of the others might be next;
    then those taken since are brought into all scores by one matrix product.

    Relevance is scaled to [0, 1] (1 where all are equal). A candidate without a
    usable vector is redundant to nothing.
    """
    n = len(relevance)
    if not n:
        return []
    low, high = relevance.min(), relevance.max()
    scaled = np.ones(n) if high == low else (relevance - low) / (high - low)
    most = max((len(v) for v in vectors if v is not None), default=0)
    unit = np.zeros((n, most))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == most and np.isfinite(v).all() and np.linalg.norm(v) > 0:
            unit[i] = v / np.linalg.norm(v)
    base, at, left = trade * scaled, np.arange(n), np.ones(n, dtype=bool)
    out = [int(base.argmax())]
    left[out[0]] = False
    near = unit @ unit[out[0]]
    while left.any():
        if left.sum() < 0.75 * len(left):
            unit, base, near, at, left = unit[left], base[left], near[left], at[left], left[left]
        score = np.where(left, base - (1 - trade) * near, -np.inf)
        inside = np.zeros(len(left), dtype=bool)
        inside[np.argpartition(-score, min(window, len(left)) - 1)[:window]] = True
        inside[score.argmax()] = True
        bound = score[~inside].max(initial=-np.inf)
        some = np.flatnonzero(inside & left)
        u, s, b, m = unit[some], score[some], base[some], near[some]
        new: list[int] = []
        while len(new) < min(len(some), 512):
            i = int(s.argmax())
            if new and s[i] <= bound:
                break
            new.append(i)
            m = np.maximum(m, u @ u[i])
            s = b - (1 - trade) * m
            s[new] = -np.inf
        out += at[some[new]].tolist()
        left[some[new]] = False
        for i in range(0, len(left), 8192):
            near[i : i + 8192] = np.maximum(near[i : i + 8192], (unit[i : i + 8192] @ u[new].T).max(axis=1))
    return out


def select_within(order: list[int], tokens: list[int], categories: list, budget: int, max_items: int, share: float = CATEGORY_SHARE) -> list[str]:
    """The fate of each candidate in the given order: chosen, EMPTY, MAX_ITEMS, CATEGORY_FULL, OVER_BUDGET.

    The reasons are tried in that order; what does not fit is skipped, the rest goes on.
    """
    cap = max(1, int(max_items * share))
    fate, used, count, per = [""] * len(tokens), 0, 0, {}
    for i in order:
        c = categories[i]
        if tokens[i] <= 0:
            fate[i] = "EMPTY"
        elif count >= max_items:
            fate[i] = "MAX_ITEMS"
        elif per.get(c, 0) >= cap:
            fate[i] = "CATEGORY_FULL"
        elif used + tokens[i] > budget:
            fate[i] = "OVER_BUDGET"
        else:
            fate[i], used, count, per[c] = "chosen", used + tokens[i], count + 1, per.get(c, 0) + 1
    return fate


def diverse_selection(candidates: DataFrame, request: str, key: str, relevance: str, vector: str, tokens: str, category: str, budget: int = 6000, max_items: int = 20) -> DataFrame:
    """Per request all candidates in diverse order, each with its fate.

    Output: request, key, place (from 1), fate. Null relevance counts as 0, null
    tokens as 0 (EMPTY). Rejected candidates count as seen, as all are put in order
    before any is chosen. A request is one task and its order takes time with the
    square of its candidates.
    """
    score = F.coalesce(F.col(relevance), F.lit(0.0))
    every = candidates.select(request, key, score.alias("_r"), F.col(vector).alias("_v"), F.coalesce(tokens, F.lit(0)).alias("_t"), F.col(category).alias("_c"))
    kinds = dict(candidates.dtypes)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_r", key], ascending=[False, True])
        order = mmr_order(pdf["_r"].to_numpy(), [None if v is None else np.asarray(v, dtype=float) for v in pdf["_v"]])
        fate = select_within(order, pdf["_t"].tolist(), pdf["_c"].tolist(), budget, max_items)
        place = np.empty(len(order), dtype=int)
        place[order] = np.arange(1, len(order) + 1)
        return pd.DataFrame({request: pdf[request].to_numpy(), key: pdf[key].to_numpy(), "place": place, "fate": fate})

    return every.groupBy(request).applyInPandas(choose, f"{request} {kinds[request]}, {key} {kinds[key]}, place int, fate string")


def compact_history(steps: DataFrame, run: str, ordinal: str, tokens: str, budget: int, verbatim: int = 2) -> DataFrame:
    """The last ``verbatim`` steps stay; older ones are kept from the newest while they fit, skipping what does not.

    Output: run, ordinal, state (verbatim, kept, dropped). Each choice depends on
    those before it, so a run is one sequence; it streams through sorted batches
    and only the room that is left is held.
    """
    kinds = dict(steps.dtypes)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, left, seen = object(), 0, 0
        for f in frames:
            states = []
            for k, t in zip(f[run].tolist(), f[tokens].tolist()):
                if k != key:
                    key, left, seen = k, budget, 0
                seen += 1
                if seen <= verbatim:
                    states.append("verbatim")
                elif t <= left:
                    states.append("kept")
                    left -= t
                else:
                    states.append("dropped")
            yield pd.DataFrame({run: f[run], ordinal: f[ordinal], "state": states})

    ordered = steps.select(run, ordinal, tokens).repartition(run).sortWithinPartitions(run, F.desc(ordinal))
    return ordered.mapInPandas(fold, f"{run} {kinds[run]}, {ordinal} {kinds[ordinal]}, state string")
