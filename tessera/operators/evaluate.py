"""Measures of retrieval and of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def ir_metrics(results: DataFrame, relevant: DataFrame, by: str, id_col: str, k: int = 10) -> DataFrame:
    """recall@k, precision@k (over k), reciprocal rank (whole list), binary nDCG@k per query that has relevant items.

    ``results``: by, id, rank; ``relevant``: by, id. An item returned twice counts once, at its best rank.
    """
    r = results.groupBy(by, id_col).agg(F.min("rank").alias("rank"))
    rel = relevant.select(by, id_col).dropna().distinct()
    n = rel.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    top = F.col("rank") <= k
    hits = r.join(rel, [by, id_col]).groupBy(by).agg(
        F.count_if(top).alias("h"), F.min("rank").alias("first"), F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1))).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return n.join(hits, by, "left").select(
        by, z(F.col("h") / F.col("n")).alias("recall"), z(F.col("h") / F.lit(k)).alias("precision"),
        z(1 / F.col("first")).alias("mrr"), z(F.col("dcg") / ideal).alias("ndcg"),
    )


def summary(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Mean, median, least and population spread of each metric: metric, mean, median, least, spread."""
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])).alias("x")).select("x.*")
    r = lambda c: F.round(c, 6)
    return long.groupBy("metric").agg(r(F.avg("v")).alias("mean"), r(F.median("v")).alias("median"), F.min("v").alias("least"), r(F.stddev_pop("v")).alias("spread"))


def nearest_rank(df: DataFrame, by: str, value: str, shares: dict[str, float], buckets: int = 64) -> DataFrame:
    """Per group the value at round-half-even(p * (n - 1)) of its sorted values, a column per share. Nulls do not count.

    Values are filed under approximate quantiles of their group; counts say in which
    bucket a rank lies, and only rows of that bucket are sorted. A group that holds
    most rows is spread over its buckets.
    """
    v = df.select(by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    edges = v.groupBy(by).agg(F.percentile_approx("_v", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 4096).alias("_e"), F.count(F.lit(1)).alias("_n"))
    e, n = (edges.select(F.col(by).alias("_g"), c) for c in ("_e", "_n"))
    filed = v.join(e, v[by].eqNullSafe(e["_g"])).select(by, "_v", F.size(F.filter(F.array_distinct("_e"), lambda x: x < F.col("_v"))).alias("_b"))
    w = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = filed.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_s", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.bround(F.lit(p) * (F.col("_n") - 1).cast("double"), 0).cast("bigint").alias("at")) for name, p in shares.items()]))
    asked = sizes.join(n, sizes[by].eqNullSafe(n["_g"])).select(by, "_b", "_s", "_c", wanted.alias("q")).where("q.at >= _s AND q.at < _s + _c")
    hit = asked.select(F.col(by).alias("_g"), F.col("_b").alias("_gb"), F.col("q.name").alias("name"), (F.col("q.at") - F.col("_s") + 1).alias("_r"))
    rows = filed.join(hit, filed[by].eqNullSafe(hit["_g"]) & (filed["_b"] == hit["_gb"])).select(by, "name", "_r", "_v")
    found = rows.withColumn("_k", F.row_number().over(Window.partitionBy(by, "name").orderBy("_v"))).where("_k = _r")
    return found.groupBy(by).agg(*[F.max(F.when(F.col("name") == s, F.col("_v"))).alias(s) for s in shares])


def weight_grid(rankings: DataFrame, relevant: DataFrame, by: str, grid: dict[str, list[float]], k: int = 10, rrf_k: int = 60) -> DataFrame:
    """Mean reciprocal rank and recall@k of the fusion for every combination of weights, best first in ``place``.

    ``rankings``: by, ranking, id, rank. The grid is a small list of settings; rows
    are repeated once per setting, and every result list is already a top-k.
    """
    names = list(grid)
    settings: list[dict[str, float]] = [{}]
    for n in names:
        settings = [s | {n: w} for s in settings for w in grid[n]]
    options = F.array(*[F.struct(*[F.lit(float(s[n])).alias(n) for n in names]) for s in settings])
    rows = rankings.where(F.col("ranking").isin(names)).withColumn("w", F.explode(options))
    weight = F.coalesce(*[F.when(F.col("ranking") == n, F.col(f"w.{n}")) for n in names])
    fused = rows.groupBy("w", by, "id").agg(F.round(F.sum(weight / (rrf_k + F.col("rank"))), 12).alias("score"))
    fused = fused.withColumn("rank", F.row_number().over(Window.partitionBy("w", by).orderBy(F.desc("score"), "id")))
    rel = relevant.select(by, "id").distinct()
    n = rel.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    per = fused.join(rel, [by, "id"]).groupBy("w", by).agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= k).alias("h"))
    queries = n.count()
    out = per.join(n, by).groupBy("w").agg(F.round(F.sum(1 / F.col("first")) / queries, 6).alias("mrr"), F.round(F.sum(F.col("h") / F.col("n")) / queries, 6).alias("recall"))
    return out.select("w.*", "mrr", "recall").withColumn("place", F.row_number().over(Window.orderBy(F.desc("mrr"), F.desc("recall"), *names)))


def answer_rates(answers: DataFrame) -> DataFrame:
    """Rates over answers (in_corpus, refused, cited, claims, invented, seconds, error); errors are left out."""
    a = answers.where("error IS NULL")
    ratio = lambda x, n: F.round(F.try_divide(x.cast("double"), n), 6)
    inside, outside = F.col("in_corpus"), ~F.col("in_corpus")
    answered = ~F.col("refused")
    return a.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(inside & answered & (F.col("claims") > 0), F.col("cited") / F.col("claims"))), 6).alias("citation_rate"),
        ratio(F.count_if(outside & F.col("refused")), F.count_if(outside)).alias("refusal_rate"),
        ratio(F.count_if(inside & F.col("refused")), F.count_if(inside)).alias("false_refusal_rate"),
        ratio(F.count_if(answered & (F.col("invented") > 0)), F.count_if(answered)).alias("hallucinated_rate"),
    )


def trajectory(hops: DataFrame) -> DataFrame:
    """Per run (run, hop, returned, new, used_id, borrowed_term, min_hops, ended): the four scores and their mean."""
    per = hops.groupBy("run").agg(
        F.coalesce(F.try_divide(F.sum("new").cast("double"), F.sum("returned")), F.lit(0.0)).alias("gain"),
        F.avg(F.when(F.col("hop") > 1, F.when(F.col("used_id"), 1.0).when(F.col("borrowed_term"), 0.5).otherwise(0.0))).alias("dependency"),
        F.least(F.lit(1.0), F.max("min_hops") / F.max("hop")).alias("efficiency"),
        F.max(F.when(F.col("ended") == "answered", 1.0).otherwise(0.0)).alias("termination"),
    )
    parts = [F.coalesce(c, F.lit(1.0)) for c in ("gain", "dependency", "efficiency", "termination")]
    return per.withColumn("overall", F.round(sum(parts[1:], parts[0]) / 4, 6))


def hops_of(found: DataFrame, run: str, order: list[str], item: str, group: str, parts: str) -> DataFrame:
    """One row per step of a run, in order: run, hop (from 1), returned, new, used_id, borrowed_term.

    ``parts`` are the ids a step returned (an array); new are those no step before it
    returned. A step used an id if its ``item`` was met before, else it borrowed a term
    if its ``group`` was. First meetings are aggregates, so nothing is held per run but its numbering.
    """
    n = found.withColumn("hop", F.row_number().over(Window.partitionBy(run).orderBy(*order)))
    ids = n.select(run, "hop", F.explode(parts).alias("_p")).distinct()
    firsts = ids.groupBy(run, "_p").agg(F.min("hop").alias("hop")).groupBy(run, "hop").agg(F.count(F.lit(1)).alias("new"))
    met = lambda c, name: n.groupBy(run, c).agg(F.min("hop").alias(name))
    out = n.join(firsts, [run, "hop"], "left").join(met(item, "_i"), [run, item], "left").join(met(group, "_g"), [run, group], "left")
    later = lambda c: F.coalesce(F.col(c) < F.col("hop"), F.lit(False))
    returned = F.size(F.array_distinct(F.coalesce(F.col(parts), F.array().cast("array<bigint>"))))
    return out.select(run, "hop", returned.alias("returned"), F.coalesce("new", F.lit(0)).alias("new"), later("_i").alias("used_id"), later("_g").alias("borrowed_term"))


def answer_verdict(rate: Column, bad: Column) -> Column:
    """An answer is ungrounded below a half of supported claims, partial below .8 or with a citation that does not exist."""
    return F.when(rate < 0.5, "ungrounded").when((rate < 0.8) | bad, "partial").otherwise("grounded")


def worst(metrics: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` worst queries by (mrr, ndcg, key), numbered in ``place``."""
    low = metrics.orderBy("mrr", "ndcg", key).limit(n)
    return low.withColumn("place", F.row_number().over(Window.orderBy("mrr", "ndcg", key)))


#: What two runs of the same harness may differ by; a gain below it is none.
RESOLUTION = 0.0122


def tuned(grid: DataFrame, base: dict[str, float], metric: str = "mrr", floor: float = RESOLUTION) -> DataFrame:
    """The settings of a :func:`weight_grid` with ``gain`` over the setting ``base`` and whether it is ``resolved``."""
    at = None
    for name, w in base.items():
        same = F.col(name) == F.lit(float(w))
        at = same if at is None else at & same
    now = grid.where(at).agg(F.max(metric).alias("m")).scalar()
    return grid.withColumn("gain", F.round(F.col(metric) - now, 6)).withColumn("resolved", F.col("gain") > floor)


def claim_support(similar: DataFrame, claim: str, step: str, score: str) -> DataFrame:
    """Per claim: direct at .62 or more, inferred if two or more steps reach .58, else none."""
    per = similar.groupBy(claim).agg(F.max(score).alias("best"), F.countDistinct(F.when(F.col(score) >= 0.58, F.col(step))).alias("steps"))
    return per.withColumn("support", F.when(F.col("best") >= 0.62, "direct").when(F.col("steps") >= 2, "inferred").otherwise("none"))
