"""Evidence operators; orders stand for decisions, their lines for outcomes and assumptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scores as sc
from tessera.operators import validation as val
from tessera.operators import evidence as e
from tessera.operators.evaluate import nearest_rank
from tessera.plans.temporal import M, memories
from tessera.sources.tables import read_table


def decisions(s, d):
    return read_table(s, d, "orders").select(
        F.col("o_orderkey").alias("decision_id"), ((F.col("o_totalprice") % 1000) / 1000).alias("confidence"), F.col("o_orderdate").alias("decided_at"),
        F.when(F.col("o_orderstatus") == "F", "settled").when(F.col("o_orderstatus") == "O", "reversed").otherwise("open").alias("status"),
    )


def outcomes(s, d):
    word = F.element_at(F.array(*map(F.lit, ("worked", "failed", "mixed", "too_early"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return read_table(s, d, "lineitem").select(F.col("l_orderkey").alias("decision_id"), word.alias("verdict"), F.col("l_shipdate").alias("observed_at"), F.col("l_extendedprice").alias("created_at"))


def held(s, d):
    word = F.when(F.col("l_returnflag") == "A", "held").when(F.col("l_returnflag") == "R", "failed")
    return read_table(s, d, "lineitem").select(F.col("l_suppkey").alias("grp"), word.alias("verdict"))


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _wilson(s, d):
    g = e.group_rates(held(s, d), "grp", "verdict").select("grp", "held", (F.col("held") + F.col("broke")).alias("n"))
    return _round(g.withColumn("i", sc.wilson(F.col("held"), F.col("n"))).select("grp", "i.*"), "rate", "low", "high")


def _calibration(s, d):
    r = decisions(s, d).join(e.latest_verdict(outcomes(s, d)).where("verdict <> 'too_early'"), "decision_id")
    return _round(e.calibration(r.withColumn("ok", F.col("verdict") == "worked"), "confidence", "ok"), "stated", "rate", "low", "high")


def _patterns(s, d):
    return _round(e.group_patterns(held(s, d), "grp", "verdict"), "confidence")


def _needed(s, d):
    g = e.group_rates(held(s, d), "grp", "verdict")
    return g.select("grp", sc.support_needed(F.col("broke"), F.col("held"), 0.5).alias("needed"))


def _gaps(s, d):
    ev = read_table(s, d, "decision_evidence").distinct()
    per = ev.groupBy("decision_id").agg(F.countDistinct("memory_id").alias("items"), F.max("linked_at").alias("last"), F.count_if(F.col("relation") == "contradicts").alias("against"), F.count(F.lit(1)).alias("n"))
    newest = ev.agg(F.max("linked_at").alias("newest"))
    quiet = (F.col("items") >= 2) & (F.unix_micros(F.col("newest")) - F.unix_micros("last") > 30 * 86_400_000_000)
    return per.withColumn("newest", newest.scalar()).where(quiet).select("decision_id", "items", "against")


def _validation(s, d):
    """Evidence as it was handed in, row by row, against the rules for it."""
    e = read_table(s, d, "decision_evidence").distinct()
    rules = val.evidence_rules("memory_id", "source_name", "external_key", "chunk_ordinal", "relation") | {"not dated": F.col("linked_at").isNotNull()}
    return val.split(e, rules)[1].select("evidence_id", F.explode("violations").alias("violation"))


DIMENSIONS = ["code", "document", "note", "other", "email", "meeting", "decision"]

QUERIES = {
    "latest_verdict": lambda s, d: e.latest_verdict(outcomes(s, d)),
    "success_rate": lambda s, d: _round(e.success_rate(decisions(s, d), outcomes(s, d)), "rate"),
    "group_hold_rates": lambda s, d: _round(e.group_rates(held(s, d), "grp", "verdict"), "hold_rate"),
    "wilson_intervals": _wilson,
    "calibration_bands": _calibration,
    "pattern_confidence": _patterns,
    "support_needed": _needed,
    "timing_pattern": lambda s, d: e.timing_pattern(decisions(s, d), outcomes(s, d)),
    "choice_pattern": lambda s, d: e.choice_pattern(decisions(s, d)),
    "orphaned_work": _gaps,
    "record_validation": _validation,
    "assessment": lambda s, d: e.assess(memories(s, d), "kind", DIMENSIONS, 100),
    "facet_changes": lambda s, d: e.facet_changes(memories(s, d), ["memory_id"], "ingested_at", "2025-06-01", "2025-07-01"),
    "facet_stability": lambda s, d: _round(e.facet_stability(memories(s, d), "kind", "ingested_at", "deleted_at", "2027-01-01", DIMENSIONS), "mean_lifetime", "mean_age", "observed_days"),
    "importance_scores": lambda s, d: memories(s, d).groupBy("source_id", "external_key").agg(F.count(F.lit(1)).alias("v"), F.max("occurred_at").alias("t")).select(
        "source_id", "external_key", sc.importance(F.col("v") * 3, F.col("v"), sc.recency(F.col("t"), F.lit("2026-06-01").cast("timestamp"))).alias("importance")),
    "recency_scores": lambda s, d: memories(s, d).select("memory_id", F.round(sc.recency(F.col("occurred_at"), F.lit("2026-06-01").cast("timestamp")), 6).alias("recency")),
    "nearest_rank_percentile": lambda s, d: nearest_rank(read_table(s, d, "events"), "event_type", "value", {"p95": 0.95, "p50": 0.5}),
}

_O = "o AS (SELECT l_orderkey AS decision_id, ['worked', 'failed', 'mixed', 'too_early'][l_linenumber % 4 + 1] AS verdict, l_shipdate AS observed_at, l_extendedprice AS created_at FROM lineitem), v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY observed_at DESC, created_at DESC, verdict DESC) AS n FROM o) WHERE n = 1)"
_D = "d AS (SELECT o_orderkey AS decision_id, (o_totalprice % 1000) / 1000 AS confidence, o_orderdate AS decided_at FROM orders)"
_G = "g AS (SELECT l_suppkey AS grp, count(*) AS members, count(*) FILTER (l_returnflag = 'A') AS held, count(*) FILTER (l_returnflag = 'R') AS broke FROM lineitem GROUP BY 1)"
_Z = "1.959963984540054e0"
_CONF = "CASE WHEN {s} <= 0 THEN 0e0 ELSE least(0.95e0, {s}::DOUBLE / ({s} + {c}) * least(1e0, {s} / 8e0)) END"


def _interval(k, n):
    z, p = _Z, f"({k}::DOUBLE / {n})"
    c, h = f"(({p} + {z}*{z}/(2e0*{n})) / (1 + {z}*{z}/{n}))", f"({z} * sqrt({p}*(1-{p})/{n} + {z}*{z}/(4e0*{n}*{n})) / (1 + {z}*{z}/{n}))"
    return f"CASE WHEN {n} > 0 THEN {p} ELSE 0 END", f"CASE WHEN {n} > 0 THEN greatest(0, {c} - {h}) ELSE 0 END", f"CASE WHEN {n} > 0 THEN least(1, {c} + {h}) ELSE 1 END"


_R, _L, _H = _interval("held", "n")
_CR, _CL, _CH = _interval("worked", "n")
_DIMS = "(SELECT unnest(['code', 'document', 'note', 'other', 'email', 'meeting', 'decision']) AS kind)"
_DAYS = "(epoch_us({b}) - epoch_us({a})) / 86400e6"
_REC = "coalesce(pow(2e0, -((epoch_us(TIMESTAMP '2026-06-01') - epoch_us({t})) / 86400e6) / 180e0), 0.5e0)"

SQL = {
    "latest_verdict": f"WITH {_O} SELECT decision_id, verdict, observed_at FROM v",
    "success_rate": f"""WITH {_O}, {_D}, c AS (SELECT count(*) FILTER (verdict = 'worked') AS worked, count(*) FILTER (verdict = 'failed') AS failed, count(*) FILTER (verdict = 'mixed') AS mixed,
count(*) FILTER (verdict = 'too_early') AS too_early, count(*) FILTER (verdict IS NULL) AS undecided FROM d LEFT JOIN v USING (decision_id)) SELECT *, round(worked::DOUBLE / nullif(worked + failed + mixed, 0), 6) AS rate FROM c""",
    "group_hold_rates": f"WITH {_G} SELECT grp, members, held, broke, round(held::DOUBLE / nullif(held + broke, 0), 6) AS hold_rate, members > 1 AS recurring FROM g",
    "wilson_intervals": f"WITH {_G}, h AS (SELECT grp, held, held + broke AS n FROM g) SELECT grp, round({_R}, 6) AS rate, round({_L}, 6) AS low, round({_H}, 6) AS high FROM h",
    "calibration_bands": f"""WITH {_O}, {_D}, b AS (SELECT CAST(least(floor(confidence * 4), 3) AS INTEGER) AS band, count(*) AS n, count(*) FILTER (verdict = 'worked') AS worked, avg(confidence) AS stated
FROM d JOIN v USING (decision_id) WHERE verdict <> 'too_early' GROUP BY 1), i AS (SELECT *, {_CR} AS rate, {_CL} AS low, {_CH} AS high FROM b)
SELECT band, n, worked, round(stated, 6) AS stated, round(rate, 6) AS rate, round(low, 6) AS low, round(high, 6) AS high, stated < low OR stated > high AS off,
CASE WHEN stated < low THEN worked ELSE n - worked END AS support, CASE WHEN stated < low THEN n - worked ELSE worked END AS against FROM i""",
    "pattern_confidence": f"WITH {_G} SELECT grp, broke AS support, held AS against, round({_CONF.format(s='broke', c='held')}, 6) AS confidence FROM g WHERE broke >= 4 AND broke > held",
    "support_needed": f"WITH {_G} SELECT grp, CAST((SELECT min(x) FROM range(0, 201) t(x) WHERE {_CONF.format(s='(broke + x)', c='held')} >= 0.5) AS INTEGER) AS needed FROM g",
    "timing_pattern": f"WITH {_O}, {_D} SELECT count(*) FILTER (observed_at - decided_at > INTERVAL 90 DAY) AS support, count(*) FILTER (observed_at - decided_at <= INTERVAL 90 DAY) AS against FROM d JOIN v USING (decision_id) WHERE verdict <> 'too_early' AND observed_at > decided_at",
    "choice_pattern": "SELECT count(*) FILTER (o_orderstatus = 'O') AS support, count(*) FILTER (o_orderstatus = 'F') AS against FROM orders",
    "orphaned_work": """WITH e AS (SELECT DISTINCT * FROM decision_evidence), p AS (SELECT decision_id, count(DISTINCT memory_id) AS items, max(linked_at) AS last, count(*) FILTER (relation = 'contradicts') AS against FROM e GROUP BY 1)
SELECT decision_id, items, against FROM p WHERE items >= 2 AND (SELECT max(linked_at) FROM e) - last > INTERVAL 30 DAY""",
    "record_validation": """WITH e AS (SELECT DISTINCT * FROM decision_evidence) SELECT evidence_id, 'names nothing' AS violation FROM e WHERE memory_id IS NULL AND (coalesce(trim(source_name), '') = '' OR coalesce(trim(external_key), '') = '')
UNION ALL SELECT evidence_id, 'key without source' FROM e WHERE external_key IS NOT NULL AND source_name IS NULL UNION ALL SELECT evidence_id, 'ordinal below 0' FROM e WHERE chunk_ordinal < 0
UNION ALL SELECT evidence_id, 'unknown relation' FROM e WHERE relation IS NULL OR relation NOT IN ('informed', 'records', 'contradicts') UNION ALL SELECT evidence_id, 'not dated' FROM e WHERE linked_at IS NULL""",
    "assessment": f"SELECT kind, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'nothing observed' WHEN n < 100 THEN 'below support' END AS reason FROM {_DIMS} LEFT JOIN (SELECT kind, count(*) AS n FROM {M} m GROUP BY 1) USING (kind)",
    "facet_changes": f"""SELECT memory_id, CASE WHEN version = 1 THEN 'added' ELSE 'replaced' END AS change, ingested_at AS at FROM {M} m WHERE ingested_at BETWEEN '2025-06-01' AND '2025-07-01'
UNION ALL SELECT memory_id, 'removed', deleted_at FROM {M} m WHERE deleted_at BETWEEN '2025-06-01' AND '2025-07-01'""",
    "facet_stability": f"""SELECT kind, coalesce(changes, 0) AS changes, round(mean_lifetime, 6) AS mean_lifetime, round(mean_age, 6) AS mean_age, round(observed_days, 6) AS observed_days FROM {_DIMS} LEFT JOIN (
SELECT kind, count(deleted_at) AS changes, avg({_DAYS.format(a='ingested_at', b='deleted_at')}) AS mean_lifetime, avg({_DAYS.format(a='ingested_at', b="TIMESTAMP '2027-01-01'")}) FILTER (deleted_at IS NULL) AS mean_age,
{_DAYS.format(a='min(ingested_at)', b="TIMESTAMP '2027-01-01'")} AS observed_days FROM {M} m GROUP BY 1) USING (kind)""",
    "importance_scores": f"""WITH g AS (SELECT source_id, external_key, count(*) AS v, max(occurred_at) AS t FROM {M} m GROUP BY ALL)
SELECT source_id, external_key, round_even(greatest(0, least(1, 0.3e0 * ln(1 + least(v * 3, 64)::DOUBLE) / ln(65e0) + 0.45e0 * ln(1 + least(greatest(v - 1, 0), 12)::DOUBLE) / ln(13e0) + 0.25e0 * least(1e0, {_REC.format(t='t')}))), 4) AS importance FROM g""",
    "recency_scores": f"SELECT memory_id, round({_REC.format(t='occurred_at')}, 6) AS recency FROM {M} m",
    "nearest_rank_percentile": """WITH g AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1)
SELECT event_type, v[CAST(round_even(0.95e0 * (len(v) - 1), 0) AS INTEGER) + 1] AS p95, v[CAST(round_even(0.5e0 * (len(v) - 1), 0) AS INTEGER) + 1] AS p50 FROM g""",
}
