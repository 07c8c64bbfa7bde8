"""Entity resolution: candidates, winners, merges and their reversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Names of one technology that no rule of spelling can bring together.
ALIASES = (("postgres", "postgresql"), ("py", "python"), ("sqlalchemy", "sa"))

# Fixed value: the cosine from which two names are proposed as one.
NAME_FLOOR = 0.86


def exact_candidates(entities: DataFrame, kind: str, key: Column, id_col: str) -> DataFrame:
    """Entities of one type and canonical key, each with the anchor, the smallest id: kind, key, anchor, id."""
    keyed = entities.select(F.col(kind).alias("kind"), key.alias("key"), F.col(id_col).alias("id")).where("key IS NOT NULL AND key <> ''")
    anchors = keyed.groupBy("kind", "key").agg(F.min("id").alias("anchor"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(anchors.drop("n"), ["kind", "key"]).where("id <> anchor").select("kind", "key", "anchor", "id")


def alias_candidates(entities: DataFrame, kind: str, key: Column, id_col: str, pairs=ALIASES) -> DataFrame:
    """E5: entities whose keys are a listed pair, at 0.99: a, b, confidence. The list is a parameter."""
    keyed = entities.select(F.col(kind).alias("kind"), key.alias("key"), F.col(id_col).alias("id"))
    listed = entities.sparkSession.createDataFrame(list(pairs), "key string, other string")
    other = keyed.select("kind", F.col("key").alias("other"), F.col("id").alias("b"))
    return keyed.join(listed, "key").join(other, ["kind", "other"]).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), F.lit(0.99).alias("confidence"))


def winner(members: DataFrame, group: list[str], mentions: str, seen: str, id_col: str) -> DataFrame:
    """Per group the entity of most mentions, then first seen, then smallest id."""
    best = F.min_by(F.col(id_col), F.struct((-F.coalesce(F.col(mentions), F.lit(0))).alias("m"), F.coalesce(F.col(seen), F.lit("9999-12-31").cast("timestamp")).alias("s"), F.col(id_col).alias("i")))
    return members.groupBy(*group).agg(best.alias("winner"))


def merge(mentions: DataFrame, merges: DataFrame, entity: str, place: list[str]) -> tuple[DataFrame, DataFrame]:
    """Mentions with merged entities pointed at their winner, and the ledger of those moved.

    ``merges``: loser, winner. Of mentions that then collide at one place one stays.
    """
    m = mentions.join(merges, mentions[entity] == merges["loser"], "left")
    moved = m.where("winner IS NOT NULL").select(*place, F.col(entity).alias("was"), F.col("winner").alias("now"))
    after = m.withColumn(entity, F.coalesce("winner", entity)).drop("loser", "winner").dropDuplicates([*place, entity])
    return after, moved


def revert(mentions: DataFrame, ledger: DataFrame, entity: str, place: list[str], loser) -> DataFrame:
    """What the ledger says was moved from ``loser`` goes back to it."""
    back = ledger.where(F.col("was") == F.lit(loser)).select(*place, F.col("now").alias(entity), "was")
    return mentions.join(back, [*place, entity], "left").withColumn(entity, F.coalesce("was", entity)).drop("was")


def similar_names(pairs: DataFrame, floor: float = NAME_FLOOR) -> DataFrame:
    """Pairs at or above the floor are proposed for review, never merged by themselves."""
    return pairs.where(F.col("score") >= floor).withColumn("status", F.lit("proposed"))
