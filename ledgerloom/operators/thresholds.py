"""Requirements whose thresholds are given at several levels, of which the most specific holds."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.compare import ladder

RULES = "kind string, level string, key string, sense string, bound double, allowed array<string>, required boolean"


def effective(entities: DataFrame, entity: str, rules: DataFrame, levels: Sequence[tuple[str, Column | None]]) -> DataFrame:
    """(entity, kind, level, sense, bound, allowed, required): of every kind of requirement the rule that is most specific to an entity.

    ``levels`` are names with the entity's key at that level, the most specific
    first; a level with None as its key is the default, which holds for all. A rule
    is met by its key alone; of rules for the same key the strictest bound holds.
    """
    keys = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(name).alias("level"), (F.lit("") if key is None else key.cast("string")).alias("key")) for k, (name, key) in enumerate(levels)))
    asked = entities.select(entity, F.explode(keys).alias("x")).select(entity, "x.*").where("key is not null")
    own = rules.select("kind", "level", F.coalesce("key", F.lit("")).alias("key"), "sense", "bound", "allowed", "required")
    strict = F.when(F.col("sense") == "min", -F.col("bound")).otherwise(F.col("bound"))
    met = asked.join(own, ["level", "key"])
    best = met.groupBy(entity, "kind").agg(F.min_by(F.struct("level", "sense", "bound", "allowed", "required"), F.struct("rank", strict.alias("strict"))).alias("x"))
    return best.select(entity, "kind", "x.*")


def outcomes(rules: DataFrame, observed: DataFrame, entity: str) -> DataFrame:
    """(entity, kind, level, observed, outcome) of every requirement in force against what was observed (entity, kind, value, text), all retained.

    NOT_APPLICABLE where nothing was observed and the rule doesn't require it;
    NOT_EVALUATED where it does; else SATISFIED or FAILED: at most or at least the
    bound, or one of the allowed texts.
    """
    both = rules.join(observed, [entity, "kind"], "left")
    good = F.when(F.col("sense") == "max", F.col("value") <= F.col("bound")).when(F.col("sense") == "min", F.col("value") >= F.col("bound")).otherwise(F.array_contains("allowed", F.col("text")))
    seen = F.when(F.col("sense") == "in", F.col("text").isNotNull()).otherwise(F.col("value").isNotNull())
    rungs = [("NOT_EVALUATED", ~seen & F.col("required")), ("NOT_APPLICABLE", ~seen), ("SATISFIED", good)]
    return both.select(entity, "kind", "level", F.coalesce(F.col("value").cast("string"), "text").alias("observed"), ladder(rungs, "FAILED").alias("outcome"))


def conformance(found: DataFrame, group: str) -> DataFrame:
    """(group, n_satisfied, n_failed, n_open, n_not_applicable, status)."""
    o = F.col("outcome")
    sums = found.groupBy(group).agg(F.count_if(o == "SATISFIED").alias("n_satisfied"), F.count_if(o == "FAILED").alias("n_failed"), F.count_if(o == "NOT_EVALUATED").alias("n_open"), F.count_if(o == "NOT_APPLICABLE").alias("n_not_applicable"))
    return sums.withColumn("status", ladder([("DOES_NOT_CONFORM", F.col("n_failed") > 0), ("INDETERMINATE", F.col("n_open") > 0)], "CONFORMS"))
