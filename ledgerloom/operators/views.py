"""Semantic views of inventories: what is stored, and what exists only by being tied to something stored."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.compare import ladder
from ledgerloom.operators.components import components
from ledgerloom.operators.written import written


def tie_classes(ties: DataFrame) -> DataFrame:
    """(identity, entity) of all identities in ``ties`` (logical, physical): what is tied, directly or not, is one entity, named by its least identity."""
    pairs = ties.select("logical", "physical").where("logical is not null and physical is not null")
    both = pairs.select(F.col("logical").alias("src"), F.col("physical").alias("dst")).union(pairs.select("physical", "logical"))
    found = written(components(both), "ties")
    least = found.groupBy("component").agg(F.min("node").alias("entity"))
    return found.join(least, "component").select(F.col("node").alias("identity"), "entity")


def semantic_view(tensors: DataFrame, ties: DataFrame) -> DataFrame:
    """(identity, name, kind, entity, backed_by, shape, type, state): each stored row of ``tensors`` (name, identity, shape, type), and each identity that ties add.

    A tied identity that nothing stores is a LOGICAL row with the shape and type of
    the least stored identity of its entity; UNBACKED if there is none. An identity
    that is stored twice is DUPLICATE_IDENTITY, also where it backs others. A row
    without an identity is UNCLASSIFIED and an entity of its own.
    """
    classes = written(tie_classes(ties), "tie-classes")
    counts = tensors.where("identity is not null").groupBy(F.col("identity").alias("c_identity")).agg(F.count("*").alias("n"))
    stored = tensors.join(counts, F.col("identity") == F.col("c_identity"), "left").join(classes.select(F.col("identity").alias("t_identity"), "entity"), F.col("identity") == F.col("t_identity"), "left")
    physical = written(stored.select("identity", "name", F.lit("PHYSICAL").alias("kind"), F.coalesce("entity", "identity").alias("entity"), F.col("identity").alias("backed_by"), "shape", "type", "n"), "stored")
    backing = physical.where("identity is not null").groupBy(F.col("entity").alias("b_entity")).agg(F.min_by(F.struct("identity", "shape", "type", "n"), F.struct("identity", "name")).alias("b"))
    added = classes.join(counts, F.col("identity") == F.col("c_identity"), "left_anti").join(backing, F.col("entity") == F.col("b_entity"), "left")
    logical = added.select("identity", F.col("identity").cast("string").alias("name"), F.lit("LOGICAL").alias("kind"), "entity", F.col("b.identity").alias("backed_by"), F.col("b.shape").alias("shape"), F.col("b.type").alias("type"), F.col("b.n").alias("n"))
    rungs = [("UNCLASSIFIED", F.col("identity").isNull()), ("UNBACKED", F.col("backed_by").isNull()), ("DUPLICATE_IDENTITY", F.col("n") > 1)]
    return physical.unionByName(logical).select("identity", "name", "kind", "entity", "backed_by", "shape", "type", ladder(rungs, "OK").alias("state"))


def entity_coverage(view: DataFrame, targets: DataFrame, realized: DataFrame) -> DataFrame:
    """(entity, n_stored, n_logical, n_targets, n_virtual, state) of every entity of a source ``view``: which of its identities ``targets`` (identity) has stored, and which only ``realized`` (identity) adds.

    COVERED by a stored target, VIRTUAL by an added one alone, AMBIGUOUS by
    several stored ones for fewer stored sources, UNCOVERED by none.
    """
    own = view.where("identity is not null").select("entity", "identity", "kind").distinct()
    there = targets.select(F.col("identity").alias("t")).where("t is not null").distinct()
    more = realized.select(F.col("identity").alias("r")).where("r is not null").distinct().join(there, F.col("r") == F.col("t"), "left_anti")
    both = own.join(there, F.col("identity") == F.col("t"), "left").join(more, F.col("identity") == F.col("r"), "left")
    sums = both.groupBy("entity").agg(F.count_if(F.col("kind") == "PHYSICAL").alias("n_stored"), F.count_if(F.col("kind") == "LOGICAL").alias("n_logical"), F.count("t").alias("n_targets"), F.count("r").alias("n_virtual"))
    rungs = [("AMBIGUOUS", F.col("n_targets") > F.greatest("n_stored", F.lit(1))), ("COVERED", F.col("n_targets") > 0), ("VIRTUAL", F.col("n_virtual") > 0)]
    return sums.withColumn("state", ladder(rungs, "UNCOVERED"))
