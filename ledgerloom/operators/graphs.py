"""Reachability over edge tables, level by level; levels are written tables, so lost executors cost one level."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.written import fresh_folder, written


class _Levels:
    """A table that grows by a level at a time; a level is written once and never again."""

    def __init__(self, first: DataFrame) -> None:
        self.spark, self.schema, self.paths = first.sparkSession, first.schema, []
        self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        self.paths.append(fresh_folder(self.spark, "level"))
        rows.select(*self.schema.names).write.parquet(self.paths[-1])
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def _checked(level: int, most: int | None, what: str) -> int:
    if most is not None and level >= most:
        raise ValueError(f"LIMIT_EXCEEDED: more than {most} {what}")
    return level + 1


def reach(edges: DataFrame, origins: DataFrame, most_levels: int | None = None) -> DataFrame:
    """(node, level): what can be reached from ``origins`` (node), each with its least number of edges.

    ``edges`` has (src, dst). Cycles end the search since known nodes are not
    followed again; a search that is still open after ``most_levels`` fails.
    Repeated edges and null ends add nothing.
    """
    edges = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    known, level = _Levels(origins.select("node").distinct().withColumn("level", F.lit(0))), 0
    front = known.last()
    while not front.isEmpty():
        level = _checked(level, most_levels, "levels")
        found = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = known.add(found.join(known.table(), "node", "left_anti").withColumn("level", F.lit(level)))
    return known.table()


def trust_paths(delegations: DataFrame, subjects: DataFrame, roots: DataFrame, most_levels: int | None = None) -> DataFrame:
    """(node, depth, root, status) for each of ``subjects`` (node): the nearest of ``roots`` (node) over ``delegations`` (child, parent, valid).

    TRUSTED has a path of valid delegations; OUT_OF_SCOPE has one only if invalid
    ones count; else NO_ROOT. Of equally near roots the smallest is given. One
    walk from the roots carries whether all delegations so far were valid, so a
    node is met twice at most. A search that is still open after ``most_levels``
    fails.
    """
    down = written(delegations.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.coalesce("valid", F.lit(False)).alias("valid")).distinct(), "delegations")
    known, level = _Levels(roots.select("node").distinct().select("node", F.lit(True).alias("good"), F.col("node").alias("root"), F.lit(0).alias("depth"))), 0
    front = known.last()
    while not front.isEmpty():
        level = _checked(level, most_levels, "levels")
        found = front.join(down, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), (F.col("good") & F.col("valid")).alias("good")).agg(F.min("root").alias("root"), F.lit(level).alias("depth"))
        seen = known.table().groupBy("node").agg(F.bool_or("good").alias("seen_good")).withColumnRenamed("node", "seen")
        open_still = F.col("seen").isNull() | (F.col("good") & ~F.col("seen_good"))
        front = known.add(found.join(seen, F.col("node") == F.col("seen"), "left").where(open_still))
    states = known.table().groupBy("node").agg(F.min_by("root", F.when(F.col("good"), F.struct("depth", "root"))).alias("root"), F.min(F.when(F.col("good"), F.col("depth"))).alias("depth"), F.lit(True).alias("reached"))
    found = subjects.select("node").join(states, "node", "left")
    status = F.when(F.col("depth").isNotNull(), "TRUSTED").when(F.col("reached"), "OUT_OF_SCOPE").otherwise("NO_ROOT")
    return found.select("node", "depth", F.when(F.col("depth").isNotNull(), F.col("root")).alias("root"), status.alias("status"))
