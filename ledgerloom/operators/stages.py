"""Stages of a validation, each bounded by the stages it depends on, for all subjects in one job."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.compare import ladder
from ledgerloom.operators.written import discarded, written

#: Statuses from the worst to the best: a stage is never better than what it depends on.
ORDER = ("FAIL", "UNAVAILABLE", "NOT_CHECKED", "WARN", "PASS")


def closure(dependencies: DataFrame) -> DataFrame:
    """(stage, needs) with all that a stage depends on, directly or not; paths double every round. A stage that depends on itself fails."""
    paths = written(dependencies.select("stage", "needs").distinct(), "closure")
    n = paths.count()
    while True:
        far = paths.select(F.col("stage").alias("needs"), F.col("needs").alias("far"))
        more = written(paths.union(paths.join(far, "needs").select("stage", "far")).distinct(), "closure")
        discarded(paths)
        paths, before, n = more, n, more.count()
        if n == before:
            break
    if not paths.where("stage = needs").isEmpty():
        raise ValueError("CYCLE: a stage depends on itself")
    return paths


def bounded(own: DataFrame, dependencies: DataFrame, subjects: DataFrame, stages: DataFrame, subject: str) -> DataFrame:
    """(subject, stage, own, status, held_by) of every stage (stage) of every one of ``subjects``.

    ``own`` has (subject, stage, status); a stage without a row is NOT_CHECKED, and
    a status that isn't one of ``ORDER`` is UNAVAILABLE. ``status`` is the worst of
    the stage's own and those of all that it depends on; ``held_by`` names the first
    stage, by name, that keeps it below its own. What a stage depends on and nobody
    lists as a stage has no row, and so holds it at NOT_CHECKED.
    """
    rank = ladder([(str(k), F.col("status") == s) for k, s in enumerate(ORDER)], str(ORDER.index("UNAVAILABLE"))).cast("int")
    named = lambda c: F.element_at(F.array(*map(F.lit, ORDER)), c + 1)
    given = own.select(subject, "stage", rank.alias("rank")).groupBy(subject, "stage").agg(F.min("rank").alias("rank"))
    asked = stages.select("stage", F.col("stage").alias("needs")).union(closure(dependencies).join(stages, "stage", "left_semi").select("stage", "needs"))
    # stages are a short list, which rides along with each subject as one array
    listed = asked.agg(F.collect_list(F.struct("stage", "needs")).alias("x")).scalar()
    wanted = subjects.select(subject).distinct().select(subject, F.inline(listed))
    both = wanted.join(given.withColumnRenamed("stage", "needs"), [subject, "needs"], "left").withColumn("rank", F.coalesce("rank", F.lit(ORDER.index("NOT_CHECKED"))))
    mine = F.max(F.when(F.col("stage") == F.col("needs"), F.col("rank")))
    sums = both.groupBy(subject, "stage").agg(mine.alias("mine"), F.min("rank").alias("least"), F.min(F.struct("rank", "needs"))["needs"].alias("holder"))
    return sums.select(subject, "stage", named(F.col("mine")).alias("own"), named(F.col("least")).alias("status"), F.when(F.col("least") < F.col("mine"), F.col("holder")).alias("held_by"))


def summaries(found: DataFrame, subject: str, final: str) -> DataFrame:
    """(subject, n_pass, n_held, weakest, overall) of each subject's stages: the first stage of the worst status, and the status of the ``final`` stage."""
    rank = ladder([(str(k), F.col("status") == s) for k, s in enumerate(ORDER)], "9").cast("int")
    sums = found.withColumn("rank", rank).groupBy(subject).agg(
        F.count_if(F.col("status") == "PASS").alias("n_pass"), F.count_if(F.col("held_by").isNotNull()).alias("n_held"), F.min(F.struct("rank", "stage"))["stage"].alias("weakest"), F.max(F.when(F.col("stage") == final, F.col("status"))).alias("overall"),
    )
    return sums
