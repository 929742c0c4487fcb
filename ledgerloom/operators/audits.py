"""What a later state keeps of a baseline, what names alone suggest, and whether a header is the one that an inventory was made of."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.compare import ladder, matched, worked_out
from ledgerloom.operators.paths import path_findings


def preserved(baseline: DataFrame, declared: DataFrame, current: DataFrame, roots: Column, reasons: Sequence[tuple[str, str]]) -> DataFrame:
    """(path, origin, state, reason) of every path of a baseline, of indexes that declare members of it, and of what is there now; each table has (path, size, digest).

    Audited are the baseline's paths where ``roots``, a condition on ``path``, holds,
    and all declared ones; a declared path that the baseline has is held to the
    baseline. They are UNCHANGED, CHANGED or MISSING, or CONFLICT where declarations
    of one path that the baseline lacks differ. Other paths of the baseline are
    EXCLUDED, with the first of ``reasons`` (name, expression) whose expression is
    found, or OTHER; paths that are new are ADDED. Repeated rows count once; several
    rows of one path in the baseline are a conflict as well. A null path is left to
    no comparison: it is CONFLICT.
    """
    sides = {"baseline": baseline, "declared": declared, "current": current}
    rows = None
    for side, table in sides.items():
        own = table.select("path", F.lit(side).alias("side"), F.struct("size", "digest").alias("x"))
        rows = own if rows is None else rows.union(own)
    of = lambda f, side: f(F.when(F.col("side") == side, F.col("x")))
    named = {f"{f.__name__}_{side}": of(f, side) for side in sides for f in (F.min, F.max)}
    known = rows.groupBy("path").agg(*(c.alias(n) for n, c in named.items()))
    has = {side: F.col(f"min_{side}").isNotNull() for side in sides}
    torn = {side: F.col(f"min_{side}") != F.col(f"max_{side}") for side in sides}
    origin = F.when(has["baseline"] & (roots | has["declared"]), "BASELINE").when(has["baseline"], "EXCLUDED").when(has["declared"], "DECLARED").otherwise("ADDED")
    placed = worked_out(known, origin=origin, expected=F.coalesce("min_baseline", "min_declared"))
    conflict = F.col("path").isNull() | torn["baseline"] | torn["current"] | (~has["baseline"] & torn["declared"])
    same = F.col("min_current").eqNullSafe(F.col("expected"))
    rungs = [("EXCLUDED", F.col("origin") == "EXCLUDED"), ("CONFLICT", F.coalesce(conflict, F.lit(False))), ("ADDED", F.col("origin") == "ADDED"), ("MISSING", ~has["current"]), ("UNCHANGED", same)]
    reason = F.when(F.col("origin") == "EXCLUDED", matched(F.col("path"), reasons, "OTHER"))
    return placed.select("path", "origin", ladder(rungs, "CHANGED").alias("state"), reason.alias("reason"))


def hints(members: DataFrame, scope: str, path: str, shard_like: str) -> DataFrame:
    """(scope, path, source, status, n_hints, n_faults) of the distinct members of each scope whose names look like shards: hints, that no index backs.

    A hint is HEURISTIC_ONLY, and never more. Where a path of a scope is no portable
    path, or meets another one, the scope's hints are REJECTED; repeats are no fault.
    """
    looks = members.where(F.col(path).rlike(shard_like)).select(F.col(scope), F.col(path)).distinct()
    found = path_findings(looks, scope, path)
    whole = found.groupBy(scope).agg(F.count("*").alias("n_hints"), F.count_if(F.col("finding") != "OK").alias("n_faults")).select(F.col(scope).alias("w_scope"), "n_hints", "n_faults")
    status = F.when(F.col("n_faults") > 0, "REJECTED").otherwise("HEURISTIC_ONLY")
    return found.join(whole, F.col(scope).eqNullSafe(F.col("w_scope"))).select(scope, path, F.lit("FILENAME_HEURISTIC").alias("source"), status.alias("status"), "n_hints", "n_faults")


def linked(headers: DataFrame, splits: DataFrame, shards: DataFrame, split: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """(split, path, status, mismatches) of each header: whether it is the header of the shard with the most metadata that a split inventory names.

    ``headers`` have ``split``, path, intact and ``fields``; ``splits`` a row a split
    with intact and the fields of the split as a whole; ``shards`` its shards with
    path, n_metadata and the fields of a shard. ``fields`` are pairs of a column and
    the table it is held against, ``splits`` or ``shards``. The first of
    SPLIT_UNKNOWN, SPLIT_BROKEN, HEADER_BROKEN, NOT_IN_SPLIT, NOT_PRIMARY, MISMATCH
    and LINKED holds; ``mismatches`` are given where the shard is the primary one.
    The primary shard is that with the most metadata, of equal ones the first path.
    """
    by = Window.partitionBy("s_split").orderBy(F.desc_nulls_last("n_metadata"), "s_path")
    of = {side: [c for c, s in fields if s == side] for side in ("splits", "shards")}
    ranked = shards.select(F.col(split).alias("s_split"), F.col("path").alias("s_path"), "n_metadata", *(F.col(c).alias(f"e_{c}") for c in of["shards"])).withColumn("primary", F.row_number().over(by) == 1).drop("n_metadata")
    whole = splits.select(F.col(split).alias("w_split"), F.col("intact").alias("w_intact"), *(F.col(c).alias(f"e_{c}") for c in of["splits"]))
    both = headers.join(whole, F.col(split) == F.col("w_split"), "left").join(ranked, (F.col(split) == F.col("s_split")) & (F.col("path") == F.col("s_path")), "left")
    differs = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"e_{c}")), c) for c, _ in fields)))
    judged = worked_out(both, differs=differs)
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rungs = [("SPLIT_UNKNOWN", F.col("w_split").isNull()), ("SPLIT_BROKEN", no("w_intact")), ("HEADER_BROKEN", no("intact")), ("NOT_IN_SPLIT", F.col("s_path").isNull()), ("NOT_PRIMARY", no("primary")), ("MISMATCH", F.size("differs") > 0)]
    shown = F.when(F.col("primary"), F.col("differs")).otherwise(F.array().cast("array<string>"))
    return judged.select(split, "path", ladder(rungs, "LINKED").alias("status"), shown.alias("mismatches"))
