"""Sets of numbered files put together: spans in checked 64-bit arithmetic, duplicates, and metadata that shards have to share."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.compare import ladder, worked_out

_MOST = str(2**64 - 1)


def unsigned(value: Column) -> Column:
    """An unsigned 64-bit number as an exact decimal; null where it is none."""
    exact = value.cast("decimal(38,0)")
    return F.when((exact >= 0) & (exact <= F.lit(_MOST).cast("decimal(38,0)")), exact)


def checked_product(factors: Column) -> Column:
    """The product of an array's numbers, null as soon as it passes 64 bits; 1 for an empty array."""
    one = F.lit(1).cast("decimal(38,0)")
    times = lambda acc, x: unsigned(F.try_multiply(acc.cast("decimal(20,0)"), x.cast("decimal(20,0)")).cast("decimal(38,0)"))
    return F.aggregate(F.transform(factors, lambda x: x.cast("decimal(38,0)")), one, lambda acc, x: times(acc, x))


def spans(tensors: DataFrame, types: Mapping[str, tuple[int, int]]) -> DataFrame:
    """``tensors`` (dims, type, offset, payload_start, file_size) with (span, first, last): the bytes that each takes, and whether they are bounded, invalid, unsupported or overflow.

    ``types`` are elements and bytes a block of each known type. Rows are whole
    blocks of the first dimension.
    """
    known = lambda k: F.create_map(*(F.lit(x) for name, pair in types.items() for x in (name, pair[k])))[F.col("type")]
    first = unsigned(F.col("payload_start").cast("decimal(20,0)") + F.col("offset").cast("decimal(20,0)"))
    row_bytes = F.expr("element_at(dims, 1) div block_elements") * F.col("block_bytes")
    length = checked_product(F.concat(F.array(row_bytes.cast("bigint")), F.slice("dims", 2, F.greatest(F.size("dims") - 1, F.lit(0)))))
    base = worked_out(tensors, block_elements=known(0).cast("bigint"), block_bytes=known(1).cast("bigint"), first=first)
    usable = (F.size("dims") > 0) & F.forall("dims", lambda d: d > 0)
    sized = worked_out(base, n_bytes=F.when(usable & F.col("block_elements").isNotNull(), length))
    ended = worked_out(sized, last=unsigned(F.col("first") + F.col("n_bytes")))
    rungs = [
        ("invalid", ~usable), ("overflow", F.col("first").isNull()), ("invalid", F.col("first") > F.col("file_size")), ("unsupported", F.col("block_elements").isNull()),
        ("invalid", F.element_at("dims", 1) % F.col("block_elements") != 0), ("overflow", F.col("n_bytes").isNull() | F.col("last").isNull()), ("invalid", F.col("n_bytes") == 0), ("bounded", F.col("last") <= F.col("file_size")),
    ]
    return worked_out(ended, span=ladder(rungs, "invalid")).drop("block_elements", "block_bytes", "n_bytes")


def shard_results(shards: DataFrame, tensors: DataFrame, shard: str) -> DataFrame:
    """(shard, n_tensors, n_overlaps, result) of all shards: spans that start before the one before them ends, of neighbours among the bounded ones, and the worst span."""
    bounded = F.col("span") == "bounded"
    order = Window.partitionBy(shard, bounded).orderBy("first", "last", "name")
    has = lambda *names: F.bool_or(F.col("span").isin(*names))
    sums = tensors.withColumn("overlap", bounded & F.coalesce(F.col("first") < F.lag("last").over(order), F.lit(False))).groupBy(shard)
    sums = sums.agg(F.count("*").alias("n_tensors"), F.count_if("overlap").alias("n_overlaps"), has("invalid", "overflow").alias("bad"), has("unsupported").alias("unknown"))
    both = shards.select(shard).join(sums, shard, "left")
    rungs = [("no_tensors", F.col("n_tensors").isNull()), ("invalid", F.col("bad")), ("unsupported", F.col("unknown"))]
    return both.select(shard, F.coalesce("n_tensors", F.lit(0)).alias("n_tensors"), F.coalesce("n_overlaps", F.lit(0)).alias("n_overlaps"), ladder(rungs, "bounded").alias("result"))


def duplicate_names(tensors: DataFrame, scope: str, *identity: str) -> DataFrame:
    """(scope, name, n, kind) of names that occur more than once in a scope: exact where their identities agree, else a conflict."""
    counts = tensors.groupBy(scope, "name").agg(F.count("*").alias("n"), F.countDistinct(F.struct(*identity)).alias("kinds")).where("n > 1")
    return counts.select(scope, "name", "n", F.when(F.col("kinds") == 1, "exact").otherwise("conflict").alias("kind"))


def metadata_consistency(metadata: DataFrame, shards: DataFrame, rules: Mapping[str, str], split: str, shard: str) -> DataFrame:
    """(split, key, rule, n_shards, n_values, ok): keys of all shards of a split under REQUIRED_PRESENT_ALL, REQUIRED_EQUAL (equal wherever present) or PRIMARY_ONLY (in the first shard only). Keys without a rule are not given; a required key that no shard has fails."""
    sizes = shards.groupBy(split).agg(F.countDistinct(shard).alias("n_all"), F.min(shard).alias("primary"))
    asked = sizes.select(split, "n_all", "primary", F.explode(F.create_map(*(F.lit(x) for pair in rules.items() for x in pair))).alias("key", "rule"))
    own = metadata.join(sizes.select(split, "primary"), split).groupBy(split, "key").agg(F.countDistinct(shard).alias("n_shards"), F.countDistinct("value").alias("n_values"), F.bool_or(F.col(shard) != F.col("primary")).alias("elsewhere"))
    both = asked.join(own, [split, "key"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_shards", "n_values")})
    ok = F.when(F.col("rule") == "REQUIRED_PRESENT_ALL", F.col("n_shards") == F.col("n_all")).when(F.col("rule") == "REQUIRED_EQUAL", (F.col("n_shards") > 0) & (F.col("n_values") == 1)).otherwise(~F.coalesce("elsewhere", F.lit(False)))
    return both.select(split, "key", "rule", "n_shards", "n_values", ok.alias("ok"))


def split_sets(names: DataFrame, name: str) -> DataFrame:
    """(stem, declared, n_files, n_missing, n_duplicate, n_counts, n_stray, contiguous, complete) of files like ``dir/stem-00001-of-00005.ext``; the largest declared count holds where they differ."""
    pattern = r"^(.*)-([0-9]{5})-of-([0-9]{5})\.[A-Za-z0-9]+$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    rows = names.where(F.col(name).rlike(pattern)).select(part(1).alias("stem"), part(2).cast("long").alias("number"), part(3).cast("long").alias("count"))
    numbers = rows.groupBy("stem", "number").agg(F.count("*").alias("n"))
    declared = rows.groupBy("stem").agg(F.max("count").alias("declared"), F.countDistinct("count").alias("n_counts"), F.count("*").alias("n_files"))
    own = numbers.join(declared, "stem").groupBy("stem", "declared", "n_counts", "n_files").agg(F.count_if(F.col("n") > 1).alias("n_duplicate"), F.count_if(F.col("number").between(1, F.col("declared"))).alias("inside"), F.count("*").alias("distinct"))
    missing, stray = F.col("declared") - F.col("inside"), F.col("distinct") - F.col("inside")
    out = own.withColumn("n_missing", missing).withColumn("n_stray", stray).withColumn("contiguous", (missing == 0) & (stray == 0))
    return out.select("stem", "declared", "n_files", "n_missing", "n_duplicate", "n_counts", "n_stray", "contiguous", (F.col("contiguous") & (F.col("n_duplicate") == 0) & (F.col("n_counts") == 1)).alias("complete"))
