"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

Blocks of ``block_words`` words are seats. Highest quotients ``target / (2i + 1)``
give each source its seats, and again each shard of a source its own by
``size / (2i + 1)``. A shard's documents, in seeded order, are a tape that is
cut into blocks and read from its start, again and again, for as many blocks as
the shard has seats.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import pin_scans, row_number, stored
from ledgerloom.operators.written import ranked

WORD = r"[^\x20\x09-\x0D]+"


def _with(rows: DataFrame, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the other columns of ``sums``, which has one row for each of ``keys``, nulls included."""
    right = sums.select(F.struct(*keys).alias("keys"), *(c for c in sums.columns if c not in keys))
    return rows.join(right, F.struct(*keys).eqNullSafe(F.col("keys"))).drop("keys")


def apportion(parties: DataFrame, within: Sequence[str], key: str, weight: str, seats: str) -> DataFrame:
    """``parties`` with ``won``: the seats of each by Sainte-Lague's method.

    Where ``seats`` are given out among the rows that agree on ``within``. Seats
    that no rounding can touch are given at once; quotients are listed only for
    the few about the rounded quota, so the rows made are a small multiple of
    the parties. Quotients are ranked in ranges, so that no task gets all
    parties of a group.
    """
    total = parties.groupBy(*within).agg(F.sum(weight).alias("all_weight"))
    share = F.coalesce(F.col(weight) / F.nullif(F.col("all_weight"), F.lit(0.0)), F.lit(0.0))
    quota = _with(parties, total, within).withColumn("share", share).withColumn("rounded", F.floor(F.col("share") * F.col(seats) + 0.5))
    off = F.abs(F.col(seats) - F.col("all_rounded"))
    near = _with(quota, quota.groupBy(*within).agg(F.sum("rounded").alias("all_rounded")), within).withColumn("near", (F.ceil(off * F.col("share")) + 2).cast("long"))
    sure = stored(near.withColumn("sure", F.greatest(F.lit(0), F.col("rounded") - F.col("near"))).select(*within, key, weight, seats, "rounded", "near", "sure"), "quotas")
    open_seats = F.max(seats) - F.sum("sure")
    asked = _with(sure, sure.groupBy(*within).agg(open_seats.alias("open")), within).withColumn("seat", F.explode(F.sequence("sure", F.col("rounded") + F.col("near"))))
    asked = asked.withColumn("quotient", F.col(weight) / (2 * F.col("seat") + 1)).select(*within, key, "sure", "open", "seat", "quotient")
    placed = ranked(asked, within, [F.desc("quotient"), F.col(key).asc_nulls_last(), F.col("seat")], "rank")
    got = (F.col("rank") <= F.col("open")) & (F.col("quotient") > 0)
    won = placed.groupBy(*within, key).agg((F.first("sure") + F.count_if(got)).alias("won"))
    return _with(parties, won, [*within, key])


def capped(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Sources with ``target``: all words by weight, none above ``most`` times its size, the excess shared again by weight.

    Weights repeat in the order of source (code points, null last). The level
    at which no open source is above its cap is found by one pass in the order
    of cap over weight, which is where repeated sharing ends.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    ranked = sources.withColumn("weight", weight).withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    still = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy())
    level = ranked.withColumn("level", (everything - before) / still)
    common = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy())
    return level.withColumn("common", common).select("source", "source_size", "rows", F.round(F.least("cap", F.col("common") * F.col("weight")), 6).alias("target"))


def seeded(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), most: int = 3, block_words: int = 8, rows_per_shard: int = 1024, seed: int = 0) -> DataFrame:
    """A row per row of ``docs``: doc_id, size, source_size, target, taken and row (``row_number``).

    ``size`` counts words; ``taken`` the words that the mix takes of this
    document, repeats counted: at most ``most`` times its size. A null text has
    no words, a null source is a source of its own, a null doc_id is ordered as
    a word of its own. Rows that are wholly alike may take each other's share.
    The same seed and rows give the same mix, however they are partitioned. An
    empty table gives no rows; other columns are not read.
    """
    pin_scans(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), row_number().alias("row")), "sizes")
    sources = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "source-sizes")
    blocks = F.round(F.sum("source_size").over(Window.partitionBy()) / block_words).cast("long")
    targets = capped(sources, weights, most).withColumn("blocks", blocks).withColumn("all", F.lit(0))
    targets = apportion(targets, ["all"], "source", "target", "blocks").select("source", "source_size", "target", F.col("won").alias("source_seats"), F.ceil(F.col("rows") / rows_per_shard).alias("n_shards"))
    targets = stored(targets, "source-targets")

    key = seeded(F.col("doc_id"), seed)
    shard = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("n_shards")
    owner = targets.withColumnRenamed("source", "of")
    spread = stored(sized.join(owner, F.col("source").eqNullSafe(F.col("of"))).withColumn("key", key).withColumn("shard", shard).drop("of", "n_shards"), "shards")
    shards = spread.groupBy("source", "shard").agg(F.sum("size").cast("double").alias("shard_size"), F.first("source_seats").alias("source_seats"))
    quotas = apportion(shards, ["source"], "shard", "shard_size", "source_seats").select(F.col("source").alias("of"), F.col("shard").alias("no"), F.col("shard_size").cast("long").alias("shard_size"), "won")
    tape = Window.partitionBy("source", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(tape), F.lit(0))
    joined = spread.withColumn("start", start).join(quotas, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("no")))
    words = F.least(F.col("won") * block_words, most * F.col("shard_size"))
    full, rest = F.floor(words / F.col("shard_size")), F.pmod(words, F.col("shard_size"))
    taken = F.when(F.col("shard_size") == 0, 0).otherwise(full * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))))
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "row")


def mixed_documents(docs: DataFrame, mixture: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each as often as its words are taken, a last partial copy cut after the words taken.

    Documents of which nothing is taken, such as those without words, are left
    out; all columns are kept, and ``n_chars`` follows the text where there is
    one. ``mixture`` is of these rows; an empty table gives no rows.
    """
    shares = mixture.where(F.col("taken") > 0).select(F.col("row").alias("mixed_row"), "size", "taken")
    numbered = docs.select(row_number().alias("own_row"), F.struct("*").alias("doc"))  # as one column, the table's names clash with none
    own = numbered.join(shares, F.col("own_row") == F.col("mixed_row")).select("doc", "size", "taken")
    copies = own.select("doc", "size", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size"))), lambda k: F.least(F.col("size"), F.col("taken") - k * F.col("size")))).alias("words"))
    text = F.col("doc")["text"].cast("string")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("words").cast("int")), "")
    whole = F.col("words") == F.col("size")
    out = {c: F.col("doc")[c] for c in docs.columns} | {"text": F.when(whole, text).otherwise(cut)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(whole, F.col("doc")["n_chars"]).otherwise(F.char_length(cut)).cast(docs.schema["n_chars"].dataType)
    return copies.select(*(out[c].alias(c) for c in docs.columns))
