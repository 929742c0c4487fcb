"""Artifact folders as tables: file manifests, tensor headers, shard indexes, vocabularies and merge rules.

Files are listed by Spark; contents are read by tasks, and only as much of them as a table needs.
"""

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.splits import checked_product

#: Bytes an element of each type of the tensor file format takes.
ELEMENT_BYTES = {"BOOL": 1, "U8": 1, "I8": 1, "F8_E4M3": 1, "F8_E5M2": 1, "I16": 2, "U16": 2, "F16": 2, "BF16": 2, "I32": 4, "U32": 4, "F32": 4, "F64": 8, "I64": 8, "U64": 8}

TENSORS = "path string, file_length long, header_length long, name string, dtype string, shape array<long>, start long, end long, error string"


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files below ``folder``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length")


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*", chunk: int = 1 << 20, whole: int = 64 << 20) -> DataFrame:
    """(path, size, sha256) of all files.

    Files of up to ``whole`` bytes are read by Spark's own reader, from any store
    that it knows; larger ones by tasks, ``chunk`` bytes at a time, so that a
    file's size doesn't bound it, from local folders and the stores that Arrow
    knows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            digests = []
            for path in batch["path"]:
                digest = hashlib.sha256()
                with _opened(path) as f:
                    while block := f.read(chunk):
                        digest.update(block)
                digests.append(digest.hexdigest())
            yield pd.DataFrame({"path": batch["path"], "size": batch["length"], "sha256": digests})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    small = files.where(F.col("length") <= whole).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path", "length").repartition("path")
    return small.union(large.mapInPandas(run, "path string, size long, sha256 string"))


def _opened(path: str):  # noqa: ANN202
    from urllib.parse import quote, unquote, urlsplit

    from pyarrow import fs

    scheme = urlsplit(path).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_stream(unquote(urlsplit(quote(path, safe=":/%")).path), buffer_size=1 << 16)
    if scheme in ("s3a", "s3n"):  # Hadoop's names of what Arrow knows as s3
        path = "s3" + path[3:]
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner, buffer_size=1 << 16)


def tensor_rows(path: str, length: int, most_bytes: int) -> Iterator[tuple]:
    """Rows of ``TENSORS`` of one file; only its header is read."""
    import json

    with _opened(path) as f:
        head = f.read(8)
        n = int.from_bytes(head, "little")
        if len(head) < 8 or 8 + n > length:
            yield path, length, None, None, None, None, None, None, "TRUNCATED"
            return
        if n > most_bytes:
            yield path, length, n, None, None, None, None, None, "LIMIT_EXCEEDED"
            return
        body = f.read(n)
    try:
        fields = [(name, t["dtype"], [int(d) for d in t["shape"]], *map(int, t["data_offsets"])) for name, t in json.loads(body).items() if name != "__metadata__"]
        rows = [(path, length, n, *t, None) for t in fields if len(t) == 5]
    except (ValueError, KeyError, TypeError, AttributeError):
        rows = [(path, length, n, None, None, None, None, None, "INVALID_HEADER")]
    yield from rows


def tensor_headers(spark: SparkSession, folder: str, pattern: str = "*.safetensors", most_bytes: int = 100_000_000) -> DataFrame:
    """A row per tensor from the files' headers: eight bytes of length, then JSON; payloads are never read.

    A file whose header can't be read gives one row with ``error`` TRUNCATED,
    LIMIT_EXCEEDED or INVALID_HEADER and no tensor.
    """

    names = [c.split()[0] for c in TENSORS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"], strict=True):
                found = pd.DataFrame(list(tensor_rows(path, length, most_bytes)), columns=names)
                yield found.astype({c: "Int64" for c in ("file_length", "header_length", "start", "end")})

    return listing(spark, folder, pattern).repartition("path").mapInPandas(run, TENSORS)


def checked_tensors(tensors: DataFrame) -> DataFrame:
    """``tensors`` with ``status``, the first that holds: the file's error, UNKNOWN_TYPE, INVALID_SHAPE, OVERFLOW, SIZE_MISMATCH, OUT_OF_BOUNDS, OVERLAP, GAP or OK.

    Sizes are exact decimals; one beyond 64 bits overflows. What follows the last
    tensor of a file is told by ``trailing_gaps``.
    """
    order = Window.partitionBy("path").orderBy("start", "end", "name")
    before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    width = F.create_map(*(F.lit(x) for pair in ELEMENT_BYTES.items() for x in pair))[F.col("dtype")]
    size = checked_product(F.concat("shape", F.array(width.cast("bigint"))))
    status = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(width.isNull(), "UNKNOWN_TYPE").when(F.exists("shape", lambda d: d < 0), "INVALID_SHAPE").when(F.col("n_bytes").isNull(), "OVERFLOW").when(F.col("n_bytes") != F.col("end") - F.col("start"), "SIZE_MISMATCH")
        .when((F.col("start") < 0) | (F.col("end") > F.col("file_length") - F.col("header_length") - 8), "OUT_OF_BOUNDS").when(F.col("before") > F.col("start"), "OVERLAP").when(F.col("before") < F.col("start"), "GAP").otherwise("OK")
    )
    sized = tensors.withColumn("before", before).withColumn("n_bytes", F.when(F.exists("shape", lambda d: d < 0), None).otherwise(size))
    return sized.withColumn("status", status).drop("before", "n_bytes")


def trailing_gaps(tensors: DataFrame) -> DataFrame:
    """(path, gap) of files whose payload goes on behind their last tensor."""
    ends = tensors.where("error is null").groupBy("path").agg((F.max(F.col("file_length") - F.col("header_length") - 8) - F.coalesce(F.max("end"), F.lit(0))).alias("gap"))
    return ends.where("gap > 0")


def _json_map(spark: SparkSession, path: str, column: str | None, values: str) -> DataFrame:
    """(key, value) of a map in a JSON file; a malformed file or a repeated key fails."""
    whole = spark.read.text(path, wholetext=True)
    kind = f"map<string, {values}>"
    found = F.from_json("value", f"struct<{column}: {kind}>" if column else kind, {"mode": "FAILFAST"})
    keys = F.map_keys("found")
    checked = F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.raise_error(F.lit("REPEATED_KEY"))).otherwise(F.col("found"))
    return whole.select((found[column] if column else found).alias("found")).select(F.explode(checked))


#: The fields of a raw record: name, dtype and shard are texts that are not empty, shape and header_len are not negative, offsets are two in order.
RECORD = "name string, dtype string, shape array<bigint>, shard string, header_len bigint, offsets array<bigint>"


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, fault) and the fields of ``RECORD`` of JSON files that each hold an array of records; a file that holds anything else is one row with fault NOT_AN_ARRAY.

    A record with other fields than these, a value of another type or out of
    range, or a field twice has a fault and no fields. A file has to fit a task.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")
    parsed = files.select("path", F.from_json("value", "array<string>").alias("texts"), F.col("value").rlike(r"(?s)\A\s*\[.*\]\s*\z").alias("array"))
    good = F.coalesce("array", F.lit(False)) & F.col("texts").isNotNull()
    rows = parsed.select("path", F.posexplode_outer(F.when(good, F.col("texts")).otherwise(F.array(F.lit(None).cast("string")))).alias("place", "text"), good.alias("good"))
    names = [c.split()[0] for c in RECORD.split(", ")]
    v = F.try_parse_json("text")
    kind = {n: F.expr(f"schema_of_variant(variant_get(v, '$.{n}'))") for n in names}
    whole = lambda n: F.coalesce(kind[n].isin("ARRAY<BIGINT>", "ARRAY<VOID>"), F.lit(False))
    fields = F.from_json("text", RECORD)
    exact = F.coalesce(F.array_sort(F.json_object_keys("text")) == F.array(*map(F.lit, sorted(names))), F.lit(False))
    texts = [F.coalesce((kind[n] == "STRING") & (F.col("x")[n] != ""), F.lit(False)) for n in ("name", "dtype", "shard")]
    typed = texts[0] & texts[1] & texts[2] & F.coalesce((kind["header_len"] == "BIGINT") & (F.col("x.header_len") >= 0), F.lit(False)) & whole("shape") & F.forall("x.shape", lambda d: d >= 0) & whole("offsets")
    ordered = (F.size("x.offsets") == 2) & (F.element_at("x.offsets", 1) >= 0) & (F.element_at("x.offsets", 1) <= F.try_element_at("x.offsets", F.lit(2)))
    fault = F.when(~F.col("good"), "NOT_AN_ARRAY").when(F.col("text").isNull() & F.col("place").isNull(), "EMPTY").when(F.col("v").isNull(), "NOT_STRICT_JSON").when(~exact, "FIELDS").when(~F.coalesce(typed, F.lit(False)), "TYPE").when(~F.coalesce(ordered, F.lit(False)), "OFFSETS")
    out = rows.withColumn("v", v).withColumn("x", fields).withColumn("fault", fault).where(F.col("fault").isNull() | (F.col("fault") != "EMPTY"))
    return out.select("path", F.when(F.col("good"), F.col("place")).alias("place"), "fault", *(F.when(F.col("fault").isNull(), F.col("x")[n]).alias(n) for n in names))


def configuration_fields(documents: DataFrame, key: str, text: str, paths: Sequence[str]) -> DataFrame:
    """(key, path, presence, type, value) of dotted paths in JSON objects: ABSENT, NULL or VALUE, with the type and the text of a value; a text that is no strict JSON has all absent."""
    own = documents.select(key, F.col(text).alias("text"), F.try_parse_json(text).alias("v"))
    out = None
    for path in paths:
        at = "".join(f"['{part}']" for part in path.split("."))
        found = own.withColumn("f", F.try_variant_get("v", f"${at}", "variant"))
        parent, _, leaf = path.rpartition(".")
        inner = F.get_json_object("text", "$" + "".join(f"['{part}']" for part in parent.split("."))) if parent else F.col("text")
        there = F.coalesce(F.array_contains(F.json_object_keys(inner), leaf), F.lit(False)) & F.col("v").isNotNull()
        kind = F.expr("schema_of_variant(f)")
        presence = F.when(~there, "ABSENT").when(F.coalesce(kind == "VOID", F.lit(True)), "NULL").otherwise("VALUE")
        said = found.select(key, F.lit(path).alias("path"), presence.alias("presence"), F.when(presence == "VALUE", kind).alias("type"), F.when(presence == "VALUE", F.get_json_object("text", f"${at}")).alias("value"))
        out = said if out is None else out.union(said)
    return out


def checkpoint_layout(files: DataFrame, index: DataFrame, shard_pattern: str = r"\.safetensors$", whole: str = "model.safetensors") -> DataFrame:
    """(layout, n_shards, n_undeclared, n_missing): whether a folder's files (path) are one whole file, the shards of an index (shard), both (which is a fault), or neither."""
    name = F.element_at(F.split("path", "/"), -1)
    own = files.select(name.alias("name")).where(F.col("name").rlike(shard_pattern)).distinct()
    declared = index.select(F.col("shard").alias("name"), F.lit(True).alias("declared")).distinct()
    both = own.withColumn("there", F.lit(True)).join(declared, "name", "full_outer")
    single = F.col("there") & (F.col("name") == whole) & F.col("declared").isNull()
    sums = both.agg(F.count_if(single).alias("single"), F.count_if("declared").alias("n_shards"), F.count_if(F.col("there") & F.col("declared").isNull() & ~single).alias("n_undeclared"), F.count_if(F.col("there").isNull()).alias("n_missing"))
    layout = F.when((F.col("single") > 0) & (F.col("n_shards") > 0), "BOTH").when(F.col("single") > 0, "MONOLITHIC").when(F.col("n_shards") > 0, "SHARDED").otherwise("NONE")
    return sums.select(layout.alias("layout"), "n_shards", "n_undeclared", "n_missing")


def total_size(tensors: DataFrame, declared: Column) -> DataFrame:
    """(n_tensors, n_bytes, declared, agrees) of the tensors of a checkpoint against the size that its index declares."""
    sums = tensors.where("name is not null").agg(F.count("*").alias("n_tensors"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("n_bytes"))
    return sums.withColumn("declared", declared.cast("long")).withColumn("agrees", F.col("n_bytes") == F.col("declared"))


def shard_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, shard) of a shard index, from its ``weight_map``; a malformed file or a repeated name fails."""
    return _json_map(spark, path, "weight_map", "string").toDF("name", "shard")


def indexed_tensors(index: DataFrame, tensors: DataFrame) -> DataFrame:
    """(name, shard, found_in, status): each tensor of index or headers is OK, MISSING, UNDECLARED, WRONG_SHARD or AMBIGUOUS."""
    own = tensors.where("name is not null").groupBy(F.col("name").alias("t_name")).agg(F.min(F.element_at(F.split("path", "/"), -1)).alias("found_in"), F.count("*").alias("n"))
    both = index.join(own, F.col("name") == F.col("t_name"), "full_outer")
    status = F.when(F.col("t_name").isNull(), "MISSING").when(F.col("name").isNull(), "UNDECLARED").when(F.col("n") > 1, "AMBIGUOUS").when(F.col("shard") != F.col("found_in"), "WRONG_SHARD").otherwise("OK")
    return both.select(F.coalesce("name", "t_name").alias("name"), "shard", "found_in", status.alias("status"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a JSON object of ids by token; a malformed file or a repeated token fails."""
    return _json_map(spark, path, None, "long").toDF("token", "id")


def merge_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(path, rank, left, right) of files that are each an ordered table of merge rules; ``#version`` lines and lines that are not two words have no rank.

    Lines end as in Unicode text, at form feeds and line separators, too. They
    are numbered within one file's text, so a file, not the folder, has to fit
    a task.
    """
    ends = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
    parts = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    texts = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")
    lines = texts.select("path", F.filter(F.split("value", ends), lambda x: (F.size(parts(x)) == 2) & ~x.startswith("#version")).alias("lines"))
    rules = lines.select("path", F.posexplode("lines").alias("rank", "line")).withColumn("parts", parts(F.col("line")))
    return rules.select("path", "rank", F.element_at("parts", 1).alias("left"), F.element_at("parts", 2).alias("right"))


def merge_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rank, left, right) of one file of merge rules."""
    return merge_tables(spark, path).drop("path")
