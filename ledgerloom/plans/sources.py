"""Queries that write files into the shared folder and read them as sources. Binary headers are written as text whose numbers are raw bytes."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.written import fresh_folder
from ledgerloom.plans.catalogue import query, table
from ledgerloom.sources import archives, files, formats


def _text_files(rows: DataFrame, name: str, key: str) -> str:
    """A folder with one text file for each row (key, value)."""
    folder = fresh_folder(rows.sparkSession, name)
    rows.select(key, "value").write.partitionBy(key).text(folder)
    return folder


def _number(value: Column | int, n_bytes: int) -> Column:
    """A number of ``n_bytes`` bytes, the lowest first, as a text of just these bytes; one that has 128 or more is no UTF-8, so such texts are joined and written only."""
    value = F.lit(value) if isinstance(value, int) else value
    digits = F.lpad(F.hex(value.cast("long")), max(16, 2 * n_bytes), "0")
    return F.unhex(F.concat(*(F.substring(digits, max(16, 2 * n_bytes) - 2 * k - 1, 2) for k in range(n_bytes)))).cast("string")


def _read(spark: SparkSession, format_: str, folder: str, key: str) -> DataFrame:
    """What a format finds in a folder of ``_text_files``, with the ``key`` that each file is of."""
    formats.register(spark)
    found = spark.read.format(format_).option("pathGlobFilter", "part-*").load(folder)
    return found.withColumn(key, F.regexp_extract("path", f"{key}=([^/]+)", 1).cast("int"))


@query("""WITH t AS (SELECT p_brand, string_agg(p_partkey || ' ' || p_name, chr(10) ORDER BY p_partkey) || chr(10) AS t FROM part GROUP BY 1) SELECT p_brand, strlen(t)::BIGINT AS size, sha256(t) AS sha256 FROM t""")
def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of files, one for each brand."""
    lines = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    folder = _text_files(lines.select("p_brand", F.array_join(F.transform("x", lambda r: F.concat_ws(" ", r["p_partkey"], r["p_name"])), "\n").alias("value")), "manifest-files", "p_brand")
    brand = F.url_decode(F.regexp_extract("path", "p_brand=([^/]+)", 1))
    return files.file_manifest(spark, folder, "part-*.txt").select(brand.alias("p_brand"), "size", "sha256")


@query("""SELECT n_regionkey, n_nationkey, CASE WHEN n_nationkey % 11 = 3 THEN 'FIELDS' WHEN n_nationkey % 11 = 4 THEN 'TYPE' WHEN n_nationkey % 11 = 5 THEN 'OFFSETS' WHEN n_nationkey % 11 = 6 THEN 'TYPE' WHEN n_nationkey % 11 = 7 THEN 'NOT_STRICT_JSON' END AS fault,
CASE WHEN n_nationkey % 11 NOT IN (3, 4, 5, 6, 7) THEN n_name END AS name, CASE WHEN n_nationkey % 11 NOT IN (3, 4, 5, 6, 7) THEN n_nationkey * 2 END::BIGINT AS last FROM nation""")
def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records of one array a region, some of which break their contract."""
    k = F.col("n_nationkey")
    odd = k % 11
    fields = F.concat(
        F.lit('{"name": "'), "n_name", F.lit('", "dtype": '), F.when(odd == 6, F.lit("7")).otherwise(F.lit('"F32"')), F.lit(', "shape": '), F.when(odd == 4, F.lit("[1.5]")).otherwise(F.concat(F.lit("["), k.cast("string"), F.lit(", 2]"))),
        F.lit(', "shard": "s", "header_len": 8, "offsets": ['), F.when(odd == 5, (k * 3).cast("string")).otherwise("0"), F.lit(", "), (k * 2).cast("string"), F.lit("]"), F.when(odd == 3, F.lit(', "more": 1')).when(odd == 7, F.lit(', "name": "again"')).otherwise(""), F.lit("}"),
    )
    arrays = table(spark, sf_dir, "nation").withColumn("record", fields).groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "record"))).alias("x"))
    folder = _text_files(arrays.select("n_regionkey", F.concat(F.lit("["), F.array_join(F.col("x.record"), ","), F.lit("]")).alias("value")), "record-files", "n_regionkey")
    region = F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int")
    numbers = arrays.select(F.col("n_regionkey").alias("of"), F.posexplode("x.n_nationkey").alias("no", "n_nationkey"))
    rows = files.raw_records(spark, folder).select(region.alias("n_regionkey"), "place", "fault", "name", F.element_at("offsets", 2).alias("last"))
    return rows.join(numbers, (F.col("n_regionkey") == F.col("of")) & (F.col("place") == F.col("no"))).select("n_regionkey", "n_nationkey", "fault", "name", "last")


@query("""SELECT p_brand, p_name || ' ' || p_partkey AS token, p_partkey::BIGINT AS id FROM part""")
def source_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary file for each brand, read back."""
    token = F.concat_ws(" ", "p_name", "p_partkey")
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(token, "p_partkey")))).alias("value"))
    folder = _text_files(rows, "vocabulary-files", "p_brand")
    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.url_decode(F.url_decode(F.regexp_extract(F.input_file_name(), "p_brand=([^/]+)", 1))).alias("p_brand"), F.explode(F.from_json("value", "map<string, bigint>")).alias("token", "id"))
    return found


@query("""WITH e AS (SELECT event_id, props FROM events) SELECT event_id, p.path, CASE WHEN p.path = 'k' THEN 'VALUE' ELSE CASE WHEN p.path = 'in.a' AND event_id % 3 = 0 THEN 'VALUE' WHEN p.path = 'in.a' AND event_id % 3 = 1 THEN 'NULL' ELSE 'ABSENT' END END AS presence,
CASE WHEN p.path = 'k' THEN 'BIGINT' WHEN p.path = 'in.a' AND event_id % 3 = 0 THEN 'STRING' END AS type, CASE WHEN p.path = 'k' THEN json_extract_string(props, '$.k') WHEN p.path = 'in.a' AND event_id % 3 = 0 THEN 'x' END AS value FROM e, (VALUES ('k'), ('in.a'), ('in.b')) p(path)""")
def source_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted fields of configurations: absent, null, or a typed value."""
    third = F.col("event_id") % 3
    inner = F.when(third == 0, F.lit('{"a": "x"}')).when(third == 1, F.lit('{"a": null}')).otherwise(F.lit("{}"))
    text = F.concat(F.lit('{"in": '), inner, F.lit(", "), F.substring("props", 2, 1000))
    return files.configuration_fields(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "event_id", "text", ["k", "in.a", "in.b"])


_TENSORS = """t AS (SELECT (p_partkey % 40)::INTEGER AS shard, p_partkey AS k, CASE p_partkey % 23 WHEN 5 THEN 'X9' WHEN 6 THEN 'I64' ELSE 'F32' END AS dtype, CASE WHEN p_partkey % 29 = 3 THEN -1 ELSE p_size END AS rows, p_size * 8 AS bytes, CASE WHEN p_partkey % 31 = 4 THEN 4 ELSE 0 END AS hole, CASE WHEN p_partkey % 37 = 5 THEN 4 ELSE 0 END AS back FROM part),
o AS (SELECT *, (sum(bytes + hole - back) OVER w - bytes)::BIGINT AS start FROM t WINDOW w AS (PARTITION BY shard ORDER BY k)), z AS (SELECT *, start + bytes AS stop, max(start + bytes) OVER (PARTITION BY shard ORDER BY start, start + bytes, 't.' || k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(start + bytes) OVER (PARTITION BY shard) - CASE WHEN shard % 8 = 2 THEN 8 ELSE 0 END AS payload FROM o)"""


def _tensor_files(spark: SparkSession, sf_dir: str) -> str:
    """Files of tensors, one for every 40th part: header lengths are multiples of 256; some types, shapes and places are wrong."""
    k = F.col("k")
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("shard"), F.col("p_partkey").alias("k"), "p_size")
    step = F.col("p_size") * 8 + F.when(k % 31 == 4, 4).otherwise(0) - F.when(k % 37 == 5, 4).otherwise(0)
    placed = parts.withColumn("stop", F.sum(step).over(Window.partitionBy("shard").orderBy("k")))
    shape = F.array(F.when(k % 29 == 3, -1).otherwise(F.col("p_size")), F.lit(2))
    tensor = F.struct(F.when(k % 23 == 5, "X9").when(k % 23 == 6, "I64").otherwise("F32").alias("dtype"), shape.alias("shape"), F.array(F.col("stop") - F.col("p_size") * 8, F.col("stop")).alias("data_offsets"))
    header = placed.groupBy("shard").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("t."), k.cast("string")), tensor))))).alias("json"), F.max("stop").alias("end"))
    blocks = F.ceil(F.length(F.col("json").cast("binary")) / 256)
    blocks = F.when(blocks % 256 >= 128, F.ceil(blocks / 256) * 256).otherwise(blocks)  # a byte of 128 or more would not be ASCII
    cut = F.when(F.col("shard") % 8 == 2, 9).otherwise(1)  # the line's end is the payload's last byte; some payloads are cut
    value = F.concat(F.chr(F.lit(0)), _number(blocks, 7), F.rpad("json", (blocks * 256).cast("int"), " "), F.repeat(F.lit("x"), (F.col("end") - cut).cast("int")))
    return _text_files(header.select("shard", value.alias("value")), "tensor-files", "shard")


@query(f"""WITH {_TENSORS} SELECT shard, 't.' || k AS name, dtype, start AS start_, stop, CASE WHEN dtype = 'X9' THEN 'UNKNOWN_TYPE' WHEN rows < 0 THEN 'INVALID_SHAPE' WHEN dtype = 'I64' THEN 'SIZE_MISMATCH' WHEN start < 0 OR stop > payload THEN 'OUT_OF_BOUNDS' WHEN coalesce(before, 0) > start THEN 'OVERLAP' WHEN coalesce(before, 0) < start THEN 'GAP' ELSE 'OK' END AS status FROM z""")
def source_tensor_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tensors that the headers of files name, each checked against its type, its shape and its neighbours."""
    found = _read(spark, "tensor_headers", _tensor_files(spark, sf_dir), "shard")
    return files.checked_tensors(found).select("shard", "name", "dtype", F.col("start").alias("start_"), F.col("end").alias("stop"), "status")


@query(f"""WITH {_TENSORS}, i AS (SELECT 't.' || p_partkey AS name, 'shard=' || CASE WHEN p_partkey % 43 = 7 THEN (p_partkey + 1) % 40 ELSE p_partkey % 40 END AS shard FROM part WHERE p_partkey % 41 <> 6 UNION ALL SELECT 'absent.' || p_partkey, 'shard=0' FROM part WHERE p_partkey % 47 = 8)
SELECT coalesce(i.name, 't.' || k) AS name, i.shard, 'shard=' || z.shard AS found_in, CASE WHEN k IS NULL THEN 'MISSING' WHEN i.name IS NULL THEN 'UNDECLARED' WHEN i.shard <> 'shard=' || z.shard THEN 'WRONG_SHARD' ELSE 'OK' END AS status FROM i FULL JOIN z ON i.name = 't.' || k""")
def source_shard_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of which tensor lies in which file, one for each size, against the files."""
    k = F.col("p_partkey")
    shard = lambda n: F.concat(F.lit("shard="), n.cast("string"))
    own = F.when(k % 41 != 6, F.struct(F.concat(F.lit("t."), k.cast("string")).alias("name"), shard(F.when(k % 43 == 7, (k + 1) % 40).otherwise(k % 40)).alias("shard")))
    absent = F.when(k % 47 == 8, F.struct(F.concat(F.lit("absent."), k.cast("string")).alias("name"), F.lit("shard=0").alias("shard")))
    listed = table(spark, sf_dir, "part").select("p_size", F.explode(F.array_compact(F.array(own, absent))).alias("x"))
    maps = listed.groupBy("p_size").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list("x")).alias("weight_map"))).alias("value"))
    index = _read(spark, "shard_indexes", _text_files(maps, "index-files", "p_size"), "p_size").select("name", "shard")
    tensors = _read(spark, "tensor_headers", _tensor_files(spark, sf_dir), "shard").select("name", shard(F.col("shard")).alias("path"))
    return files.indexed_tensors(index, tensors)


@query("""WITH p AS (SELECT (p_partkey % 160)::INTEGER AS file, p_partkey AS k, p_name, p_size, row_number() OVER (PARTITION BY p_partkey % 160 ORDER BY p_partkey) - 1 AS no FROM part)
SELECT file, 'metadata' AS kind, 'general.name' AS name, 'string' AS value_type, min(p_name) AS value, NULL AS dims, NULL::INTEGER AS type, NULL AS offset_, 0 AS place FROM p WHERE file % 20 <> 7 GROUP BY 1 UNION ALL SELECT file, 'metadata', 'count', 'uint32', least(count(*), 127)::VARCHAR, NULL, NULL, NULL, 1 FROM p WHERE file % 20 <> 7 GROUP BY 1
UNION ALL SELECT file, 'tensor', 'blk.' || k, NULL, NULL, p_size || ',' || 2, (p_size % 20)::INTEGER, (no % 128 * 256)::VARCHAR, no::INTEGER FROM p WHERE file % 20 <> 7 AND no < 127 UNION ALL SELECT DISTINCT file, 'error', NULL, NULL, NULL, NULL, NULL::INTEGER, NULL, NULL::INTEGER FROM p WHERE file % 20 = 7""")
def source_model_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and tensors in the headers of single-file models; one in 20 is of no known version."""
    text = lambda c: F.concat(_number(F.length(c), 8), c)
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 160).alias("file"), F.col("p_partkey").alias("k"), "p_name", "p_size").withColumn("no", F.row_number().over(Window.partitionBy("file").orderBy("k")) - 1)
    tensor = F.concat(text(F.concat(F.lit("blk."), F.col("k").cast("string"))), _number(2, 4), _number(F.col("p_size"), 8), _number(2, 8), _number(F.col("p_size") % 20, 4), _number(F.col("no") % 128 * 256, 8))
    sums = parts.groupBy("file").agg(F.min("p_name").alias("name"), F.least(F.count("*"), F.lit(127)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("no") < 127, F.struct("no", tensor.alias("x"))))).alias("tensors"))
    version = F.when(F.col("file") % 20 == 7, 9).otherwise(3)
    pairs = F.concat(text(F.lit("general.name")), _number(8, 4), text(F.col("name")), text(F.lit("count")), _number(4, 4), _number(F.col("n"), 4))
    value = F.concat(F.lit("GGUF"), _number(version, 4), _number(F.col("n"), 8), _number(2, 8), pairs, F.array_join(F.col("tensors.x"), ""))
    found = _read(spark, "model_headers", _text_files(sums.select("file", value.alias("value")), "model-files", "file"), "file")
    dims = F.array_join(F.transform("dims", lambda d: d.cast("string")), ",")
    return found.select("file", "kind", "name", "value_type", "value", dims.alias("dims"), "type", F.col("offset").cast("string").alias("offset_"), "place")


@query("""WITH w AS (SELECT p_brand, p_partkey, string_split(p_name, ' ') AS w FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS rank FROM w WHERE len(w) = 2 AND p_partkey % 9 > 0)
SELECT p_brand, rank::INTEGER AS rank, w[1] AS left_, w[2] AS right_ FROM r""")
def source_merge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered merge rules, a file for each brand, between lines that are none."""
    line = F.when(F.col("p_partkey") % 9 == 0, F.lit("#version: 0.2\u2028three words here")).otherwise(F.col("p_name"))
    lines = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda r: r["line"]), "\n").alias("value"))
    found = files.merge_tables(spark, _text_files(lines, "merge-files", "p_brand"))
    return found.select(F.url_decode(F.url_decode(F.regexp_extract("path", "p_brand=([^/]+)", 1))).alias("p_brand"), "rank", F.col("left").alias("left_"), F.col("right").alias("right_"))


_ENTRIES_SQL = """e AS (SELECT c_custkey % 128 AS archive, CASE c_custkey % 11 WHEN 1 THEN 'a/../' || c_custkey WHEN 2 THEN '/abs' || c_custkey WHEN 3 THEN 'x\\..\\' || c_custkey WHEN 4 THEN 'C:' || c_custkey WHEN 5 THEN 'same' ELSE lower(c_mktsegment) || '/' || c_custkey END AS name, c_custkey % 13 = 0 AS encrypted, c_nationkey AS packed, c_nationkey * CASE WHEN c_custkey % 17 = 0 THEN 512 ELSE 1 END AS size FROM customer),
f AS (SELECT *, CASE WHEN regexp_matches(name, '(^|[/\\\\])[.][.]([/\\\\]|$)') THEN 'TRAVERSAL' WHEN name LIKE '/%' OR name LIKE 'C:%' THEN 'ABSOLUTE' WHEN encrypted THEN 'ENCRYPTED' WHEN size > 100 * packed THEN 'RATIO' WHEN count(*) OVER (PARTITION BY archive, name) > 1 THEN 'REPEATED' ELSE 'OK' END AS finding FROM e)"""


@query(f"WITH {_ENTRIES_SQL} SELECT archive::INTEGER AS archive, name, encrypted, packed::BIGINT AS packed, size::BIGINT AS size, finding FROM f")
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of archives, a row each from their directories, with what is wrong about them. Links are in the tests."""
    k, n = F.col("c_custkey"), lambda v, b: _number(v, b)
    said = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    forms = {1: said("a/../", k), 2: said("/abs", k), 3: said("x\\..\\", k), 4: said("C:", k), 5: F.lit("same")}
    name = F.coalesce(*(F.when(k % 11 == r, form) for r, form in forms.items()), said(F.lower("c_mktsegment"), "/", k))
    packed = F.col("c_nationkey")
    size = packed * F.when(k % 17 == 0, 512).otherwise(1)
    rest = F.lit(110) - F.length("name")  # an entry takes 256 bytes: its name, an unknown field of 100, and a comment
    entry = F.concat(F.lit("PK\u0001\u0002"), n(0, 4), n(F.when(k % 13 == 0, 1).otherwise(0), 2), n(0, 10), n(packed, 4), n(size, 4), n(F.length("name"), 2), n(100, 2), n(rest, 2), n(0, 12), "name", n(77, 2), n(96, 2), F.repeat(F.lit("e"), 96), F.repeat(F.lit("c"), rest))
    rows = table(spark, sf_dir, "customer").withColumn("name", name)
    sums = rows.groupBy((k % 128).alias("archive")).agg(F.count("*").alias("n"), F.array_join(F.collect_list(entry), "").alias("directory"))
    last = lambda count, size, begin: F.concat(F.lit("PK\u0005\u0006"), n(0, 4), n(count, 2), n(count, 2), n(size, 4), n(begin, 4), n(1, 2))  # noqa: E731  the line's end is the archive's comment
    own, length = F.col("n"), F.col("n") * 256
    wide_end = F.concat(F.lit("PK\u0006\u0006"), n(44, 8), n(0, 12), n(own, 8), n(own, 8), n(length, 8), n(0, 8), F.lit("PK\u0006\u0007"), n(0, 4), n(length, 8), n(1, 4), last(0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF))
    end = F.when(own < 0xFFFF, last(own, length, 0)).otherwise(wide_end)  # more entries need the 64-bit form
    found = _read(spark, "archive_entries", _text_files(sums.select("archive", F.concat("directory", end).alias("value")), "archive-files", "archive"), "archive")
    return archives.entry_findings(found).select("archive", "name", "encrypted", "packed", "size", "finding")
