"""Artifact files as formats of ``spark.read``: tensor headers, model headers, shard indexes and archive directories.

``register(spark)`` makes them known, then ``spark.read.format("tensor_headers").load(folder)``
reads a folder. Files are listed once, when a query is planned, and dealt to
partitions by how much of them is read; filters on ``path`` leave files out then,
and filters on ``name`` leave rows out before they reach the JVM. The interface
prunes no columns, so Spark does that after the scan.
"""

from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase
from functools import partial

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from ledgerloom.sources import archives, model_files
from ledgerloom.sources.files import TENSORS, _opened, tensor_rows

INDEX = "path string, file_length long, name string, shard string, error string"


class Files(InputPartition):
    """Files that one task reads."""

    def __init__(self, files: Sequence[tuple[str, int]]) -> None:
        self.files = list(files)


def _system(folder: str):  # noqa: ANN202
    from urllib.parse import unquote, urlsplit

    from pyarrow import fs

    scheme = urlsplit(folder).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(folder.removeprefix("file://")), "file:"
    system, inner = fs.FileSystem.from_uri("s3" + folder[3:] if scheme in ("s3a", "s3n") else folder)
    return system, inner, f"{scheme}://"


class HeaderReader(DataSourceReader):
    """Lists the files of a folder and reads the rows of each by ``rows`` of its source."""

    def __init__(self, source: "HeaderSource") -> None:
        self.source, self.options = source, source.options
        self.paths: list[Filter] = []
        self.names: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the interface's name
        for f in filters:
            known = isinstance(f, EqualTo | In | StringStartsWith) and f.attribute in (("path",), ("name",))
            if known:
                (self.paths if f.attribute == ("path",) else self.names).append(f)
            else:
                yield f

    @staticmethod
    def _keeps(filters: list[Filter], value: str | None) -> bool:
        def one(f: Filter) -> bool:
            if value is None:
                return False
            return value == f.value if isinstance(f, EqualTo) else value in f.value if isinstance(f, In) else value.startswith(f.value)

        return all(map(one, filters))

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, inner, scheme = _system(self.options["path"])
        pattern, many = self.options.get("pathglobfilter", self.source.pattern), int(self.options.get("filesperpartition", "64"))
        found = system.get_file_info(fs.FileSelector(inner, recursive=True)) if system.get_file_info(inner).type == fs.FileType.Directory else [system.get_file_info(inner)]
        files = sorted((f"{scheme}{i.path}", i.size) for i in found if i.type == fs.FileType.File and fnmatchcase(i.base_name, pattern) and not i.base_name.startswith(("_", ".")))
        files = [f for f in files if self._keeps(self.paths, f[0])]
        return [Files(files[k : k + many]) for k in range(0, max(1, len(files)), many)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema, most, held = self.source.arrow, int(self.options.get("mostbytes", str(1 << 28))), []
        names = schema.names
        for path, length in partition.files:
            for row in self.source.rows(path, length, most):
                r = row if isinstance(row, dict) else dict(zip(names, row, strict=True))
                if self.names and not self._keeps(self.names, r.get("name")):
                    continue
                held.append(r)
                if len(held) >= 4096:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class HeaderSource(DataSource):
    """What the formats share; a format has a name, columns, a file pattern and the rows of a file."""

    columns, pattern = "", "*"
    arrow: pa.Schema

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: object) -> HeaderReader:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        self.arrow = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(self.columns))
        return HeaderReader(self)

    def rows(self, path: str, length: int, most_bytes: int) -> Iterator[tuple | dict]:
        raise NotImplementedError


class TensorHeaders(HeaderSource):
    columns, pattern = TENSORS, "*.safetensors"

    @classmethod
    def name(cls) -> str:
        return "tensor_headers"

    def rows(self, path: str, length: int, most_bytes: int) -> Iterator[tuple]:
        return tensor_rows(path, length, most_bytes)


class ModelHeaders(HeaderSource):
    columns, pattern = model_files.HEADERS, "*.gguf"

    @classmethod
    def name(cls) -> str:
        return "model_headers"

    def rows(self, path: str, length: int, most_bytes: int) -> Iterator[dict]:
        return model_files.header_rows(partial(_opened, path), path, length, most_bytes)


class ShardIndexes(HeaderSource):
    columns, pattern = INDEX, "*.index.json"

    @classmethod
    def name(cls) -> str:
        return "shard_indexes"

    def rows(self, path: str, length: int, most_bytes: int) -> Iterator[tuple]:
        import json

        def once(pairs: list[tuple[str, object]]) -> dict:
            out = dict(pairs)
            if len(out) < len(pairs):
                raise KeyError("REPEATED_KEY")
            return out

        if length > most_bytes:
            yield path, length, None, None, "LIMIT_EXCEEDED"
            return
        with _opened(path) as f:
            body = f.read()
        try:
            found = json.loads(body, object_pairs_hook=once)["weight_map"]
            rows = [(path, length, name, shard, None) for name, shard in found.items() if isinstance(shard, str) or _no(name)]
        except KeyError as e:
            rows = [(path, length, None, None, "REPEATED_KEY" if e.args[0] == "REPEATED_KEY" else "NO_WEIGHT_MAP")]
        except (ValueError, TypeError, AttributeError):
            rows = [(path, length, None, None, "INVALID_INDEX")]
        yield from rows


def _no(name: str) -> bool:
    raise ValueError(name)


class ArchiveEntries(HeaderSource):
    columns, pattern = archives.ENTRIES, "*.zip"

    @classmethod
    def name(cls) -> str:
        return "archive_entries"

    def rows(self, path: str, length: int, most_bytes: int) -> Iterator[tuple]:
        system, inner, _ = _system(path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
        with system.open_input_file(inner) as f:
            yield from archives.entry_rows(f, path, length, most_bytes)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TensorHeaders, ModelHeaders, ShardIndexes, ArchiveEntries):
        spark.dataSource.register(source)
