"""Directories of ZIP archives as rows, read from the tail of a file; payloads are never read."""

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.compare import ladder

ENTRIES = "path string, file_length long, place int, name string, method int, encrypted boolean, packed long, size long, mode int, offset long, error string"
#: Fixed values of the format: signatures, the parts of records that are read, and how long an end record with its comment is at most.
_END, _END64, _LOCATOR, _ENTRY = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02"
_TAIL = 22 + 65535
_CHUNK = 1 << 20


def entry_rows(file, path: str, length: int, most_bytes: int) -> Iterator[tuple]:
    """Rows of ``ENTRIES`` of one archive (a file that can seek), streamed; one with an ``error`` alone where it is none, is cut off, or has a longer directory than ``most_bytes``."""

    def fault(name: str) -> tuple:
        return (path, length, *(None,) * 8, name)

    file.seek(max(0, length - _TAIL))
    tail = file.read(_TAIL)
    at = tail.rfind(_END)
    if at < 0 or len(tail) - at < 22:
        yield fault("NO_DIRECTORY")
        return
    n, size, begin = struct.unpack("<HII", tail[at + 10 : at + 20])
    end = length - len(tail) + at
    if n == 0xFFFF or 0xFFFFFFFF in (size, begin):  # the 64-bit form says where it is just before the end record
        locator = tail[at - 20 : at] if at >= 20 else b""
        if locator[:4] != _LOCATOR:
            yield fault("INVALID_DIRECTORY")
            return
        file.seek(struct.unpack("<Q", locator[8:16])[0])
        record = file.read(56)
        if len(record) < 56 or record[:4] != _END64:
            yield fault("INVALID_DIRECTORY")
            return
        n, size, begin = struct.unpack("<QQQ", record[32:56])
    if begin + size > end:
        yield fault("TRUNCATED")
        return
    if size > most_bytes:
        yield fault("LIMIT_EXCEEDED")
        return
    file.seek(begin)
    held, left = b"", size

    def take(k: int) -> bytes:
        nonlocal held, left
        while len(held) < k and left:
            block = file.read(min(left, max(_CHUNK, k)))
            if not block:
                break
            held, left = held + block, left - len(block)
        out, held = held[:k], held[k:]
        return out

    for place in range(n):
        head = take(46)
        if len(head) < 46 or head[:4] != _ENTRY:
            yield fault("INVALID_ENTRY")
            return
        flags, method = struct.unpack("<HH", head[8:12])
        packed, whole, name_length, extra_length, comment_length = struct.unpack("<IIHHH", head[20:34])
        mode, offset = struct.unpack("<II", head[38:46])
        rest = take(name_length + extra_length + comment_length)
        if len(rest) < name_length + extra_length + comment_length:
            yield fault("INVALID_ENTRY")
            return
        name = rest[:name_length].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        whole, packed, offset = _wide(rest[name_length : name_length + extra_length], [whole, packed, offset])
        yield path, length, place, name, method, bool(flags & 1), packed, whole, mode >> 16, offset, None


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Values with those that didn't fit 32 bits taken from the entry's 64-bit field, in their order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack("<HH", extra[at : at + 4])
        if kind == 1:
            field, k = extra[at + 4 : at + 4 + n], 0
            for i, v in enumerate(values):
                if v == 0xFFFFFFFF and k + 8 <= len(field):
                    values[i] = struct.unpack("<Q", field[k : k + 8])[0]
                    k += 8
        at += 4 + n
    return values


def entry_findings(entries: DataFrame, most_ratio: int = 100, most_bytes: int = 1 << 40) -> DataFrame:
    """``entries`` with ``finding``, the first that holds: the archive's error, TRAVERSAL, ABSOLUTE, LINK, ENCRYPTED, RATIO (it would grow more than ``most_ratio`` times), TOO_LARGE, REPEATED or OK; names are compared within an archive."""
    name = F.replace("name", F.lit("\\"), F.lit("/"))
    repeated = entries.where("error is null").groupBy(F.col("path").alias("r_path"), F.col("name").alias("r_name")).agg(F.count("*").alias("n_named")).where("n_named > 1")
    both = entries.join(repeated, (F.col("path") == F.col("r_path")) & (F.col("name") == F.col("r_name")), "left")
    rungs = [
        ("TRAVERSAL", name.rlike(r"(?:\A|/)\.\.(?:/|\z)")), ("ABSOLUTE", name.rlike(r"\A(?:/|[A-Za-z]:)")), ("LINK", F.col("mode").bitwiseAND(0o170000) == 0o120000), ("ENCRYPTED", F.col("encrypted")),
        ("RATIO", F.col("size") > most_ratio * F.col("packed")), ("TOO_LARGE", F.col("size") > most_bytes), ("REPEATED", F.col("n_named").isNotNull()),
    ]
    return both.select(*entries.columns, F.coalesce("error", ladder(rungs, "OK")).alias("finding"))


def archive_findings(found: DataFrame) -> DataFrame:
    """(path, n_entries, n_bad, worst) of archives with findings: the worst is the one that comes first by name of those that aren't OK."""
    bad = F.col("finding") != "OK"
    return found.groupBy("path").agg(F.count("name").alias("n_entries"), F.count_if(bad).alias("n_bad"), F.coalesce(F.min(F.when(bad, F.col("finding"))), F.lit("OK")).alias("worst"))

