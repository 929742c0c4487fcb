"""Facts that the tables lack, drawn from digests of their keys, alike in Spark and in SQL."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def drawn(key: Column, salt: str, n: int) -> Column:
    """A number below ``n`` from a key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string"))), 1, 6)
    return (F.conv(digits, 16, 10).cast("int") % n).cast("int")


def drawn_sql(key: str, salt: str, n: int) -> str:
    return f"(('0x' || substr(md5('{salt}:' || ({key})::VARCHAR), 1, 6))::INT % {n})"


def one_of(key: Column, salt: str, *values: str | None) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), drawn(key, salt, len(values)) + 1)


def one_of_sql(key: str, salt: str, *values: str | None) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"[{listed}][{drawn_sql(key, salt, len(values))} + 1]"
