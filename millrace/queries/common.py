"""What the query modules share: the register, tables, and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: SQL of white space as the text functions have it, and of a text's normal form.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{SPACE}+', ' ', 'g'))"


UNIT = "(('0x' || substr(sha256({0}), 1, 8))::UBIGINT / 4294967295.0)"
CONTENTS = "coalesce(array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), ' '), '')"
ONE = "(select * from records qualify row_number() over (partition by id order by prepared_at) = 1)"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def one_records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").dropDuplicates(["id"])


def shingles(x: str, size: int = 5) -> str:
    """SQL of the distinct runs of words of a normalized text."""
    w = f"regexp_extract_all({x}, '[a-z0-9]+')"
    return f"case when len({w}) >= {size} then list_distinct(list_transform(range(1, len({w}) - {size} + 2), lambda i: array_to_string(({w})[i:i + {size - 1}], ' '))) when len({w}) > 0 then [array_to_string({w}, ' ')] else [] end"
