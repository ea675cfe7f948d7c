"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquarry.session import _blas, one_blas_thread, settled, shared_dir, ship, stored

#: Bytes that Python workers get at once; one text may be longer.
BYTES_AT_ONCE = 8 << 20
#: Keys with more than one in so many of a table's rows (and at least HOT_ROWS) are hot: there are fewer than HOT_KEYS of them.
HOT_KEYS, HOT_ROWS = 100_000, 1_000


def text_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Just doc_id (long), the other named columns and text; names are matched once, so extra columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in columns], F.col("text").cast("string").alias("text"))


def map_arrow(df: DataFrame, fn, schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches of bounded bytes. Spark reads the bound from the session when a plan is made; it is only ever lowered."""
    spark = df.sparkSession
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or int(now) > BYTES_AT_ONCE:
        spark.conf.set(key, str(BYTES_AT_ONCE))
    return df.mapInArrow(fn, schema)


def join_keyed(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to keyed: a stored table of one row a key, with the number of rows of the key in weight.

    Hot keys are few by their definition, so their side is broadcast and their rows stay where they are; all other rows meet
    by a shuffle. No task gets a hot key's rows together. Where no key is hot, it is one plain join.
    """
    total, most = keyed.agg(F.sum(weight), F.max(weight)).first()
    hot = hot_above(total or 0)
    if (most or 0) <= hot:
        return rows.join(keyed, keys, how)
    return join_parts(rows, keyed.where(F.col(weight) > hot), keyed.where(F.col(weight) <= hot), keys, how)


def hot_above(total: int) -> int:
    """Keys with more rows than this are hot."""
    return max(HOT_ROWS, total // HOT_KEYS)


def join_parts(rows: DataFrame, hot: DataFrame, cold: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined to hot by a broadcast (it has fewer than HOT_KEYS rows) and to cold by a shuffle."""
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return rest.unionByName(rows.join(F.broadcast(hot), keys).select(*rest.columns))


@contextmanager
def on_one_blas_thread() -> Iterator[None]:
    """On the driver: small matrices need no more threads, each of which has buffers of its own."""
    put, get = _blas()
    before = get()
    put(1)
    try:
        yield
    finally:
        put(before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["hot_above", "join_keyed", "join_parts", "map_arrow", "on_one_blas_thread", "one_blas_thread", "settled", "shared_dir", "stored", "table", "text_rows"]
