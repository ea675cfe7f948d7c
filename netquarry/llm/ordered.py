"""Global numbers of rows and groups in a sort order, without a window: local counts in ranges, and a row a range of offsets.

Rows are dealt into ranges of the order and sorted within them, so a group that holds a third of all rows lies in many
ranges; no group is gathered anywhere. Rolling polynomials of the rows of a group come from the same scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from netquarry.llm.runtime import map_arrow, stored


@dataclass(frozen=True)
class Polynomial:
    """Of the values h (a column, at least 0) of a group's rows so far: the sum of h[k] * base^k modulo a prime below 2^31."""

    column: str
    base: int
    prime: int


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base to the exponents, by their bits."""
    out, left, power = np.ones(len(exponents), np.int64), exponents.astype(np.int64), base % prime
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = out[odd] * power % prime
        left, power = left >> 1, power * power % prime
    return out


def _local(group: str, polynomials: list[Polynomial]):
    """Number of the group in this range, place in it, whether the next row is of another group, and the polynomials with and without
    this row, all as far as this range goes. A batch is handed on when the next one tells whether its last group goes on."""

    def run(batches):
        group_no, place, before, held = -1, 0, None, None
        carry = [0] * len(polynomials)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(group)
            # Runs take nulls as equal values.
            ends = pc.run_end_encode(column, run_end_type=pa.int64()).run_ends.to_numpy()
            starts = np.concatenate([[0], ends[:-1]])
            run_of = np.repeat(np.arange(len(ends)), ends - starts)
            goes_on = group_no >= 0 and column[0].as_py() == before
            if held is not None:
                held[2][-1] = not goes_on
                yield _with(*held)
            places = np.arange(batch.num_rows) - starts[run_of]
            places[: ends[0]] += place if goes_on else 0
            group_no += 0 if goes_on else 1
            last = np.zeros(batch.num_rows, bool)
            last[ends - 1] = True
            sums = []
            for k, p in enumerate(polynomials):
                term = batch.column(p.column).to_numpy() % p.prime * powers(p.base, places, p.prime) % p.prime
                total = np.cumsum(term)
                so_far = total - (total[starts] - term[starts])[run_of]
                so_far[: ends[0]] += carry[k] if goes_on else 0
                so_far %= p.prime
                carry[k] = int(so_far[-1])
                sums += [so_far, (so_far - term) % p.prime]
            held = (batch, group_no + run_of, last, places, sums)
            group_no, place, before = group_no + len(ends) - 1, int(places[-1]) + 1, column[-1].as_py()
        if held is not None:
            held[2][-1] = False
            yield _with(*held)

    return run


def _with(batch, groups, last, places, sums):
    columns = [pa.array(groups, pa.int64()), pa.array(places, pa.int64()), pa.array(last), *[pa.array(s, pa.int64()) for s in sums]]
    names = ["__group", "__place", "__last", *[f"__{c}{k // 2}" for k, c in zip(range(len(sums)), "fg" * len(sums), strict=False)]]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "ordered", polynomials: tuple[Polynomial, ...] = ()) -> tuple[DataFrame, int]:
    """(rows with part, group_no, place, last, and of each polynomial k f{k} and g{k}; number of groups), in the order of (group, *order), nulls first.

    group_no numbers the groups and place the rows of a group, both from 0; last marks a group's last row; f is the polynomial
    with the row and g the one before it. part is the range that the row lies in. The rows are a written table; one row
    a range reaches the driver.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("part", F.spark_partition_id())
    sums = [f"__{c}{k}" for k in range(len(polynomials)) for c in "fg"]
    own = [StructField(c, LongType()) for c in ("__group", "__place")] + [StructField("__last", BooleanType())] + [StructField(c, LongType()) for c in sums]
    local = stored(map_arrow(dealt, _local(group, list(polynomials)), StructType([*dealt.schema.fields, *own])), name)
    at = F.struct("__group", "__place")
    tops = F.max_by(F.array(F.lit(0).cast("long"), *[F.col(f"__f{k}") for k in range(len(polynomials))]), at).alias("sums")
    ends = local.groupBy("part").agg(F.min_by(F.struct(group), at).alias("first"), F.max_by(F.struct(group), at).alias("last"), F.max(at).alias("top"), tops)
    offsets, groups, place, before, carry = [], 0, 0, None, [0] * len(polynomials)
    found = sorted(ends.collect(), key=lambda r: r["part"])
    for k, r in enumerate(found):
        goes_on = before is not None and before[0] == r["first"][0]
        first, ahead = (groups - 1, place) if goes_on else (groups, 0)
        shifts = [(carry[j] if goes_on else 0, pow(p.base, ahead, p.prime)) for j, p in enumerate(polynomials)]
        closes = k + 1 == len(found) or found[k + 1]["first"][0] != r["last"][0]
        offsets.append((r["part"], first, ahead, *r["top"], closes, [x for s in shifts for x in s]))
        whole = r["top"][0] == 0
        place = r["top"][1] + 1 + (ahead if whole else 0)
        carry = [(s[0] + v * s[1]) % p.prime if whole else v for s, v, p in zip(shifts, r["sums"][1:], polynomials, strict=True)]
        groups, before = first + r["top"][0] + 1, r["last"]
    bound = spark.createDataFrame(offsets, "part int, __first long, __ahead long, __top long, __end long, __closes boolean, __shifts array<long>")
    joined = local.join(F.broadcast(bound), "part")
    here = (F.col("__group") == F.col("__top")) & (F.col("__place") == F.col("__end"))
    cut = F.col("__group") == 0
    values = []
    for k, p in enumerate(polynomials):
        for c in "fg":
            local_value = F.col(f"__{c}{k}")
            shifted = (F.get("__shifts", F.lit(2 * k)) + local_value * F.get("__shifts", F.lit(2 * k + 1)) % p.prime) % p.prime
            values.append(F.when(cut, shifted).otherwise(local_value).alias(f"{c}{k}"))
    return joined.select(
        *[F.col(c) for c in rows.columns],
        "part",
        (F.col("__first") + F.col("__group")).alias("group_no"),
        (F.col("__place") + F.when(cut, F.col("__ahead")).otherwise(0)).alias("place"),
        F.when(here, F.col("__closes")).otherwise(F.col("__last")).alias("last"),
        *values,
    ), groups
