"""Typed metadata: conditions as column expressions, and the inverted table of keys."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

BUCKETS = (3, 6, 9)
INT_MAX = 10**12


def scaled(column: Column, kind: T.DataType, decimals: int | None = None, field: str = "") -> Column:
    """A column as an indexable integer: dates as yyyymmdd, floats scaled by their declared decimals, half to even."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return (F.year(column) * 10000 + F.month(column) * 100 + F.day(column)).cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        if decimals is None:
            raise TypeError(f"{field}: a float needs declared decimals")
        return F.bround(column.cast("double") * 10**decimals).cast("long")
    if isinstance(kind, T.IntegralType):
        return column.cast("long")
    raise TypeError(f"{field}: type {kind.simpleString()} isn't supported")


def _value(v, decimals: int | None):
    if isinstance(v, (dt.date, dt.datetime)):
        return v.year * 10000 + v.month * 100 + v.day
    return round(v * 10**decimals) if isinstance(v, float) and decimals is not None else v


def where(schema: T.StructType, conditions: dict, decimals: dict[str, int] | None = None) -> Column:
    """All conditions: a value, a list of values, ('range', a, b), ('re', pattern) or ('exists',) for each field.

    Array fields match if an element does. Ranges take both ends, in either order. Patterns are Java's.
    """
    decimals, out = decimals or {}, F.lit(True)
    for name, want in conditions.items():
        kind = schema[name].dataType
        many = isinstance(kind, T.ArrayType)
        own = kind.elementType if many else kind
        text = isinstance(own, (T.StringType, T.BooleanType))

        def one(x: Column, want=want, own=own, text=text, name=name) -> Column:
            d = decimals.get(name)
            x = x if text else scaled(x, own, d, name)
            if isinstance(want, tuple) and want[0] == "range":
                a, b = sorted(_value(v, d) for v in want[1:])
                return x.between(a, b)
            if isinstance(want, tuple) and want[0] == "re":
                return x.rlike(want[1])
            values = want if isinstance(want, list) else [want]
            return x.isin([_value(v, d) for v in values])

        column = F.col(name)
        if isinstance(want, tuple) and want[0] == "exists":
            out &= (column.isNotNull() & (F.size(column) > 0)) if many else column.isNotNull()
        elif isinstance(want, tuple) and want[0] not in ("range", "re"):
            raise ValueError(f"unknown condition {want[0]!r}")
        else:
            out &= F.coalesce(_any(column, one) if many else one(column), F.lit(False))
    return out


def _any(column: Column, one) -> Column:
    return F.exists(column, lambda x: one(x))


def keys(df: DataFrame, id_col: str, fields: list[str], decimals: dict[str, int] | None = None) -> DataFrame:
    """Rows key, doc_id: 'field=value' of every value, three coarser buckets of integers, and 'field:*' where present."""
    decimals, out = decimals or {}, None
    for name in fields:
        kind = df.schema[name].dataType
        many = isinstance(kind, T.ArrayType)
        own = kind.elementType if many else kind
        x = df.select(F.col(id_col).alias("doc_id"), (F.explode(name) if many else F.col(name)).alias("v")).where("v IS NOT NULL")
        if isinstance(own, (T.StringType, T.BooleanType)):
            every = F.array(F.concat(F.lit(f"{name}="), F.col("v").cast("string")), F.lit(f"{name}:*"))
        else:
            n = scaled(F.col("v"), own, decimals.get(name), name)
            x = x.withColumn("n", F.when((n >= 0) & (n < INT_MAX), n).otherwise(F.raise_error(F.lit(f"{name}: out of 0 to 10^12")).cast("long")))
            every = F.array(
                F.concat(F.lit(f"{name}="), F.col("n").cast("string")),
                *[F.concat(F.lit(f"{name}.b{b}="), F.floor(F.col("n") / 10**b).cast("string")) for b in BUCKETS],
                F.lit(f"{name}:*"),
            )
        rows = x.select(F.explode(every).alias("key"), "doc_id")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def matching(inverted: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Documents that have a key of every group; an unknown key matches none."""
    wanted = F.array(*[F.array(*[F.lit(k) for k in g]) for g in groups])
    hits = inverted.withColumn("g", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(groups) - 1)), lambda i: F.array_contains(F.get(wanted, i), F.col("key")))))
    return hits.groupBy("doc_id").agg(F.count_distinct("g").alias("n")).where(F.col("n") == len(groups)).select("doc_id")


def cardinalities(inverted: DataFrame) -> DataFrame:
    return inverted.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"))


def bitmaps(df: DataFrame, id_col: str, by: str) -> DataFrame:
    """Compact sets of ids a category: rows category, bucket, bitmap, n; a bucket is 32768 ids."""
    x = df.select(F.col(by).alias("category"), F.col(id_col).cast("long").alias("id"))
    return x.groupBy("category", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap")).withColumn("n", F.bitmap_count("bitmap"))


def density(df: DataFrame, condition: Column | str | None) -> float:
    """The share of rows that match; 1 for no condition."""
    if condition is None:
        return 1.0
    c = F.expr(condition) if isinstance(condition, str) else condition
    n, hit = df.agg(F.count("*"), F.count_if(c)).first()
    return min(1.0, hit / n) if n else 1.0
