"""Snapshot transforms: what an insert, an upsert or a delete leaves behind, as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. With ``min_by`` rows are combined before the shuffle, which a window can't do."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*").select(*df.columns)


def is_stored(batch: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``batch`` whose keys are already in ``store``."""
    return batch.join(store.select(*keys).distinct(), keys, "left_semi")


def insert_new(batch: DataFrame, store: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that an insert-if-absent of ``batch`` adds: absent from the store, first of equals within the batch."""
    return first_of(batch.join(store.select(*keys).distinct(), keys, "left_anti"), keys, order)


def upsert(store: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``store`` with the non-null values of ``changes``; new keys are added."""
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    return store.select(key, *columns).join(new, key, "full_outer").select(key, *[F.coalesce(f"new_{c}", c).alias(c) for c in columns])


def diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change_type, field_name, old_value, new_value): added, deleted and, for each field, modified."""
    pair = lambda df, side: df.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias(side))
    both = pair(before, "old").join(pair(after, "new"), key, "full_outer")
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"old.{c}").alias("o"), F.col(f"new.{c}").alias("n")) for c in columns])
    changed = both.filter("old IS NOT NULL AND new IS NOT NULL").select(key, F.explode(F.filter(fields, lambda x: ~x["o"].eqNullSafe(x["n"]))).alias("x")).select(key, F.lit("modified").alias("change_type"), F.col("x.field").alias("field_name"), F.col("x.o").alias("old_value"), F.col("x.n").alias("new_value"))
    void = F.lit(None).cast("string")
    one_side = both.filter("old IS NULL OR new IS NULL").select(key, F.when(F.col("old").isNull(), "added").otherwise("deleted").alias("change_type"), void.alias("field_name"), void.alias("old_value"), void.alias("new_value"))
    return changed.unionByName(one_side)


def cache_lookup(requests: DataFrame, key: str, at: str, usable: Column, days: int = 7) -> DataFrame:
    """Each request with the age of the latest usable earlier one of its key, and whether that is a hit within ``days``.

    A busy key is split by day: the latest entry of earlier days comes from one row for each day,
    and only the requests of one day are ordered together.
    """
    dated = requests.withColumn("_day", F.to_date(at))
    daily = dated.groupBy(key, "_day").agg(F.max(F.when(usable, F.col(at))).alias("_last"))
    carried = daily.withColumn("_carried", F.max("_last").over(Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))).select(F.col(key).alias("_key"), F.col("_day").alias("_of"), "_carried")
    earlier = Window.partitionBy(key, "_day").orderBy(at, "log_id").rowsBetween(Window.unboundedPreceding, -1)
    out = dated.withColumn("_today", F.max(F.when(usable, F.col(at))).over(earlier)).join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_day").eqNullSafe(F.col("_of"))).withColumn("cached_at", F.coalesce("_today", "_carried"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    age = micros(at) - micros("cached_at")
    return out.withColumn("age_s", F.floor(age / 1_000_000).cast("long")).withColumn("hit", F.coalesce(age <= days * 86_400_000_000, F.lit(False))).drop("_day", "_today", "_carried", "_key", "_of")


def to_fetch(requests: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """The distinct keys of ``requests`` that no usable entry of ``cached`` answers; a null key is none."""
    return requests.select(key).filter(F.col(key).isNotNull()).distinct().join(cached.select(key).distinct(), key, "left_anti")


def changed(store: DataFrame, changes: DataFrame, key: str, columns: list[str], stamp: Column | None = None, stamped: str = "updated_at") -> DataFrame:
    """``store`` with ``columns`` as ``changes`` has them, nulls included; other rows and columns stay. ``stamp`` is set on the rows changed.

    ``changes`` has one row for each key; keys that the store lacks change nothing.
    """
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    hit = F.col("_key").isNotNull()
    out = store.join(new, store[key] == F.col("_key"), "left")
    values = {c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    if stamp is not None:
        values[stamped] = F.when(hit, stamp).otherwise(F.col(stamped))
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in store.columns])


def switched_off(store: DataFrame, ids: DataFrame, key: str, flag: str = "is_active") -> DataFrame:
    """Soft delete: ``flag`` is false on the rows whose key is among ``ids``; a null flag counts as true."""
    gone = ids.select(F.col(key).alias("_key")).distinct()
    return store.join(gone, store[key] == F.col("_key"), "left").select(*[(F.coalesce(F.col(c), F.lit(True)) & F.col("_key").isNull()).alias(c) if c == flag else F.col(c) for c in store.columns])


def filled(docs: DataFrame, key: str, text: str, vec: str, provider, dim: int) -> DataFrame:
    """``docs`` with missing vectors made by ``provider`` (texts -> vectors, a list for a list), each distinct text once.

    The provider runs inside tasks, on Arrow batches; documents of equal text share its answer. Rows
    without text keep no vector.
    """
    missing = docs.filter(F.col(vec).isNull() & F.col(text).isNotNull()).select(F.xxhash64(text).alias("_h1"), F.md5(text).alias("_h2"), F.col(text).alias("_text")).dropDuplicates(["_h1", "_h2"])

    def run(frames):
        for pdf in frames:
            made = [[float(x) for x in v] for v in provider(pdf["_text"].tolist())]
            if any(len(v) != dim for v in made):
                raise ValueError(f"the provider must give vectors of {dim} numbers")
            yield pdf[["_h1", "_h2"]].assign(_made=made)

    made = missing.mapInPandas(run, "_h1 long, _h2 string, _made array<double>").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(15))))
    needs = F.col(vec).isNull() & F.col(text).isNotNull()
    asked = docs.withColumn("_h1", F.when(needs, F.xxhash64(text))).withColumn("_h2", F.when(needs, F.md5(text))).withColumn("_deal", F.pmod(F.xxhash64(key), F.lit(16)).cast("int"))
    kind = docs.schema[vec].dataType
    return asked.join(made, ["_h1", "_h2", "_deal"], "left").withColumn(vec, F.coalesce(F.col(vec), F.col("_made").cast(kind))).select(*docs.columns)


def append_item(field: Column, item: Column, separator: str = ", ") -> Column:
    """An item added to a packed field; an empty field becomes the item."""
    return F.when(field.isNull() | (F.trim(field) == ""), item).otherwise(F.concat(field, F.lit(separator), item))


def remove_substring(field: Column, part: Column) -> Column:
    """A field without any occurrence of ``part``, ends trimmed; null where nothing is left."""
    return F.nullif(F.trim(F.replace(field, part, F.lit(""))), F.lit(""))


def remove_item(field: Column, item: Column) -> Column:
    """A packed field without every entry equal to ``item``; null where nothing is left."""
    kept = F.filter(F.transform(F.split(field, ","), lambda x: F.trim(x)), lambda x: (x != item) & (x != ""))
    return F.nullif(F.array_join(kept, ", "), F.lit(""))
