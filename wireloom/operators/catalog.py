"""A catalog of stored messages: messages (id, class_id, name, modified_ms, msg) and classes (class_id, class_name)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listing(messages: DataFrame, classes: DataFrame, default: str = "default") -> DataFrame:
    """Messages with their class names (or the default) and sizes, newest first."""
    got = messages.join(classes, "class_id", "left").withColumn("class_name", F.coalesce("class_name", F.lit(default)))
    return got.withColumn("bytes_len", F.length("msg")).drop("msg").orderBy(F.desc("modified_ms"), F.desc("id"))


def orphaned(classes: DataFrame, messages: DataFrame) -> DataFrame:
    """Classes that no message is of."""
    return classes.join(messages.select("class_id").distinct(), "class_id", "left_anti")


def existing(ids: DataFrame, messages: DataFrame) -> DataFrame:
    """Saved ids whose message is still there."""
    return ids.join(messages.select("id"), "id", "left_semi")


def delete(messages: DataFrame, classes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the messages, and without classes that lost their last message to it."""
    left = messages.join(ids.select("id").distinct(), "id", "left_anti")
    lost = messages.join(ids.select("id").distinct(), "id", "left_semi").select("class_id").distinct().join(left.select("class_id").distinct(), "class_id", "left_anti")
    return left, classes.join(lost, "class_id", "left_anti")


def create(messages: DataFrame, classes: DataFrame, new: DataFrame, now: Column, default: int = 0) -> DataFrame:
    """Messages with those of new (class_id, name, msg) added: ids that follow the largest, made now.

    A class that isn't there becomes the default. Ids are given in no order, in one
    pass: each partition of new takes a stretch of them, so they have gaps.
    """
    top = messages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    known = classes.select("class_id", F.lit(True).alias("_known")).dropDuplicates(["class_id"])
    got = new.join(known, "class_id", "left").join(F.broadcast(top))  # one row
    made = got.select((F.col("_top") + 1 + F.monotonically_increasing_id()).alias("id"), F.when(F.col("_known"), F.col("class_id")).otherwise(F.lit(default)).cast(messages.schema["class_id"].dataType).alias("class_id"), "name", now.alias("modified_ms"), "msg")
    return messages.unionByName(made.select(*[F.col(c).cast(messages.schema[c].dataType).alias(c) for c in messages.columns]))


def rename(table: DataFrame, key: str, value, column: str, name: str, now: Column | None = None) -> DataFrame:
    """A new name in the row with a key; modified_ms follows if now is given."""
    hit = F.col(key) == F.lit(value)
    out = table.withColumn(column, F.when(hit, F.lit(name)).otherwise(F.col(column)))
    return out if now is None else out.withColumn("modified_ms", F.when(hit, now).otherwise(F.col("modified_ms")))


def update_bytes(messages: DataFrame, changed: DataFrame, now: Column) -> DataFrame:
    """Messages with the bytes of changed (id, msg), modified now."""
    new = changed.select("id", F.col("msg").alias("_new"))
    got = messages.join(new, "id", "left")
    return got.withColumns({"msg": F.coalesce("_new", "msg"), "modified_ms": F.when(F.col("_new").isNotNull(), now).otherwise(F.col("modified_ms"))}).drop("_new")


def frames_as_messages(frames: DataFrame, names: Column) -> DataFrame:
    """Frames as rows of messages: names, with what a frame's flags say."""
    suffix = F.concat(F.when(F.col("compressed"), " (compressed)").otherwise(""), F.when(F.col("json"), " (json)").otherwise(""))
    return frames.withColumn("name", F.concat(names, suffix))


def expand_paths(text: Column | str) -> Column:
    """Lines of a list of paths: trimmed, without empty ones, distinct and sorted."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(t, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")))
