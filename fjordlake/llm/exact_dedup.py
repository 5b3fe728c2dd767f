"""Exact deduplication by skew-safe combining of (digest, text) groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import broadcast_if_small, join_groups, materialize


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """Names for every row the row that stays of all rows with its text.

    Three stages, each grouping by the digest and the whole text: rows of one
    partition are combined before they leave it (all carry the partition's
    salt, so the map side holds one row a text), salted groups are merged,
    then the winners of all salts. A text that a third of all rows share
    reaches a task as one row a map task at most. Rows of texts that occur
    again find their group by the digest alone, with the group broadcast or
    the digest salted; should two texts ever share a digest, those rows alone
    are joined by the whole text.

    Returns ``id_col, keep_id, group_size, kept, text_sha256``, one row per
    input row. Null texts count as empty. The largest id stays; of rows that
    repeat that id with the same text one is kept; null ids stay only where
    a text has no other id (again one). Extra columns are ignored; an empty
    table gives an empty result.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    ).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("sha", "text", "salt")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    grouped = salted.groupBy("sha", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    winners = materialize(grouped.select("sha", "keep_id", "group_size"), "winners")
    groups = materialize(winners.where("group_size > 1"), "groups")

    def looked_up(part: DataFrame) -> DataFrame:  # a text that one row has is its own winner
        found = join_groups(part.select("doc_id", "sha"), groups, "sha")
        keep, size = F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size")
        return found.select("doc_id", "sha", keep, size)

    shared = winners.groupBy("sha").count().where("count > 1").select("sha")
    if shared.isEmpty():
        joined = looked_up(rows)
    else:
        clash = shared.withColumn("clash", F.lit(True))
        split = rows.join(clash, "sha", "left")
        by_text = split.where("clash").select("doc_id", "sha", "text").join(grouped, ["sha", "text"]).drop("text")
        joined = looked_up(split.where("clash IS NULL")).unionByName(by_text)
    found = materialize(joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))), "found")
    again = found.where("kept").groupBy("sha", "doc_id", "keep_id").count().where("count > 1")
    if not again.isEmpty():  # only rows that repeat the id of a kept row are numbered
        one = Window.partitionBy("sha", "doc_id", "keep_id").orderBy("group_size")
        found = found.where("NOT kept").unionByName(
            found.where("kept").withColumn("kept", F.row_number().over(one) == 1)
        )
    return found.select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Rows that repeat a kept id with the same text come back once.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"d{i}" for i in range(len(columns))])
    row_id, text = F.col(f"d{columns.index(id_col)}"), F.col(f"d{columns.index(text_col)}")
    found = materialize(exact_duplicates(docs, id_col, text_col).toDF("id", "keep", "size", "kept", "sha"), "exact")
    found = found.select("id", "kept", F.unhex("sha").alias("sha"))
    by_row = found.groupBy("id", "sha").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = materialize(by_row.where("NOT kept").select("id", "sha"), "gone")
    rows = plain.withColumn("sha", F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)))
    left = rows.alias("r").join(
        broadcast_if_small(gone).alias("g"), row_id.eqNullSafe(F.col("g.id")) & (F.col("r.sha") == F.col("g.sha")), "left_anti"
    )
    if not by_row.where("kept AND n > 1").isEmpty():
        one = Window.partitionBy(row_id, "sha").orderBy(F.lit(1))
        left = left.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n")
    return left.drop("sha").toDF(*columns)
