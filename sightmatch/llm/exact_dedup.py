"""Exact duplicates of texts, white space aside, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightmatch.llm.batches import free_names
from sightmatch.sources.scratch import cut

#: Space and the control characters 9 to 13, which do not count in a comparison.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without BLANKS; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def group_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest=sha256,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after deleting BLANKS. The row with the longest original
    text (code points) stays, the smallest id among those. Three stages: the map side folds the
    copies that one task reads, groups are merged by (digest, text, salt), where the salt is the
    task's number, and the winners of all salts are merged by (digest, text). The whole text is part
    of the key at each stage, so unequal texts with one digest stay apart, and no task gets more
    rows of a group than tasks share a salt, or than there are salts.

    Rows are then labelled by a join on the digest without the texts, which Spark may split for hot
    groups. Digests that stand for several texts are looked for once; only their rows are
    labelled by a join on the texts too.

    Defined cases: ids may be of any type with an order, texts included. Null text is empty, so
    empty and blank texts are one group. Rows with a null id
    are ordinary rows whose id loses every tie. Rows with the same id and text are copies like
    others: all are counted, exactly one of them can have kept = true. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    clean = normalised(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_points"),
        digest(clean).alias("digest"),
        clean.alias("clean"),
    )
    no_id = F.col("doc_id").isNull()
    best = F.min(F.struct((-F.col("n_points")).alias("minus"), no_id.alias("no_id"), "doc_id"))
    groups = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "clean", "salt")
        .agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
        .groupBy("digest", "clean")
        .agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
        .withColumns({"keep_id": F.col("best.doc_id"), "text_sha256": sha256(F.col("clean"))})
    )
    known = cut(groups.select("digest", "keep_id", "group_size", "text_sha256"))
    clashing = known.groupBy("digest").count().filter("count > 1").select("digest")
    times = F.count(F.lit(1)).alias("times")
    columns = ["doc_id", "keep_id", "group_size", "times", "text_sha256"]
    if clashing.isEmpty():
        labelled = rows.groupBy("doc_id", "digest").agg(times).join(known, "digest").select(columns)
    else:
        clashing = cut(clashing)
        alone, shared = (rows.join(clashing, "digest", how) for how in ("left_anti", "left_semi"))
        labelled = (
            alone.groupBy("doc_id", "digest").agg(times).join(known, "digest").select(columns)
        ).unionAll(
            shared.groupBy("doc_id", "digest", "clean")
            .agg(times)
            .join(groups.join(clashing, "digest", "left_semi"), ["digest", "clean"])
            .select(columns)
        )
    return labelled.withColumn(
        "nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns.

    Defined cases: as for group_copies(). Of rows with the id and the text that stay, any one does,
    whatever its other columns hold. An empty table gives no rows. Other columns are passed on,
    whatever their names."""
    copy_id, sha = free_names(docs, "copy_id", "copy_sha")
    copies = group_copies(docs, id_col, text_col).filter("kept")
    wanted = copies.select(F.col("doc_id").alias(copy_id), F.col("text_sha256").alias(sha))
    same = F.col(id_col).eqNullSafe(F.col(copy_id)) & (
        sha256(normalised(F.col(text_col))) == F.col(sha)
    )
    kept = docs.join(wanted, same, "left_semi")
    if docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        return kept
    # Repeated ids: of rows with the same id and text, one stays.
    return (
        kept.withColumn(sha, sha256(normalised(F.col(text_col))))
        .dropDuplicates([id_col, sha])
        .drop(sha)
    )
