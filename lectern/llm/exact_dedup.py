"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes in a group.

Only DataFrame functions run here. Texts count as equal when they are identical after every run
of white space became one space; a null text counts as empty.

Defined cases: empty and null texts form one group; of rows with equal texts the smallest doc_id
stays; a null doc_id never stays if its group has another id, and where all ids of a group are
null keep_id is null and kept is false; a row repeated under the same doc_id counts twice in
group_size, and both rows carry kept=true; an empty table gives an empty result; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text):
    """The text with each run of white space replaced by one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    hashed = norm.select("doc_id", F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    # map-side combine first: copies inside a task leave as one row, so a hot group stays small
    groups = written(
        norm.groupBy(F.unhex(F.md5("norm")).alias("h")).agg(
            F.min("doc_id").alias("keep_id"),
            F.count(F.lit(1)).alias("group_size"),
            F.min("norm").alias("low"),
            F.max("norm").alias("high"),
        ).select("h", "keep_id", "group_size", (F.col("low") != F.col("high")).alias("mixed")),
        "exact-groups",
    )
    sure = hashed.join(groups.where(~F.col("mixed")), "h").select("doc_id", "keep_id", "group_size", "sha")
    if groups.where("mixed").isEmpty():
        out = sure
    else:
        out = sure.unionByName(_split(norm, groups.where("mixed").select("h")))
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _split(norm: DataFrame, mixed: DataFrame) -> DataFrame:
    """Groups whose bytes differ under one hash, told apart by the bytes themselves."""
    own = norm.withColumn("h", F.unhex(F.md5("norm"))).join(mixed, "h", "left_semi")
    by_text = own.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return own.join(by_text, ["h", "norm"]).select(
        "doc_id", "keep_id", "group_size", F.unhex(F.sha2("norm", 256)).alias("sha")
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Rows without an id stay.

    A row goes by its id and text: another text under the same id stays.
    """
    rows = docs.select(normalised(F.col("text")).alias("norm"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select(F.col("row.doc_id").alias("doc_id"), F.sha2("norm", 256).alias("text_sha256"), "row")
    gone = exact_groups(docs).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id", "text_sha256")
    return rows.join(gone, ["doc_id", "text_sha256"], "left_anti").select("row.*")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, coalesce(n.doc_id = g.keep_id, false) AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
