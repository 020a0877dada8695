"""A batch through all filters in their order, what became of each entry, and figures that must add up.

The figures are counted from the written fates and not from observed metrics: those count a task's rows twice when a
lost executor makes it run again, and the check would then raise on a sound run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import batch as B
from lectern.operators.folds import cut
from lectern.operators.same_batch import dedup_same_batch

#: Where an entry may be dropped, in the order of the filters.
STAGES = ("same_batch", "papers", "stale", "noise", "cross_day")


def fates(entries: DataFrame, index: DataFrame, as_of: Column, paper_sources: list[str], canonical: str) -> DataFrame:
    """(pos, fate): the filter that dropped an entry, or `kept`.

    `pos` is an entry's own number and unique. An entry that takes an earlier one's slot is judged at that place by the rules that follow.
    Entries without words are no noise; those of unknown date aren't stale.
    """
    rows = entries.select("pos", "url", "title", "summary", "source_name", "published", "low_confidence")
    left = {"same_batch": cut(rows.join(dedup_same_batch(rows), "pos").withColumn("entry", F.col("pos")).withColumn("pos", F.col("slot")).drop("slot"))}
    left["papers"] = cut(B.dedup_papers(left["same_batch"], paper_sources, canonical).withColumn("pos", F.col("slot")).drop("slot"))
    left["stale"] = B.fresh(left["papers"], as_of)
    left["noise"] = left["stale"].where(~F.coalesce(B.noise(F.col("url"), F.concat_ws(" ", "title", "summary")), F.lit(False)))
    passed = B.dedup_cross_day(left["noise"], index, as_of).where("decision <> 'drop'").select("pos")
    left["cross_day"] = left["noise"].join(passed, "pos", "left_semi")
    # how many filters an entry passed: a row a filter, reduced by entry
    steps = rows.select(F.col("pos").alias("entry"), F.lit(0).alias("passed"))
    for n, stage in enumerate(STAGES, 1):
        steps = steps.unionByName(left[stage].select("entry", F.lit(n).alias("passed")))
    fate = F.element_at(F.array(*map(F.lit, (*STAGES, "kept"))), F.max("passed") + 1)
    return steps.groupBy(F.col("entry").alias("pos")).agg(fate.alias("fate"))


def audited(entries: DataFrame, told: DataFrame) -> DataFrame:
    """One row: total, kept and the dropped of each filter; it raises where an entry has no fate, several, or never came."""
    both = entries.select("pos", F.lit(1).alias("came"), F.lit(None).cast("string").alias("fate")).unionByName(told.select("pos", F.lit(0).alias("came"), "fate"))
    each = both.groupBy("pos").agg(F.sum("came").alias("came"), F.count("fate").alias("told"), F.max("fate").alias("fate"))
    wrong = F.count_if((F.col("came") != 1) | (F.col("told") != 1) | ~F.coalesce(F.col("fate").isin(*STAGES, "kept"), F.lit(False)))
    got = each.agg(F.coalesce(F.sum("came"), F.lit(0)).alias("total"), wrong.alias("wrong"), *[F.count_if(F.col("fate") == x).alias(x) for x in ("kept", *STAGES)])
    sound = F.when(F.col("wrong") > 0, F.raise_error(F.format_string("%d entries have not exactly one fate", "wrong"))).otherwise(F.col("total"))
    return got.withColumn("total", sound.cast("long")).drop("wrong")


def run_figures(attempts: DataFrame, entries: DataFrame, told: DataFrame, enriched: DataFrame, records: DataFrame) -> DataFrame:
    """One row for a run: sources_attempted, sources_failed, fetched, kept, enrich_failed, written.

    `attempts` (source_name, success): a source failed if no attempt succeeded. `enriched` (pos, ok) has the kept entries; it
    raises where it has another one, misses one or has one twice. `records` has a row a document written.
    """
    sources = attempts.groupBy("source_name").agg(F.bool_or("success").alias("ok"))
    kept = told.where("fate = 'kept'").select("pos", F.lit(1).alias("kept"), F.lit(0).alias("tried"), F.lit(0).alias("failed"))
    tried = enriched.select("pos", F.lit(0).alias("kept"), F.lit(1).alias("tried"), F.when(F.col("ok"), 0).otherwise(1).alias("failed"))
    each = kept.unionByName(tried).groupBy("pos").agg(*[F.sum(x).alias(x) for x in ("kept", "tried", "failed")])
    wrong = F.count_if((F.col("kept") != 1) | (F.col("tried") != 1))
    failed = F.when(wrong > 0, F.raise_error(F.format_string("%d entries were kept and not enriched once, or not kept", wrong))).otherwise(F.coalesce(F.sum("failed"), F.lit(0)))
    counted = {
        "sources_attempted": sources.agg(F.count(F.lit(1)).alias("n")),
        "sources_failed": sources.agg(F.count_if(~F.coalesce("ok", F.lit(False))).alias("n")),
        "fetched": entries.agg(F.count(F.lit(1)).alias("n")),
        "kept": told.agg(F.count_if(F.col("fate") == "kept").alias("n")),
        "enrich_failed": each.agg(failed.cast("long").alias("n")),
        "written": records.agg(F.count(F.lit(1)).alias("n")),
    }
    rows = None
    for name, one in counted.items():
        one = one.select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.max(F.when(F.col("name") == x, F.col("n"))).alias(x) for x in counted])
