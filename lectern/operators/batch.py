"""Operators over a batch of entries: filters, dedup rules, topics, health. One `as_of`, no clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import config as C
from lectern.functions import text as T
from lectern.functions import urls as U
from lectern.operators.scans import in_blocks, running


def fresh(entries: DataFrame, as_of: Column, days: int = C.STALE_DAYS) -> DataFrame:
    """Entries of unknown date or not older than `days`."""
    return entries.where(F.col("published").isNull() | (F.datediff(as_of, "published") <= days))


def active(registry: DataFrame) -> DataFrame:
    """Sources that are still read."""
    return registry.where(~F.coalesce(F.col("reliability") == "dead", F.lit(False)))


def preflight(registry: DataFrame, health: DataFrame, as_of: Column, days: int = C.SOURCE_STALE_DAYS) -> DataFrame:
    """(source_name, stale, reliability): stale where nobody has verified the source for more than `days`, or ever.

    The running state in `health` (source_name, state) counts; a source seen first is seeded with the registry's.
    """
    old = F.coalesce(F.datediff(as_of, "last_verified") > days, F.lit(True))
    return registry.join(health, "source_name", "left").select("source_name", old.alias("stale"), F.coalesce("state", "reliability").alias("reliability"))


def keep_signal(url: Column, words: Column) -> Column:
    host = U.host(url)
    known = F.lit(False)
    for d in C.KEEP_DOMAINS:
        known = known | (host == d) | F.endswith(host, F.lit(f".{d}"))
    return known | words.rlike("(?i)" + "|".join(C.KEEP_PATTERNS))


def noise(url: Column, words: Column) -> Column:
    """A drop pattern without a keep signal."""
    return words.rlike("(?i)" + "|".join(C.DROP_PATTERNS)) & ~keep_signal(url, words)


def dedup_papers(entries: DataFrame, sources: list[str], canonical: str) -> DataFrame:
    """One row of each title among paper sources: the first, unless a later one of another source is canonical.

    The row stays at the place (`slot`) of the first; rows of other sources pass.
    """
    paper = F.col("source_name").isin(sources)
    key = T.title_key(F.col("title"))
    papers = entries.where(paper).withColumn("title_key", key)
    is_canonical = F.endswith(U.host(F.col("url")), F.lit(canonical))
    row = F.struct("pos", "source_name", is_canonical.alias("canonical"))
    first = papers.groupBy("title_key").agg(F.min(row).alias("first"))
    both = papers.join(first, "title_key")
    better = both.where(~F.col("first.canonical") & is_canonical & (F.col("source_name") != F.col("first.source_name")))
    picked = first.join(better.groupBy("title_key").agg(F.min("pos").alias("swap")), "title_key", "left")
    picked = picked.select(F.coalesce("swap", "first.pos").alias("pos"), F.col("first.pos").alias("slot"))
    kept = entries.where(paper).join(picked, "pos")
    return kept.unionByName(entries.where(~paper).withColumn("slot", F.col("pos")))


def dedup_cross_day(entries: DataFrame, index: DataFrame, as_of: Column) -> DataFrame:
    """Entries against the index of URLs seen: `decision` is new, later, re_coverage or drop.

    Later rows of the batch see what the first of their key would have stored, at age 0.
    """
    keyed = entries.withColumn("key", U.index_key(F.col("url")))
    known = index.where(F.datediff(as_of, "first_seen_date") <= C.INDEX_TTL_DAYS)
    known = known.select(F.col("normalized_url").alias("key"), "first_seen_date", "raw_summary_excerpt", F.lit(True).alias("known"))
    first = keyed.groupBy("key").agg(F.min(F.struct("pos", F.substring("summary", 1, C.EXCERPT_CHARS).alias("excerpt"))).alias("first"))
    rows = keyed.join(first, "key").join(known, "key", "left")
    there = F.coalesce("known", F.lit(False))
    excerpt = F.when(there, F.col("raw_summary_excerpt")).otherwise(F.col("first.excerpt"))
    age = F.when(there, F.datediff(as_of, "first_seen_date")).otherwise(0)
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    overlap = T.jaccard(T.tokens(F.col("summary")), T.tokens(excerpt))
    decision = (
        F.when(~there & (F.col("pos") == F.col("first.pos")), "new")
        .when(age > C.INDEX_RECENT_DAYS, "later")
        .when(~empty(F.col("summary")) & ~empty(excerpt) & (overlap <= C.RE_COVERAGE), "re_coverage")
        .otherwise("drop")
    )
    return rows.select("pos", "key", decision.alias("decision"))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest `order` of each key: an aggregate, so that a hot key is reduced early."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("_row")).select(*keys, "_row.*")


def latest_file(rows: DataFrame, key: str, file: str, pos: str = "pos") -> DataFrame:
    """The row of each key whose file name comes last; of rows with one name the first, by the number `pos`."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(file), -F.col(pos))).alias("_row"))
    return last.select("_row.*")


def alike_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of rows (pos, tokens) whose token sets have that Jaccard share, without false negatives.

    Equal sets are compared once. Of each set only the rarest tokens are joined: two sets that are
    alike enough share one of their first |x| - ceil(t |x|) + 1 tokens in any one order.
    """
    sets = rows.where(F.size("tokens") > 0).select("pos", F.array_sort("tokens").alias("tokens"))
    ids = sets.groupBy("tokens").agg(F.min("pos").alias("pos"))
    each = ids.select("pos", F.explode("tokens").alias("token"))
    common = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(common, "token").groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    size = F.size("ranked")
    prefix = F.slice("ranked", F.lit(1), (size - F.ceil(size * percent / 100) + 1).cast("int"))
    heads = ranked.select("pos", F.explode(prefix).alias("head"), size.alias("n")).select("pos", F.col("head.token").alias("token"), "n")
    left, right = heads.toDF("a", "token", "n_a"), heads.toDF("b", "token", "n_b")
    fits = (F.col("a") < F.col("b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    near = left.join(right, "token").where(fits).select("a", "b").distinct()
    own = lambda x: ids.select(F.col("pos").alias(x), F.col("tokens").alias(f"of_{x}"))
    both = near.join(own("a"), "a").join(own("b"), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    links = both.where(100 * shared >= percent * F.size(F.array_union("of_a", "of_b"))).select("a", "b")
    # copies: a star around the first row of each equal set
    copies = sets.join(ids.withColumnRenamed("pos", "a"), "tokens").where("pos <> a").select("a", F.col("pos").alias("b"))
    return links.unionByName(copies)


def trends(rows: DataFrame, least: int = C.TREND_COUNT, days: int = C.TREND_DAYS) -> DataFrame:
    """Per topic with enough rows over enough days: topic_slug, total_count, active_days."""
    known = rows.where(~F.coalesce("topic_slug", F.lit("")).isin("", C.OVERFLOW_TOPIC))
    got = known.groupBy("topic_slug").agg(F.count(F.lit(1)).alias("total_count"), F.count_distinct("doc_date").alias("active_days"))
    return got.where((F.col("total_count") >= least) & (F.col("active_days") >= days))


def top_by_date(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The newest n rows of each key; ties by id. The filter on the rank limits each task's rows early."""
    w = Window.partitionBy(key).orderBy(F.col("doc_date").desc(), F.col("id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def daily_counts(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """Rows a day over a whole calendar, 0 where there are none."""
    days = rows.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("doc_date"))
    counts = rows.where(F.col("doc_date").between(first, last)).groupBy("doc_date").agg(F.count(F.lit(1)).alias("n"))
    return days.join(counts, "doc_date", "left").select("doc_date", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def granularity(assigned: DataFrame, existing: DataFrame) -> DataFrame:
    """New topics with too few rows go to the overflow topic; large ones are marked."""
    counts = assigned.groupBy("topic_slug").agg(F.count(F.lit(1)).alias("held"))
    known = existing.select("topic_slug", F.lit(True).alias("known"))
    topics = counts.join(known, "topic_slug", "left").select("topic_slug", "held", F.coalesce("known", F.lit(False)).alias("known"))
    rows = assigned.join(F.broadcast(topics) if topics.count() <= 10_000 else topics, "topic_slug")
    small = ~F.col("known") & (F.col("held") < C.NEW_TOPIC_MIN)
    return rows.select(
        "id",
        F.when(small, C.OVERFLOW_TOPIC).otherwise(F.col("topic_slug")).alias("topic_slug"),
        (~F.col("known") & ~small & (F.col("topic_slug") != C.OVERFLOW_TOPIC)).alias("is_new"),
        (F.col("held") > C.SPLIT_HINT).alias("split_hint"),
    )


def health_state(failures: Column) -> Column:
    return F.when(failures >= C.DEAD_FAILURES, "dead").when(failures >= C.DEGRADED_FAILURES, "degraded").otherwise("alive")


def failures_so_far(attempts: DataFrame) -> DataFrame:
    """Attempts (source_name, ts, seq, success) with `failures` since the source's last success, and whether there was one (`succeeded`).

    A source with many attempts spreads over tasks: failures are counted along its blocks, less those counted
    at the last success. (ts, seq) tells a source's attempts apart.
    """
    keys, order = ["source_name"], ["ts", "seq"]
    rows = in_blocks(attempts.select(*keys, *order, "success"), keys, order)
    one = lambda x: F.when(x, F.lit(1)).otherwise(F.lit(0)).cast("long")
    ran = running(rows, keys, order, failed=("sum", one(~F.col("success")), 0), passed=("sum", one(F.col("success")), 0))
    ran = running(ran, keys, order, base=("max", F.when(F.col("success"), F.col("failed")), 0))
    return ran.select(*keys, *order, "success", (F.col("failed") - F.col("base")).alias("failures"), (F.col("passed") > 0).alias("succeeded"))


def source_health(attempts: DataFrame) -> DataFrame:
    """After each attempt of a source: failures since its last success, and its state."""
    return failures_so_far(attempts).select("source_name", "seq", "failures", health_state(F.col("failures")).alias("state"))


def current_health(attempts: DataFrame) -> DataFrame:
    """(source_name, failures, state) of each source after its last attempt."""
    at = F.struct("ts", "seq")
    last = attempts.where("success").groupBy(F.col("source_name").alias("name")).agg(F.max(at).alias("last"))
    rows = attempts.join(last, F.col("source_name") == F.col("name"), "left")
    failures = F.count_if(~F.col("success") & (F.col("last").isNull() | (at > F.col("last"))))
    return rows.groupBy("source_name").agg(failures.alias("failures")).withColumn("state", health_state(F.col("failures")))


def digest_lines(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """(pos, line) of a digest's entries: those with a URL, of a registered source, the first of each URL.

    Nothing is made up or merged; the source's name is the registry's own, the blurb is cut by rule.
    `entries`: pos, url, title, source_name, gist.
    """
    known = registry.select("source_name").distinct()
    rows = first_of(entries.where("url <> ''").join(known, "source_name", "left_semi"), ["url"], "pos")
    line = F.concat(F.lit("- **"), "title", F.lit("**（来源："), "source_name", F.lit("）"), T.truncate_blurb(F.col("gist")), F.lit(" "), "url")
    return rows.select("pos", line.alias("line"))


def digest_record(lines: DataFrame, as_of: Column) -> DataFrame:
    """The digest of a run as one document; `digest_lines` has it line by line for runs of any size."""
    own = F.array_sort(F.collect_list(F.struct("pos", "line")))
    body = F.concat(F.array_join(F.transform("own", lambda x: x["line"]), "\n"), F.lit("\n"))
    return lines.agg(F.count(F.lit(1)).alias("entry_count"), own.alias("own")).select(F.concat(F.lit("digest-"), as_of.cast("string")).alias("id"), "entry_count", body.alias("body"))


def classify_daily(is_recap: Column, zettel_id: Column, channel: Column) -> Column:
    noted = zettel_id.isNotNull()
    return (
        F.when(is_recap & noted, "recap_with_zettel")
        .when(is_recap, "recap_not_upgraded")
        .when(noted & (channel == "placeholder"), "has_zettel_original_missing")
        .when(noted, "has_zettel_has_original")
        .otherwise("no_zettel_has_original")
    )


def paged(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of documents, latest day first, then latest update, then id; `total` counts all. Past the end there is no row."""
    page = rows.orderBy(F.col("doc_date").desc_nulls_last(), F.col("updated").desc_nulls_last(), "id").offset(offset).limit(limit)
    return page.withColumn("total", rows.agg(F.count(F.lit(1))).scalar())


def daily_marker(kind: Column) -> Column:
    """What a daily page's line shows for its class; null for another class."""
    return F.create_map(*[F.lit(x) for pair in C.DAILY_MARKERS.items() for x in pair])[kind]
