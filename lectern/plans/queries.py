"""Queries over the provided tables, one a rule or read, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern import config as C
from lectern.functions import text as T
from lectern.functions import urls as U
from lectern.operators import batch as B
from lectern.operators import search as S
from lectern.operators import store as K
from lectern.operators import text_index as I
from lectern.operators.folds import parts_for, shared_dir
from lectern.plans import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *ctes: str):
    if name in QUERIES:
        raise ValueError(f"two queries are named {name}")

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return function

    return add


def scalar(name: str, view, key: str, made, cte: str, sql: str):
    """A query of one computed column `value` beside the row's key."""
    source = cte.split(" ", 1)[0]
    query(name, f"SELECT {key}, {sql} AS value FROM {source}", cte)(lambda spark, sf_dir: view(spark, sf_dir).select(key, made().alias("value")))


c = F.col
CJK_SQL = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7A3}]"
HAN_SQL = r"[\x{4E00}-\x{9FFF}]"
_cjk = lambda x: f"(CASE WHEN length({x}) = 0 THEN 0.0::DOUBLE ELSE (length({x}) - length(regexp_replace({x}, '{CJK_SQL}', '', 'g')))::DOUBLE / length({x}) END)"
_bare = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, '(?s)```.*?```', '', 'g'), 'https?://\\S+', '', 'g'), '{C.MEDIA_SCHEME}\\S+', '', 'g')"
_tokens = lambda x: f"(CASE WHEN len(regexp_extract_all({x}, '{HAN_SQL}')) > 0 THEN list_filter(list_distinct(regexp_extract_all({x}, '{HAN_SQL}')), lambda t: t NOT IN ({V.quoted(C.STOP_ZH)})) ELSE list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')), lambda t: t NOT IN ({V.quoted(C.STOP_EN)})) END)"
_jaccard = lambda a, b: f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"
_lines = lambda x: f"string_split({x}, chr(10))"
_noise = f"regexp_matches(l, '[^\\s]') AND NOT regexp_matches(l, '[A-Za-z]{{3,}}|{HAN_SQL}{{2,}}')"
_reference = f"trim(l) <> '' AND trim(l) <> '-' AND regexp_matches(l, '(?i)({C.REFERENCE}|{C.ET_AL})')"
_share = lambda part, whole: f"(CASE WHEN len({whole}) = 0 THEN 0.0::DOUBLE ELSE len({part})::DOUBLE / len({whole}) END)"
_own = "list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^\\s]'))"
_ratio_clean_text = f"array_to_string(list_filter({_lines(_bare('body'))}, lambda l: NOT ({_noise})), chr(10))"
_clean = f"(SELECT CASE WHEN length(regexp_replace(b, '\\s', '', 'g')) = 0 THEN 0.0::DOUBLE ELSE (length(b) - length(regexp_replace(b, '{CJK_SQL}', '', 'g')))::DOUBLE / length(regexp_replace(b, '\\s', '', 'g')) END FROM (SELECT {_ratio_clean_text} AS b))"
_residue = "regexp_matches(body, 'ltx_|<td[\\s>]|<tr[\\s>]|class=\"ltx')"

# --- scalar rules
scalar("norm_url_index", V.entries, "pos", lambda: U.index_key(c("url")), V.ENTRIES, V.KEY("url"))
scalar("norm_host_path", V.entries, "pos", lambda: U.host_path(c("url")), V.ENTRIES, V.HOST_PATH("url"))
scalar("tokens", V.rich, "doc_id", lambda: F.size(T.tokens(c("body"))).cast("long"), V.RICH, f"len({_tokens('body')})")
scalar("jaccard", V.entries, "pos", lambda: T.jaccard(T.tokens(c("title")), T.tokens(c("summary"))), V.ENTRIES, _jaccard(_tokens("title"), _tokens("summary")))
scalar("paper_title_key", V.entries, "pos", lambda: T.title_key(c("title")), V.ENTRIES, r"trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))")
scalar("cjk_ratio", V.rich, "doc_id", lambda: T.cjk_ratio(c("body")), V.RICH, _cjk("body"))
scalar("needs_translation", V.rich, "doc_id", lambda: T.needs_translation(c("title"), c("body")), V.RICH, f"NOT ({_cjk('title')} > 0 OR {_cjk('substr(body, 1, 500)')} > 0.3)")
scalar("strip_code_links", V.rich, "doc_id", lambda: F.sha2(T.strip_code_links(c("body")), 256), V.RICH, f"sha256({_bare('body')})")
scalar("code_fraction", V.rich, "doc_id", lambda: T.code_fraction(c("body")), V.RICH, f"CASE WHEN length(body) = 0 THEN 0.0::DOUBLE ELSE 1 - length({_bare('body')})::DOUBLE / length(body) END")
scalar("word_count", V.rich, "doc_id", lambda: T.word_count(c("body")), V.RICH, f"length(regexp_replace({_bare('body')}, '\\s', '', 'g'))")
scalar("noise_line", V.rich, "doc_id", lambda: F.size(F.filter(F.split("body", "\n", -1), T.noise_line)).cast("long"), V.RICH, f"len(list_filter({_lines('body')}, lambda l: {_noise}))")
scalar("mostly_noise", V.rich, "doc_id", lambda: T.noise_share(c("body")) >= C.NOISE_SHARE, V.RICH, f"{_share(f'list_filter({_own}, lambda l: {_noise})', _own)} >= 0.95")
scalar("reference_line", V.rich, "doc_id", lambda: F.size(F.filter(F.split("body", "\n", -1), T.reference_line)).cast("long"), V.RICH, f"len(list_filter({_lines('body')}, lambda l: {_reference}))")
scalar("mostly_references", V.rich, "doc_id", lambda: T.reference_share(c("body")) >= C.REFERENCE_SHARE, V.RICH, _share(f"list_filter({_own}, lambda l: {_reference})", f"list_filter({_own}, lambda l: trim(l) <> '-')") + " >= 0.3")
scalar("fallback_tail", V.rich, "doc_id", lambda: F.sha2(T.fallback_tail(F.split("body", "\n", -1)), 256), V.RICH, f"(SELECT sha256(r[-1]) FROM (SELECT list_filter({_lines('body')}[2:], lambda l: NOT ({_reference})) AS r) WHERE len(r) > 0)")
scalar("cjk_ratio_clean", V.rich, "doc_id", lambda: T.cjk_ratio_clean(c("body")), V.RICH, _clean)
scalar("residue", V.rich, "doc_id", lambda: T.has_residue(c("body")), V.RICH, _residue)
scalar("translation_complete", V.rich, "doc_id", lambda: T.translation_complete(c("body")), V.RICH, f"NOT {_residue} AND {_clean} >= 0.5")
scalar("content_hash", V.rich, "doc_id", lambda: F.sha2("body", 256), V.RICH, "sha256(body)")
scalar("original_id", V.entries, "pos", lambda: T.original_id(c("url")), V.ENTRIES, "'original-' || substr(sha256(url), 1, 12)")
scalar("slugify", V.entries, "pos", lambda: T.slugify(c("title"), c("url")), V.ENTRIES, "CASE WHEN len(regexp_extract_all(lower(title), '[a-z0-9]+')) > 0 THEN array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+')[:5], '-') ELSE 'untitled-' || substr(sha256(url), 1, 8) END")
scalar("humanize_slug", V.originals, "id", lambda: T.humanize_slug(c("topic_slug")), V.ORIGINALS, "array_to_string(list_transform(string_split(topic_slug, '-'), lambda p: upper(p[1]) || lower(p[2:])), ' ')")
scalar("topic_heading", V.originals, "id", lambda: T.topic_heading(c("topic_slug")), V.ORIGINALS, f"'## ' || map([{V.quoted(C.TOPIC_MARKS)}], [{V.quoted(C.TOPIC_MARKS.values())}])[topic_slug] || ' ' || map([{V.quoted(C.TOPIC_LABELS)}], [{V.quoted(C.TOPIC_LABELS.values())}])[topic_slug] || ' [[' || topic_slug || ']]'")
scalar("fallback_notice", V.entries, "pos", lambda: T.fallback_notice(F.element_at(F.array(*map(F.lit, ("jina", "playwright", "placeholder", "direct"))), (c("pos") % 4 + 1).cast("int")), F.when(c("pos") % 3 == 0, "x")), V.ENTRIES, f"nullif(concat_ws('；', map([{V.quoted(C.CHANNEL_NOTICES)}], [{V.quoted(C.CHANNEL_NOTICES.values())}])[(['jina', 'playwright', 'placeholder', 'direct'])[pos % 4 + 1]], CASE WHEN pos % 3 = 0 THEN 'x' END), '')")
scalar("dedup_paragraphs", V.rich, "doc_id", lambda: F.sha2(T.dedup_paragraphs(c("body")), 256), V.RICH, "(SELECT sha256(string_agg(p, chr(10) || chr(10) ORDER BY i)) FROM (SELECT p, i, row_number() OVER (PARTITION BY trim(p) ORDER BY i) AS n FROM (SELECT unnest(string_split(body, chr(10) || chr(10))) AS p, generate_subscripts(string_split(body, chr(10) || chr(10)), 1) AS i)) WHERE n = 1 OR length(trim(p)) < 40)")
scalar("fulltext_url", V.entries, "pos", lambda: T.fulltext_url(F.concat(F.lit("https://arxiv.org/"), F.when(c("pos") % 2 == 0, "abs/").otherwise("pdf/"), c("pos").cast("string"), F.lit("/"))), V.ENTRIES, "CASE WHEN pos % 2 = 0 THEN 'https://arxiv.org/html/' || pos END")
scalar("fulltext_pending", V.entries, "pos", lambda: T.fulltext_pending(F.concat(F.lit("https://arxiv.org/"), F.when(c("pos") % 2 == 0, "abs/").otherwise("pdf/"), c("pos").cast("string")), F.when(c("pos") % 3 == 0, True).when(c("pos") % 3 == 1, False)), V.ENTRIES, "CASE WHEN pos % 2 = 0 THEN pos % 3 <> 0 END")
scalar("translate_timeout", V.rich, "doc_id", lambda: T.translate_timeout(F.ceil(F.length("body") / 2000)), V.RICH, "least(greatest(300 + 30 * CAST(ceil(length(body) / 2000.0) AS BIGINT), 1800), 5400)")
scalar("markdown_plain", V.rich, "doc_id", lambda: F.sha2(T.markdown_plain(c("body")), 256), V.RICH, r"sha256(regexp_replace(regexp_replace(body, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'))")
scalar("excerpt90", V.originals, "id", lambda: T.excerpt(c("gist")), V.ORIGINALS, "CASE WHEN length(gist) > 90 THEN substr(gist, 1, 90) || '…' ELSE gist END")
scalar("doc_href", V.originals, "id", lambda: T.doc_href(c("doc_type"), c("id")), V.ORIGINALS, "'/' || CASE doc_type WHEN 'daily' THEN 'daily' WHEN 'topic' THEN 'topics' WHEN 'zettel' THEN 'zettel' WHEN 'digest' THEN 'digest' WHEN 'deep_dive' THEN 'deep-dive' ELSE 'originals' END || '/' || id")
scalar("rewrite_media", V.rich, "doc_id", lambda: F.sha2(F.replace("body", F.lit(C.MEDIA_SCHEME), F.lit("/media/")), 256), V.RICH, f"sha256(replace(body, '{C.MEDIA_SCHEME}', '/media/'))")
scalar("strip_nul", V.entries, "pos", lambda: T.strip_nul(c("title")), V.ENTRIES, "title")
_even = lambda x: f"(CASE WHEN len(string_split({x}, '**')) % 2 = 0 THEN substr({x}, 1, length({x}) - strpos(reverse({x}), '**') - 1) ELSE {x} END)"
# gists with full stops of another kind, so that a cut finds one
_BLURB = f"(SELECT CASE WHEN length(g) <= 120 THEN g WHEN strpos(t, '。') > 1 THEN {_even('u')} ELSE {_even('v')} || '…' END FROM (SELECT g, t, substr(t, 1, 121 - strpos(reverse(t), '。')) AS u, rtrim(t, E' \\n\\t') AS v FROM (SELECT g, substr(g, 1, 120) AS t FROM (SELECT regexp_replace(gist, '\\. ', '。', 'g') AS g))))"
scalar("truncate_blurb", V.originals, "id", lambda: T.truncate_blurb(F.regexp_replace("gist", "\\. ", "。")), V.ORIGINALS, _BLURB)
_raw = "CASE pos % 6 WHEN 0 THEN pos || ' days ago' WHEN 1 THEN (pos % 60) || ' hours ago' WHEN 2 THEN '昨天' WHEN 3 THEN (pos % 9) || '天前' WHEN 4 THEN 'on 2026-01-' || lpad(CAST(pos % 28 + 1 AS VARCHAR), 2, '0') ELSE 'no date' END"


def _raw_date():
    s = lambda x: x.cast("string")
    p = c("pos")
    return (
        F.when(p % 6 == 0, F.concat(s(p), F.lit(" days ago"))).when(p % 6 == 1, F.concat(s(p % 60), F.lit(" hours ago"))).when(p % 6 == 2, "昨天")
        .when(p % 6 == 3, F.concat(s(p % 9), F.lit("天前"))).when(p % 6 == 4, F.concat(F.lit("on 2026-01-"), F.lpad(s(p % 28 + 1), 2, "0"))).otherwise("no date")
    )


scalar("flex_date", V.entries, "pos", lambda: T.flexible_date(_raw_date(), V.as_of()), V.ENTRIES, "CASE pos % 6 WHEN 0 THEN DATE '2026-07-05' - CAST(pos AS INTEGER) WHEN 1 THEN DATE '2026-07-05' - CAST(pos % 60 // 24 AS INTEGER) WHEN 2 THEN DATE '2026-07-04' WHEN 3 THEN DATE '2026-07-05' - CAST(pos % 9 AS INTEGER) WHEN 4 THEN DATE '2026-01-01' + CAST(pos % 28 AS INTEGER) END")
scalar("low_confidence", V.entries, "pos", lambda: (F.trim("url") == "") | (F.trim("title") == "") | (F.trim("summary") == "") | c("published").isNull() | F.coalesce(c("published") > F.date_add(V.as_of(), 1), F.lit(False)), V.ENTRIES, "trim(url) = '' OR trim(title) = '' OR trim(summary) = '' OR published IS NULL OR coalesce(published > DATE '2026-07-06', false)")
scalar("src_listing_html", lambda s, d: V.table(s, d, "pages"), "page_id", lambda: F.sha2(F.substring(F.regexp_replace("html", r"(?is)<(script|style|noscript|svg)\b[^>]*>.*?</\1>", ""), 1, 40000), 256), "pages_ AS (SELECT * FROM pages)", "sha256(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style>', '', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript>', '', 'g'), '(?is)<svg\\b[^>]*>.*?</svg>', '', 'g'), 1, 40000))")


@query("completeness", "SELECT pos, published IS NOT NULL AS has_date, length(summary) AS summary_length, NOT low_confidence AS sure FROM entries", V.ENTRIES)
def _(spark, sf_dir):
    return V.entries(spark, sf_dir).select("pos", c("published").isNotNull().alias("has_date"), F.length("summary").cast("long").alias("summary_length"), (~c("low_confidence")).alias("sure"))


_links_of = r"list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(body, '(?s)```.*?```', '', 'g'), '`[^`\n]*`', '', 'g'), '\[\[([^\]|#\n]+)(?:#[^\]|\n]*)?(?:\|[^\]\n]*)?\]\]', 1), lambda t: trim(t)), lambda t: t <> '')"


@query("wikilinks", f"SELECT doc_id, unnest({_links_of}) AS target FROM rich", V.RICH)
def wikilinks(spark, sf_dir):
    return V.rich(spark, sf_dir).select("doc_id", F.explode(T.wikilinks(c("body"))).alias("target"))


@query("join_wikilink_resolve", f"SELECT w.doc_id, w.target, d.doc_id IS NOT NULL AS found FROM (SELECT doc_id, unnest({_links_of}) AS target FROM rich) w LEFT JOIN documents d ON w.target = 'note-' || d.doc_id", V.RICH)
def _(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(F.concat(F.lit("note-"), c("doc_id").cast("string")).alias("target"), F.lit(True).alias("there"))
    return wikilinks(spark, sf_dir).join(docs, "target", "left").select("doc_id", "target", F.coalesce("there", F.lit(False)).alias("found"))


@query("cited_ids", f"SELECT doc_id, list_sort(list_filter(['note-1', 'note-2', 'topic-3', 'gone'], lambda t: list_contains({_links_of}, t))) AS cited FROM rich", V.RICH)
def _(spark, sf_dir):
    valid = F.array(*map(F.lit, ("note-1", "note-2", "topic-3", "gone")))
    return V.rich(spark, sf_dir).select("doc_id", F.array_sort(F.array_intersect(valid, T.wikilinks(c("body")))).alias("cited"))


# --- filters and dedup
_words = "title || ' ' || summary"
_drop = "|".join(C.DROP_PATTERNS).replace("'", "''")
_keep = f"({V.HOST('url')} IN ({V.quoted(C.KEEP_DOMAINS)}) OR {' OR '.join(f'ends_with({V.HOST(chr(117) + chr(114) + chr(108))}, {chr(39)}.{d}{chr(39)})' for d in C.KEEP_DOMAINS)} OR regexp_matches({_words}, '(?i){'|'.join(C.KEEP_PATTERNS)}'))"


@query("filter_staleness", "SELECT pos FROM entries WHERE published IS NULL OR DATE '2026-07-05' - published <= 14", V.ENTRIES)
def _(spark, sf_dir):
    return B.fresh(V.entries(spark, sf_dir), V.as_of()).select("pos")


@query("filter_noise", f"SELECT pos FROM entries WHERE NOT (regexp_matches({_words}, '(?i){_drop}') AND NOT {_keep})", V.ENTRIES)
def _(spark, sf_dir):
    return V.entries(spark, sf_dir).where(~B.noise(c("url"), F.concat_ws(" ", "title", "summary"))).select("pos")


@query("keep_signal", f"SELECT pos, {_keep} AS value FROM entries", V.ENTRIES)
def _(spark, sf_dir):
    return V.entries(spark, sf_dir).select("pos", B.keep_signal(c("url"), F.concat_ws(" ", "title", "summary")).alias("value"))


@query("filter_audit", "SELECT count(*) AS total, count(*) FILTER (published IS NULL OR DATE '2026-07-05' - published <= 14) AS kept, count(*) FILTER (DATE '2026-07-05' - published > 14) AS dropped FROM entries", V.ENTRIES)
def _(spark, sf_dir):
    old = F.coalesce(F.datediff(V.as_of(), "published") > C.STALE_DAYS, F.lit(False))
    return V.entries(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(~old).alias("kept"), F.count_if(old).alias("dropped"))


@query("date_window", "SELECT id FROM originals WHERE doc_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'", V.ORIGINALS)
def _(spark, sf_dir):
    return V.originals(spark, sf_dir).where(c("doc_date").between("2024-01-08", "2024-01-14")).select("id")


@query("json_path_eq", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '69'")
def _(spark, sf_dir):
    return V.table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k") == "69").select("event_id")


@query("distinct_field_count", "SELECT count(DISTINCT json_extract_string(props, '$.k')) AS n FROM events")
def _(spark, sf_dir):
    return V.table(spark, sf_dir, "events").agg(F.count_distinct(F.get_json_object("props", "$.k")).alias("n"))


@query("suffix_latest", "SELECT s.slug, arg_max(o.id || '-' || o.topic_slug, (o.doc_date, o.id)) AS id FROM originals o JOIN (SELECT DISTINCT topic_slug AS slug FROM originals) s ON ends_with(o.id || '-' || o.topic_slug, '-' || s.slug) GROUP BY s.slug", V.ORIGINALS)
def _(spark, sf_dir):
    """A slug is a run of an id's last dash-separated parts, so the ends of each id are joined by equality."""
    rows = V.originals(spark, sf_dir).select(F.concat_ws("-", "id", "topic_slug").alias("full"), "doc_date", "id")
    parts = F.split("full", "-")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "-"))
    slugs = V.originals(spark, sf_dir).select(c("topic_slug").alias("slug")).distinct()
    return rows.select("full", "doc_date", "id", F.explode(ends).alias("slug")).join(slugs, "slug").groupBy("slug").agg(F.max_by("full", F.struct("doc_date", "id")).alias("id"))


@query(
    "dedup_papers",
    rf"""SELECT pos, slot FROM (SELECT p.*, first_pos AS slot FROM p JOIN (
      SELECT k, first_pos, coalesce((SELECT min(q.pos) FROM p q WHERE q.k = f.k AND NOT f.canon AND q.canon AND q.source_name <> f.source_name), first_pos) AS chosen
      FROM (SELECT k, min(pos) AS first_pos, arg_min(canon, pos) AS canon, arg_min(source_name, pos) AS source_name FROM p GROUP BY k) f) g ON p.pos = g.chosen)
      UNION ALL SELECT pos, pos FROM entries WHERE source_name NOT IN ('source-0', 'source-1')""",
    V.ENTRIES,
    rf"p AS (SELECT pos, source_name, trim(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS k, ends_with({V.HOST('url')}, '.example.com') AS canon FROM entries WHERE source_name IN ('source-0', 'source-1'))",
)
def _(spark, sf_dir):
    return B.dedup_papers(V.entries(spark, sf_dir), V.PAPERS, V.CANONICAL).select("pos", "slot")


@query(
    "dedup_cross_day",
    f"""SELECT pos, key, CASE WHEN i.normalized_url IS NULL AND pos = first_pos THEN 'new' WHEN coalesce(DATE '2026-07-05' - i.first_seen_date, 0) > 7 THEN 'later'
      WHEN summary <> '' AND excerpt <> '' AND {_jaccard(_tokens('summary'), _tokens('excerpt'))} <= 0.6 THEN 're_coverage' ELSE 'drop' END AS decision
      FROM (SELECT e.*, i.*, CASE WHEN i.normalized_url IS NULL THEN first_excerpt ELSE i.raw_summary_excerpt END AS excerpt
        FROM (SELECT pos, summary, {V.KEY('url')} AS key, first_value(pos) OVER w AS first_pos, first_value(substr(summary, 1, 200)) OVER w AS first_excerpt FROM entries WINDOW w AS (PARTITION BY {V.KEY('url')} ORDER BY pos)) e
        LEFT JOIN (SELECT * FROM url_index WHERE DATE '2026-07-05' - first_seen_date <= 30) i ON e.key = i.normalized_url) i""",
    V.ENTRIES,
    V.URL_INDEX,
)
def _(spark, sf_dir):
    return B.dedup_cross_day(V.entries(spark, sf_dir), V.url_index(spark, sf_dir), V.as_of())


@query("dedup_digest", "SELECT url, min(pos) AS pos FROM entries WHERE url <> '' AND source_name <> 'source-3' GROUP BY url", V.ENTRIES)
def _(spark, sf_dir):
    known = registry(spark, sf_dir).where("reliability <> 'dead'").select("source_name")
    rows = V.entries(spark, sf_dir).where("url <> ''").join(known, "source_name", "left_semi")
    return B.first_of(rows.select("url", "pos"), ["url"], "pos")


@query("dedup_latest_file", "SELECT source_name, pos, 'page-' || lpad(CAST(pos * 7919 % 10007 AS VARCHAR), 5, '0') || '.md' AS file FROM entries QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY file DESC) = 1", V.ENTRIES)
def _(spark, sf_dir):
    name = F.concat(F.lit("page-"), F.lpad((c("pos") * 7919 % 10007).cast("string"), 5, "0"), F.lit(".md"))
    return B.latest_file(V.entries(spark, sf_dir).select("source_name", "pos", name.alias("file")), "source_name", "file")


def registry(spark, sf_dir):
    """Sources by name, one for each supplier; the first seven are those of the entries."""
    i = c("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("stable", "degraded", "unknown", "dead"))), (i % 4 + 1).cast("int"))
    seen = F.when(i % 7 != 6, F.date_sub(V.as_of(), (i * 10 % 90).cast("int")))
    return V.table(spark, sf_dir, "supplier").select(F.concat(F.lit("source-"), i.cast("string")).alias("source_name"), kind.alias("reliability"), seen.alias("last_verified"))


_REGISTRY = "registry AS (SELECT 'source-' || s_suppkey AS source_name, (['stable', 'degraded', 'unknown', 'dead'])[s_suppkey % 4 + 1] AS reliability, CASE WHEN s_suppkey % 7 <> 6 THEN DATE '2026-07-05' - CAST(s_suppkey * 10 % 90 AS INTEGER) END AS last_verified FROM supplier)"


@query("src_registry_active", "SELECT * FROM registry WHERE reliability <> 'dead'", _REGISTRY)
def _(spark, sf_dir):
    return B.active(registry(spark, sf_dir))


@query("degraded_demote", "SELECT pos, low_confidence OR reliability = 'degraded' AS low_confidence FROM entries JOIN registry USING (source_name)", V.ENTRIES, _REGISTRY)
def _(spark, sf_dir):
    return V.entries(spark, sf_dir).join(registry(spark, sf_dir), "source_name").select("pos", (c("low_confidence") | (c("reliability") == "degraded")).alias("low_confidence"))


_HEALTH = f"""health AS (SELECT 'source-' || source_name AS source_name, CASE WHEN f >= 3 THEN 'dead' WHEN f >= 1 THEN 'degraded' ELSE 'alive' END AS state
 FROM (SELECT a.source_name, count(*) FILTER (NOT success AND (last IS NULL OR (ts, seq) > last)) AS f FROM attempts a JOIN (SELECT source_name, max((ts, seq)) FILTER (success) AS last FROM attempts GROUP BY 1) USING (source_name) GROUP BY 1))"""


@query("preflight_stale", "SELECT source_name, coalesce(DATE '2026-07-05' - last_verified > 30, true) AS stale, coalesce(state, reliability) AS reliability FROM registry LEFT JOIN health USING (source_name)", _REGISTRY, V.ATTEMPTS, _HEALTH)
def _(spark, sf_dir):
    health = B.current_health(V.attempts(spark, sf_dir)).select(F.concat(F.lit("source-"), c("source_name").cast("string")).alias("source_name"), "state")
    return B.preflight(registry(spark, sf_dir), health, V.as_of())


@query("script_stats", "SELECT source_name, count(*) AS n, count(*) FILTER (summary <> '') AS with_summary FROM entries GROUP BY source_name", V.ENTRIES)
def _(spark, sf_dir):
    return V.entries(spark, sf_dir).groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("summary") != "").alias("with_summary"))


@query("src_table_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")


@query(
    "sim_self_join",
    f"SELECT x.pos AS a, y.pos AS b FROM t x JOIN t y ON x.pos < y.pos AND 100 * len(list_intersect(x.k, y.k)) >= 85 * len(list_distinct(list_concat(x.k, y.k))) WHERE len(x.k) > 0 AND len(y.k) > 0 AND (list_sort(x.k) <> list_sort(y.k) AND x.first AND y.first OR list_sort(x.k) = list_sort(y.k) AND x.first)",
    V.ENTRIES,
    f"s AS (SELECT pos, {_tokens('title')} AS k FROM entries)",
    "t AS (SELECT *, row_number() OVER (PARTITION BY list_sort(k) ORDER BY pos) = 1 AS first FROM s)",
)
def _(spark, sf_dir):
    return B.alike_pairs(V.entries(spark, sf_dir).select("pos", T.tokens(c("title")).alias("tokens")), C.TITLE_ALIKE_PERCENT)


# --- aggregates, windows, reads
@query("topic_trends", "SELECT topic_slug, count(*) AS total_count, count(DISTINCT doc_date) AS active_days FROM originals WHERE topic_slug <> 'uncategorized' GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT doc_date) >= 2 ORDER BY 2 DESC, 1 LIMIT 8", V.ORIGINALS)
def topic_trends(spark, sf_dir):
    return B.trends(V.originals(spark, sf_dir)).orderBy(c("total_count").desc(), "topic_slug").limit(C.TREND_TOP)


@query("monthly_candidates", "SELECT topic_slug, count(*) AS total_count, count(DISTINCT doc_date) AS active_days FROM originals WHERE topic_slug <> 'uncategorized' GROUP BY 1 HAVING count(*) >= 8 AND count(DISTINCT doc_date) >= 4", V.ORIGINALS)
def _(spark, sf_dir):
    return B.trends(V.originals(spark, sf_dir), C.MONTH_COUNT, C.MONTH_DAYS)


@query("daily_counts", "SELECT d::DATE AS doc_date, count(o.id) AS n FROM generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY) t(d) LEFT JOIN originals o ON o.doc_date = d::DATE GROUP BY 1", V.ORIGINALS)
def _(spark, sf_dir):
    return B.daily_counts(V.originals(spark, sf_dir), F.to_date(F.lit("2023-12-25")), F.to_date(F.lit("2024-02-05")))


@query(
    "granularity",
    "SELECT id, CASE WHEN small THEN 'uncategorized' ELSE slug END AS topic_slug, NOT known AND NOT small AND slug <> 'uncategorized' AS is_new, held > 8 AS split_hint FROM (SELECT *, NOT known AND held < 3 AS small FROM (SELECT id, slug, slug IN ('agents', 'new-3') AS known, count(*) OVER (PARTITION BY slug) AS held FROM (SELECT id, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'new-' || (CAST(id AS BIGINT) % 400) ELSE topic_slug END AS slug FROM originals)))",
    V.ORIGINALS,
)
def _(spark, sf_dir):
    n = c("id").cast("long")
    rows = V.originals(spark, sf_dir).select("id", F.when(n % 5 == 0, F.concat(F.lit("new-"), (n % 400).cast("string"))).otherwise(c("topic_slug")).alias("topic_slug"))
    return B.granularity(rows, spark.createDataFrame([("agents",), ("new-3",)], "topic_slug string"))


@query("daily_stats", "SELECT doc_date, count(*) AS processed, count(DISTINCT topic_slug) AS topics, count(*) FILTER (doc_type = 'zettel') AS notes FROM originals GROUP BY doc_date", V.ORIGINALS)
def _(spark, sf_dir):
    return V.originals(spark, sf_dir).groupBy("doc_date").agg(F.count(F.lit(1)).alias("processed"), F.count_distinct("topic_slug").alias("topics"), F.count_if(c("doc_type") == "zettel").alias("notes"))


@query("group_by_topic", "SELECT doc_date, topic_slug, string_agg('- [[' || id || ']]', chr(10) ORDER BY CAST(id AS BIGINT)) AS lines FROM originals GROUP BY 1, 2", V.ORIGINALS)
def _(spark, sf_dir):
    line = F.struct(c("id").cast("long").alias("pos"), F.concat(F.lit("- [["), c("id"), F.lit("]]")).alias("line"))
    got = V.originals(spark, sf_dir).groupBy("doc_date", "topic_slug").agg(F.array_sort(F.collect_list(line)).alias("own"))
    return got.select("doc_date", "topic_slug", F.array_join(F.transform("own", lambda x: x["line"]), "\n").alias("lines"))


@query("count_by_type", "SELECT doc_type, count(*) AS n FROM originals GROUP BY 1", V.ORIGINALS)
def _(spark, sf_dir):
    return V.originals(spark, sf_dir).groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))


@query("max_doc_date", "SELECT doc_type, max(doc_date) AS latest FROM originals GROUP BY 1", V.ORIGINALS)
def _(spark, sf_dir):
    return V.originals(spark, sf_dir).groupBy("doc_type").agg(F.max("doc_date").alias("latest"))


@query("distinct_topics_unnest", "SELECT count(DISTINCT t) AS n FROM (SELECT unnest(string_split(topic_slug, '-')) AS t FROM originals)", V.ORIGINALS)
def _(spark, sf_dir):
    return V.originals(spark, sf_dir).select(F.explode(F.split("topic_slug", "-")).alias("t")).agg(F.count_distinct("t").alias("n"))


@query("backlink_counts", "SELECT to_id, count(*) AS n FROM links GROUP BY 1", V.LINKS)
def _(spark, sf_dir):
    return V.links(spark, sf_dir).groupBy("to_id").agg(F.count(F.lit(1)).alias("n"))


@query("tag_counts", "SELECT tag, count(*) AS n FROM tags GROUP BY 1", V.TAGS)
def _(spark, sf_dir):
    return V.tags(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "tag")


@query("topic_article_count", r"SELECT doc_id, len(regexp_extract_all(body, '\n- \[\[')) AS n FROM rich", V.RICH)
def _(spark, sf_dir):
    return V.rich(spark, sf_dir).select("doc_id", T.article_count(c("body")).alias("n"))


@query("pipeline_summary", "SELECT source_name, count(*) AS attempted, count(*) FILTER (NOT success) AS failed FROM attempts GROUP BY 1", V.ATTEMPTS)
def _(spark, sf_dir):
    return V.attempts(spark, sf_dir).groupBy("source_name").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(~c("success")).alias("failed"))


@query("group_by_month", "SELECT strftime(doc_date, '%Y-%m') AS month, count(*) AS n, min(doc_date) AS first FROM originals GROUP BY 1", V.ORIGINALS)
def _(spark, sf_dir):
    return V.originals(spark, sf_dir).groupBy(F.date_format("doc_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_date").alias("first"))


@query("backlink_bins", f"SELECT to_id, doc_type, list_position([{V.quoted(C.DOC_TYPES)}], doc_type) AS place, count(*) AS n FROM (SELECT l.to_id, o.doc_type FROM links l JOIN originals o ON CAST(l.from_id AS VARCHAR) = o.id) GROUP BY 1, 2", V.LINKS, V.ORIGINALS)
def _(spark, sf_dir):
    docs = V.originals(spark, sf_dir).select(c("id").cast("long").alias("from_id"), "doc_type")
    place = F.array_position(F.array(*map(F.lit, C.DOC_TYPES)), c("doc_type")).cast("int")
    return V.links(spark, sf_dir).join(docs, "from_id").groupBy("to_id", "doc_type").agg(F.count(F.lit(1)).alias("n")).withColumn("place", place)


@query("yield_flag", "SELECT doc_date, count(*) FILTER (doc_type = 'zettel') AS notes, CASE WHEN count(*) FILTER (doc_type = 'zettel') > 10 THEN 'high' WHEN count(*) FILTER (doc_type = 'zettel') < 3 THEN 'low' END AS flag FROM originals GROUP BY 1", V.ORIGINALS)
def _(spark, sf_dir):
    n = F.count_if(c("doc_type") == "zettel")
    return V.originals(spark, sf_dir).groupBy("doc_date").agg(n.alias("notes")).withColumn("flag", F.when(c("notes") > 10, "high").when(c("notes") < 3, "low"))


@query("outdated_word_count", f"SELECT doc_id, n_chars AS stored, length(regexp_replace({_bare('text')}, '\\s', '', 'g')) AS counted FROM documents WHERE n_chars IS DISTINCT FROM length(regexp_replace({_bare('text')}, '\\s', '', 'g'))")
def _(spark, sf_dir):
    rows = V.table(spark, sf_dir, "documents").select("doc_id", c("n_chars").alias("stored"), T.word_count(c("text")).alias("counted"))
    return rows.where(~c("stored").eqNullSafe(c("counted")))


@query("representatives", "SELECT topic_slug, id, CAST(row_number() OVER (PARTITION BY topic_slug ORDER BY doc_date DESC, id) AS INTEGER) AS rank FROM originals QUALIFY rank <= 3", V.ORIGINALS)
def _(spark, sf_dir):
    return B.top_by_date(V.originals(spark, sf_dir).select("topic_slug", "id", "doc_date"), "topic_slug", C.REPRESENTATIVES).select("topic_slug", "id", "rank")


@query("cluster_fulltext", "SELECT topic_slug, id, CAST(row_number() OVER (PARTITION BY topic_slug ORDER BY doc_date DESC, id) AS INTEGER) AS rank FROM originals QUALIFY rank <= 8", V.ORIGINALS)
def _(spark, sf_dir):
    return B.top_by_date(V.originals(spark, sf_dir).select("topic_slug", "id", "doc_date"), "topic_slug", 8).select("topic_slug", "id", "rank")


@query("recent_cap", "SELECT id, doc_date FROM originals ORDER BY doc_date DESC, id LIMIT 30", V.ORIGINALS)
def _(spark, sf_dir):
    return V.originals(spark, sf_dir).select("id", "doc_date").orderBy(c("doc_date").desc(), "id").limit(30)


@query("previous_week", "SELECT DISTINCT doc_date, doc_date - 7 AS week_first, doc_date - 1 AS week_last, CAST(date_trunc('month', doc_date) - INTERVAL 1 MONTH AS DATE) AS month_first, CAST(date_trunc('month', doc_date) AS DATE) - 1 AS month_last FROM originals", V.ORIGINALS)
def _(spark, sf_dir):
    d = c("doc_date")
    month = F.trunc(d, "month")
    return V.originals(spark, sf_dir).select(d).distinct().select(d, F.date_sub(d, 7).alias("week_first"), F.date_sub(d, 1).alias("week_last"), F.add_months(month, -1).alias("month_first"), F.date_sub(month, 1).alias("month_last"))


@query("source_health", "SELECT source_name, seq, CAST(sum(CAST(NOT success AS BIGINT)) OVER (PARTITION BY source_name, island ORDER BY ts, seq) AS BIGINT) AS failures, CASE WHEN sum(CAST(NOT success AS BIGINT)) OVER (PARTITION BY source_name, island ORDER BY ts, seq) >= 3 THEN 'dead' WHEN sum(CAST(NOT success AS BIGINT)) OVER (PARTITION BY source_name, island ORDER BY ts, seq) >= 1 THEN 'degraded' ELSE 'alive' END AS state FROM (SELECT *, sum(CAST(success AS BIGINT)) OVER (PARTITION BY source_name ORDER BY ts, seq) AS island FROM attempts)", V.ATTEMPTS)
def _(spark, sf_dir):
    return B.source_health(V.attempts(spark, sf_dir))


@query("is_recap", "SELECT pos, coalesce(first_seen_date <> DATE '2026-07-05', false) AS is_recap FROM (SELECT pos, " + V.KEY("url") + " AS k FROM entries) e LEFT JOIN url_index ON k = normalized_url", V.ENTRIES, V.URL_INDEX)
def _(spark, sf_dir):
    rows = V.entries(spark, sf_dir).select("pos", U.index_key(c("url")).alias("normalized_url"))
    return rows.join(V.url_index(spark, sf_dir), "normalized_url", "left").select("pos", F.coalesce(c("first_seen_date") != V.as_of(), F.lit(False)).alias("is_recap"))


@query("page_by_type", "SELECT id, doc_date FROM originals WHERE doc_type = 'original' ORDER BY doc_date DESC NULLS LAST, id LIMIT 24 OFFSET 24", V.ORIGINALS)
def _(spark, sf_dir):
    return V.originals(spark, sf_dir).where("doc_type = 'original'").select("id", "doc_date").orderBy(c("doc_date").desc_nulls_last(), "id").offset(24).limit(24)


@query("page_by_tag", "SELECT o_orderkey AS id, o_orderdate AS doc_date FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 60")
def _(spark, sf_dir):
    got = V.tags(spark, sf_dir).where("tag = '1-URGENT'").join(V.table(spark, sf_dir, "orders"), c("doc_id") == c("o_orderkey"))
    return got.select(c("o_orderkey").alias("id"), c("o_orderdate").alias("doc_date")).orderBy(c("doc_date").desc(), "id").limit(60)


@query("latest_id", "SELECT doc_type, arg_max(id, (doc_date, id)) AS id FROM originals GROUP BY 1", V.ORIGINALS)
def _(spark, sf_dir):
    return V.originals(spark, sf_dir).groupBy("doc_type").agg(F.max_by("id", F.struct("doc_date", "id")).alias("id"))


@query("has_more", "SELECT doc_type, count(*) > 24 AS has_more FROM originals GROUP BY 1", V.ORIGINALS)
def _(spark, sf_dir):
    return V.originals(spark, sf_dir).groupBy("doc_type").agg((F.count(F.lit(1)) > 24).alias("has_more"))


@query("join_backlinks", "SELECT l.to_id, o.id AS from_id, o.doc_type FROM links l JOIN originals o ON CAST(l.from_id AS VARCHAR) = o.id", V.LINKS, V.ORIGINALS)
def _(spark, sf_dir):
    docs = V.originals(spark, sf_dir).select("id", "doc_type", c("id").cast("long").alias("_from"))
    return V.links(spark, sf_dir).join(docs, c("from_id") == c("_from")).select("to_id", c("id").alias("from_id"), "doc_type")


@query("join_tag_docs", "SELECT tag, o.id FROM tags t JOIN originals o ON CAST(t.doc_id AS VARCHAR) = o.id", V.TAGS, V.ORIGINALS)
def _(spark, sf_dir):
    docs = V.originals(spark, sf_dir).select("id", c("id").cast("long").alias("doc_id"))
    return V.tags(spark, sf_dir).join(docs, "doc_id").select("tag", "id")


@query("join_url_index", f"SELECT pos, first_seen_date, zettel_id FROM (SELECT pos, {V.KEY('url')} AS k FROM entries) LEFT JOIN url_index ON k = normalized_url", V.ENTRIES, V.URL_INDEX)
def _(spark, sf_dir):
    rows = V.entries(spark, sf_dir).select("pos", U.index_key(c("url")).alias("normalized_url"))
    return rows.join(V.url_index(spark, sf_dir), "normalized_url", "left").select("pos", "first_seen_date", "zettel_id")


@query("anti_existing_originals", "SELECT pos FROM entries WHERE 'original-' || substr(sha256(url), 1, 12) NOT IN (SELECT 'original-' || substr(sha256(url), 1, 12) FROM entries WHERE pos % 3 = 1)", V.ENTRIES)
def _(spark, sf_dir):
    rows = V.entries(spark, sf_dir).withColumn("id", T.original_id(c("url")))
    return rows.join(rows.where("pos % 3 = 1").select("id"), "id", "left_anti").select("pos")


@query("semi_valid_targets", "SELECT from_id, to_id FROM links WHERE from_id <> to_id AND to_id IN (SELECT doc_id FROM documents)", V.LINKS)
def _(spark, sf_dir):
    ids = V.table(spark, sf_dir, "documents").select(c("doc_id").alias("to_id"))
    return V.links(spark, sf_dir).where("from_id <> to_id").join(ids, "to_id", "left_semi").select("from_id", "to_id")


@query("fill_missing_assignments", "SELECT pos, CASE WHEN pos % 3 = 0 THEN 'agents' ELSE 'uncategorized' END AS topic_slug FROM entries", V.ENTRIES)
def _(spark, sf_dir):
    """What came back for known rows, and the default for those that it left out; unknown ones go."""
    rows = V.entries(spark, sf_dir).select("pos")
    came = rows.where("pos % 3 = 0").unionByName(rows.selectExpr("-1 - pos AS pos")).withColumn("topic_slug", F.lit("agents"))
    return rows.join(came, "pos", "left").select("pos", F.coalesce("topic_slug", F.lit(C.OVERFLOW_TOPIC)).alias("topic_slug"))


# --- builders
@query("classify_daily", "SELECT pos, CASE WHEN pos % 3 = 0 AND pos % 2 = 0 THEN 'recap_with_zettel' WHEN pos % 3 = 0 THEN 'recap_not_upgraded' WHEN pos % 2 = 0 AND pos % 5 = 0 THEN 'has_zettel_original_missing' WHEN pos % 2 = 0 THEN 'has_zettel_has_original' ELSE 'no_zettel_has_original' END AS class FROM entries", V.ENTRIES)
def _(spark, sf_dir):
    p = c("pos")
    return V.entries(spark, sf_dir).select("pos", B.classify_daily(p % 3 == 0, F.when(p % 2 == 0, "n"), F.when(p % 5 == 0, "placeholder").otherwise("direct")).alias("class"))


@query("build_original", "SELECT 'original-' || substr(sha256(url), 1, 12) AS id, CASE WHEN pos % 5 = 0 AND summary <> '' THEN 'translated ' || pos WHEN pos % 7 <> 0 THEN summary ELSE '' END AS body, coalesce(published, DATE '2026-07-05') AS doc_date FROM entries", V.ENTRIES)
def _(spark, sf_dir):
    """A fifth has a translation, a seventh no text of its own."""
    rows = V.entries(spark, sf_dir)
    done = F.when((c("pos") % 5 == 0) & (c("summary") != ""), F.concat(F.lit("translated "), c("pos").cast("string"))).when(c("pos") % 2 == 0, "")
    rows = rows.withColumns({"translated": done, "original": F.when(c("pos") % 7 != 0, c("summary"))})
    return rows.select(T.original_id(c("url")).alias("id"), T.original_body(c("translated"), c("original")).alias("body"), F.coalesce("published", V.as_of()).alias("doc_date"))


@query("build_zettel", "SELECT id, '# ' || title || chr(10) || chr(10) || gist || chr(10) || chr(10) || '[[' || id || ']]' AS body FROM originals", V.ORIGINALS)
def _(spark, sf_dir):
    return V.originals(spark, sf_dir).select("id", F.concat(F.lit("# "), "title", F.lit("\n\n"), "gist", F.lit("\n\n[["), "id", F.lit("]]")).alias("body"))


_DIGEST = f"""digest AS (SELECT pos, '- **' || title || '**（来源：' || source_name || '）' || {_BLURB} || ' ' || url AS line FROM (SELECT pos, url, title, source_name, summary AS gist
   FROM entries WHERE url <> '' AND source_name IN (SELECT source_name FROM registry) QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1))"""


def _digest(spark, sf_dir):
    rows = V.entries(spark, sf_dir).withColumn("gist", F.regexp_replace("summary", "\\. ", "。"))
    return B.digest_lines(rows.select("pos", "url", "title", "source_name", "gist"), registry(spark, sf_dir))


@query("digest_lines", "SELECT * FROM digest", V.ENTRIES, _REGISTRY, _DIGEST)
def _(spark, sf_dir):
    return _digest(spark, sf_dir)


@query("build_digest", "SELECT 'digest-2026-07-05' AS id, count(*) AS entry_count, sha256(string_agg(line, chr(10) ORDER BY pos) || chr(10)) AS body FROM digest", V.ENTRIES, _REGISTRY, _DIGEST)
def _(spark, sf_dir):
    return B.digest_record(_digest(spark, sf_dir), V.as_of()).select("id", "entry_count", F.sha2("body", 256).alias("body"))


# --- store
@query("upsert_documents", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' || lang ELSE lang END AS lang FROM documents UNION ALL SELECT -1 - doc_id, 'new ' || lang FROM documents WHERE doc_id % 3 = 0")
def _(spark, sf_dir):
    old = V.table(spark, sf_dir, "documents").select("doc_id", "lang")
    fresh = old.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("new "), "lang").alias("lang"), F.lit(2).alias("version"))
    stale = fresh.select("doc_id", F.lit("stale").alias("lang"), F.lit(1).alias("version"))
    added = fresh.select((-1 - c("doc_id")).alias("doc_id"), "lang", "version")
    return K.upsert(old, fresh.unionByName(stale).unionByName(added), "doc_id")


@query("sync_tags", "SELECT doc_id, tag FROM tags WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, unnest(['x', 'y']) FROM tags WHERE doc_id % 8 = 0", V.TAGS)
def _(spark, sf_dir):
    old = V.tags(spark, sf_dir)
    lists = F.when(c("doc_id") % 8 == 0, F.array(F.lit("x"), F.lit("y"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return K.replace_tags(old, old.where("doc_id % 4 = 0").select("doc_id", lists.alias("tags")))


@query("sync_links", "SELECT * FROM links UNION SELECT l.to_id, l.from_id FROM links l WHERE l.to_id IN (SELECT doc_id FROM documents) AND l.from_id IN (SELECT doc_id FROM documents)", V.LINKS)
def _(spark, sf_dir):
    old = V.links(spark, sf_dir)
    new = old.select(c("to_id").alias("from_id"), c("from_id").alias("to_id"))
    parts = parts_for(spark, V.table(spark, sf_dir, "lineitem").count())
    return K.add_links(old, new, V.table(spark, sf_dir, "documents").select(c("doc_id").alias("id")), parts)


@query(
    "url_index_upsert",
    f"SELECT coalesce(i.normalized_url, s.k) AS normalized_url, first_seen_date, CASE WHEN i.normalized_url IS NULL THEN ['now'] WHEN s.k IS NOT NULL THEN list_append(kept_in_daily, 'now') ELSE kept_in_daily END AS kept_in_daily FROM url_index i FULL JOIN (SELECT DISTINCT {V.KEY('url')} AS k FROM entries WHERE pos % 2 = 0) s ON i.normalized_url = s.k",
    V.ENTRIES,
    V.URL_INDEX,
)
def _(spark, sf_dir):
    seen = V.entries(spark, sf_dir).where("pos % 2 = 0").select(U.index_key(c("url")).alias("normalized_url"))
    return K.upsert_index(V.url_index(spark, sf_dir), seen, F.lit("now"))


@query("url_index_ttl", "SELECT normalized_url FROM url_index WHERE first_seen_date >= DATE '2026-07-05' - 30", V.ENTRIES, V.URL_INDEX)
def _(spark, sf_dir):
    return K.expire_index(V.url_index(spark, sf_dir), V.as_of()).select("normalized_url")


@query("backfill_zettel_id", f"SELECT normalized_url, coalesce(n.note, zettel_id) AS zettel_id FROM url_index LEFT JOIN (SELECT {V.KEY('url')} AS k, max('filled-' || pos) AS note FROM entries WHERE pos % 4 = 1 GROUP BY 1) n ON k = normalized_url", V.ENTRIES, V.URL_INDEX)
def _(spark, sf_dir):
    notes = V.entries(spark, sf_dir).where("pos % 4 = 1").select(U.index_key(c("url")).alias("normalized_url"), F.concat(F.lit("filled-"), c("pos").cast("string")).alias("zettel_id"))
    return K.set_once(V.url_index(spark, sf_dir).select("normalized_url", "zettel_id"), notes, "normalized_url", "zettel_id")


# --- full text
_TERMS = r"terms AS (SELECT doc_id AS id, unnest(w) AS term, generate_subscripts(w, 1) AS at FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents))"
_MATCH = "SELECT id, count(*) AS hits FROM terms WHERE term IN ('the', 'of') GROUP BY id HAVING count(DISTINCT term) = 2"


_INDEXES: dict[tuple, str] = {}


def _texts(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "text")


def text_index(spark, sf_dir) -> str:
    """Folder of the documents' index: made in two batches when first asked for, read by every search after."""
    docs = _texts(spark, sf_dir)
    key = (spark.sparkContext.applicationId, *sorted(docs.inputFiles()))
    if key not in _INDEXES:
        folder = f"{shared_dir(spark)}/lectern-index-{uuid.uuid4().hex}"
        for batch in (0, 1):
            I.add_batch(folder, docs.where(F.pmod(F.xxhash64("id"), F.lit(2)) == batch), batch)
        _INDEXES[key] = folder
    return _INDEXES[key]


@query("fts_match", f"SELECT * FROM ({_MATCH}) WHERE id IN (SELECT a.id FROM terms a JOIN terms b ON a.id = b.id AND a.at + 1 = b.at WHERE a.term = 'of' AND b.term = 'the') AND id NOT IN (SELECT id FROM terms WHERE term = 'license')", _TERMS)
def _(spark, sf_dir):
    return I.find(spark, text_index(spark, sf_dir), 'the of "of the" -license').select("id", "hits")


@query("fts_rank", f"SELECT m.id, hits, hits::DOUBLE / n AS rank FROM ({_MATCH}) m JOIN (SELECT id, count(*) AS n FROM terms GROUP BY id) s ON m.id = s.id ORDER BY rank DESC, m.id LIMIT 20", _TERMS)
def _(spark, sf_dir):
    return S.ranked(I.find(spark, text_index(spark, sf_dir), "the of"))


_AND = "SELECT id FROM terms WHERE term = 'license' INTERSECT SELECT id FROM terms WHERE term = 'under'"
_PHRASE = "SELECT a.id FROM terms a JOIN terms b ON a.id = b.id AND a.at + 1 = b.at WHERE a.term = 'of' AND b.term = 'the' EXCEPT SELECT id FROM terms WHERE term = 'and'"


@query("fts_web_search", f"SELECT id, count(*) FILTER (term IN ('license', 'under', 'of', 'the')) AS hits FROM terms WHERE id IN ({_AND}) OR id IN ({_PHRASE}) GROUP BY id", _TERMS)
def _(spark, sf_dir):
    return I.find(spark, text_index(spark, sf_dir), 'license UNDER or "of  the" -and or').select("id", "hits")


# --- pages with their total, marks of lines, arrays of texts
_UPDATED = "CAST(id AS BIGINT) % 10"


@query("page_by_type_total", f"SELECT id, doc_date, {_UPDATED} AS updated, (SELECT count(*) FROM originals WHERE doc_type = 'original') AS total FROM originals WHERE doc_type = 'original' ORDER BY doc_date DESC NULLS LAST, {_UPDATED} DESC, id LIMIT 24 OFFSET 12", V.ORIGINALS)
def _(spark, sf_dir):
    rows = V.originals(spark, sf_dir).where("doc_type = 'original'").select("id", "doc_date", (c("id").cast("long") % 10).alias("updated"))
    return B.paged(rows, 24, 12)


@query("cluster_fulltext_week", "SELECT topic_slug, id, CAST(row_number() OVER (PARTITION BY topic_slug ORDER BY doc_date DESC, id) AS INTEGER) AS rank FROM originals WHERE doc_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' QUALIFY rank <= 5", V.ORIGINALS)
def _(spark, sf_dir):
    rows = V.originals(spark, sf_dir).where(c("doc_date").between("2024-01-08", "2024-01-14"))
    return B.top_by_date(rows.select("topic_slug", "id", "doc_date"), "topic_slug", 5).select("topic_slug", "id", "rank")


scalar(
    "daily_marker", V.entries, "pos",
    lambda: B.daily_marker(B.classify_daily(c("pos") % 3 == 0, F.when(c("pos") % 2 == 0, "n"), F.when(c("pos") % 5 == 0, "placeholder").otherwise("direct"))),
    V.ENTRIES, "CASE WHEN pos % 6 = 0 THEN '🔄' WHEN pos % 3 = 0 THEN '🔄（未升级为原子笔记）' WHEN pos % 10 = 0 THEN '（原文缺失）' ELSE '' END",
)
scalar(
    "strip_nul_all", V.entries, "pos",
    lambda: F.array_join(T.strip_nul_all(F.array(F.concat(F.lit("\x00"), "title", F.lit("\x00\x00")), F.when(c("pos") % 2 == 0, F.concat_ws("\x00", F.lit("a"), "summary")), F.lit("\x00"))), "|", "-"),
    V.ENTRIES, "coalesce(title, '-') || '|' || CASE WHEN pos % 2 = 0 THEN 'a' || coalesce(summary, '') ELSE '-' END || '|'",
)
