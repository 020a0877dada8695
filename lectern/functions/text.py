"""Column functions over texts: what one row alone decides."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import config as C

CJK_WIDE = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7A3}]"
HAN = r"[\x{4E00}-\x{9FFF}]"
IMAGE_TAG = r"(?is)<img\b[^>]*>"


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def _let(value: Column, made: Callable[[Column], Column]) -> Column:
    """`made` of a value that is computed once, however often `made` names it."""
    return F.transform(F.array(value), made)[0]


def tokens(text: Column) -> Column:
    """Distinct tokens: Han characters where there are any, else ASCII words; stop words go."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.lower)
    han = F.regexp_extract_all(text, F.lit(HAN), F.lit(0))
    without = lambda c, stop: F.array_except(F.array_distinct(c), F.array(*map(F.lit, stop)))
    return F.when(F.size(han) > 0, without(han, C.STOP_ZH)).otherwise(without(words, C.STOP_EN))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens; 0 where either side has none."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def stripped(text: Column, white: str = r"\s") -> Column:
    """Without white space at both ends; `white` is the pattern of one such character."""
    return F.regexp_replace(text, rf"(?U)^{white}+|{white}+\z", "")


def title_key(title: Column) -> Column:
    bare = F.regexp_replace(F.lower(title), r"(?U)[^\w\s]", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def cjk_ratio(text: Column) -> Column:
    return _share(F.length(text) - F.length(F.regexp_replace(text, CJK_WIDE, "")), F.length(text))


def needs_translation(title: Column, body: Column) -> Column:
    """Whether neither title nor the first part of the body is Chinese."""
    return ~((cjk_ratio(title) > 0) | (cjk_ratio(F.substring(body, 1, C.LANGUAGE_SAMPLE)) > C.LANGUAGE_SHARE))


def strip_code_links(text: Column) -> Column:
    # most texts have neither code nor links: a plain search costs less than three patterns
    marked = text.contains("```") | text.contains("http") | text.contains(C.MEDIA_SCHEME)
    bare = F.regexp_replace(text, r"(?s)```.*?```", "")
    bare = F.regexp_replace(bare, r"https?://\S+", "")
    return F.when(marked, F.regexp_replace(bare, C.MEDIA_SCHEME + r"\S+", "")).otherwise(text)


def code_fraction(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(1 - F.length(strip_code_links(text)) / F.length(text))


def code_heavy(text: Column) -> Column:
    return code_fraction(text) >= C.CODE_SHARE


def word_count(text: Column) -> Column:
    return F.length(F.regexp_replace(strip_code_links(text), r"(?U)\s", "")).cast("long")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return ~line.rlike(r"(?U)\S")


def noise_line(line: Column) -> Column:
    return ~_blank(line) & ~line.rlike("[A-Za-z]{3}|" + HAN + "{2}")


def reference_line(line: Column) -> Column:
    bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    return (bare != "") & (bare != "-") & (line.rlike("(?i)" + C.REFERENCE) | line.rlike("(?i)" + C.ET_AL))


def noise_share(text: Column) -> Column:
    return _let(F.filter(_lines(text), lambda x: ~_blank(x)), lambda own: _share(F.size(F.filter(own, noise_line)), F.size(own)))


def reference_share(text: Column) -> Column:
    own = F.filter(_lines(text), lambda x: ~_blank(x) & (stripped(x) != "-"))
    return _let(own, lambda own: _share(F.size(F.filter(own, reference_line)), F.size(own)))


def fallback_tail(chunks: Column) -> Column:
    """The last chunk but the first that isn't mostly references; null if there is none."""
    rest = F.slice(chunks, 2, F.greatest(F.size(chunks), F.lit(1)))
    last, fits = F.try_element_at(chunks, F.lit(-1)), lambda x: reference_share(x) < C.REFERENCE_SHARE
    # that is the last one as a rule; the others are looked at only where it isn't
    return F.when((F.size(chunks) > 1) & fits(last), last).otherwise(F.try_element_at(F.filter(rest, fits), F.lit(-1)))


def cjk_ratio_clean(text: Column) -> Column:
    bare = F.array_join(F.filter(_lines(strip_code_links(text)), lambda x: ~noise_line(x)), "\n")
    # white space is looked for in what isn't CJK, little as a rule
    solid = lambda x: F.length(F.regexp_replace(x, r"(?U)\s+", ""))
    share = lambda n, rest: _share(n - F.length(rest), n - F.length(rest) + solid(rest))
    return _let(bare, lambda x: _let(F.regexp_replace(x, CJK_WIDE + "+", ""), lambda rest: share(F.length(x), rest)))


def has_residue(text: Column) -> Column:
    return (text.contains("ltx") | text.contains("<t")) & text.rlike("|".join(C.RESIDUE))


def translation_complete(text: Column) -> Column:
    return ~has_residue(text) & (cjk_ratio_clean(text) >= C.COMPLETE_SHARE)


def original_id(url: Column) -> Column:
    return F.concat(F.lit("original-"), F.substring(F.sha2(url, 256), 1, 12))


def slugify(text: Column, seed: Column) -> Column:
    words = F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), 1, C.SLUG_WORDS)
    return F.when(F.size(words) > 0, F.array_join(words, "-")).otherwise(F.concat(F.lit("untitled-"), F.substring(F.sha2(seed, 256), 1, 8)))


def display_title(translated: Column, fetched: Column) -> Column:
    """The translated title unless there is none."""
    return F.coalesce(F.nullif(translated, F.lit("")), fetched)


def legacy_date(value: Column, as_of: Column) -> Column:
    """The date of an ISO date or timestamp, by its first ten characters; `as_of` for all else."""
    bare = stripped(value)
    iso = bare.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}.*)?$")
    return F.coalesce(F.when(iso, F.try_to_date(F.substring(bare, 1, 10), "yyyy-MM-dd")), as_of)


def clean_markdown(text: Column) -> Column:
    """Fetched text without its leading title, known blocks, site header, tracking images and repeated paragraphs, in this order."""
    bare = F.regexp_replace(text, r"^#[ \t]+[^\n]+?\n+", "")
    tail = r"[ \t]*#{1,6}[ \t]*(?:" + "|".join(C.BOILERPLATE_TITLES) + r")\b"
    bare = F.when(bare.rlike(tail), F.regexp_replace(F.regexp_replace(bare, f"(?s){tail}.*$", ""), r"(?U)\s+$", "")).otherwise(bare)
    bare = F.regexp_replace(bare, "(?s)^" + C.SITE_HEADER, "")
    domains = "|".join(d.replace(".", r"\.") for d in C.TRACKING_DOMAINS)
    bare = F.regexp_replace(bare, rf"!\[[^\]]*\]\(https?://(?:[\w.-]+\.)?(?:{domains})/[^)]*\)", "")
    return dedup_paragraphs(bare)


def clean_abstract(text: Column, white: str = r"\s") -> Column:
    """An abstract page without its header block, its link prefix and the side bar at its end."""
    # the side bar goes first: without an abstract the prefix would take the lines before it along
    bare = F.regexp_replace(text, rf"(?is)(?<!\n)\n{white}*+Full-text links:.*", "")
    bare = F.regexp_replace(bare, r"(?i)^#[^\n]*\n+\s*\[Submitted[^\]]*\]\n+\s*#+\s*Title:[^\n]*\n+", "")
    bare = F.regexp_replace(bare, rf"(?i)^\s*View PDF\s*Abstract:{white}*", "")
    return stripped(bare, white)


def insert_block(body: Column, heading: Column, lines: Column) -> Column:
    """`body` with the array `lines` at the end of the block under `heading`.

    Without that block a new one comes before the first heading of its level, or at the end.
    """
    own = F.split(body, "\n", -1)
    at = F.array_position(own, heading)
    opens = F.transform(own, lambda x, i: F.when(x.startswith("## ") & (i >= at), i + 1))
    next_ = F.coalesce(F.array_min(opens), (F.size(own) + 1).cast("int"))
    join = lambda *parts: F.array_join(F.concat(*parts), "\n")
    upto, rest = F.slice(own, F.lit(1), next_ - 1), F.slice(own, next_, F.size(own))
    new = F.concat(F.array(heading, F.lit("")), lines, F.array(F.lit("")))
    last = F.concat(F.regexp_replace(body, r"\n+$", ""), F.lit("\n\n"), heading, F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n"))
    return F.when(at > 0, join(upto, lines, rest)).when(next_ <= F.size(own), join(upto, new, rest)).otherwise(last)


def article_count(body: Column) -> Column:
    """Entries of a topic page: lines that begin with a linked item."""
    return F.regexp_count(body, F.lit(r"\n- \[\[")).cast("long")


def length_tier(articles: Column, tiers: tuple[tuple[int, str], ...]) -> Column:
    """The label of the highest tier whose number of articles is reached; tiers ascend from 0."""
    out = F.lit(tiers[0][1])
    for least, label in tiers[1:]:
        out = F.when(articles >= least, label).otherwise(out)
    return out


def humanize_slug(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def topic_mark(slug: Column) -> Column:
    return _looked_up(C.TOPIC_MARKS, slug)


def topic_label(slug: Column) -> Column:
    return _looked_up(C.TOPIC_LABELS, slug)


def topic_heading(slug: Column) -> Column:
    mark = F.coalesce(_looked_up(C.TOPIC_MARKS, slug), F.lit("📌"))
    return F.concat(F.lit("## "), mark, F.lit(" "), F.coalesce(_looked_up(C.TOPIC_LABELS, slug), humanize_slug(slug)), F.lit(" [["), slug, F.lit("]]"))


def fallback_notice(channel: Column, translation: Column) -> Column:
    return F.nullif(F.concat_ws("；", _looked_up(C.CHANNEL_NOTICES, channel), F.nullif(translation, F.lit(""))), F.lit(""))


def _balanced(text: Column) -> Column:
    """Without its last, unclosed bold part."""
    odd = F.regexp_count(text, F.lit(r"\*\*")) % 2 == 1
    before_last = F.length(text) - F.locate("**", F.reverse(text)) - 1
    return F.when(odd, F.substring(text, F.lit(1), before_last)).otherwise(text)


def truncate_blurb(text: Column, most: int = C.BLURB_CHARS) -> Column:
    cut = F.substring(text, 1, most)
    out = F.concat(_balanced(F.regexp_replace(cut, r"(?U)\s+$", "")), F.lit("…"))
    for mark in reversed("。！？；"):
        at = F.length(cut) - F.locate(mark, F.reverse(cut)) + 1
        out = F.when((F.locate(mark, cut) > 0) & (at > 1), _balanced(F.substring(cut, F.lit(1), at))).otherwise(out)
    return F.when(F.length(text) <= most, text).otherwise(out)


def original_body(translated: Column, original: Column) -> Column:
    """An article's text: the translation, else what was read, else nothing."""
    return F.coalesce(F.nullif(translated, F.lit("")), original, F.lit(""))


def dedup_paragraphs(text: Column, separator: str = "\n\n", shortest: int = 40) -> Column:
    """First occurrences of the long paragraphs, and all short ones, in order.

    Paragraphs are sorted by their words and place; one whose neighbour says the same isn't the first.
    """
    item = lambda x, i: F.struct(stripped(x).alias("bare"), i.alias("i"), x.alias("part"))

    def kept(own):
        before = F.concat(F.array(F.get(own, F.lit(-1))), F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))))
        first = lambda a, b: b.isNull() | (a["bare"] != b["bare"]) | (F.length(a["bare"]) < shortest)
        told = F.zip_with(own, before, lambda a, b: F.struct(a["i"].alias("i"), a["part"].alias("part"), first(a, b).alias("keep")))
        return F.array_join(F.transform(F.array_sort(F.filter(told, lambda x: x["keep"])), lambda x: x["part"]), separator)

    return _let(F.array_sort(F.transform(F.split(text, separator, -1), item)), kept)


def fulltext_url(url: Column, host: str = "arxiv.org") -> Column:
    found = F.regexp_extract(F.trim(url), rf"(?i)^https?://{host.replace('.', '[.]')}/abs/([\w.]+)/?$", 1)
    return F.when(found != "", F.concat(F.lit(f"https://{host}/html/"), found))


def fulltext_pending(url: Column, got_fulltext: Column) -> Column:
    """Whether a full text is still to come; null for pages that have none elsewhere."""
    return F.when(fulltext_url(url).isNotNull(), ~F.coalesce(got_fulltext, F.lit(False)))


def translate_timeout(chunks: Column) -> Column:
    return F.least(F.greatest(300 + 30 * chunks, F.lit(1800)), F.lit(5400)).cast("long")


def markdown_plain(text: Column) -> Column:
    bare = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    return F.regexp_replace(bare, r"\[([^\]]*)\]\([^)]*\)", "$1")


def wikilinks(text: Column) -> Column:
    """Targets of [[target|shown]] outside code, without headings, trimmed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"`[^`\n]*`", "")
    found = F.regexp_extract_all(bare, F.lit(r"\[\[([^\]|#\n]+)(?:#[^\]|\n]*)?(?:\|[^\]\n]*)?\]\]"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def excerpt(text: Column, most: int = 90) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def doc_href(doc_type: Column, doc_id: Column) -> Column:
    places = {"daily": "daily", "topic": "topics", "zettel": "zettel", "original": "originals", "digest": "digest", "deep_dive": "deep-dive"}
    return F.concat(F.lit("/"), F.coalesce(_looked_up(places, doc_type), F.lit("originals")), F.lit("/"), doc_id)


def strip_nul(text: Column) -> Column:
    return F.translate(text, "\x00", "")


def absolute_date(raw: Column) -> Column:
    """The first date written out: ISO, with dots, strokes or Chinese units, or with an English month; else null."""
    part = lambda pattern, *groups: F.concat_ws(" ", *[F.regexp_extract(raw, pattern, g) for g in groups])
    month = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
    numbers = r"(\d{4})[-/.年]\s*(\d{1,2})[-/.月]\s*(\d{1,2})"
    first = month + r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"
    last = r"(?i)\b(\d{1,2})(?:st|nd|rd|th)?\s+(?:of\s+)?" + month[6:] + r",?\s+(\d{4})\b"
    return F.coalesce(
        F.try_to_date(part(numbers, 1, 2, 3), "yyyy M d"),
        F.try_to_date(F.initcap(part(first, 1, 2, 3)), "MMM d yyyy"),
        F.try_to_date(F.initcap(part(last, 2, 1, 3)), "MMM d yyyy"),
    )


def flexible_date(raw: Column, fetched: Column) -> Column:
    """Relative dates in Chinese or English first, then dates written out within ten years of `fetched`; null for more days than an int holds."""
    number = lambda p, unit=1: F.floor(F.regexp_extract(raw, p, 1).try_cast("long") / unit).try_cast("int")
    iso = absolute_date(raw)
    return (
        F.when(raw.rlike(r"\d+\s*天前"), F.date_sub(fetched, number(r"(\d+)\s*天前")))
        .when(raw.rlike(r"(?i)\d+\s*days?\s*ago"), F.date_sub(fetched, number(r"(?i)(\d+)\s*days?\s*ago")))
        .when(raw.rlike(r"\d+\s*小时前"), F.date_sub(fetched, number(r"(\d+)\s*小时前", 24)))
        .when(raw.rlike(r"(?i)\d+\s*hours?\s*ago"), F.date_sub(fetched, number(r"(?i)(\d+)\s*hours?\s*ago", 24)))
        .when(raw.rlike("(?i)昨天|yesterday"), F.date_sub(fetched, 1))
        .when(raw.rlike("(?i)今天|today"), fetched)
        .when(F.abs(F.datediff(fetched, iso)) <= 3650, iso)
    )


def topic_sections(body: Column) -> Column:
    """Parts of a topic page that begin with a dated heading, in order; what comes before goes."""
    parts = F.split(body, r"(?m)^(?=## \d{4}-\d{2}-\d{2}\s*$)", -1)
    return F.filter(parts, lambda x: x.rlike(r"^## \d{4}-\d{2}-\d{2}\s*(\n|$)"))


def without_title_block(body: Column) -> Column:
    """Without a first `# title` line and the quotes under it."""
    bare = F.regexp_replace(body, r"\A\n+", "")
    titled = bare.rlike(r"\A# .+\n")
    rest = F.regexp_replace(F.regexp_replace(bare, r"\A# .+\n\n*", ""), r"\A(?:> .*(?:\n|\z))+", "")
    return F.when(titled, F.regexp_replace(rest, r"\A\n+", "")).otherwise(bare)


def legacy_gist(body: Column, most: int = C.EXCERPT_CHARS, white: str = r"\s") -> Column:
    """The part under the concept heading, else the whole body, on one line and cut; nothing where that part is empty."""
    head = r"## 概念\s*/\s*事件"
    own = F.regexp_extract(body, rf"(?s){head}(?={white}*\n){white}*+(?!## )(.+?)(?:\n##|\z)", 1)
    # the next heading of this level is no part of an empty one
    empty = body.rlike(rf"{head}{white}*\n(?:{white}+\z|{white}*## )")
    line = F.replace(stripped(F.when(own != "", own).when(empty, "").otherwise(body), white), F.lit("\n"), F.lit(" "))
    cut = F.concat(F.regexp_replace(F.substring(line, 1, most), rf"(?U){white}+\z", ""), F.lit("…"))
    return F.when(F.length(line) <= most, line).otherwise(cut)


def chart_label(text: Column, most: int = C.LABEL_CHARS) -> Column:
    """Free text as a label of a chart: without the marks that end one, and never the word `end` alone."""
    bare = F.replace(F.trim(F.regexp_replace(text, r'["|\[\]\n`]', "")), F.lit("#"), F.lit("＃"))
    return F.substring(F.when(F.lower(bare) == "end", F.concat(bare, F.lit(" "))).otherwise(bare), 1, most)


def chart_is_sound(code: Column) -> Column:
    """Whether a chart block has its fences, a known kind, and brackets and quotes in pairs."""
    lines = F.split(F.regexp_replace(code, r"(?U)\A\s+|\s+\z", ""), "\n", -1)
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    count = lambda mark: F.regexp_count(inner, F.lit(mark))
    kind = F.trim(F.try_element_at(lines, F.lit(2)))
    return F.coalesce(
        (F.size(lines) >= 3) & (lines[0] == "```mermaid") & (F.try_element_at(lines, F.lit(-1)) == "```")
        & kind.rlike("^(flowchart|pie|xychart-beta|quadrantChart)")
        & (count(r"\[") == count(r"\]")) & (count(r"\(") == count(r"\)")) & (count('"') % 2 == 0)
        & ~(kind.startswith("quadrantChart") & inner.rlike(r"\b\d+\.0\b")),
        F.lit(False),
    )


def chart_coordinate(share: Column) -> Column:
    """Two decimals, half to even; whole numbers without a point."""
    return F.regexp_replace(F.bround(share, 2).cast("string"), r"\.0$", "")


def headline(text: Column, words: list[str], most: int = C.HEADLINE_WORDS, white: str = r"\s") -> Column:
    """The `most` words from the first one sought on, those sought marked; the beginning if there is none. White space at the end stays, as one space."""
    shown = F.split(F.ltrim(text), rf"(?U){white}+")
    # most words hold none of those sought: a plain search costs less than a pattern
    held = lambda w: reduce(Column.__or__, [F.lower(w).contains(x) for x in words], F.lit(False))
    sought = lambda w: held(w) & F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+\z", "").isin(words)
    at = F.greatest(F.array_position(F.transform(shown, sought), True), F.lit(1))
    return F.array_join(F.transform(F.slice(shown, at.cast("int"), F.lit(most)), lambda w: F.when(sought(w), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)), " ")


def images(html: Column) -> Column:
    """Images of a page: where each is, its text, its file ending, and whether it shows anything."""
    tags = F.regexp_extract_all(html, F.lit(IMAGE_TAG), F.lit(0))
    of = lambda tag, name: F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*["']([^"']*)["']""", 1)
    inline = lambda x: F.when((x != "") & ~x.startswith("data:"), x)

    def one(tag):
        first = F.regexp_extract(of(tag, "srcset"), r"^(https?://[^\s,]+)", 1)
        src = F.coalesce(inline(of(tag, "data-src")), inline(of(tag, "data-original")), inline(of(tag, "src")), inline(first))
        dot = lambda n: of(tag, n).isin("0", "1")
        ending = F.lower(F.regexp_extract(src, r"^[^?#]*(\.[A-Za-z0-9]+)(?:[?#]|$)", 1))
        kind = F.when(ending == ".jpeg", ".jpg").when(ending.isin(".png", ".jpg", ".gif", ".webp", ".svg", ".avif", ".bmp"), ending).otherwise(".bin")
        return F.struct(src.alias("src"), of(tag, "alt").alias("alt"), kind.alias("ending"), (src.isNotNull() & ~(dot("width") & dot("height"))).alias("shown"))

    return F.transform(tags, one)


def strip_nul_all(texts: Column) -> Column:
    """An array of texts, each without NUL characters; null stays null."""
    return F.transform(texts, strip_nul)
