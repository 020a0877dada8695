"""Thresholds, word lists and patterns that results depend on."""

# Fixed values.
STALE_DAYS = 14
SOURCE_STALE_DAYS = 30
TITLE_ALIKE_PERCENT, SUMMARY_ALIKE_PERCENT, SUMMARY_PREFIX = 85, 90, 100
EXCERPT_CHARS, INDEX_TTL_DAYS, INDEX_RECENT_DAYS, RE_COVERAGE = 200, 30, 7, 0.6
NOISE_SHARE, REFERENCE_SHARE, CODE_SHARE, COMPLETE_SHARE = 0.95, 0.3, 0.35, 0.5
LANGUAGE_SAMPLE, LANGUAGE_SHARE = 500, 0.3
NEW_TOPIC_MIN, SPLIT_HINT, BLURB_CHARS, SLUG_WORDS = 3, 8, 120, 5
TREND_COUNT, TREND_DAYS, TREND_TOP, REPRESENTATIVES = 3, 2, 8, 3
MONTH_COUNT, MONTH_DAYS = 8, 4
DEAD_FAILURES, DEGRADED_FAILURES = 3, 1

STOP_EN = "the a an of to in on for and or is are was were with by at from this that it as be have has will we our its".split()
STOP_ZH = list("的了和是在有与及等对为也就都而并将被这那个上中")

DROP_PATTERNS = (
    r"完成.{0,6}轮融资", r"获.{0,10}投资", r"funding round", r"raises\s*\$", r"series [a-z] funding",
    r"招聘", r"内推", r"we'?re hiring", r"join our team",
    r"报名开启", r"直播预告", r"线下沙龙", r"\bwebinar\b", r"\bmeetup\b", r"register now",
    r"限时优惠", r"\bsponsored\b", r"编译自", r"compiled from", r"翻译自",
)
KEEP_DOMAINS = ("arxiv.org", "github.com", "huggingface.co")
KEEP_PATTERNS = (
    r"benchmark", r"\bsota\b", r"state-of-the-art", r"开源", r"open.?source", r"\bpaper\b", r"论文", r"policy",
    r"regulation", r"政策", r"监管", r"\bsafety\b", r"\balignment\b", r"安全对齐", r"对齐",
)
TOPICS = (
    "model-releases", "safety-alignment", "opensource-tools", "research-papers", "policy-regulation",
    "industry-moves", "funding-investment", "infra-hardware", "applications", "agents",
)
OVERFLOW_TOPIC = "uncategorized"
TOPIC_MARKS = {
    "model-releases": "🚀", "safety-alignment": "🛡️", "opensource-tools": "🛠️", "research-papers": "📄",
    "policy-regulation": "⚖️", "industry-moves": "🏢", "funding-investment": "💰", "infra-hardware": "🖥️",
    "applications": "🎯", "agents": "🤖", "uncategorized": "📌",
}
TOPIC_LABELS = {
    "model-releases": "模型发布", "safety-alignment": "安全对齐", "opensource-tools": "开源工具", "research-papers": "研究论文",
    "policy-regulation": "政策监管", "industry-moves": "产业动态", "funding-investment": "融资投资", "infra-hardware": "基础设施",
    "applications": "应用案例", "agents": "Agent", "uncategorized": "其他",
}
CHANNEL_NOTICES = {
    "jina": "主抓取通道失败（反爬拦截/超时等），使用 Jina Reader 兜底获取原文",
    "playwright": "direct 与 Jina 均失败，使用无头浏览器渲染兜底获取原文",
    "placeholder": "全部抓取通道失败（direct/Jina/Playwright），仅占位记录，正文缺失",
}
DAILY_MARKERS = {
    "has_zettel_has_original": "",
    "no_zettel_has_original": "",
    "has_zettel_original_missing": "（原文缺失）",
    "recap_with_zettel": "🔄",
    "recap_not_upgraded": "🔄（未升级为原子笔记）",
}
DOC_TYPES = ("daily", "zettel", "original", "topic", "digest", "deep_dive")
#: Titles of blocks after which a fetched page has nothing of its own.
BOILERPLATE_TITLES = ("References & Citations", "Bibliographic and Citation Tools", "Keep reading")
SITE_HEADER = r"\[Skip to main content\]\([^)]*\).*?\[Try ChatGPT\(opens in a new window\)\]\(https://chatgpt\.com/\)Login\n*"
TRACKING_DOMAINS = (
    "bat.bing.com", "google-analytics.com", "googletagmanager.com", "doubleclick.net", "facebook.com", "connect.facebook.net",
    "analytics.twitter.com", "px.ads.linkedin.com", "scorecardresearch.com", "hotjar.com",
)
ICON_PATHS = (r"/static/browse/.*?/icons/", r"arxiv\.org/static/base/.*?/images/")
VIDEO_ENDINGS = (".mp4", ".webm", ".mov", ".avi", ".mkv", ".m4v")
#: Length of a summary by the number of its articles.
WEEKLY_TIERS = ((0, "150-300字"), (5, "300-500字"), (15, "500-800字"))
MONTHLY_TIERS = ((0, "400-700字"), (5, "600-1200字"), (15, "1000-1800字"))
#: Rows that an annotator gets at once.
ANNOTATED_ROWS = 20
RESIDUE = (r"ltx_", r"<td[\s>]", r"<tr[\s>]", r'class="ltx')
REFERENCE = r"\[\d{4}[a-z]?\]|\[\d{1,3}\]|doi\s*:|doi\.org|arxiv|\(\d{4}\)"
ET_AL = r"等人|et al\.?"
#: Scheme of stored images; a setting of the site, with no default.
MEDIA_SCHEME = "media-store://"
#: Where the mirrored feed's direct links go, and what its list pages hold.
MIRROR_HOST, MIRROR_SUMMARY_CHARS = "mp.weixin.qq.com", 200
LIST_ENTRIES, LIST_BLOCK_CHARS = 20, 3000
LISTING_CHARS, LISTING_DATE_CHARS = 40_000, 80
SECTION_LINES, SELECTED_ROWS = 1000, 200
BACKFILL_DAYS = 14
LIST_SKIPPED = ("/author/", "/tag/", "/category/", "/page/")
CHUNK_CHARS = 2000
NOTE_ID_MINUTES, HIGHLIGHTS, HEADLINE_WORDS = 60, 5, 30
LABEL_CHARS, NODE_CHARS = 24, 30
#: Translation: tokens of a call, twice as many for the second model; shares and lengths that decide.
CALL_TOKENS, RETRY_SHARE, RETRIES, SPLIT_CHARS = 8000, 0.10, 2, 400
#: Notices and placeholders of translations that aren't whole; fixed, as readers see them.
KEPT_CHUNKS = "{}/{} 个分块因翻译调用异常保留原文未翻译"
PART_NOTICE = "翻译完整性机械校验未通过，仅完整翻译首尾部分，其余章节保留原文提示"
CODE_NOTICE = "原文结构复杂（大量代码/技术实现内容），机器翻译难以完整覆盖，已展示开头与结尾内容，建议查看原文获取完整教程"
PART_PLACEHOLDER = "（原文中间部分因翻译完整性校验未通过，未逐段翻译，可通过原文链接查阅完整内容）"
CODE_PLACEHOLDER = "（原文包含大量代码/技术实现内容，机器翻译难以逐段覆盖，完整代码请查阅原文链接）"
