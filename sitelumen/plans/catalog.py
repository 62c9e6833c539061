"""The rule catalogue: 107 declarative rules as SQL expressions over the page-facts and site-facts frames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from sitelumen.plans.advice import ADVICE

#: Entries of a finding's sample that the evidence shows.
SAMPLES = 5

# --- fixed values ---
CATEGORIES = ("technical", "onpage", "structured-data", "performance", "i18n", "ai-search", "links", "media", "security")
CATEGORY_WEIGHT = {
    "technical": 0.22, "onpage": 0.20, "links": 0.12, "performance": 0.12, "structured-data": 0.10, "i18n": 0.08, "ai-search": 0.08, "media": 0.08, "security": 0.0,
}
SEVERITIES = ("critical", "error", "warning", "notice", "info")
SEVERITY_MULTIPLIER = {"critical": 5.0, "error": 3.0, "warning": 1.5, "notice": 0.5, "info": 0.0}
SEVERITY_BOOST = {"critical": 1.5, "error": 1.2, "warning": 1.0, "notice": 0.8, "info": 0.5}
EFFORT_FACTOR = {"low": 1.0, "medium": 0.6, "high": 0.35}
NEEDS = ("html", "headers", "net", "site")
CONTENT_DEPENDENT = frozenset(
    "thin-content h1-missing h1-count heading-hierarchy-skip duplicate-content-cluster img-missing-alt img-missing-dimensions img-alt-quality jsonld-missing "
    "answerable-summary-missing broken-internal-link orphan-page anchor-text-generic internal-links-few".split()
)
# --- end of fixed values ---


@dataclass(frozen=True)
class Rule:
    """One rule; ``applies`` and ``fails`` are boolean SQL over a facts row, ``measure`` a number for the evidence.

    ``message`` (with ``{value}`` for the measure and ``{pages}`` for the number of pages) and ``fix`` are what a finding
    says, ``sample`` an array of what it is about, of which the evidence shows SAMPLES. ``pages`` names an array column of
    a site-facts row with the first pages of a finding (``measure`` counts them all), ``page`` one with its single page.
    ``groups`` is a page column: each of its values that several pages share is a finding of its own.

    A rule in Python has ``check`` instead of ``fails``: it is called with a dict of the columns that ``reads`` names, for
    each row that the rule applies to, and returns whether the row fails, or a number, which fails and is the measure.
    What it raises is kept as an error of the rule and fails nothing. With ``by_frame`` it is called with a pandas frame of
    those columns, many rows at a time, and returns a Series. A rule with ``finds`` may have several findings a row: it is
    called as a check is and gives a dict for each, with its own ``message``, ``measure`` and ``sample`` where it likes.
    """

    id: str
    category: str
    severity: str
    weight: int
    impact: int
    effort: str
    applies: str
    fails: str = ""
    needs: tuple[str, ...] = ("html",)
    scope: str = "page"
    measure: str = "NULL"
    pages: str = "NULL"
    groups: str | None = None
    page: str = "NULL"
    message: str = ""
    fix: str = ""
    sample: str = "NULL"
    check: Callable[[dict], object] | None = None
    reads: tuple[str, ...] = ()
    by_frame: bool = False
    finds: Callable[[dict], Iterable[dict]] | None = None

    @property
    def python(self) -> bool:
        return self.check is not None or self.finds is not None

    def __post_init__(self) -> None:
        if not self.id or self.category not in CATEGORIES or self.severity not in SEVERITIES or self.effort not in EFFORT_FACTOR:
            raise ValueError(f"bad rule {self.id!r}")
        if not 1 <= self.weight <= 10 or not 1 <= self.impact <= 5 or self.scope not in ("page", "site") or not set(self.needs) <= set(NEEDS):
            raise ValueError(f"bad rule {self.id!r}")
        if not self.applies or bool(self.fails) + (self.check is not None) + (self.finds is not None) != 1 or (self.python and not self.reads):
            raise ValueError(f"rule {self.id!r} needs applies, and one of fails, check with reads, and finds with reads")

    @property
    def says(self) -> str:
        return self.message or f"The rule {self.id} fails."

    @property
    def mend(self) -> str:
        return self.fix or f"See what the rule {self.id} asks for."

    @property
    def offline(self) -> bool:
        return not {"headers", "net"} & set(self.needs)


def _rules(category: str, scope: str, rows: list[tuple]) -> list[Rule]:
    """Rules of (id, severity, weight, impact, effort, applies, fails, options)."""
    out = []
    for name, severity, weight, impact, effort, applies, fails, *rest in rows:
        options = dict(rest[0]) if rest else {}
        needs = options.pop("needs", "html" if scope == "page" else "site")
        message, fix = ADVICE[name]
        out.append(Rule(name, category, severity, weight, impact, effort, applies, fails, tuple(needs.split("+")), scope, message=message, fix=fix, **options))
    return out


# --- fixed values: ASCII word bounds and the patterns of questions, services, file names and language tags ---
W, NOT_W = "(?=[A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_B = "(?<![A-Za-z0-9_])"
#: Word bounds are those of ASCII words, so a letter outside ASCII ends none.
QUESTION = "(?i)[?]|" + "|".join([f"{_B}{w}{NOT_W}" for w in ("ne", "nasıl", "neden", "hangi", "nedir", "mi", "mu")] + [f"{_B}{w}{W}" for w in ("ka[çÇ]", "mı", "m[üÜ]")])
SERVICE = "(?i)(hizmet|dublaj|seslendirme|fiyat|paket|cozum|[çÇ][öÖ]z[üÜ]m|service|pricing)"
FAQ_SERVICE = "(?i)(hizmet|fiyat|paket|dublaj|seslendirme|service|pricing)"
BAD_FILE = r"(?i)(?:^|/)(?:img[_-]?\\d+|dsc[_-]?\\d+|image\\d*|photo\\d*|adsiz|untitled|screenshot)[^/]*$"
BCP47 = "^(?:x-default|[a-z]{2,3}(?:-[A-Z][a-z]{3})?(?:-(?:[A-Z]{2}|[0-9]{3}))?)$"
# --- end of fixed values ---
QUESTIONS = f"size(filter(headings, h -> h.level >= 2 AND h.text RLIKE '{QUESTION}'))"
HEADERS = "ok AND size(headers) > 0"
ALT_BAD = (
    "i -> trim(coalesce(i.alt, '')) <> '' AND (length(trim(i.alt)) + regexp_count(trim(i.alt), '[\\\\x{10000}-\\\\x{10FFFF}]') > 125"
    " OR (substring_index(coalesce(i.src, ''), '/', -1) <> '' AND lower(translate(trim(i.alt), 'IİŞĞÜÖÇ', 'ıişğüöç')) = "
    "lower(translate(regexp_replace(substring_index(coalesce(i.src, ''), '/', -1), '(?i)[.][a-z0-9]+$', ''), 'IİŞĞÜÖÇ', 'ıişğüöç')))"
    " OR exists(array_distinct({t}), x -> size(filter({t}, y -> y = x)) >= 3))"
).replace("{t}", "filter(split(lower(translate(i.alt, 'IİŞĞÜÖÇ', 'ıişğüöç')), '[^a-zçğıöşü0-9]+'), w -> length(w) > 1)")

RULES: list[Rule] = [
    *_rules("technical", "page", [
        ("soft-404", "error", 8, 4, "medium", "ok", "soft404"),
        ("redirect-chain", "warning", 5, 3, "low", "true", "size(redirect_chain) >= 2", {"needs": "headers", "measure": "size(redirect_chain)", "sample": "transform(redirect_chain, r -> r.url)"}),
        ("canonical-missing", "warning", 6, 3, "low", "idx", "canonical IS NULL"),
        ("canonical-relative-url", "warning", 4, 3, "low", "coalesce(canonical_raw, '') <> ''", "NOT trim(canonical_raw) RLIKE '(?i)^https?://'", {"sample": "array(canonical_raw)"}),
        ("canonical-cross-host", "error", 8, 5, "low", "canonical IS NOT NULL", "canonical_host IS NOT NULL AND regexp_replace(canonical_host, '^www[.]', '') <> regexp_replace(page_host, '^www[.]', '')", {"sample": "array(canonical)"}),
        ("canonical-non-200", "error", 9, 5, "low", "canonical IS NOT NULL AND has_status", "canonical_bad", {"needs": "html+net", "sample": "array(canonical)"}),
        ("robots-noindex-conflict", "critical", 10, 5, "low", "ok AND NOT robots_index", "in_sitemap OR inlinks > 0", {"needs": "html+site", "measure": "inlinks"}),
        ("meta-robots-nofollow", "error", 6, 4, "low", "ok", "NOT robots_follow"),
        ("mixed-content", "error", 7, 4, "medium", "url LIKE 'https://%'", "size(insecure) > 0", {"measure": "size(insecure)", "sample": "transform(insecure, i -> i.url)"}),
        ("url-turkish-charset", "warning", 5, 3, "medium", "ok", "url_turkish"),
        ("url-uppercase-underscore", "notice", 3, 2, "medium", "ok", "url_upper"),
        ("url-excessive-depth", "notice", 3, 2, "high", "ok", "path_depth > 4", {"measure": "path_depth"}),
    ]),
    *_rules("technical", "site", [
        ("robots-txt-missing", "warning", 5, 3, "low", "true", "NOT robots_found", {"needs": "net"}),
        ("sitemap-missing", "error", 8, 4, "medium", "true", "sitemaps_ok = 0", {"needs": "net"}),
        ("sitemap-invalid-xml", "error", 7, 4, "low", "sitemaps > 0", "sitemaps > sitemaps_ok", {"needs": "net", "measure": "sitemaps - sitemaps_ok"}),
        ("sitemap-url-non-indexable", "error", 8, 4, "medium", "sitemap_locs > 0", "sitemap_bad > 0", {"needs": "net+site", "measure": "sitemap_bad"}),
        ("sitemap-orphan-pages", "warning", 6, 3, "medium", "sitemap_locs > 0 AND pages > 1", "sitemap_orphans_count > 0", {"measure": "sitemap_orphans_count", "pages": "sitemap_orphans"}),
        ("sitemap-lastmod-invalid", "notice", 3, 2, "low", "sitemap_entries > 0", "lastmod_bad > 0", {"needs": "net", "measure": "lastmod_bad"}),
        ("http-status-error", "critical", 10, 5, "medium", "statuses > 0", "status_bad > 0", {"needs": "net+site", "measure": "status_bad"}),
        ("www-https-canonicalization", "error", 8, 5, "low", "net AND size(hosts) > 0", "size(array_intersect(hosts, transform(hosts, h -> concat('www.', h)))) > 0", {"needs": "net+site", "sample": "array_intersect(hosts, transform(hosts, h -> concat('www.', h)))"}),
        ("duplicate-content-cluster", "error", 8, 4, "high", "pages > 1", "near_duplicates > 0", {"measure": "near_duplicates"}),
        ("client-side-rendering", "warning", 7, 4, "high", "pages > 0", "spa_share >= 0.5"),
    ]),
    *_rules("onpage", "page", [
        ("title-missing", "critical", 10, 5, "low", "idx", "title IS NULL"),
        ("title-pixel-width", "warning", 7, 4, "low", "idx AND title IS NOT NULL", "title_px > 580", {"measure": "title_px", "sample": "array(title)"}),
        ("title-too-short", "notice", 4, 3, "low", "idx AND title IS NOT NULL", "length(title) < 30", {"measure": "length(title)", "sample": "array(title)"}),
        ("meta-description-missing", "warning", 6, 3, "low", "idx", "meta_description IS NULL"),
        ("meta-description-length", "notice", 4, 2, "low", "idx AND meta_description IS NOT NULL", "NOT (length(meta_description) >= 70 AND description_px <= 990)", {"measure": "length(meta_description)", "sample": "array(meta_description)"}),
        ("h1-missing", "error", 8, 4, "low", "idx", "h1_count = 0"),
        ("h1-count", "warning", 5, 3, "low", "idx", "h1_count > 1", {"measure": "h1_count", "sample": "transform(filter(headings, h -> h.level = 1), h -> h.text)"}),
        ("heading-hierarchy-skip", "notice", 3, 2, "low", "idx", "jumps > 0", {"measure": "jumps"}),
        ("heading-empty", "notice", 2, 2, "low", "idx", "exists(headings, h -> h.text = '')"),
        ("thin-content", "warning", 6, 4, "high", "idx AND NOT soft404", "mw < {min_words}", {"measure": "mw"}),
        ("turkish-mojibake", "critical", 9, 5, "low", "ok", "mojibake"),
        ("charset-declaration-late", "error", 7, 4, "low", "ok", "NOT coalesce(charset_pos <= 1024, false) AND NOT (charset_pos IS NULL AND coalesce(headers['content-type'], '') RLIKE '(?i)charset=')", {"measure": "charset_pos"}),
        ("viewport-meta-missing", "error", 7, 4, "low", "ok", "NOT coalesce(viewport RLIKE '(?i)width\\\\s*=\\\\s*device-width', false)"),
        ("lang-attribute-missing", "error", 8, 4, "low", "ok", "coalesce(lang, '') = ''"),
    ]),
    *_rules("onpage", "site", [
        ("title-duplicate", "error", 8, 4, "medium", "pages > 1", "title_groups > 0", {"groups": "title"}),
        ("meta-description-duplicate", "warning", 5, 3, "medium", "pages > 1", "meta_description_groups > 0", {"groups": "meta_description"}),
    ]),
    *_rules("structured-data", "page", [
        ("jsonld-parse-error", "error", 9, 4, "low", "ok AND size(jsonld) > 0", "exists(jsonld, b -> b.error)", {"measure": "size(filter(jsonld, b -> b.error))"}),
        ("jsonld-missing", "warning", 6, 3, "medium", "idx", "size(jsonld) = 0"),
        ("jsonld-context-invalid", "error", 7, 3, "low", "ok AND exists(jsonld, b -> b.parsed)", "exists(jsonld, b -> b.context_bad)"),
        ("jsonld-required-props", "error", 8, 4, "medium", "ok AND exists(jsonld, b -> b.parsed)", "exists(nodes, n -> size(n.missing) > 0)", {"measure": "size(filter(nodes, n -> size(n.missing) > 0))", "sample": "array_distinct(flatten(transform(nodes, n -> n.missing)))"}),
        ("jsonld-faq-mismatch", "error", 7, 4, "low", "ok AND array_contains(types, 'FAQPage')", "faq_unseen > 0", {"measure": "faq_unseen"}),
        ("jsonld-service-missing", "warning", 6, 4, "medium", f"idx AND (url RLIKE '{SERVICE}' OR coalesce(first_h1, '') RLIKE '{SERVICE}')", "NOT arrays_overlap(types, array('Service', 'Offer', 'Product', 'ProfessionalService'))"),
        ("jsonld-breadcrumb-missing", "notice", 4, 2, "low", "idx AND path_depth >= 2", "NOT array_contains(types, 'BreadcrumbList')"),
        ("og-missing", "warning", 5, 3, "low", "idx", "size(array_except(array('title', 'description', 'image', 'url'), map_keys(og))) > 0", {"sample": "array_except(array('title', 'description', 'image', 'url'), map_keys(og))"}),
        ("twitter-card-missing", "notice", 3, 2, "low", "idx", "NOT array_contains(map_keys(twitter), 'card')"),
    ]),
    *_rules("structured-data", "site", [
        ("jsonld-organization-missing", "warning", 6, 4, "low", "true", "NOT arrays_overlap(home.types, array('Organization', 'LocalBusiness', 'ProfessionalService', 'Corporation'))", {"page": "home.url"}),
        ("jsonld-sameas-missing", "notice", 4, 3, "low", "has_organization", "NOT has_same_as"),
    ]),
    *_rules("performance", "page", [
        ("render-blocking-css", "warning", 7, 4, "medium", "ok", "blocking_css > 1", {"measure": "blocking_css"}),
        ("render-blocking-js", "warning", 7, 4, "low", "ok", "blocking_js > 0", {"measure": "blocking_js"}),
        ("lcp-candidate-lazy", "error", 8, 5, "low", "ok AND has_first_image", "first_image_loading = 'lazy'"),
        ("no-compression", "error", 8, 4, "low", HEADERS, "html_bytes >= 2048 AND NOT coalesce(headers['content-encoding'], '') RLIKE '(?i)br|gzip|zstd|deflate'", {"needs": "headers", "measure": "html_bytes"}),
        ("ttfb-slow", "warning", 6, 4, "high", "ok AND ttfb_ms IS NOT NULL", "ttfb_ms > 800", {"needs": "headers", "measure": "ttfb_ms"}),
        ("html-size-excessive", "warning", 5, 3, "medium", "ok", "floor(html_bytes / 1024 + 0.5) > 250", {"measure": "html_bytes"}),
        ("dom-node-count", "notice", 4, 3, "high", "ok", "dom_nodes > 1500", {"measure": "dom_nodes"}),
        ("inline-style-bloat", "notice", 3, 2, "medium", "ok", "floor(style_bytes / 1024 + 0.5) > 50", {"measure": "style_bytes"}),
        ("third-party-script-count", "warning", 6, 4, "medium", "ok", "size(third_hosts) > 8", {"measure": "size(third_hosts)", "sample": "third_hosts"}),
        ("font-display-missing", "notice", 4, 3, "low", "ok AND (font_face OR size(font_links) > 0)", "NOT font_display AND NOT exists(font_links, h -> h LIKE '%display=%')"),
        ("preconnect-missing", "notice", 3, 2, "low", "ok AND size(third_hosts) > 0", "size(array_except(third_hosts, preconnect_hosts)) > 0", {"sample": "array_except(third_hosts, preconnect_hosts)"}),
    ]),
    *_rules("i18n", "page", [
        ("lang-attribute-mismatch", "error", 8, 4, "low", "ok AND coalesce(lang, '') <> '' AND wc >= 50", "turkish_ratio >= 0.06 AND NOT lower(lang) LIKE 'tr%'", {"sample": "array(lang)"}),
        ("lang-region-format", "notice", 3, 2, "low", "ok AND coalesce(lang, '') <> ''", f"NOT lang RLIKE '{BCP47}'", {"sample": "array(lang)"}),
        ("hreflang-invalid-code", "error", 8, 4, "low", "ok AND size(hreflang) > 0", f"exists(hreflang, h -> NOT h.lang RLIKE '{BCP47}')"),
        ("hreflang-self-missing", "error", 7, 4, "low", "ok AND size(hreflang) > 0", "NOT exists(hreflang, h -> coalesce(h.normalized = nurl, false))"),
        ("hreflang-return-tag", "error", 9, 4, "medium", "ok AND size(hreflang) > 0 AND site_pages > 1", "no_return > 0", {"needs": "html+site", "measure": "no_return"}),
        ("hreflang-non-200", "error", 8, 4, "low", "ok AND size(hreflang) > 0 AND has_status", "hreflang_bad > 0", {"needs": "html+net", "measure": "hreflang_bad"}),
        ("hreflang-canonical-conflict", "error", 8, 4, "medium", "ok AND size(hreflang) > 0 AND canonical IS NOT NULL", "coalesce(canonical_norm <> nurl, false)", {"sample": "array(canonical)"}),
    ]),
    *_rules("i18n", "site", [
        ("hreflang-x-default-missing", "notice", 3, 2, "low", "size(hreflang_langs) >= 2", "NOT array_contains(hreflang_langs, 'x-default')"),
        ("hreflang-missing-multilocale", "warning", 6, 4, "medium", "size(locales) >= 2", "size(hreflang_langs) = 0"),
    ]),
    *_rules("ai-search", "site", [
        ("ai-crawler-blocked", "warning", 5, 3, "low", "robots_found", "ai_blocked > 0", {"needs": "net", "measure": "ai_blocked"}),
        ("llms-txt-missing", "notice", 4, 2, "low", "true", "NOT llms_found", {"needs": "net"}),
    ]),
    *_rules("ai-search", "page", [
        ("content-server-rendered", "warning", 7, 4, "high", "idx", "spa"),
        ("answerable-summary-missing", "notice", 5, 3, "low", "idx AND mw >= 300", "first_paragraph IS NULL OR paragraph_units NOT BETWEEN 80 AND 400", {"measure": "paragraph_units"}),
        ("faq-block-missing", "notice", 5, 3, "medium", f"idx AND url RLIKE '{FAQ_SERVICE}' AND mw >= 250", f"{QUESTIONS} < 2 AND NOT array_contains(types, 'FAQPage')"),
        ("content-freshness-missing", "notice", 4, 2, "low", "idx AND mw >= 500", f"NOT exists(jsonld, b -> b.raw RLIKE '\"date(Modified|Published)\"') AND NOT substring(main_text, 1, 1200) RLIKE '{_B}20[0-9][0-9]{NOT_W}' AND NOT main_text RLIKE '(?i)(g[üÜ]ncelleme|g[üÜ]ncellendi|yayınlanma)'"),
        ("heading-question-form", "info", 2, 2, "low", "ok AND mw >= 800", f"{QUESTIONS} < floor(mw / 800)"),
        ("toc-missing", "info", 2, 2, "low", "ok AND mw >= 1500", "size(filter(links, l -> l.href LIKE '#%')) < 3"),
    ]),
    *_rules("links", "page", [
        ("broken-internal-link", "critical", 10, 5, "low", "ok AND has_status", "broken_links > 0", {"needs": "html+net+site", "measure": "broken_links"}),
        ("internal-redirect-link", "warning", 5, 3, "low", "ok AND has_status", "redirect_links > 0", {"needs": "html+net+site", "measure": "redirect_links"}),
        ("anchor-text-generic", "notice", 4, 3, "low", "ok AND size(links) > 0", "generic_links > 0", {"measure": "generic_links"}),
        ("anchor-text-empty", "warning", 6, 3, "low", "ok AND size(links) > 0", "exists(links, l -> l.accessible = '')", {"sample": "transform(filter(links, l -> l.accessible = ''), l -> l.href)"}),
        ("target-blank-no-noopener", "warning", 5, 2, "low", "ok AND exists(links, l -> l.blank)", "exists(links, l -> l.blank AND NOT array_contains(l.rel, 'noopener'))", {"sample": "transform(filter(links, l -> l.blank AND NOT array_contains(l.rel, 'noopener')), l -> l.href)"}),
        ("internal-link-nofollow", "notice", 4, 2, "low", "ok", "exists(links, l -> l.internal AND array_contains(l.rel, 'nofollow'))", {"sample": "transform(filter(links, l -> l.internal AND array_contains(l.rel, 'nofollow')), l -> l.href)"}),
        ("internal-links-few", "notice", 4, 3, "medium", "idx AND mw > 300", "size(filter(links, l -> l.internal AND l.area = 'main')) < 3", {"measure": "size(filter(links, l -> l.internal AND l.area = 'main'))"}),
        ("excessive-links", "notice", 3, 2, "medium", "ok", "size(links) > 150", {"measure": "size(links)"}),
        ("link-to-http", "warning", 5, 3, "low", "url LIKE 'https://%'", "exists(links, l -> l.internal AND l.abs LIKE 'http://%')", {"sample": "transform(filter(links, l -> l.internal AND l.abs LIKE 'http://%'), l -> l.abs)"}),
    ]),
    *_rules("links", "site", [
        ("orphan-page", "error", 8, 4, "medium", "pages > 2 AND NOT single_page", "orphans_count > 0", {"measure": "orphans_count", "pages": "orphans"}),
    ]),
    *_rules("media", "page", [
        ("img-missing-alt", "error", 8, 4, "low", "ok AND size(images) > 0", "exists(images, i -> i.alt IS NULL)", {"measure": "size(filter(images, i -> i.alt IS NULL))", "sample": "transform(filter(images, i -> i.alt IS NULL), i -> i.src)"}),
        ("img-alt-quality", "notice", 4, 2, "low", "ok AND exists(images, i -> trim(coalesce(i.alt, '')) <> '')", f"exists(images, {ALT_BAD})"),
        ("img-missing-dimensions", "warning", 7, 4, "low", "ok AND size(images) > 0", "exists(images, i -> NOT i.dimensions)", {"measure": "size(filter(images, i -> NOT i.dimensions))", "sample": "transform(filter(images, i -> NOT i.dimensions), i -> i.src)"}),
        ("img-legacy-format", "notice", 4, 3, "medium", "ok AND exists(images, i -> i.format IS NOT NULL)", "exists(images, i -> coalesce(i.format IN ('jpg', 'jpeg', 'png'), false) AND NOT i.modern)", {"sample": "transform(filter(images, i -> coalesce(i.format IN ('jpg', 'jpeg', 'png'), false) AND NOT i.modern), i -> i.src)"}),
        ("img-lazy-missing", "notice", 4, 3, "low", "ok AND size(images) > 3", "exists(slice(images, 3, size(images)), i -> coalesce(i.loading, '') <> 'lazy')"),
        ("img-filename-quality", "notice", 3, 2, "medium", "ok AND size(images) > 0", f"exists(images, i -> coalesce(i.src, '') RLIKE '{BAD_FILE}' OR substring_index(coalesce(i.src, ''), '/', -1) RLIKE '[ıİşŞğĞüÜöÖçÇ\\\\s]')"),
        ("video-missing-schema", "warning", 6, 4, "medium", "ok AND videos > 0", "NOT array_contains(types, 'VideoObject')"),
        ("audio-missing-transcript", "warning", 6, 4, "medium", "ok AND audios > 0", "NOT (arrays_overlap(types, array('AudioObject', 'PodcastEpisode')) AND mw >= 80 * audios)"),
        ("iframe-missing-title", "notice", 3, 2, "low", "ok AND size(iframe_titles) > 0", "exists(iframe_titles, t -> coalesce(t, '') = '')"),
    ]),
    *_rules("security", "page", [
        ("hsts-missing", "warning", 7, 4, "low", f"{HEADERS} AND url LIKE 'https://%'", "coalesce(headers['strict-transport-security'], '') = ''", {"needs": "headers"}),
        ("hsts-weak", "notice", 4, 2, "low", f"{HEADERS} AND coalesce(headers['strict-transport-security'], '') <> ''", "coalesce(try_cast(regexp_extract(headers['strict-transport-security'], '(?i)max-age\\\\s*=\\\\s*([0-9]+)', 1) AS DECIMAL(38, 0)), 0) < 15552000", {"needs": "headers", "sample": "array(headers['strict-transport-security'])"}),
        ("csp-missing", "warning", 7, 4, "high", HEADERS, "coalesce(headers['content-security-policy'], '') = ''", {"needs": "headers"}),
        ("csp-unsafe", "notice", 5, 3, "high", f"{HEADERS} AND coalesce(headers['content-security-policy'], '') <> ''", "headers['content-security-policy'] RLIKE \"(?i)'unsafe-inline'|'unsafe-eval'|script-src[^;]*[*](?![.])\"", {"needs": "headers", "sample": "array(headers['content-security-policy'])"}),
        ("x-content-type-options-missing", "notice", 5, 3, "low", HEADERS, "NOT coalesce(headers['x-content-type-options'], '') RLIKE '(?i)nosniff'", {"needs": "headers"}),
        ("clickjacking-protection-missing", "notice", 5, 3, "low", HEADERS, "coalesce(headers['x-frame-options'], '') = '' AND NOT coalesce(headers['content-security-policy'], '') RLIKE '(?i)frame-ancestors'", {"needs": "headers"}),
        ("referrer-policy-missing", "notice", 4, 2, "low", HEADERS, "coalesce(headers['referrer-policy'], '') = ''", {"needs": "headers"}),
        ("permissions-policy-missing", "info", 3, 2, "low", HEADERS, "coalesce(headers['permissions-policy'], '') = ''", {"needs": "headers"}),
        ("cookie-flags-weak", "warning", 6, 3, "low", f"{HEADERS} AND coalesce(headers['set-cookie'], '') <> ''", "NOT (headers['set-cookie'] RLIKE '(?i);\\\\s*secure' AND headers['set-cookie'] RLIKE '(?i);\\\\s*httponly' AND headers['set-cookie'] RLIKE '(?i);\\\\s*samesite')", {"needs": "headers"}),
        ("server-version-disclosure", "info", 2, 1, "low", HEADERS, "exists(array('server', 'x-powered-by', 'x-aspnet-version', 'x-generator'), k -> coalesce(headers[k], '') RLIKE '[0-9]+[.][0-9]+')", {"needs": "headers"}),
        ("sri-missing", "notice", 5, 3, "medium", "ok AND size(third_hosts) > 0", "exists(scripts, s -> coalesce(s.integrity, '') = '')", {"measure": "size(filter(scripts, s -> coalesce(s.integrity, '') = ''))", "sample": "transform(filter(scripts, s -> coalesce(s.integrity, '') = ''), s -> s.src)"}),
    ]),
]

if len({r.id for r in RULES}) != len(RULES):
    raise ValueError("rule ids repeat")
BY_ID = {r.id: r for r in RULES}


def catalog_digest(rules: list[Rule] = RULES) -> str:
    """A short digest of ids, categories, severities and weights, the same whatever the order."""
    import hashlib

    return hashlib.sha256("|".join(sorted(f"{r.id}:{r.category}:{r.severity}:{r.weight}" for r in rules)).encode()).hexdigest()[:16]
