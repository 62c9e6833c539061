"""One HTML page to one nested record; an Arrow-batched operator that returns facts, not verdicts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelumen.functions import url as U
from sitelumen.sources.html_tree import Node, tree

# --- fixed values ---
GENERIC_ANCHORS = (
    "buraya tıklayın", "tıklayın", "tıkla", "devamı", "devamını oku", "daha fazla", "daha fazlası", "detaylar", "detaylı bilgi", "incele", "buradan",
    "link", "click here", "read more", "more", "here", "learn more",
)
EMBED_HOSTS = ("youtube.com", "youtu.be", "vimeo.com", "dailymotion")
#: Properties a schema.org type needs.
REQUIRED_PROPS = {
    "Article": ("headline", "datePublished", "author"),
    "NewsArticle": ("headline", "datePublished", "author"),
    "BlogPosting": ("headline", "datePublished", "author"),
    "Product": ("name", "offers"),
    "Service": ("name", "provider"),
    "LocalBusiness": ("name", "address", "telephone"),
    "Organization": ("name", "url"),
    "FAQPage": ("mainEntity",),
    "BreadcrumbList": ("itemListElement",),
    "VideoObject": ("name", "thumbnailUrl", "uploadDate"),
    "Event": ("name", "startDate", "location"),
}
# --- end of fixed values ---

SPACE = re.compile(r"[\s\ufeff]+")
NO_TEXT = frozenset(("script", "style", "noscript", "template", "svg"))
NOT_MAIN = frozenset(("script", "style", "noscript", "nav", "header", "footer", "aside"))
AREAS = ("nav", "footer", "header", "aside")

S, I, B = pa.string(), pa.int32(), pa.bool_()
SCHEMA = pa.schema(
    [
        ("title", S), ("meta_description", S), ("canonical_raw", S), ("canonical", S), ("robots_meta", S), ("viewport", S), ("lang", S), ("generator", S),
        ("charset_pos", I), ("charset", S),
        ("headings", pa.list_(pa.struct([("level", I), ("text", S)]))),
        ("text", S), ("main_text", S), ("first_paragraph", S), ("dom_nodes", I),
        ("links", pa.list_(pa.struct([("pos", I), ("href", S), ("abs", S), ("normalized", S), ("anchor", S), ("accessible", S), ("rel", pa.list_(S)), ("internal", B), ("blank", B), ("area", S)]))),
        ("images", pa.list_(pa.struct([("src", S), ("abs", S), ("alt", S), ("dimensions", B), ("loading", S), ("format", S), ("modern", B)]))),
        ("videos", I), ("audios", I), ("iframe_titles", pa.list_(S)),
        ("jsonld", pa.list_(pa.struct([("raw", S), ("error", B), ("types", pa.list_(S)), ("context_bad", B), ("parsed", B)]))),
        ("nodes", pa.list_(pa.struct([("types", pa.list_(S)), ("missing", pa.list_(S)), ("questions", pa.list_(S)), ("same_as", B)]))),
        ("og", pa.map_(S, S)), ("twitter", pa.map_(S, S)),
        ("hreflang", pa.list_(pa.struct([("lang", S), ("href", S), ("abs", S), ("normalized", S), ("source", S)]))),
        ("blocking_css", I), ("blocking_js", I), ("preconnect_hosts", pa.list_(S)),
        ("insecure", pa.list_(pa.struct([("tag", S), ("url", S)]))),
        ("scripts", pa.list_(pa.struct([("src", S), ("host", S), ("integrity", S)]))),
        ("style_bytes", I), ("script_bytes", I), ("font_links", pa.list_(S)), ("has_first_image", B), ("first_image_loading", S), ("parse_error", S),
    ]
)


def squeezed(text: str) -> str:
    return SPACE.sub(" ", text).strip()


def _strict(_: str) -> None:
    raise ValueError


def json_types(node: object, out: list[str]) -> list[str]:
    if isinstance(node, list):
        for x in node:
            json_types(x, out)
    elif isinstance(node, dict):
        kind = node.get("@type")
        out += [kind] if isinstance(kind, str) else [x for x in kind if isinstance(x, str)] if isinstance(kind, list) else []
        if isinstance(node.get("@graph"), list):
            json_types(node["@graph"], out)
        for key in ("mainEntity", "itemListElement", "hasPart"):
            if node.get(key):
                json_types(node[key], out)
    return out


def typed_nodes(node: object, out: list[dict]) -> list[dict]:
    """Nodes with a type at top level, in arrays and in @graph."""
    if isinstance(node, list):
        for x in node:
            typed_nodes(x, out)
    elif isinstance(node, dict):
        if isinstance(node.get("@graph"), list):
            typed_nodes(node["@graph"], out)
        if node.get("@type"):
            out.append(node)
    return out


def node_facts(node: dict) -> dict:
    kind = node["@type"]
    kinds = [x for x in (kind if isinstance(kind, list) else [kind]) if isinstance(x, str)]
    missing = [f"{k}.{p}" for k in kinds for p in REQUIRED_PROPS.get(k, ()) if node.get(p) is None or node.get(p) == ""]
    asked = node.get("mainEntity") if kind == "FAQPage" else None
    asked = asked if isinstance(asked, list) else [asked] if asked else []
    questions = [q["name"] for q in asked if isinstance(q, dict) and isinstance(q.get("name"), str) and q["name"]]
    same = node.get("sameAs")
    return {"types": kinds, "missing": missing, "questions": questions, "same_as": bool(same) if not isinstance(same, list) else len(same) > 0}


def context_bad(parsed: object) -> bool:
    for node in parsed if isinstance(parsed, list) else [parsed]:
        own = node.get("@context") if isinstance(node, dict) else None
        if not own or "schema.org" not in json.dumps(own, ensure_ascii=False):
            return True
    return False


def link_area(node: Node) -> str:
    up: set[str] = set()
    at: Node | None = node
    while at is not None:
        up.add(at.tag)
        if at.attrs.get("role") == "navigation":
            up.add("nav")
        at = at.parent
    return next((a for a in AREAS if a in up), "main")


def extract(url: str | None, html: str | None, headers: dict[str, str] | None = None) -> dict:
    """The page's record (fields of SCHEMA)."""
    html, headers = html or "", headers or {}
    root = tree(html)
    every = list(root.walk())
    of: dict[str, list[Node]] = {}
    for node in every:
        of.setdefault(node.tag, []).append(node)
    tags = lambda *names: [n for n in every if n.tag in names]

    def meta(name: str) -> str | None:
        found = next((n for n in of.get("meta", ()) if n.attrs.get("name") == name), None)
        return (found.attrs.get("content", "").strip() or None) if found else None

    def links_of(rel: str) -> list[Node]:
        return [n for n in of.get("link", ()) if n.attrs.get("rel") == rel]

    base_href = next((n.attrs["href"] for n in of.get("base", ()) if "href" in n.attrs), None)
    base = (U.resolve(base_href, url) or url) if base_href else url
    title = next((n.text().strip() for n in of.get("title", ()) if n.parent.tag == "head"), "") or None
    canonical_raw = next((n.attrs.get("href") for n in links_of("canonical")), None)
    charset = re.search(r"<meta[^>]+charset\s*=\s*[\"']?([\w-]+)", html, re.I)
    header_charset = re.search(r"charset=([\w-]+)", headers.get("content-type") or "", re.I)
    robots = ",".join(x for x in (meta("robots"), meta("googlebot")) if x)

    main = next((of[t][0] for t in ("main", "article", "body") if of.get(t)), root)
    paragraph = next((t for n in of.get("p", ()) if n.within("body") and len((t := n.text()).strip()) > 40), None)

    anchors = []
    for node in of.get("a", ()):
        absolute = U.resolve(node.attrs.get("href"), base)
        if not absolute:
            continue
        anchor = squeezed(node.text())
        alt = next((n.attrs["alt"].strip() for n in node.walk() if n.tag == "img" and "alt" in n.attrs), "")
        anchors.append(
            {
                "pos": len(anchors), "href": node.attrs["href"], "abs": absolute, "normalized": U.normalize(absolute) or absolute, "anchor": anchor,
                "accessible": anchor or alt or node.attrs.get("aria-label", "").strip(), "rel": node.attrs.get("rel", "").lower().split(),
                "internal": U.same_site(absolute, url), "blank": node.attrs.get("target") == "_blank", "area": link_area(node),
            }
        )

    images = []
    for node in of.get("img", ()):
        src = node.attrs.get("src", node.attrs.get("data-src"))
        absolute = U.resolve(src, base) if src else None
        kind = re.search(r"\.(jpe?g|png|gif|webp|avif|svg)(\?|$)", absolute or "", re.I)
        picture = node.closest("picture")
        modern = picture is not None and any(n.tag == "source" and n.attrs.get("type") in ("image/webp", "image/avif") for n in picture.walk())
        kind = kind[1].lower() if kind else None
        images.append(
            {
                "src": src, "abs": absolute, "alt": node.attrs.get("alt"), "loading": node.attrs.get("loading"), "format": kind, "modern": kind in ("webp", "avif") or modern,
                "dimensions": bool(node.attrs.get("width") and node.attrs.get("height")) or "aspect-ratio" in node.attrs.get("style", "").lower(),
            }
        )

    blocks, nodes = [], []
    for node in of.get("script", ()):
        if node.attrs.get("type") == "application/ld+json":
            raw = node.text()
            try:
                parsed = json.loads(raw, parse_constant=_strict)
            except (ValueError, RecursionError):
                blocks.append({"raw": raw, "error": True, "types": [], "context_bad": False, "parsed": False})
                continue
            truthy = parsed not in (None, False, "") and not (isinstance(parsed, (int, float)) and parsed == 0)
            blocks.append({"raw": raw, "error": False, "types": json_types(parsed, []), "context_bad": truthy and context_bad(parsed), "parsed": truthy})
            nodes += [node_facts(n) for n in typed_nodes(parsed, [])] if truthy else []

    def named(attribute: str, prefix: str) -> list[tuple[str, str]]:
        found = {}
        for n in of.get("meta", ()):
            key = n.attrs.get(attribute, "")
            if key.startswith(prefix) and key[len(prefix) :] and n.attrs.get("content"):
                found[key[len(prefix) :]] = n.attrs["content"]
        return list(found.items())

    alternates = [(n.attrs["hreflang"], n.attrs["href"], "html") for n in links_of("alternate") if n.attrs.get("hreflang") and n.attrs.get("href")]
    shape = r"<([^>]+)>\s*;\s*rel\s*=\s*\"?alternate\"?\s*;\s*hreflang\s*=\s*\"?([\w-]+)\"?"
    alternates += [(m[2], m[1], "header") for m in re.finditer(shape, headers.get("link") or "", re.I)]
    hreflang = []
    for lang, href, source in alternates:
        absolute = U.resolve(href, base)
        hreflang.append({"lang": lang, "href": href, "abs": absolute, "normalized": (U.normalize(absolute) or absolute) if absolute else None, "source": source})

    own_host, insecure, scripts = U.host(url), [], []
    for node in tags("script", "link", "img", "iframe", "source", "audio", "video"):
        raw = node.attrs.get("href" if node.tag == "link" else "src")
        if raw is None:
            continue
        absolute = U.resolve(node.attrs.get("src", node.attrs.get("href")), url)
        if not absolute:
            continue
        if absolute.startswith("http://"):
            insecure.append({"tag": node.tag, "url": absolute})
        if node.tag == "script" and (name := U.host(absolute)) and name != own_host:
            scripts.append({"src": absolute, "host": name, "integrity": node.attrs.get("integrity")})

    in_head = lambda n: n.within("head")
    css = [n for n in links_of("stylesheet") if in_head(n) and n.attrs.get("media", "all").lower() != "print"]
    js = [n for n in of.get("script", ()) if in_head(n) and "src" in n.attrs and "async" not in n.attrs and "defer" not in n.attrs and n.attrs.get("type", "") != "module"]
    connect = [U.host(U.resolve(n.attrs.get("href"), url)) for n in of.get("link", ()) if n.attrs.get("rel") in ("preconnect", "dns-prefetch")]
    first = next((n for n in of.get("img", ()) if n.within("body")), None)
    frames = of.get("iframe", [])
    return {
        "title": title, "meta_description": meta("description"), "canonical_raw": canonical_raw, "canonical": U.resolve(canonical_raw, base) if canonical_raw else None,
        "robots_meta": robots or None, "viewport": meta("viewport"), "lang": of["html"][0].attrs.get("lang"), "generator": meta("generator"),
        "charset_pos": len(html[: charset.start()].encode("utf-8", "replace")) if charset else None, "charset": charset[1] if charset else header_charset[1] if header_charset else None,
        "headings": [{"level": int(n.tag[1]), "text": squeezed(n.text())} for n in tags("h1", "h2", "h3", "h4", "h5", "h6")],
        "text": squeezed(root.text(NO_TEXT)), "main_text": squeezed(main.text(NOT_MAIN)), "first_paragraph": squeezed(paragraph) if paragraph else None, "dom_nodes": len(every),
        "links": anchors, "images": images, "videos": len(of.get("video", ())) + sum(any(h in n.attrs.get("src", "").lower() for h in EMBED_HOSTS) for n in frames),
        "audios": len(of.get("audio", ())), "iframe_titles": [n.attrs.get("title") for n in frames], "jsonld": blocks, "nodes": nodes,
        "og": named("property", "og:"), "twitter": named("name", "twitter:"), "hreflang": hreflang, "blocking_css": len(css), "blocking_js": len(js),
        "preconnect_hosts": [h for h in connect if h], "insecure": insecure, "scripts": scripts,
        "style_bytes": sum(len(n.text().encode("utf-8", "replace")) for n in of.get("style", ())), "script_bytes": sum(len(n.text().encode("utf-8", "replace")) for n in of.get("script", ())),
        "font_links": [n.attrs["href"] for n in of.get("link", ()) if "fonts.googleapis.com" in n.attrs.get("href", "") or "fonts.gstatic.com" in n.attrs.get("href", "")],
        "has_first_image": first is not None, "first_image_loading": first.attrs.get("loading") if first else None, "parse_error": None,
    }


def safe_extract(url: str | None, html: str | None, headers: dict[str, str] | None) -> dict:
    """``extract``, with the error in the record instead of raised; the rest is that of an empty page."""
    try:
        return extract(url, html, headers)
    except Exception as e:
        return extract(url, "", headers) | {"parse_error": f"{type(e).__name__}: {e}"}


def _spark_type(kind: pa.DataType) -> str:
    if pa.types.is_list(kind):
        return f"array<{_spark_type(kind.value_type)}>"
    if pa.types.is_map(kind):
        return f"map<{_spark_type(kind.key_type)},{_spark_type(kind.item_type)}>"
    if pa.types.is_struct(kind):
        return "struct<" + ",".join(f"{f.name}:{_spark_type(f.type)}" for f in kind) + ">"
    return {S: "string", I: "int", B: "boolean"}[kind]


def parsed_pages(raw: DataFrame, keep: list[str]) -> DataFrame:
    """``raw`` (url, html, headers and ``keep``) with one ``model`` struct a row; html is parsed once and not carried on."""
    ddl = "struct<" + ",".join(f"{f.name}:{_spark_type(f.type)}" for f in SCHEMA) + ">"
    kind = pa.struct(list(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, htmls = batch.column("url").to_pylist(), batch.column("html").to_pylist()
            heads = [dict(h or ()) for h in batch.column("headers").to_pylist()]
            made = [safe_extract(u, h, x) for u, h, x in zip(urls, htmls, heads, strict=True)]
            normal = [U.normalize(u) or u for u in urls]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(normal, S), pa.array(made, kind)], [*keep, "normalized_url", "model"])

    fields = {f.name: f.dataType.simpleString() for f in raw.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in keep) + f", normalized_url string, model {ddl}"
    rows = raw.select(*keep, *[c for c in ("url", "html", "headers") if c not in keep])
    return rows.mapInArrow(run, schema)


def model_columns() -> list:
    return [F.col(f"model.{f.name}").alias(f.name) for f in SCHEMA]
