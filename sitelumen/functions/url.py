"""URL functions: a WHATWG-style parser for the extractor and Column expressions for the rest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values ---
TRACKING_PARAMS = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid gbraid wbraid fbclid msclkid yclid ttclid ref mc_cid mc_eid _ga igshid".split()
)
MULTI_LEVEL_SUFFIXES = "com.tr net.tr org.tr gov.tr edu.tr k12.tr av.tr bel.tr co.uk org.uk com.au co.jp com.br".split()
NON_NAVIGATIONAL = ("mailto", "tel", "javascript", "data", "sms", "whatsapp")
ASSET_EXTENSIONS = "jpg jpeg png gif webp avif svg ico css js mjs json xml pdf zip rar mp3 mp4 wav ogg webm woff woff2 ttf eot txt csv xls xlsx doc docx".split()
RAW_TURKISH = "ıİşŞğĞüÜöÖçÇ"
# --- end of fixed values ---

_SCHEME = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.-]*):")
_PARTS = re.compile(r"^(https?)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", re.S)
_DEFAULT = {"http": "80", "https": "443"}
_PATH_KEEP = frozenset(b"!$%&'()*+,-./0123456789:;=@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_abcdefghijklmnopqrstuvwxyz|~")
_QUERY_KEEP = frozenset(b"!$%&()*+,-./0123456789:;=?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~")
_FORM_KEEP = frozenset(b"*-._0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def _escape(text: str, keep: frozenset[int]) -> str:
    return "".join(chr(b) if b in keep else f"%{b:02X}" for b in text.encode("utf-8", "surrogatepass"))


def _dots(path: str) -> str:
    out: list[str] = []
    segments = path.split("/")[1:]
    for i, s in enumerate(segments):
        plain = s.lower().replace("%2e", ".")
        if plain == "..":
            out = out[:-1]
        elif plain != ".":
            out.append(s)
            continue
        if i == len(segments) - 1:
            out.append("")
    return "/" + "/".join(out)


def parse(text: str | None, base: str | None = None) -> tuple[str, str, str, str, str] | None:
    """``(scheme, host with port, path, query, fragment)`` of an http(s) URL, serialised, or None."""
    if text is None:
        return None
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    scheme = _SCHEME.match(text)
    if scheme and scheme[1].lower() not in _DEFAULT:
        return None
    if scheme:
        rest = text[scheme.end() :].replace("\\", "/")
        if base and scheme[1].lower() == (_SCHEME.match(base) or scheme)[1].lower() and not rest.startswith("/"):
            text = rest
            scheme = None
        else:
            text = f"{scheme[1].lower()}://{rest.lstrip('/')}"
    if not scheme:
        if not base:
            return None
        head = re.match(r"[^?#]*", text)[0]
        text = head.replace("\\", "/") + text[len(head) :]
        try:
            text = f"{base.split('#')[0]}{text}" if text.startswith("#") else base.split("#")[0].split("?")[0] + text if text.startswith("?") else urljoin(base, text)
        except ValueError:
            return None
    found = _PARTS.match(text)
    if not found:
        return None
    name, host, path, query, fragment = found.groups()
    host, _, port = host.partition(":") if not host.startswith("[") else (host, "", "")
    if not host or re.search(r"[\x00-\x20#/:<>?@\\^|%]", host):
        return None
    try:
        host = host.lower() if host.isascii() else host.encode("idna").decode().lower()
    except UnicodeError:
        return None
    if port and (not port.isdigit() or int(port) > 65535):
        return None
    at = host + (f":{int(port)}" if port and str(int(port)) != _DEFAULT[name] else "")
    path = _escape(_dots(path or "/"), _PATH_KEEP)
    query = "" if not query else "?" + _escape(query[1:], _QUERY_KEEP)
    fragment = "" if not fragment else "#" + _escape(fragment[1:], _QUERY_KEEP)
    return name, at, path, "" if query == "?" else query, fragment


def serialised(parts: tuple[str, str, str, str, str]) -> str:
    return f"{parts[0]}://{parts[1]}{parts[2]}{parts[3]}{parts[4]}"


def _form_decoded(text: str) -> str:
    data = text.replace("+", " ").encode("utf-8", "surrogatepass")
    return re.sub(rb"%([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), data).decode("utf-8", "replace")


def normalize(text: str | None, base: str | None = None) -> str | None:
    """Fragment, default port and tracking parameters dropped, parameters sorted by name, escapes in upper case."""
    parts = parse(text, base)
    if not parts:
        return None
    name, host, path, query, _ = parts
    if query:
        pairs = [tuple(map(_form_decoded, (p.partition("=")[0], p.partition("=")[2]))) for p in query[1:].split("&") if p]
        pairs = sorted((p for p in pairs if p[0].lower() not in TRACKING_PARAMS), key=lambda p: p[0].encode("utf-16-be", "surrogatepass"))
        form = lambda x: _escape(x, _FORM_KEEP | {32}).replace(" ", "+")
        query = "?" + "&".join(f"{form(k)}={form(v)}" for k, v in pairs) if pairs else ""
    upper = re.sub(r"%[0-9a-fA-F]{2}", lambda m: m[0].upper(), path + query)
    return f"{name}://{host}{upper}"


def resolve(href: str | None, base: str | None) -> str | None:
    """Absolute URL of a link, or None for empty, fragment-only, non-navigational and unparsable ones."""
    if href is None:
        return None
    href = href.strip()
    if not href or href.startswith("#") or re.match(rf"(?i)(?:{'|'.join(NON_NAVIGATIONAL)}):", href):
        return None
    parts = parse(href, base)
    return serialised(parts) if parts else None


def host(url: str | None) -> str | None:
    parts = parse(url)
    return parts[1].partition(":")[0] if parts else None


def site_of(url: str | None) -> str | None:
    name = host(url)
    if not name:
        return None
    labels = name.split(".")
    if len(labels) <= 2:
        return name
    return ".".join(labels[-3:] if ".".join(labels[-2:]) in MULTI_LEVEL_SUFFIXES else labels[-2:])


def same_site(a: str | None, b: str | None) -> bool:
    own = site_of(a)
    return own is not None and own == site_of(b)


@F.pandas_udf(StringType())
def normalize_url(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``normalize`` over Arrow batches."""
    for part in urls:
        yield part.map(normalize)


# --- Column expressions ---


def host_of(url: Column | str) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    found = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def path_of(url: Column | str) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    path = F.regexp_extract(url, r"(?is)^https?://[^/?#]*([^?#]*)", 1)
    return F.when(host_of(url).isNull(), F.lit("")).otherwise(F.when(path == "", F.lit("/")).otherwise(path))


def registrable_domain(url: Column | str) -> Column:
    name = host_of(url)
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) <= 2, name).when(last(2).isin(MULTI_LEVEL_SUFFIXES), last(3)).otherwise(last(2))


def path_depth(url: Column | str) -> Column:
    return F.size(F.filter(F.split(path_of(url), "/"), lambda s: s != ""))


def strip_www(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)^www\.", "")


def has_raw_turkish(url: Column | str) -> Column:
    path = path_of(url)
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.coalesce(decoded.rlike(f"[{RAW_TURKISH}]"), F.lit(False))


def encoded_path(url: Column | str) -> Column:
    """Path as a parser serialises it: anything outside ASCII is escaped."""
    return F.regexp_replace(path_of(url), r"[^\x00-\x7F]", "%C3")


def has_uppercase_or_underscore(url: Column | str) -> Column:
    return F.coalesce(encoded_path(url).rlike("[A-Z_]"), F.lit(False))


def without_trailing_slash(url: Column | str) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_replace(url, r"^(https?://[^/?#]+/[^?#]*?)/+($|[?#])", "$1$2")


def looks_non_html(url: Column | str) -> Column:
    return F.coalesce(path_of(url).rlike(rf"(?i)\.(?:{'|'.join(ASSET_EXTENSIONS)})$"), F.lit(False))


def normalize_native(url: Column | str) -> Column:
    """Normal form of a well-formed http(s) URL without user info, in the JVM; ``normalize_url`` handles all others.

    Path and query are taken as written but for upper-case escapes, so ``%20`` in a query is not turned into ``+``.
    """
    url = F.col(url) if isinstance(url, str) else url
    plain = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(plain, r"(?i)^(https?)://", 1))
    at = F.lower(F.regexp_extract(plain, r"(?i)^https?://([^/?]+)", 1))
    at = F.when(scheme == "http", F.regexp_replace(at, ":80$", "")).otherwise(F.regexp_replace(at, ":443$", ""))
    path = F.regexp_extract(plain, r"(?i)^https?://[^/?]+([^?]*)", 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    pairs = F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING_PARAMS))
    keyed = F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    query = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["p"]), "&")
    return F.when((scheme != "") & (at != ""), F.concat(scheme, F.lit("://"), at, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))
