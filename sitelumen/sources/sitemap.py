"""Sitemaps as rows: read as a stream of XML events, so that a broken or cut-off document gives what can be read of it."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sitemaps that are read on a level of a site, and levels below the first, unless told otherwise.
MOST_A_LEVEL, MOST_LEVELS = 50, 2
#: Bytes of an unpacked sitemap, unless told otherwise; a longer one is read as far as that, as a cut-off one is.
MOST_BYTES = 50 * 1024 * 1024
#: Entries sent on at once, and characters of a tag or text that are looked at together.
ENTRIES, WINDOW = 5000, 1 << 16

_MARK = re.compile(r"<!--|<!\[CDATA\[|<[/!?A-Za-z]")
_TAG = re.compile(r"""<(/?)(?:[\w.-]+:)?([\w.-]+)((?:[^<>"']|"[^"]*"|'[^']*')*)>""")
_ATTRIBUTE = re.compile(r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_REFERENCE = re.compile(r"&(?:#x([0-9a-fA-F]{1,6})|#([0-9]{1,7})|(amp|lt|gt|quot|apos));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decoded(text: str) -> str:
    """Text with its character references resolved, once."""

    def one(m: re.Match) -> str:
        code = int(m[1], 16) if m[1] else int(m[2]) if m[2] else 0
        return _NAMED[m[3]] if m[3] else chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _REFERENCE.sub(one, text)


def events(xml: str) -> Iterator[tuple[str, str, str]]:
    """``(start, name, attributes)``, ``(end, name, "")`` and ``(text, "", text)`` of a document, in order; names without prefix.

    Comments, processing instructions and declarations are left out; so is a tag that the document ends in.
    """
    at, n = 0, len(xml)
    while at < n:
        found = _MARK.search(xml, at)
        if found is None or found.start() > at:
            end = found.start() if found else n
            yield "text", "", decoded(xml[at:end])
            at = end
            if found is None:
                return
        kind = found[0]
        if kind == "<!--":
            end = xml.find("-->", at + 4)
            at = end + 3 if end >= 0 else n
        elif kind == "<![CDATA[":
            end = xml.find("]]>", at + 9)
            yield "text", "", xml[at + 9 : end if end >= 0 else n]
            at = end + 3 if end >= 0 else n
        elif kind in ("<!", "<?"):
            end = xml.find(">", at)
            at = end + 1 if end >= 0 else n
        else:
            tag = _TAG.match(xml, at, at + WINDOW)
            if tag is None:
                if xml.find(">", at) < 0:
                    return
                yield "text", "", "<"
                at += 1
                continue
            name = tag[2].lower()
            if tag[1]:
                yield "end", name, ""
            else:
                yield "start", name, tag[3]
                if tag[3].endswith("/"):
                    yield "end", name, ""
            at = tag.end()


def entries_of(xml: str) -> Iterator[tuple[str, dict]]:
    """``(kind, entry)`` of each ``url`` and ``sitemap`` element with an address; the last one need not be closed.

    Of an element the first ``loc`` and ``lastmod`` with text count; a name that opens within another closes it.
    """
    kind = field = None
    entry: dict = {}
    text: list[str] = []

    def close_field() -> None:
        nonlocal field
        if field is not None:
            entry.setdefault(field, None)
            entry[field] = entry[field] or "".join(text).strip() or None
        field = None
        text.clear()

    def closed() -> Iterator[tuple[str, dict]]:
        nonlocal kind, entry
        close_field()
        if kind and entry.get("loc"):
            yield kind, {"loc": entry["loc"], "lastmod": entry.get("lastmod"), "alternates": entry["alternates"]}
        kind, entry = None, {}

    for what, name, rest in events(xml):
        if what == "text":
            if field is not None:
                text.append(rest)
        elif name in ("url", "sitemap"):
            yield from closed()
            if what == "start":
                kind, entry = name, {"alternates": []}
        elif kind is None:
            continue
        elif name in ("loc", "lastmod"):
            close_field()
            field = name if what == "start" else None
        elif name == "link" and what == "start":
            own = {k.lower().split(":")[-1]: decoded(a or b).strip() for k, a, b in _ATTRIBUTE.findall(rest)}
            if own.get("rel") == "alternate" and own.get("hreflang") and own.get("href"):
                entry["alternates"].append({"lang": own["hreflang"], "href": own["href"]})
    yield from closed()


def sitemap_text(body: bytes | None, most: int = MOST_BYTES) -> str | None:
    """Text of a sitemap's bytes, at most ``most`` of them; gzip is recognised by its first bytes, and a cut-off one is read as far as it goes."""
    if body is None:
        return None
    if body[:2] == b"\x1f\x8b":
        try:
            body = zlib.decompressobj(31).decompress(body, most)
        except zlib.error:
            return None
    return body[:most].decode("utf-8", "replace")


_ENTRY = "site_id string, sitemap_url string, kind string, loc string, lastmod string, alternates array<struct<lang:string,href:string>>"


def elements(sitemaps: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """``(site_id, sitemap_url, kind, loc, lastmod, alternates)`` of the elements of ``sitemaps(site_id, sitemap_url, xml)``.

    ``xml`` is text, or bytes as they were sent. Entries leave a task some thousands at a time, whatever the size of the document.
    """
    alternates = pa.list_(pa.struct([("lang", pa.string()), ("href", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string()] * 5 + [alternates]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split(" ")[0] for x in _ENTRY.split(", ")])

        for batch in batches:
            rows: list[tuple] = []
            for i in range(len(batch)):
                site, url, xml = (batch.column(c)[i].as_py() for c in range(3))
                xml = sitemap_text(xml, most) if isinstance(xml, bytes) else xml
                for kind, e in entries_of(xml or ""):
                    rows.append((site, url, kind, e["loc"], e["lastmod"], e["alternates"]))
                    if len(rows) >= ENTRIES:
                        yield batch_of(rows)
                        rows = []
            yield batch_of(rows)

    return sitemaps.select("site_id", "sitemap_url", "xml").mapInArrow(run, _ENTRY)


def entries(sitemaps: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """``(site_id, sitemap_url, loc, lastmod, alternates)``."""
    return elements(sitemaps, most).where("kind = 'url'").drop("kind")


def collected(start: DataFrame, fetch: Callable[[DataFrame], DataFrame], most: int = MOST_A_LEVEL, levels: int = MOST_LEVELS) -> DataFrame:
    """Sitemaps reached from ``start(site_id, sitemap_url)``: ``levels`` below it, ``most`` a level and site.

    ``fetch`` adds ``xml`` (null if it failed) to such a frame; the result has ``ok`` too.
    """
    level, every = start, None
    for depth in range(levels + 1):
        rank = F.row_number().over(Window.partitionBy("site_id").orderBy("sitemap_url"))
        got = fetch(level.distinct().withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")).withColumn("level", F.lit(depth))
        every = got if every is None else every.unionByName(got)
        level = elements(got.where("xml IS NOT NULL")).where("kind = 'sitemap'").select("site_id", F.col("loc").alias("sitemap_url"))
    return every.withColumn("ok", F.col("xml").isNotNull())
