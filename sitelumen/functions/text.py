"""Text functions as Column expressions (Turkish-aware, evaluated in the JVM)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# --- fixed values ---
UPPER_TR, LOWER_TR = "IİŞĞÜÖÇ", "ıişğüöç"
UPPER_FROM, UPPER_TO = "iışğüöç", "İIŞĞÜÖÇ"
SLUG_FROM, SLUG_TO = "ıİşŞğĞüÜöÖçÇ", "iIsSgGuUoOcC"
STOP_WORDS = (
    "ve ile bir bu için olarak daha çok gibi olan da de ama veya ya her en ne kadar sonra önce ise ki mi nasıl neden hangi tüm bazı kendi şey yok var".split()
)
MOJIBAKE = ("Ã¼", "Ã¶", "Ã§", "ÅŸ", "Ä±", "ÄŸ", "Ä°", "Åž", "Ã‡", "Ã–", "Ãœ", "Â ")
#: Glyph widths in tenths of a pixel.
PUNCTUATION_WIDTHS = {
    " ": 56, "!": 56, '"': 71, "#": 111, "$": 111, "%": 178, "&": 133, "'": 38, "(": 67, ")": 67, "*": 78, "+": 117,
    ",": 56, "-": 67, ".": 56, "/": 56, ":": 56, ";": 56, "<": 117, "=": 117, ">": 117, "?": 111, "@": 203, "[": 56,
    "]": 56, "_": 111, "|": 52, "–": 111, "—": 200, "’": 38, "“": 71, "”": 71,
}
LETTER_WIDTHS = (("iıjlftrİ", 48), ("mw", 167), ("IJ", 56), ("MW", 167), ("ABCDEFGHKLNOPQRSTUVXYZÇĞÖŞÜ", 133))
OTHER_WIDTH = 111
SEEDS, PRIME = (0x811C9DC5, 0x9E3779B9), 0x01000193
# --- end of fixed values ---

#: White space as ECMAScript's \s has it, for a Java character class.
WS = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tr_lower(text: Column | str) -> Column:
    return F.lower(F.translate(F.coalesce(_col(text), F.lit("")), UPPER_TR, LOWER_TR))


def tr_upper(text: Column | str) -> Column:
    return F.upper(F.translate(F.coalesce(_col(text), F.lit("")), UPPER_FROM, UPPER_TO))


def tr_equals(a: Column | str, b: Column | str) -> Column:
    """Equal under Turkish collation at base strength (case and accents aside)."""
    return F.collate(F.coalesce(_col(a), F.lit("")), "tr_CI_AI") == F.collate(F.coalesce(_col(b), F.lit("")), "tr_CI_AI")


def collapse(text: Column | str) -> Column:
    """White space runs become one blank, none at the ends."""
    one = F.regexp_replace(_col(text), f"{WS}+", " ")
    return F.regexp_replace(one, "^ | $", "")


def normalize_key(text: Column | str) -> Column:
    return collapse(tr_lower(text))


def slugify(text: Column | str) -> Column:
    """ASCII slug: mapped Turkish letters, Turkish lower case, accents off, other runs become hyphens."""
    mapped = tr_lower(F.translate(F.coalesce(_col(text), F.lit("")), SLUG_FROM, SLUG_TO))
    accents = "àáâãäåèéêëìíîïñòóôõùúûýÿāăąćĉċčďēĕėęěĝġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝšţťũūŭůűųŵŷźżž"
    plain = "aaaaaaeeeeiiiinoooouuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrsssttuuuuuuwyzzz"
    return F.regexp_replace(F.regexp_replace(F.translate(mapped, accents, plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tokens(text: Column | str) -> Column:
    """Runs of two letters or digits and more, in lower case."""
    return F.regexp_extract_all(tr_lower(text), F.lit("[a-zçğıöşü0-9]{2,}+"), 0)


def word_count(text: Column | str) -> Column:
    return F.size(tokens(text))


def stop_word_hits(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(STOP_WORDS)))


def turkish_ratio(text: Column | str) -> Column:
    words = tokens(text)
    return F.when(F.size(words) < 20, F.lit(0.0)).otherwise(stop_word_hits(words) / F.size(words))


def mojibake_counts(text: Column | str) -> Column:
    """Non-overlapping count of each mojibake sequence, in order."""
    text = _col(text)
    return F.array(*[((F.length(text) - F.length(F.replace(text, F.lit(s)))) / len(s)).cast("int") for s in MOJIBAKE])


def is_mojibake(text: Column | str) -> Column:
    counts = mojibake_counts(text)
    kinds = F.size(F.filter(counts, lambda n: n > 0))
    total = F.aggregate(counts, F.lit(0), lambda a, n: a + n)
    return F.coalesce((kinds >= 2) | (total >= 4), F.lit(False))


def text_px(text: Column | str) -> Column:
    """Rendered width in whole pixels; each class of glyphs is counted by what removing it takes away."""
    text = F.coalesce(_col(text), F.lit(""))
    tenths = F.length(text) * OTHER_WIDTH
    widths: dict[int, str] = {}
    for glyph, width in PUNCTUATION_WIDTHS.items():
        widths[width] = widths.get(width, "") + glyph
    for glyphs, width in LETTER_WIDTHS:
        widths[width] = widths.get(width, "") + glyphs
    for width, glyphs in widths.items():
        if width != OTHER_WIDTH:
            tenths += (F.length(text) - F.length(F.translate(text, glyphs, ""))) * (width - OTHER_WIDTH)
    return F.floor((tenths + 5) / 10).cast("int")


def hash32(token: str, seed: int) -> int:
    """FNV-1a over UTF-16 units."""
    h = seed
    for unit in memoryview(token.encode("utf-16-le", "surrogatepass")).cast("H"):
        h = ((h ^ unit) * PRIME) & 0xFFFFFFFF
    return h


_hashes: dict[str, int] = {}


def hash64(token: str) -> int:
    """Two 32-bit hashes side by side; kept a worker, since texts repeat their words."""
    found = _hashes.get(token)
    if found is None:
        if len(_hashes) > 500_000:
            _hashes.clear()
        found = _hashes[token] = hash32(token, SEEDS[0]) | hash32(token, SEEDS[1]) << 32
    return found


@F.pandas_udf(LongType())
def _simhash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(words: str | None) -> int:
        tokens = (words or "").split(" ") if words else []
        if not tokens:
            return 0
        hashes = np.array([hash64(t) for t in tokens], np.uint64)
        ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * ones > len(tokens), bitorder="little").view(np.int64)[0])

    for part in parts:
        yield part.map(one).astype("int64")


def simhash(words: Column) -> Column:
    """64-bit SimHash of a token array as a signed number; 0 for none. A bit is set if more tokens have it than lack it.

    An Arrow-batched UDF: 64 votes a token as higher-order functions would be evaluated one by one, uncompiled.
    """
    return _simhash(F.array_join(words, " "))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def utf8_bytes(text: Column | str) -> Column:
    return F.coalesce(F.octet_length(_col(text)), F.lit(0))


def utf16_length(text: Column | str) -> Column:
    text = _col(text)
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def truncate(text: Column | str, most: int) -> Column:
    short = collapse(text)
    return F.when(F.length(short) > most, F.concat(F.substring(short, 1, most - 1), F.lit("…"))).otherwise(short)


def lastmod_problem(value: Column | str, now: Column) -> Column:
    """``missing``, ``format``, ``future`` or null for a valid W3C date not over a day ahead of ``now``."""
    value = _col(value)
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?$"
    full = F.regexp_replace(F.regexp_replace(value, r"([T ]\d{2}:\d{2})($|Z|[+-])", "$1:00$2"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    at = F.try_to_timestamp(F.when(F.length(value) > 10, full).otherwise(value))
    return (
        F.when(value.isNull() | (value == ""), F.lit("missing"))
        .when(~value.rlike(shape) | at.isNull(), F.lit("format"))
        .when(at > now + F.expr("INTERVAL 1 DAY"), F.lit("future"))
    )
