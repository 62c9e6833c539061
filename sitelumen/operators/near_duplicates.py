"""Pages with nearly the same content: SimHash within a Hamming distance, per site."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR_BITS = 6
#: Blocks of a key: of ``NEAR_BITS + k`` blocks ``k`` are untouched, and a key holds about 64 k / (6 + k) bits.
KEY_BLOCKS = (2, 3, 4, 5)
#: Distinct codes of a site up to which keys of k blocks are wide enough to keep unlike codes apart.
MOST_CODES = {2: 1 << 16, 3: 1 << 21, 4: 1 << 26}


def block_ranges(k: int) -> list[tuple[int, int]]:
    """``(shift, bits)`` of each of the NEAR_BITS + k blocks of 64 bits, as even as can be."""
    n = NEAR_BITS + k
    ends = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache
def _choices(k: int) -> str:
    """SQL of ``(blocks, upto, mask)`` of each choice of k blocks: a bit for each chosen one, for each up to the last, and their bits of a code.

    One text a k, made once: hundreds of expressions built call by call cost seconds before anything runs.
    """
    ranges, out = block_ranges(k), []
    for chosen in combinations(range(NEAR_BITS + k), k):
        mask = sum(((1 << bits) - 1) << shift for shift, bits in (ranges[i] for i in chosen))
        out.append(f"named_struct('blocks', {sum(1 << i for i in chosen)}, 'upto', {(2 << chosen[-1]) - 1}, 'mask', {mask - (1 << 64) if mask >> 63 else mask}L)")
    return f"array({', '.join(out)})"


def _shared(k: int) -> str:
    """SQL of a bit for each block that the codes of x and y share."""
    return " | ".join(f"if((shiftrightunsigned(x.code ^ y.code, {shift}) & {(1 << bits) - 1}L) = 0, {1 << i}, 0)" for i, (shift, bits) in enumerate(block_ranges(k)))


def _by_k(sql: Callable[[int], str], k: str) -> Column:
    return F.expr(f"CASE {' '.join(f'WHEN {k} = {own} THEN {sql(own)}' for own in KEY_BLOCKS)} END")


def near_classes(rows: DataFrame, site: str = "site_id", code: str = "simhash") -> DataFrame:
    """``(site, a, b)``: pairs a < b of distinct codes of a site that differ in at most six bits.

    Rows with one code are collapsed before the join. Of 6 + k blocks at most six can differ, so k at least are equal:
    codes are filed under every choice of k blocks, and a pair is reported only under the first k blocks that it shares,
    so nothing has to be made distinct afterwards. k follows the number of a site's codes, so a key stays as selective on
    a large site as on a small one; every k gives the same pairs. A key that many codes of a site share is split by Spark
    as a skewed join.
    """
    codes = rows.select(F.col(site).alias("site"), F.col(code).alias("code")).where("code IS NOT NULL").distinct()
    sizes = codes.groupBy("site").agg(F.count("*").alias("n"))
    k = F.lit(KEY_BLOCKS[-1])
    for own in reversed(KEY_BLOCKS[:-1]):
        k = F.when(F.col("n") <= MOST_CODES[own], F.lit(own)).otherwise(k)
    key = F.transform("choices", lambda c: F.struct(c["blocks"], c["upto"], F.col("code").bitwiseAND(c["mask"]).alias("value")))
    filed = codes.join(sizes.select("site", k.alias("k")), "site").select("site", "k", "code", _by_k(_choices, "k").alias("choices")).select("site", "k", "code", F.inline(key))
    x, y = filed.alias("x"), filed.alias("y")
    same = (F.col("x.site") == F.col("y.site")) & (F.col("x.blocks") == F.col("y.blocks")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.code") < F.col("y.code"))
    near = F.bit_count(F.col("x.code").bitwiseXOR(F.col("y.code"))) <= NEAR_BITS
    first = _by_k(_shared, "x.k").bitwiseAND(F.col("x.upto")) == F.col("x.blocks")
    return x.join(y, same & near & first).select(F.col("x.site").alias(site), F.col("x.code").alias("a"), F.col("y.code").alias("b"))


def near_counts(rows: DataFrame, site: str = "site_id", code: str = "simhash") -> DataFrame:
    """``(site, code, members, near)``: rows of each code and how many other rows are within the distance."""
    sizes = rows.where(F.col(code).isNotNull()).groupBy(site, code).agg(F.count("*").alias("members"))
    ways = F.array(F.struct(F.col("a").alias(code), F.col("b").alias("other")), F.struct(F.col("b").alias(code), F.col("a").alias("other")))
    both = near_classes(rows, site, code).select(site, F.inline(ways))
    others = sizes.select(F.col(site).alias("s2"), F.col(code).alias("other"), F.col("members").alias("n"))
    near = both.join(others, (both[site] == others["s2"]) & (both["other"] == others["other"])).groupBy(site, code).agg(F.sum("n").alias("linked"))
    return sizes.join(near, [site, code], "left").select(site, code, "members", (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("near"))


def pair_total(rows: DataFrame, site: str = "site_id", code: str = "simhash") -> DataFrame:
    """``(site, pairs)``: number of unordered pairs of rows within the distance, without listing them."""
    return near_counts(rows, site, code).groupBy(site).agg((F.sum(F.col("members") * F.col("near")) / 2).cast("bigint").alias("pairs"))
