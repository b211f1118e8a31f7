"""URL filters: a blocked Bloom filter before an exact join.

Listed URLs are brought to one canonical form and set 8 bits in one 256-bit
block of a Bloom filter, held as a table of blocks (``block, w0..w3``).  A page
meets its one block in an equi-join; only pages whose bits are all set go on to
the exact join with the list, which removes false positives.  The filter has 16 bits
for each listed URL, up to ``MAX_BLOCKS`` blocks of 40 bytes, so it may be broadcast
whatever the length of the list; beyond 16 million URLs more pages go on to the
exact join, which is a shuffle join, and the result is the same.

Defined cases: a null url, or one without ``://``, has empty host and path, fits
no rule and is never listed; nulls and repeats in the list are ignored; repeated
pages stay repeated; an empty list blocks nothing; extra columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import LOWER, UPPER, hidden, settle, shown

#: At least and at most so many blocks of 256 bits (0.25 and 32 MB of bits).
MIN_BLOCKS, MAX_BLOCKS = 1 << 13, 1 << 20


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading ``www.`` or default port, path without closing ``/``
    or ``.html``, query without tracking parameters; no scheme, no fragment.
    Null where there is no ``://``."""
    h = F.regexp_replace(host(url), r"\Awww\.|:(80|443)\z", "")
    p = F.regexp_replace(path(url), r"(/index\.html?|\.html?|/+)\z", "")
    q = F.regexp_extract(url, r"(?s)\A.*?://[^?#]*\?([^#]*)", 1)
    q = F.array_join(F.array_sort(F.filter(F.split(q, "&"), lambda x: (x != "") & ~x.rlike(r"\A(utm_[a-z]+|ref|fbclid|gclid)="))), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(h, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def fitting_rule(h: Column, p: Column, rules: list[tuple[str, str, str]], give) -> Column:
    """``give(rule)`` of the longest rule ``(verdict, host, path)`` that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        out = F.when(((h == rule[1]) | h.endswith("." + rule[1])) & p.startswith(rule[2]), F.lit(give(rule))).otherwise(out)
    return out


def _bits(key: Column, n_blocks: int) -> list[Column]:
    """The block of a key, and its bits in the four words of that block."""
    where = F.xxhash64(key, F.lit(1))
    spread = F.xxhash64(key, F.lit(2))
    at = [F.shiftrightunsigned(spread, 8 * j).bitwiseAND(F.lit(255)) for j in range(8)]
    word = lambda w: reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(F.shiftright(a, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), a.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")) for a in at],
    )
    return [F.pmod(where, F.lit(n_blocks)).alias("block"), *(word(w).alias(f"m{w}") for w in range(4))]


def blocks_for(n: int) -> int:
    """A power of two of blocks with 16 bits for each of n URLs, within the bounds."""
    return min(MAX_BLOCKS, max(MIN_BLOCKS, 1 << max(0, n * 16 // 256).bit_length()))


def bloom(keys: DataFrame, key: str, n_blocks: int = MIN_BLOCKS) -> DataFrame:
    """The filter as a table: at most ``n_blocks`` rows (block, w0, w1, w2, w3)."""
    return keys.where(F.col(key).isNotNull()).select(*_bits(F.col(key), n_blocks)).groupBy("block").agg(*(F.bit_or(f"m{w}").alias(f"w{w}") for w in range(4)))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = (), url: str = "url", listed_url: str = "url", n_blocks: int | None = None) -> DataFrame:
    """Every page with host, path, rule, listed and verdict (``allow`` or ``block``):
    the longest rule's verdict, else ``block`` if the page's canonical URL is listed."""
    rules = list(rules)
    keys = listed.select(canonical(F.col(listed_url)).alias("_key")).where("_key IS NOT NULL").distinct()
    keys = settle(keys, "listed")
    n_blocks = n_blocks or blocks_for(keys.count())
    pages, names = hidden(pages)
    url, own = names[url], list(names.values())
    seen = pages.select(*own, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), canonical(F.col(url)).alias("_key"))
    probe = seen.select("*", *(b.alias(f"_{n}") for b, n in zip(_bits(F.col("_key"), n_blocks), ("block", "m0", "m1", "m2", "m3"))))
    blocks = bloom(keys, "_key", n_blocks).withColumnRenamed("block", "_block")
    probe = probe.join(F.broadcast(blocks), "_block", "left")
    hit = reduce(lambda a, b: a & b, [F.col(f"w{w}").bitwiseAND(F.col(f"_m{w}")) == F.col(f"_m{w}") for w in range(4)])
    probe = probe.select(*seen.columns, F.coalesce(hit & F.col("_key").isNotNull(), F.lit(False)).alias("_possible"))
    exact = probe.where("_possible").join(keys.select("_key", F.lit(True).alias("listed")), "_key", "left")
    both = exact.select(*own, "host", "path", F.coalesce("listed", F.lit(False)).alias("listed")).unionByName(
        probe.where("NOT _possible").select(*own, "host", "path", F.lit(False).alias("listed"))
    )
    fit = lambda give: fitting_rule(F.col("host"), F.col("path"), rules, give)
    return both.select(
        *shown(names, ("host", "path", "rule", "listed", "verdict")), "host", "path", fit(lambda r: r[1] + r[2]).alias("rule"),
        F.coalesce(fit(lambda r: r[0]), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed",
    )
