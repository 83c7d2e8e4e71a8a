"""URL filters by listed hosts and paths, in DataFrame operations alone.

A url's canonical keys are its host and all parent domains, each with the
prefixes of its path that listed entries are long. A blocked Bloom filter of
the listed entries lets possible hits pass; a hash join with the entries
removes the false ones; the longest entry decides.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trendloom.llm.common import cut_lineage

#: Bits of the filter per entry; a block has four words of 64 bits, and an entry sets two bits in each.
BITS_PER_ENTRY = 16
_WORDS = 4
#: A filter, or a list, is broadcast up to so many bytes; beyond, Spark joins by shuffle.
BROADCAST_BYTES = 32 << 20
DEFAULT = "allow"


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no `://`."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _masks(key: Column) -> list[Column]:
    """What an entry sets in each word of its block."""
    spread = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("bigint")

    def bit(i: int) -> Column:
        return F.call_function("shiftleft", one, F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int"))

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(_WORDS)]


def bloom_filter(entries: DataFrame, key: str, blocks: int) -> DataFrame:
    """block, w0 ... w3: the words of each block that holds an entry."""
    words = [m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))]
    return entries.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *words).groupBy("block").agg(
        *[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)])


def possible_hits(rows: DataFrame, key: str, entries: DataFrame, entry: str, count: int) -> DataFrame:
    """Rows of `rows` whose key the Bloom filter of the `count` entries lets pass."""
    blocks = -(-count * BITS_PER_ENTRY // (64 * _WORDS)) or 1
    words = bloom_filter(entries, entry, blocks)
    if blocks * 8 * (_WORDS + 1) <= BROADCAST_BYTES:
        words = F.broadcast(words)
    marked = rows.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    for i, mask in enumerate(_masks(F.col(key))):
        marked = marked.withColumn(f"__m{i}", mask)
    fits = [F.col(f"w{i}").bitwiseAND(F.col(f"__m{i}")) == F.col(f"__m{i}") for i in range(_WORDS)]
    return marked.join(words, F.col("__block") == F.col("block")).where(
        reduce(lambda a, b: a & b, fits)).select(*rows.columns)


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
               default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict, one row per input row.

    rules: host, path, verdict. A rule fits its host and all subdomains, if
    the url's path starts with the rule's; the longest rule wins, and of equal
    rules the greater verdict (`block` over `allow`). Urls that no rule fits,
    null ones among them, get a null rule and `default`. A rule with a null
    column is ignored; a null path has to be given as an empty one.
    """
    rules = rules.select(_lower(F.col("host")).alias("host"), "path", "verdict").na.drop()
    listed = rules.groupBy(F.concat("host", "path").alias("entry")).agg(F.max("verdict").alias("decided"))
    sizes = rules.agg(F.collect_set(F.char_length("path")), F.countDistinct("host", "path"),
                      F.sum(F.octet_length("host") + F.octet_length("path") + 16)).first()
    lengths, count, size = sorted(sizes[0]), sizes[1], sizes[2] or 0
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    if not count:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    longest = lengths[-1]
    head = F.substring(F.col("path"), 1, longest) if longest else F.lit("")
    # a verdict depends on the host and the first characters of the path alone
    places = rows.where("host <> ''").select("host", head.alias("head")).distinct()
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("head")),
        lambda n: F.call_function("substring", F.col("head"), F.lit(1), n))
    keys = F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda p: F.concat(d, p))))
    offered = places.select("host", "head", F.explode(F.array_distinct(keys)).alias("key"))
    passed = possible_hits(offered, "key", listed, "entry", count)
    hits = passed.join(F.broadcast(listed) if size <= BROADCAST_BYTES else listed, F.col("key") == F.col("entry"))
    decided = hits.groupBy(F.col("host").alias("h"), F.col("head").alias("p")).agg(
        F.max(F.struct(F.char_length("key").alias("size"), "key", "decided")).alias("best"))
    # saved, so that Spark knows its size: a small table is broadcast and no url moves, with a
    # larger one the partitions of a frequent host can be split
    decided = cut_lineage(decided, "decided")
    joined = rows.withColumn("head", head).join(decided, (F.col("host") == F.col("h")) & (F.col("head") == F.col("p")), "left")
    return joined.select("page_id", "host", "path", F.col("best.key").alias("rule"),
                         F.coalesce("best.decided", F.lit(default)).alias("verdict"))
