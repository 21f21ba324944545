"""URL filters: host and path rules, then a blocked Bloom filter of listed canonical URLs.

The filter is a table of 256-bit blocks (eight 32-bit words, one bit each per
key), built with one ``bit_or`` aggregate. A URL's hash names its block; the
block table is joined to the URLs and the eight bits tested, all in Column
code. The number of blocks follows the list but never passes ``MAX_BLOCKS``, so
the table that is broadcast has a proven bound (36 bytes a block, 9 MB in all); beyond
that the filter lets more URLs through and the answer stays the same, because
possible hits then go to an exact hash join with the list.

Only possible hits are shuffled. A URL that many pages share is a skewed key of
an inner join with a distinct list, which adaptive execution can split.

Null URLs have an empty host and path, fit no rule, are on no list and are
allowed. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.llm.common import lower_ascii, query, splittable, table, unused

MAX_BLOCKS = 1 << 18
KEYS_PER_BLOCK = 20  # about 13 bits a key
# Odd multipliers that pick a bit in each word of a block.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)

Rule = tuple[str, str]  # (allow or block, host/path)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without one."""
    return lower_ascii(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without trailing slashes, query without tracking; null without a host."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    p = F.regexp_replace(path(url), r"/+\z", "")
    q = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    q = F.regexp_replace(q, r"(^|&)(utm_[^=&]*|ref)(=[^&]*)?(?=&|\z)", "")
    q = F.regexp_replace(q, r"^&+", "")
    return F.when(h != "", F.concat(h, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def rule_of(host_column: Column, path_column: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits; null where none does. For short rule lists."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, pattern in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):
        domain, slash, rest = pattern.partition("/")
        fits = ((host_column == domain) | host_column.endswith(f".{domain}")) & path_column.startswith(slash + rest)
        rule = F.when(fits, F.lit(pattern)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


# -- the filter ------------------------------------------------------------
def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(key), 32), F.lit(blocks)).cast("int")


def bit_of(key: Column, word: int) -> Column:
    """One of 32 bits, from the low half of the hash times the word's multiplier."""
    low = F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))
    product = (low * F.lit(SALTS[word] >> 4)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.call_function("shiftleft", F.lit(1), F.shiftright(product, 27).cast("int"))


def build_filter(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """``block, w0..w7``: the blocks that hold any key."""
    bits = [F.bit_or(bit_of(F.col(key), i)).alias(f"w{i}") for i in range(8)]
    return listed.groupBy(block_of(F.col(key), blocks).alias("block")).agg(*bits)


def blocks_for(keys: int) -> int:
    return max(1, min(MAX_BLOCKS, -(-keys // KEYS_PER_BLOCK)))


def may_be_listed(df: DataFrame, key: str, bloom: DataFrame, blocks: int, name: str) -> DataFrame:
    """``df`` with boolean ``name``: false only if ``key`` is certainly not listed."""
    block, *words = unused(df, "_block", *[f"_w{i}" for i in range(8)])
    small = F.broadcast(bloom.select(F.col("block").alias(block), *[F.col(f"w{i}").alias(w) for i, w in enumerate(words)]))
    joined = df.join(small, block_of(F.col(f"`{key}`"), blocks) == F.col(block), "left")
    test = F.col(block).isNotNull() & F.col(f"`{key}`").isNotNull()
    for i, w in enumerate(words):
        test = test & (F.col(w).bitwiseAND(bit_of(F.col(f"`{key}`"), i)) != 0)
    return joined.withColumn(name, F.coalesce(test, F.lit(False))).drop(block, *words)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, possible, listed, verdict``.

    ``listed`` has one column of canonical URLs, repeated ones allowed. A rule's
    verdict stands; otherwise a listed URL is blocked and any other allowed.
    """
    names = unused(pages, "host", "path", "canonical", "rule", "possible", "listed", "verdict", "_url")
    h, p, c, r, possible, on_list, verdict, listed_url = names
    distinct = listed.select(F.col(listed.columns[0]).alias(listed_url)).where(F.col(listed_url).isNotNull()).distinct()
    blocks = blocks_for(distinct.count())
    bloom = build_filter(distinct, listed_url, blocks)
    seen = pages.withColumns({h: host(F.col(url)), p: path(F.col(url)), c: canonical(F.col(url))})
    rule, by_rule = rule_of(F.col(h), F.col(p), rules)
    seen = may_be_listed(seen.withColumns({r: rule, verdict: by_rule}), c, bloom, blocks, possible)
    clear = seen.where(~F.col(possible)).withColumn(on_list, F.lit(False))
    hits = seen.where(F.col(possible)).join(splittable(distinct, listed_url, F.length(listed_url) >= 0), F.col(f"`{c}`") == F.col(listed_url), "left")
    hits = hits.withColumn(on_list, F.col(listed_url).isNotNull()).drop(listed_url)
    method = F.when(F.col(on_list), "block").otherwise("allow")
    return clear.unionByName(hits).withColumn(verdict, F.coalesce(F.col(verdict), method))


RULES: tuple[Rule, ...] = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
JUNK_TITLE = r"<title>[^<]*([#*%$&|]{3}[^<]*){3}"


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list used by the query: canonical URLs of all pages whose title is full of symbols."""
    return pages.where(F.col("html").rlike(JUNK_TITLE)).select(canonical(F.col("url")).alias("url"))


AFTER = "CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
ORACLE = rf"""
WITH a AS (SELECT page_id, html, {AFTER} AS rest FROM pages),
p AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS q FROM a),
c AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_full_match(x, '(utm_[^=&]*|ref)(=.*)?')), '&') AS kept FROM p),
u AS (SELECT page_id, html, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
  || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical FROM c),
l AS (SELECT DISTINCT canonical FROM u WHERE regexp_matches(html, '{JUNK_TITLE}') AND canonical IS NOT NULL),
r AS (SELECT page_id, host, path, u.canonical, l.canonical IS NOT NULL AS listed, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM u LEFT JOIN l ON u.canonical = l.canonical)
SELECT page_id, host, path, rule, listed, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


@query("op1_url_filter", ORACLE)
def urls_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    done = filter_urls(pages.select("page_id", "url"), listed_urls(pages), RULES)
    return done.select("page_id", "host", "path", "rule", "listed", "verdict")
