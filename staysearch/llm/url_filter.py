"""URL filters: longest matching rule, else a blocked Bloom filter before an exact hash join.

1. A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
   in lower case; its path goes on to ``?``, ``#`` or the end. Without ``://`` both are empty.
2. A rule (host, path, verdict) fits its host and all subdomains if the path begins with the
   rule's. Of several the longest (host and path together) holds; its verdict is final.
3. The other urls are looked up in a list of canonical urls. The list's blocked Bloom filter
   (blocks of 256 bits, one bit in each of eight 32-bit words) passes those that may be listed;
   an exact hash join with the list removes the false positives. What is listed is blocked,
   everything else allowed.

The filter has at most ``MAX_BLOCKS`` blocks (8 MB of bits, some 25 MB as a broadcast table),
so it may always be broadcast. Lists of more than 5 million urls leave fewer bits each: more
urls reach the join, and the result stays the same. The join salts urls that a large share of
the possible hits has.

A canonical url has no scheme, default port, trailing slashes, fragment or tracking
parameters; its other parameters are sorted. Null urls and those without ``://`` have none and
are allowed. Repeated rows and repeated or null ids are rows of their own. An empty list blocks
nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staysearch.llm.common import saved
from staysearch.operators.joins import lookup_join

BITS_PER_URL = 12
BLOCK_BITS = 256
MAX_BLOCKS = 1 << 18
# Of a listed url in memory or on disk, roughly: decides whether the list itself may be broadcast.
URL_BYTES = 100
TRACKING = ("utm_", "ref", "fbclid", "gclid")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = ("w0", "w1", "w2", "w3")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


# Fixed: the rules that the registered query judges by.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The url that stands for all spellings of it; null without a host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    name = lambda part: F.substring_index(part, "=", 1)

    def told(part: Column) -> Column:
        tracks = reduce(
            Column.__or__, [name(part).startswith(t) if t.endswith("_") else name(part) == t for t in TRACKING]
        )
        return (part != "") & ~tracks

    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), told)), "&")
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def matched(rules: Sequence[Rule], host: Column, path: Column, value: str) -> Column:
    """``value`` (text or verdict) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("string")
    # The longest is asked first; of equally long ones the first by text.
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text, r.verdict), reverse=True):
        found = F.when(rule.fits(host, path), F.lit(getattr(rule, value))).otherwise(found)
    return found


def _masks(url: Column) -> list[Column]:
    """The bits of a url in its block: four longs of two words each, a bit in every word."""
    bits = F.xxhash64(F.lit(2), url)
    place = [F.shiftrightunsigned(bits, 5 * i).bitwiseAND(F.lit(31)).cast("int") for i in range(8)]
    one = F.lit(1).cast("bigint")
    return [
        F.call_function("shiftleft", one, place[2 * j]).bitwiseOR(
            F.call_function("shiftleft", one, place[2 * j + 1] + F.lit(32))
        )
        for j in range(4)
    ]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), url), F.lit(blocks).cast("bigint"))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """block and w0 to w3: the blocks that hold any bit, ``blocks`` rows at most."""
    rows = listed.select(_block(F.col("canonical"), blocks).alias("block"), *[m.alias(w) for m, w in zip(_masks(F.col("canonical")), WORDS, strict=True)])
    return rows.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def possible_hits(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``maybe``: whether the filter has all bits of the row's ``canonical``."""
    passed = reduce(
        Column.__and__,
        [F.col(w).bitwiseAND(m) == m for m, w in zip(_masks(F.col("canonical")), WORDS, strict=True)],
    )
    probed = rows.withColumn("block", _block(F.col("canonical"), blocks)).join(F.broadcast(bloom), "block", "left")
    maybe = F.col("canonical").isNotNull() & F.coalesce(passed, F.lit(False))
    return probed.select(*rows.columns, maybe.alias("maybe"))


def judged(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``listed`` has distinct canonical urls, none null, in ``canonical``.
    """
    known = saved(listed.select("canonical"), "listed")
    n = known.count()
    blocks = min(max(1, -(-n * BITS_PER_URL // BLOCK_BITS)), max_blocks)
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    ruled = parsed.select(
        *parsed.columns,
        matched(rules, F.col("host"), F.col("path"), "text").alias("rule"),
        matched(rules, F.col("host"), F.col("path"), "verdict").alias("verdict"),
    )
    asked = ruled.withColumn("canonical", F.when(F.col("verdict").isNull(), F.col("canonical")))
    rows = saved(possible_hits(asked, bloom_filter(known, blocks), blocks), "possible-hits")
    out = ["page_id", "host", "path", "rule", "verdict"]
    hits = rows.where("maybe").select("page_id", "host", "path", "rule", "canonical")
    met = lookup_join(
        hits, known.withColumn("listed", F.lit(True)), "canonical", ["page_id"], "left", n * URL_BYTES
    ).withColumn("verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    misses = rows.where(~F.col("maybe")).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    return misses.select(*out).unionAll(met.select(*out))


def unwanted_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Canonical urls of pages whose document is labelled toxic or of low quality.

    The document's id is the path's second part (``/en/123``, with or without an ending).
    """
    number = F.regexp_extract(path_of(F.col("url")), r"^/[a-z]+/([0-9]{1,18})(?:\.html|/)?$", 1)
    urls = pages.select(
        canonical(F.col("url")).alias("canonical"), F.nullif(number, F.lit("")).cast("bigint").alias("id")
    )
    # Copies of a url are counted once before the join.
    urls = urls.where(F.col("canonical").isNotNull() & F.col("id").isNotNull()).distinct()
    bad = labels.where((F.col("toxic") == 1) | (F.col("quality") == 0)).select(F.col("doc_id").alias("id")).distinct()
    return urls.join(bad, "id", "left_semi").select("canonical").distinct()


def url_report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(pages, RULES, unwanted_urls(pages, labels))


ORACLE = r"""
WITH split AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    [p FOR p IN string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&')
       IF p <> '' AND NOT starts_with(p, 'utm_') AND split_part(p, '=', 1) NOT IN ('ref', 'fbclid', 'gclid')] AS params
  FROM split
), pages_ AS (
  SELECT page_id, host, path,
    CASE WHEN regexp_replace(host, ':(80|443)$', '') <> '' THEN
      regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '')
      || CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_sort(params), '&') ELSE '' END END AS canonical
  FROM parts
), listed AS (
  SELECT DISTINCT canonical FROM pages_
  JOIN labels ON doc_id = TRY_CAST(regexp_extract(path, '^/[a-z]+/([0-9]{1,18})(\.html|/)?$', 1) AS BIGINT)
  WHERE canonical IS NOT NULL AND (toxic = 1 OR quality = 0)
), rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), numbered AS (
  SELECT *, row_number() OVER () AS n FROM pages_
), fitting AS (
  SELECT p.n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
    arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM numbered p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.n
)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN p.canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM numbered p LEFT JOIN fitting f USING (n)
"""
