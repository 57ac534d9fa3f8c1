"""URL filters: host and path rules, then a blocked Bloom filter of listed canonical URLs with an exact join behind it.

Native throughout: DataFrame functions only. Each listed URL sets BITS_SET bits in one 64-bit block, chosen by its hash; the
filter is a table (block, word). Up to MAX_BLOCKS blocks it is broadcast, so with a proven bound; a larger filter is dealt
by block in a shuffle, and the URLs with it. URLs that pass go to a shuffled hash join with the list, which removes false
positives; the others take no part in it. Filter and list are tables of their own by then, so Spark splits a URL, or block,
that very many rows share.

Edge cases: a null URL or one without `://` has empty host and path, no canonical form, fits no rule and is not listed.
Repeated rows, in either table, give one verdict a row of pages. An empty list blocks nothing; an empty table gives no rows.
URLs of any length are taken whole. Of rules that fit, the longest wins. Columns of any other name are passed on (`listed`)
or not read (`judge`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.core import checkpointed, table
from ebbtide.llm.text import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_SET, BITS_EACH, MAX_BLOCKS = 6, 12, 1 << 20
# Verdict, host, path prefix.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def _after_scheme(url: Column) -> Column:
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    return F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without `www.`, path without closing slashes, the query's other than tracking parameters, sorted."""
    query = F.regexp_extract(_after_scheme(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|gclid|fbclid)(=|$)")))
    rest = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    whole = F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""), rest)
    return F.when(F.instr(url, "://") > 0, whole)


def rule_of(host_name: Column, path_name: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host, then path prefix, joined), and its verdict; null where none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host_name == h) | host_name.endswith(f".{h}")) & path_name.startswith(p) for _, h, p in ordered]
    chain = lambda values: reduce(lambda c, x: c.when(*x), zip(fits[1:], map(F.lit, values[1:]), strict=True), F.when(fits[0], F.lit(values[0])))
    if not ordered:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return chain([h + p for _, h, p in ordered]), chain([v for v, _, _ in ordered])


def _or_bits(hashed: Column) -> Column:
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.pmod(F.shiftrightunsigned(hashed, 6 * i), F.lit(64)).cast("int")) for i in range(BITS_SET)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def listed(pages: DataFrame, names: DataFrame, key: str, flag: str) -> DataFrame:
    """pages with a boolean column `flag`: whether its column `key` is in names(key)."""
    names = checkpointed(names.select(key).where(F.col(key).isNotNull()).distinct())
    block, word, may = (fresh(pages, c) for c in ("block_", "word_", "may_"))
    blocks = max(1, -(-names.count() * BITS_EACH // 64))
    at = F.pmod(F.xxhash64(key), F.lit(blocks))
    mask = _or_bits(F.xxhash64(key, F.lit(1)))
    bloom = checkpointed(names.select(at.alias(block), mask.alias(word)).groupBy(block).agg(F.bit_or(word).alias(word)))
    tried = pages.withColumn(block, at).join(F.broadcast(bloom) if blocks <= MAX_BLOCKS else bloom, block, "left")
    tried = tried.withColumn(may, F.coalesce(F.col(word).bitwiseAND(mask) == mask, F.lit(False)))
    exact = names.withColumn(flag, F.lit(True)).hint("shuffle_hash")
    passed = tried.where(may).select(*pages.columns).join(exact, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return passed.select(*pages.columns, flag).unionByName(tried.where(~F.col(may)).select(*pages.columns, F.lit(False).alias(flag)))


def judge(pages: DataFrame, names: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(key, host, path, rule, verdict) of each row; names(canonical) are the listed URLs."""
    seen = pages.select(F.col(key), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), canonical(F.col(url)).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    found = listed(seen, names, "canonical", "listed")
    return found.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


#: Hosts of the list that the query takes: each has the paths /en/0, /en/2 ... /en/9998, and so for the other languages.
HOSTS = ("spam-farm.example.com", "blog.tionsh.example.com", "tionble.example.org", "tiontion.example.net", "m.tionsh.example.net", "blog.tionsh.example.net", "thther.example.org")
LANGUAGES, NUMBERS = ("de", "en", "es", "fr"), 10_000


def blocklist(spark: SparkSession) -> DataFrame:
    """(canonical): the list, made by rule; the hosts were named knowing that some occur in the tables, so that the list decides rows there."""
    paths = spark.range(0, NUMBERS, 2).select(F.explode(F.array(*(F.concat(F.lit(f"/{x}/"), F.col("id").cast("string")) for x in LANGUAGES))).alias("path"))
    return paths.select(F.explode(F.array(*(F.concat(F.lit(h), "path") for h in HOSTS))).alias("canonical"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), blocklist(spark))


_REST = "case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end"
_SORTED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{{{i}}}'" for i, (_, h, p) in enumerate(_SORTED))
ORACLE = f"""with u as (select *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) as q from (select page_id, url, {_REST} as rest from pages)),
r as (select *, case {_FITS.format(*(h + p for _, h, p in _SORTED))} end as rule, case {_FITS.format(*(v for v, _, _ in _SORTED))} end as v, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))) as kept from u),
c as (select *, case when instr(url, '://') > 0 then regexp_replace(host, '^www[.]', '') || regexp_replace(path, '/+$', '') || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as canonical from r),
list as (select h || '/' || l || '/' || n as name from (values {", ".join(f"('{h}')" for h in HOSTS)}) as hosts(h), (values {", ".join(f"('{x}')" for x in LANGUAGES)}) as languages(l), range(0, {NUMBERS}, 2) as numbers(n))
select page_id, host, path, rule, coalesce(v, case when canonical in (select name from list) then 'block' else 'allow' end) as verdict from c"""
