"""URL filter: host and path rules first, then a list of canonical URLs.

The list is tested by a blocked Bloom filter of fixed size; only possible hits go on to the
exact hash join that removes false positives. All of it is native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (action, rule); a rule is a host and the start of a path.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
# First host labels of unwanted sites, each followed by "-".
LISTED_LABELS = ("adult", "spam", "cheap", "ads", "casino", "free")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The filter has so many blocks of eight 32-bit words: 512 KiB at most, whatever the list.
BLOCKS = 1 << 14
_WORDS = 8


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null or empty where there is none."""
    return F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(_after_scheme(url), r"\A([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*(/[^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """``www.`` and ``m.`` go, as do a closing slash and ``.html``; query and fragment went before."""
    return F.concat(
        F.regexp_replace(host, r"\A(?:www|m)\.", ""), F.regexp_replace(path, r"(?:/|\.html)\z", "")
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its action, null where none fits. ``rules`` is a short list."""
    rule = action = None
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        site, _, rest = text.partition("/")
        fits = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(
            path, F.lit("/" + rest)
        )
        rule = F.when(fits, F.lit(text)).otherwise(F.lit(None).cast("string") if rule is None else rule)
        action = F.when(fits, F.lit(act)).otherwise(
            F.lit(None).cast("string") if action is None else action
        )
    return rule, action


def _block(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BLOCKS)).cast("int")


def _bits(key: Column) -> list[Column]:
    """One bit in each word of the key's block."""
    seed = F.xxhash64(key, F.lit(1))
    shift = lambda i: F.shiftrightunsigned(seed, 5 * i).bitwiseAND(31).cast("int")
    return [F.call_function("shiftleft", F.lit(1), shift(i)) for i in range(_WORDS)]


def bloom(listed: DataFrame) -> DataFrame:
    """The blocked filter of ``listed.canonical``: at most ``BLOCKS`` rows of eight words."""
    bits = _bits(F.col("canonical"))
    rows = listed.select(
        _block(F.col("canonical")).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)]
    )
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)])


def parsed(pages: DataFrame) -> DataFrame:
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("canonical", canonical(F.col("host"), F.col("path")))
    )


def listed_pages(pages: DataFrame, labels=LISTED_LABELS) -> DataFrame:
    """Distinct canonical URLs of pages on sites with an unwanted first label."""
    bad = F.col("host").rlike(r"(?:\A|\.)(?:%s)-" % "|".join(labels))
    return parsed(pages).filter(bad).select("canonical").distinct()


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, canonical`` of every page.

    ``listed`` has distinct, non-null ``canonical``. A rule decides where one fits; else a page
    is blocked if its canonical URL is listed. A null URL or one without ``://`` has an empty
    host and path, fits no rule and is listed nowhere. Repeated rows are answered once each.
    The filter alone is broadcast (a size fixed by ``BLOCKS``); pages that it stops are never
    shuffled, the others meet the list in a join that may be split by key.
    """
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = parsed(pages).withColumns({"rule": rule, "_action": action})
    asked = rows.withColumn("_block", _block(F.col("canonical")))
    words = bloom(listed).withColumnRenamed("block", "_block")
    tested = asked.join(F.broadcast(words), "_block", "left")
    hit = F.lit(True)
    for i, bit in enumerate(_bits(F.col("canonical"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    tested = tested.withColumn("_hit", F.coalesce(hit, F.lit(False)) & F.col("_action").isNull())
    keep = ["page_id", "host", "path", "rule", "_action", "canonical"]
    clear = tested.filter(~F.col("_hit")).select(*keep, F.lit(None).cast("string").alias("_found"))
    exact = listed.select("canonical", F.col("canonical").alias("_found"))
    possible = tested.filter("_hit").select(*keep).join(exact.hint("merge"), "canonical", "left")
    judged = clear.unionByName(possible.select(*keep, "_found"))
    verdict = F.coalesce(
        "_action", F.when(F.col("_found").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    )
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "canonical")


SQL = r"""
WITH cut AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut
), named AS (
  SELECT page_id,
    translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(substr(rest, length(raw) + 1), '^/[^?#]*'), '') AS path
  FROM parts
), sites AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)$', '') AS canonical
  FROM named
), rules(rule, site, prefix, act) AS (
  VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
    ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'),
    ('org/es/', 'org', '/es/', 'block')
), best AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(act, length(rule)) AS act
  FROM (SELECT DISTINCT page_id, host, path FROM sites) s, rules r
  WHERE (host = site OR ends_with(host, '.' || site)) AND starts_with(path, prefix)
  GROUP BY ALL
), listed AS (
  SELECT DISTINCT canonical FROM sites
  WHERE regexp_matches(host, '(^|\.)(adult|spam|cheap|ads|casino|free)-')
)
SELECT s.page_id, s.host, s.path, b.rule,
  coalesce(b.act, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, s.canonical
FROM sites s LEFT JOIN best b USING (page_id, host, path) LEFT JOIN listed l ON s.canonical = l.canonical
"""
