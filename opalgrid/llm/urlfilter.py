"""URL filters: a blocked Bloom filter before an exact hash join.  DataFrame functions only.

The filter of the listed canonical URLs is a table of blocks of eight 64-bit words.  A URL's hash
picks one block and one bit in each word.  The number of blocks follows the list up to
``MAX_BLOCKS`` (64 bytes each), so the filter always has a bounded size and may be sent to every
task; a longer list only passes more false positives to the exact join, which removes them.

Host and path rules come first: a rule fits its host and all subdomains if the path starts with the
rule's, and the longest rule wins.  What no rule decides is blocked if its canonical URL is listed.
A list of at most ``BROADCAST_ROWS`` URLs is sent to every task for the exact join: the pages are read
once and not shuffled.  Beyond that only what passes the filter is shuffled to the list.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is
allowed unless listed; empty lists block nothing; repeated URLs and rows are judged each; null list
entries are ignored; empty tables give no rows; a URL may be of any length; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opalgrid.llm._store import BROADCAST_ROWS, stored

WORDS, ROWS_PER_BLOCK, MAX_BLOCKS = 8, 32, 1 << 17
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
TRACKING = r"(?:utm_[^=&]*|ref|fbclid|gclid)=[^&]*"
# Sites of the list: hosts under each top, with pages of each language numbered from 0.
LISTED_HOSTS = ("spam-farm", "ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets")
LISTED_TOPS = ("example.com", "example.net", "example.org")
LISTED_LANGUAGES, LISTED_NUMBERS = ("de", "en", "es", "fr"), 2_500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first :// (empty if there is none)."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #; A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Scheme, www. and m., fragment, tracking parameters and a final slash do not count."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.|:(?:80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$|/index\.html?$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^" + TRACKING + "$"))), "&")
    return F.when(url.contains("://"), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _shift(amount: str) -> str:
    return f"shiftleft(cast(1 as bigint), {amount})"


def bloom_blocks(listed: DataFrame, key: str = "listed_url") -> tuple[DataFrame, int]:
    """(bloom_block, w0 .. w7) for the distinct keys, and the number of blocks addressed."""
    n = listed.count()
    blocks = max(1, min(MAX_BLOCKS, -(-n // ROWS_PER_BLOCK)))
    hashed = listed.select(F.xxhash64(key).alias("h"), F.xxhash64(F.col(key), F.lit(1)).alias("b"))
    words = [F.bit_or(F.expr(_shift(f"cast(shiftrightunsigned(b, {6 * k}) & 63 as int)"))).alias(f"w{k}") for k in range(WORDS)]
    return hashed.groupBy(F.pmod("h", F.lit(blocks)).alias("bloom_block")).agg(*words), blocks


def listed_hits(pages: DataFrame, listed: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds canonical_url and is_listed to pages (column url)."""
    keys = stored(listed.select(canonical(F.col("url").cast("string")).alias("listed_url")).where("listed_url is not null").distinct(), "listed")
    filt, blocks = bloom_blocks(keys)
    rows = pages.withColumn("canonical_url", canonical(F.col("url").cast("string")))
    rows = rows.withColumn("bloom_h", F.xxhash64("canonical_url")).withColumn("bloom_b", F.xxhash64(F.col("canonical_url"), F.lit(1)))
    rows = rows.withColumn("bloom_at", F.pmod("bloom_h", F.lit(blocks)))
    # at most MAX_BLOCKS rows of 72 bytes, whatever the list
    probed = rows.join(F.broadcast(filt), F.col("bloom_at") == F.col("bloom_block"), "left")
    passes = F.lit(True)
    for k in range(WORDS):
        bit = F.expr(_shift(f"cast(shiftrightunsigned(bloom_b, {6 * k}) & 63 as int)"))
        passes = passes & (F.col(f"w{k}").bitwiseAND(bit) != 0)
    possible = F.col("canonical_url").isNotNull() & F.coalesce(passes, F.lit(False))
    probed = probed.withColumn("bloom_key", F.when(possible, F.col("canonical_url")))
    kept = [*(F.col(f"`{c}`") for c in pages.columns), "canonical_url"]
    exact = F.col("listed_url").isNotNull().alias("is_listed")
    if keys.count() <= broadcast_rows:
        return probed.join(F.broadcast(keys), F.col("bloom_key") == F.col("listed_url"), "left").select(*kept, exact)
    hits = probed.where("bloom_key is not null").join(keys, F.col("bloom_key") == F.col("listed_url"), "left").select(*kept, exact)
    return hits.unionByName(probed.where("bloom_key is null").select(*kept, F.lit(False).alias("is_listed")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):  # longer ones override
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical_url and is_listed of each row of pages."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = listed_hits(rows, listed, broadcast_rows).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("is_listed"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "canonical_url", "is_listed")


def listed_urls(spark: SparkSession, hosts=LISTED_HOSTS, tops=LISTED_TOPS, languages=LISTED_LANGUAGES, numbers: int = LISTED_NUMBERS) -> DataFrame:
    """A list of bad sites: (url) for each host, language and page number, made where it is read."""
    host = F.explode(F.array(*[F.lit(f"{h}.{t}") for h in hosts for t in tops]))
    language = F.explode(F.array(*[F.lit(x) for x in languages]))
    made = spark.range(numbers).select("id", host.alias("host")).select("id", "host", language.alias("language"))
    return made.select(F.concat(F.lit("http://www."), "host", F.lit("/"), "language", F.lit("/"), F.col("id").cast("string"), F.lit("/")).alias("url"))
