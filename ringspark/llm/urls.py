"""URL filters: a Bloom filter cascade over the corpus's keys, and path rules.

The cascade: level 1 encodes the listed keys, level 2 the keys of the universe that
level 1 holds falsely, level 3 the listed keys that level 2 holds falsely, and so on
until a level holds nothing falsely.  A key of the universe is listed exactly if the
first level that lacks it is an even one (if none lacks it: if their number is odd).
The universe is the distinct keys of the corpus, so the answer is exact for every row,
and rows are judged by looking up bits: no join and no exchange.

Bits are an array of longs, made by hash aggregation and read as a scalar subquery.  Its
size is known before it is built (``max_bytes`` for all levels, 64 MB by default); a
list that needs more, or a cascade that does not end within ``max_levels``, is judged by
an equi-join with the distinct listed keys instead, which is as exact.

Built-in functions only.  Defined results: a null url, or one without ``://``, has an
empty host and path, fits no rule, and is allowed unless the empty key is listed; null keys
of the list list nothing; repeated urls are judged alike, however long; an empty table gives an
empty result; of rules of equal length that fit, the last by host and path holds.  Callers'
columns with the names of results are kept under the next free names (``host_1``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, make_room, own_prefix, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def parse(url: Column) -> tuple[Column, Column]:
    """host and path."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Rules are a short list (they become one expression)."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _shape(n: int, rate: float) -> tuple[int, int]:
    """Bits (a multiple of 64) and hash functions for n keys."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64) * 64)
    return bits, max(1, min(16, round(bits / max(1, n) * math.log(2))))


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    a, b = F.pmod(F.xxhash64(key, F.lit(2 * level)), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(2 * level + 1)), F.lit(bits))
    return [(a + b * j + j * j) % bits for j in range(hashes)]


class Cascade:
    def __init__(self) -> None:
        self.levels: list[tuple[Column, int, int]] = []

    def holds(self, key: Column, level: int) -> Column:
        words, bits, hashes = self.levels[level]
        out = F.lit(True)
        for p in _positions(key, level, bits, hashes):
            word = F.get(words, F.floor(p / 64).cast("int"))
            out = out & (F.call_function("shiftrightunsigned", word, (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out

    def listed(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self.holds(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def cascade(keys: DataFrame, listed: DataFrame, max_bytes: int = 64 << 20, max_levels: int = 40) -> Cascade | None:
    """keys, listed: one string column key each, repeats allowed. None where the limits are exceeded."""
    spark = keys.sparkSession
    scratch = Scratch(spark, "cascade")
    flag = lambda df, a, b: df.select("key", F.lit(a).alias("here"), F.lit(b).alias("listed"))
    universe = flag(keys, 1, 0).union(flag(listed, 0, 1)).where("key is not null").groupBy("key").agg(F.max("here").alias("here"), F.max("listed").alias("listed"))
    universe = scratch.save(universe.where("here = 1").select("key", "listed"), "universe")
    inside, outside = universe.where("listed = 1").select("key"), universe.where("listed = 0").select("key")
    out, used = Cascade(), 0
    n_in, n_out = inside.count(), outside.count()
    while n_in:
        level = len(out.levels)
        rate = min(0.5, max(1e-6, n_in / max(1, n_out) / math.sqrt(2))) if level == 0 else 0.5
        bits, hashes = _shape(n_in, rate)
        used += bits // 8
        if used > max_bytes or level >= max_levels:
            return None
        at = inside.select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("p"))
        words = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits"))
        whole = spark.range(bits // 64).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
        # In runs of 1024 words first, so that the one row is joined of few pieces.
        sorted_bits = lambda: F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"])
        runs = whole.groupBy(F.call_function("div", "id", F.lit(1024)).alias("run")).agg(sorted_bits().alias("bits"))
        packed = runs.select(F.col("run").alias("id"), "bits").agg(F.flatten(sorted_bits()).alias("words"))
        out.levels.append((scratch.save(packed, f"level{level}").scalar(), bits, hashes))
        false = scratch.save(outside.where(out.holds(F.col("key"), level)), f"false{level}")
        inside, outside, n_in, n_out = false, inside, false.count(), n_in
    return out


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, url_col: str = "url", max_bytes: int = 64 << 20) -> DataFrame:
    """pages with the columns host, path, rule and verdict (block or allow); the listed keys are hosts."""
    host, path = parse(F.col(url_col))
    p = own_prefix(pages)
    parsed = pages.withColumns({p + "h": host, p + "p": path})  # before the names are taken: the url may be in one of them
    out = make_room(parsed, "host", "path", "rule", "verdict").withColumnsRenamed({p + "h": "host", p + "p": "path"})
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    built = cascade(out.select(F.col("host").alias("key")), listed, max_bytes)
    if built is not None:
        blocked = built.listed(F.col("host"))
    else:
        out = out.join(listed.where("key is not null").select(F.col("key").alias(p + "listed")).distinct(), F.col("host") == F.col(p + "listed"), "left")
        blocked = F.col(p + "listed").isNotNull()
    out = out.withColumns({"rule": name, "verdict": F.coalesce(verdict, F.when(blocked, "block").otherwise("allow"))})
    return out.drop(p + "listed")


def query(spark, sf_dir: str) -> DataFrame:
    """The list, for want of a table of its own: the corpus's hosts whose md5 begins with 0 to 3."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(parse(F.col("url"))[0].alias("key"))
    listed = hosts.where(F.substring(F.md5(F.col("key").cast("binary")), 1, 1) <= "3").distinct()
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from a),
c as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from b),
d as (select *, '.' || host as dotted from c),
e as (select *, case
  when ends_with(dotted, '.example.com') and starts_with(path, '/en/7') then 'example.com/en/7'
  when ends_with(dotted, '.example.net') and starts_with(path, '/de/8') then 'example.net/de/8'
  when ends_with(dotted, '.com') and starts_with(path, '/en/') then 'com/en/'
  when ends_with(dotted, '.net') and starts_with(path, '/de/') then 'net/de/'
  when ends_with(dotted, '.org') and starts_with(path, '/es/') then 'org/es/' end as rule from d)
select page_id, host, path, rule, case
  when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block' when rule is not null then 'allow'
  when substr(md5(host), 1, 1) <= '3' then 'block' else 'allow' end as verdict from e
"""
