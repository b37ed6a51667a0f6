"""URL filters by a cascade of Bloom filters, with DataFrame functions alone.

A list of keys (rules, blocked hosts) is matched against every key that the corpus's urls can ask for. Level 0 holds
the listed keys. Level 1 holds the corpus keys that pass level 0 without being listed, level 2 the listed keys that
pass level 1, and so on until nothing passes wrongly. As the levels were built over all keys of the corpus, asking them
in turn is exact for every one of these keys, and a url is judged without a join. Of a long list only what the corpus asks
for is encoded, so that a filter's size goes by the listed keys that occur.

Null urls and urls without ``://`` have an empty host and path, fit no rule and are allowed. Empty tables give empty
results. Repeated urls are judged alike. Columns that the judged table brings along are kept; ``host``, ``path``,
``rule`` and ``verdict`` of the input are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, spare

#: Rules of the production query: the action and the rule, a host and a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Hosts that are blocked, with their subdomains, where no rule fits.
BLOCKED_HOSTS = (
    "ads-track.example.com", "adult-x.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org",
)
#: A word of a filter has 64 bits.
WORD = 64
#: Bits of a filter that may go to the executors with the plan (16 MB, for 11 million listed keys that occur in the corpus);
#: beyond it keys are matched by a shuffled join.
MAX_BITS = 1 << 27

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Level:
    """One filter: its words, its size and the salt of its hashes. The words are one constant of the plan."""

    words: list[int]
    n_bits: int
    salt: int
    n_hashes: int

    def has(self, key: Column) -> Column:
        words = F.from_json(F.lit("[" + ",".join(map(str, self.words)) + "]"), "array<bigint>")
        return F.forall(F.array(*positions(key, self)), lambda p: F.call_function("getbit", F.get(words, word_of(p)), (p % WORD).cast("int")) == 1)


def word_of(position: Column) -> Column:
    return F.shiftright(position, 6).cast("int")


def bit_of(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (position % WORD).cast("int"))


def positions(key: Column, level: Level) -> list[Column]:
    """The bits of a key, by double hashing."""
    size = F.lit(level.n_bits).cast("long")
    a, b = F.pmod(F.xxhash64(F.lit(level.salt), key), size), F.pmod(F.xxhash64(key, F.lit(level.salt + 1)), size)
    return [F.pmod(a + b * F.lit(i), size) for i in range(level.n_hashes)]


@dataclass
class Cascade:
    """Levels that answer in turn; exact for the keys over which they were built."""

    levels: list[Level] = field(default_factory=list)

    def has(self, key: Column) -> Column:
        out: Column = F.lit(False)
        for level in reversed(self.levels):
            out = level.has(key) & ~out
        return out


class TooLarge(ValueError):
    """A level would be larger than what may be broadcast."""


def build_level(keys: DataFrame, n: int, salt: int, bits_per_key: int, n_hashes: int, max_bits: int, clip: bool = False) -> Level:
    """A filter of the ``key`` column. What reaches the driver is bounded by ``max_bits``; more raises, or, if ``clip`` is
    set, is pressed into so many bits, and more keys pass that are none."""
    n_bits = -(-max(n * bits_per_key, 64) // WORD) * WORD
    if n_bits > max_bits and not clip:
        raise TooLarge(f"{n} keys need {n_bits} bits")
    n_bits = min(n_bits, max_bits)
    level = Level([0] * (n_bits // WORD), n_bits, salt, n_hashes)
    bits = keys.select(F.explode(F.array(*positions(F.col("key"), level))).alias("p"))
    for w, b in bits.groupBy(word_of(F.col("p")).alias("w")).agg(F.bit_or(bit_of(F.col("p"))).alias("b")).collect():
        level.words[w] = b
    return level


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = 12, n_hashes: int = 4, max_bits: int = MAX_BITS) -> Cascade:
    """A cascade that holds ``listed.key`` and rejects every other ``universe.key``. Null keys are never held."""
    cascade = Cascade()
    universe = universe.where("key is not null").select("key")
    inside = materialize(listed.where("key is not null").select("key").distinct().join(universe, "key", "left_semi"), "listed")
    known = inside
    while (n := inside.count()) > 0:
        depth = len(cascade.levels)
        level = build_level(inside, n, 1000 + 2 * depth, bits_per_key, n_hashes, max_bits)
        cascade.levels.append(level)
        outside = universe.where(level.has(F.col("key")))
        if depth == 0:
            outside = outside.join(known, "key", "left_anti").distinct()
        inside, universe = materialize(outside.select("key"), "cascade"), inside
    return cascade


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, max_labels: int, lengths: list[int]) -> Column:
    """Every key that could fit: the host and its parent domains, each with the start of the path at every listed length."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max_labels))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: DataFrame, blocked: DataFrame, url: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules`` has ``action`` (block or allow) and ``rule`` (a host with a path, like ``net/``); ``blocked`` has ``key``,
    hosts that are blocked with their subdomains where no rule fits. A rule fits its host and all subdomains if the
    path starts with the rule's path; of those that fit, the longest string wins. A rule listed with both actions
    blocks. Rules' hosts are to be in lower case. Memory on the driver and in the plan is bounded by ``max_bits`` for
    each level; where more listed keys than that occur, they are matched by a shuffled join on the same candidate keys.
    """
    rules = rules.where("rule is not null and rule != ''").select("action", "rule")
    blocked = blocked.where("key is not null and key != ''").select("key").distinct()
    rule_host, rule_path = F.regexp_extract("rule", r"^([^/]*)", 1), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)
    shapes = rules.select(F.length(rule_path).alias("n"), F.size(F.split(rule_host, r"\.", -1)).alias("labels")).union(blocked.select(F.lit(0), F.size(F.split("key", r"\.", -1))))
    shape = shapes.agg(F.collect_set("n").alias("n"), F.max("labels").alias("labels")).first()
    lengths, max_labels = sorted(shape["n"]) or [0], shape["labels"] or 1
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    asked_keys = spare([*kept, "host", "path", "rule", "verdict"], "__keys")
    base = pages.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    asked = base.select("host", F.substring("path", 1, max(lengths)).alias("path")).distinct()
    keys = candidates(F.col("host"), F.col("path"), max_labels, lengths)
    universe = asked.select(F.explode(keys).alias("key")).distinct()
    listed = rules.select(F.col("rule").alias("key"))
    blocking = rules.where("action = 'block'").select(F.col("rule").alias("key")).unionByName(blocked)
    try:
        universe = materialize(universe, "universe")
        in_rules, in_block = build_cascade(listed, universe, max_bits=max_bits), build_cascade(blocking, universe, max_bits=max_bits)
    except TooLarge:
        return _judge_by_join(base, rules, blocked, keys)
    fits = base.withColumn(asked_keys, keys).withColumn(asked_keys, F.transform(asked_keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"), in_rules.has(k).alias("rule"), in_block.has(k).alias("block"))))
    best = F.array_max(F.filter(asked_keys, lambda k: k["rule"]))
    hosts = F.exists(asked_keys, lambda k: k["block"] & ~k["rule"] & ~F.contains(k["k"], F.lit("/")))
    verdict = F.when(F.coalesce(best["block"], best.isNull() & hosts), F.lit("block")).otherwise(F.lit("allow"))
    return fits.select(*[F.col(f"`{c}`") for c in kept], "host", "path", best["k"].alias("rule"), verdict.alias("verdict"))


def _judge_by_join(base: DataFrame, rules: DataFrame, blocked: DataFrame, keys: Column) -> DataFrame:
    """For lists beyond the bound: join distinct candidate keys with the list, then distinct hosts and paths with the outcome."""
    lists = rules.groupBy(F.col("rule").alias("key")).agg(F.max((F.col("action") == "block").cast("int")).alias("block"), F.lit(1).alias("rule"))
    lists = lists.unionByName(blocked.select("key", F.lit(1).alias("block"), F.lit(0).alias("rule")))
    asked = base.select("host", "path").distinct()
    found = asked.withColumn("key", F.explode(keys)).join(lists, "key")
    best = F.max(F.when(F.col("rule") == 1, F.struct(F.length("key").alias("n"), F.col("key").alias("k"), F.col("block").alias("block"))))
    found = found.groupBy("host", "path").agg(best.alias("__best"), F.max(F.when(F.col("rule") == 0, F.col("block"))).alias("__listed"))
    block = F.coalesce(F.col("__best.block"), F.col("__listed"), F.lit(0)) == 1
    out = base.join(found, ["host", "path"], "left")
    return out.select(*[F.col(f"`{c}`") for c in base.columns], F.col("__best.k").alias("rule"), F.when(block, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` under the production rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.sql("select * from values " + ", ".join(f"('{a}', '{r}')" for a, r in RULES) + " as t(action, rule)")
    blocked = spark.sql("select * from values " + ", ".join(f"('{h}')" for h in BLOCKED_HOSTS) + " as t(key)")
    return judge(pages, rules, blocked).select("page_id", "host", "path", "rule", "verdict")


#: The same by plain expressions.
ORACLE = f"""
with u as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
r as (
  select *, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from u)
select page_id, host, path, rule, case
    when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
    when {" or ".join(f"host = '{h}' or ends_with(host, '.{h}')" for h in BLOCKED_HOSTS)} then 'block' else 'allow' end as verdict
from r"""
