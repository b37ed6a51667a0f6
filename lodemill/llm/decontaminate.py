"""Benchmark decontamination by template windows, with DataFrame functions alone.

Texts are cut into words and numbers, and into single signs in scripts that put no spaces between words. Numbers, names
(runs of capitalised words other than a list of common ones) and units after a number become typed placeholders, one for
a whole run, so that a name of another length shifts nothing. Windows of eight such tokens are hashed and joined with the
benchmark's. Windows that match on one diagonal (the distance between the places in document and item) are one
occurrence; there every value of a slot in the item has to stand for one value in the document, so a question with other
numbers and names is caught, and prose that shares a few common turns is not. An item that numbers and names leave without
enough windows of words is matched by its own words as they are; one of fewer than four tokens by a text that is no more
than the item.

The benchmark's window hashes go to the executors as a constant bitmap of bounded size, so that only windows that may
match leave a document's row. A very large benchmark fills the bitmap, which then lets more windows pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import identified, materialize, spare

#: Tokens of a window, and how many of them have to be words.
WINDOW, LEAST_WORDS = 8, 4
#: An item with fewer windows of so many words is matched by its own words.
FEW = 3
#: An occurrence needs this share of an item's windows, or so many windows, and this share of slots that are consistent.
SHARE, ENOUGH, CONSISTENT = 0.5, 13, 0.8
#: Windows of a benchmark that are broadcast at most (more are joined by a shuffle of what the bitmap lets pass), and bits of the bitmap.
BROADCAST_WINDOWS, MAX_BITS = 500_000, 1 << 27
#: Every so many tokens at most a text is held against the benchmark's bitmap.
STRIDE = 4
#: Units of measure, in lower case.
UNITS = (
    "mm", "cm", "dm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "oz", "lb", "ml", "cl", "l", "s", "sec", "min", "h", "hr", "ms", "hz", "khz", "mhz", "ghz",
    "w", "kw", "mw", "kwh", "v", "a", "j", "kj", "cal", "kcal", "pa", "kpa", "bar", "kb", "mb", "gb", "tb", "usd", "eur", "gbp", "cents", "dollars", "euros", "pounds",
    "meters", "metres", "miles", "inches", "feet", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "percent", "degrees", "grams", "liters", "litres",
)
#: Placeholders of numbers, names and units, and the mark at both ends of a text.
NUMBER, NAME, UNIT, EDGE = "\u0001", "\u0002", "\u0003", "\u0004"
#: Words that begin sentences and are no names.
COMMON = (
    "A", "About", "After", "All", "Also", "Although", "An", "And", "Are", "As", "At", "Because", "Before", "But", "By", "Calculate", "Can", "Choose", "Compute", "Consider", "Did", "Do", "Does", "During", "Each",
    "Every", "Evaluate", "Explain", "Find", "For", "From", "Give", "Given", "Had", "Has", "Have", "He", "Her", "Here", "His", "How", "However", "I", "If", "In", "Is", "It", "Its", "Let", "Many", "More",
    "Most", "Must", "My", "No", "Not", "Now", "Of", "On", "Once", "One", "Or", "Our", "Over", "Please", "Prove", "Select", "Several", "She", "Should", "Show", "Since", "So", "Solve", "Some", "Sort", "Suppose",
    "That", "The", "Then", "There", "These", "They", "This", "Those", "To", "True", "Two", "Under", "Until", "Use", "Was", "We", "Were", "What", "When", "Where", "Which", "While", "Who", "Whose", "Why",
    "Will", "With", "Would", "Write", "Yes", "You", "Your", "Das", "Dem", "Den", "Der", "Die", "Ein", "Eine", "Es", "Ist", "Sie", "Und", "Was", "Wenn", "Wer", "Wie", "Wo", "Zu", "Dans", "Des", "Elle",
    "En", "Et", "Il", "La", "Le", "Les", "Quel", "Quelle", "Un", "Une", "Con", "El", "Las", "Los", "Para", "Por", "Que", "Una",
)
#: Signs of scripts without spaces: Thai to Myanmar, Khmer, Japanese and Chinese.
SIGN = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
CAPITAL = rf"(?!(?:{'|'.join(sorted(set(COMMON)))})(?!\p{{L}}))\p{{Lu}}\p{{L}}*+"
#: A run of up to eight capitalised words, and a number with up to 32 groups of digits (bounded, as a longer one may overflow the stack).
NAMES = rf"(?=\p{{Lu}})(?<!\p{{L}}){CAPITAL}(?: {{1,3}}+{CAPITAL}){{0,7}}+"
NUMBERS = r"\p{N}++(?:[.,]\p{N}++){0,31}+"
LETTERS = rf"[{SIGN}&&\p{{L}}]|[\p{{L}}&&[^{SIGN}]]++"
#: The tokens of a template, and those of a text as it is, which are as many.
TOKENS, WORDS = rf"[\x01-\x04]|{LETTERS}", rf"{NAMES}|{NUMBERS}|{LETTERS}"


def _text(text: Column) -> Column:
    """Null as empty, without the signs that mark placeholders and without the dot that lower-casing parts from a capital I."""
    return F.translate(F.coalesce(text, F.lit("")), f"{NUMBER}{NAME}{UNIT}{EDGE}\u0307", "    ")


def templates_of(text: Column) -> Column:
    """The tokens of a text's template, with an edge mark at either end: whole-text replacements, then one extraction."""
    text = F.regexp_replace(_text(text), NAMES, f" {NAME} ")
    text = F.replace(F.lower(F.regexp_replace(text, NUMBERS, f" {NUMBER} ")), F.lit("\u0307"), F.lit(""))
    text = F.regexp_replace(text, rf"{NUMBER} {{1,3}}(?:{'|'.join(UNITS)})(?!\p{{L}})", f"{NUMBER} {UNIT} ")
    return F.regexp_extract_all(F.concat(F.lit(f"{EDGE} "), text, F.lit(f" {EDGE}")), F.lit(TOKENS), F.lit(0))


def words_of(text: Column) -> Column:
    """The names, words and numbers of a text as they are, with the edge marks."""
    edge = F.array(F.lit(EDGE))
    return F.concat(edge, F.regexp_extract_all(_text(text), F.lit(WORDS), F.lit(0)), edge)


def tokenized(rows: DataFrame, text: str, literal: bool = False) -> DataFrame:
    """Add ``templates`` (or, if ``literal``, the own words in lower case) and ``hashes``, a hash for each of them."""
    tokens = F.transform(words_of(F.col(text)), F.lower) if literal else templates_of(F.col(text))
    return rows.withColumn("templates", tokens).withColumn("hashes", F.transform("templates", lambda t: F.xxhash64(t)))


def items_of(items: DataFrame, key: str, text: str) -> DataFrame:
    return items.select(F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").alias("text")).where("item is not null and text is not null").distinct()


def benchmark_windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """``literal``, ``item``, ``n`` (tokens of a window), ``at``, ``h``, ``pairs``, ``words``, ``template``, ``of``.

    Windows with fewer than ``LEAST_WORDS`` words besides placeholders are left out, and ``of`` counts what is left. Items
    with fewer than ``FEW`` windows left have all their windows over their own words too (``literal``), and these alone
    if some were left out.
    """
    items = items_of(items, key, text)
    plain = lambda t: ~t.isin(NUMBER, NAME, UNIT)
    found = None
    for literal in (False, True):
        rows = tokenized(items, "text").withColumn("own", words_of(F.col("text")))
        rows = rows.withColumn("n", F.least(F.size("hashes") - 2, F.lit(WINDOW))).where(F.col("n") >= LEAST_WORDS)
        starts = F.sequence(F.lit(1), F.size("hashes") - 1 - F.col("n"))
        left = F.filter(starts, lambda i: F.size(F.filter(F.slice("templates", i + 1, F.col("n")), plain)) >= LEAST_WORDS)
        rows = rows.withColumn("starts", starts).withColumn("left", left)
        if literal:
            rows = tokenized(rows.where(F.size("left") < FEW), "text", True).withColumn("left", F.col("starts"))
        else:
            rows = rows.where((F.size("left") >= FEW) | (F.size("left") == F.size("starts")))
        rows = rows.select("item", "n", "own", "templates", "hashes", F.explode("left").alias("at"), F.size("left").alias("of"))
        cut = lambda c: F.slice(c, F.col("at") + 1, F.col("n"))
        rows = rows.select(F.lit(literal).alias("literal"), "item", "n", "at", "of", F.xxhash64(cut("hashes")).alias("h"), F.transform(F.sequence(F.lit(0), F.col("n") - 2), lambda k: _pair(F.col("hashes"), F.col("at") + k)).alias("pairs"), cut("own").alias("words"), cut("templates").alias("template"))
        found = rows if found is None else found.union(rows)
    return found


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``__id``, ``key``, ``item``, ``windows`` (matched), ``consistent`` (share of slots) for each document and item that it leaks.

    ``__id`` tells rows of one key with different texts apart; repeated rows are one document. Null texts hold nothing;
    items with a null key or text, or without any token, match nothing; items of fewer than eight tokens are one window,
    and of fewer than four they match texts of just these tokens. A match holds for one occurrence, or for several parts
    of one; a part that repeats counts once. Empty tables give an empty result. Texts are taken whole; other columns are
    ignored. Keys may be of any type that can be ordered.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return _leaks(identified(rows, "key", "text"), items, item, item_text)


def _leaks(docs: DataFrame, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """As ``leaks``, for ``docs(__id, key, text)``."""
    docs = docs.select("__id", "key", "text")
    bench = materialize(benchmark_windows(items, item, item_text), "benchmark")
    kinds = [(r["literal"], r["n"], r["count"]) for r in bench.groupBy("literal", "n").count().collect()]
    small = sum(count for *_, count in kinds) <= BROADCAST_WINDOWS
    out = _equal_texts(docs, items_of(items, item, item_text))
    found = None
    for literal, n, _ in sorted(kinds):
        rows = tokenized(docs, "text", literal)
        starts = starts_of(F.col("hashes"), n, _may_hold(bench.where(F.col("literal") == literal), n))
        part = rows.withColumn("starts", starts).withColumn("own", F.when(F.size("starts") > 0, words_of(F.col("text"))))
        cut = lambda c, i, n=n: F.slice(c, i + 1, n)
        windows = F.transform("starts", lambda i: F.struct(i.alias("at"), F.xxhash64(cut("hashes", i)).alias("h"), cut("templates", i).alias("template"), cut("own", i).alias("own")))
        part = part.select("__id", "key", F.lit(literal).alias("literal"), F.lit(n).alias("n"), F.explode(windows).alias("w")).select("__id", "key", "literal", "n", "w.*")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return out
    right = bench.select("literal", "item", "n", "h", "of", "words", F.col("at").alias("item_at"), F.col("template").alias("item_template"))
    matched = found.join(F.broadcast(right) if small else right, ["literal", "n", "h"]).where(F.col("template") == F.col("item_template"))
    matched = materialize(matched.select("__id", "key", "literal", "item", "of", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", "template", "words", "own").distinct(), "matches")
    place = ["__id", "literal", "item", "of", "diagonal"]
    slots = matched.select(*place, F.explode(F.filter(F.arrays_zip("template", "words", "own"), lambda s: s["template"].isin(NUMBER, NAME, UNIT))).alias("s"))
    slots = slots.groupBy(*place, F.col("s.template").alias("kind"), F.col("s.words").alias("value")).agg((F.min("s.own") == F.max("s.own")).cast("double").alias("same"))
    slots = slots.groupBy(*place).agg(F.avg("same").alias("consistent"))
    counts = matched.groupBy(*place).agg(F.first("key").alias("key"), F.collect_set("item_at").alias("ats"))
    joined = counts.join(slots, place, "left").withColumn("consistent", F.coalesce("consistent", F.lit(1.0))).where(F.col("consistent") >= CONSISTENT)
    joined = joined.select("__id", "key", "literal", "item", "of", "consistent", F.explode("ats").alias("item_at"))
    held = joined.groupBy("__id", "literal", "item", "of").agg(F.first("key").alias("key"), F.count_distinct("item_at").alias("windows"), F.min("consistent").alias("consistent"))
    need = F.least(F.ceil(F.col("of") * SHARE), F.lit(ENOUGH))
    held = held.where(F.col("windows") >= need).select("__id", "key", "item", "windows", "consistent").unionByName(out)
    return held.groupBy("__id", "item").agg(F.first("key").alias("key"), F.max("windows").alias("windows"), F.min("consistent").alias("consistent")).select("__id", "key", "item", "windows", "consistent")


def _equal_texts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that are no more than an item of fewer than ``LEAST_WORDS`` tokens."""
    own = tokenized(items, "text", True).where(F.size("hashes").between(3, LEAST_WORDS + 1)).select("item", F.col("templates").alias("item_tokens"))
    none = docs.select("__id", "key").limit(0).crossJoin(own.select("item").limit(0)).select("__id", "key", "item", F.lit(1).cast("long").alias("windows"), F.lit(1.0).alias("consistent"))
    if own.isEmpty():
        return none
    rows = tokenized(docs, "text", True).where(F.size("hashes").between(3, LEAST_WORDS + 1)).select("__id", "key", "templates")
    return rows.join(own, F.col("templates") == F.col("item_tokens")).select("__id", "key", "item", F.lit(1).cast("long").alias("windows"), F.lit(1.0).alias("consistent")).distinct()


def stride_of(n: int) -> int:
    """Every so many tokens a text is asked whether a window of ``n`` lies there."""
    return min(STRIDE, n - 1)


def starts_of(hashes: Column, n: int, may_hold) -> Column:
    """Where windows of ``n`` tokens begin that lie around tokens that ``may_hold`` lets pass: it is asked at every
    ``stride_of(n)``-th token, and each window has exactly one of these among as many first tokens."""
    last, stride = F.size(hashes) - 1 - n, stride_of(n)
    asked = F.sequence(F.lit(1), F.size(hashes) - 2, F.lit(stride))
    found = F.filter(asked, lambda i: may_hold(hashes, i))
    around = F.flatten(F.transform(found, lambda i: F.sequence(F.greatest(i - (stride - 1), F.lit(1)), F.least(i, last))))
    return F.when(last >= 1, F.when(F.size(found) > 0, F.filter(around, lambda i: i <= last)))


def _pair(hashes: Column, i: Column) -> Column:
    """A number for the two tokens from ``i`` on."""
    return F.get(hashes, i).bitwiseXOR(F.shiftright(F.get(hashes, i + 1), 7))


def _may_hold(bench: DataFrame, n: int, least_bits: int = 1 << 16):
    """Whether one of these windows may have a token among its first: a bitmap over the pairs that begin there, with 16
    bits or more for each pair, up to ``MAX_BITS``."""
    pairs = bench.where(F.col("n") == n).select(F.explode(F.slice("pairs", 1, stride_of(n))).alias("pair")).distinct()
    bits = min(MAX_BITS, max(least_bits, 1 << (16 * pairs.count()).bit_length()))
    place = F.col("pair").bitwiseAND(F.lit(bits - 1)).cast("int")
    marks = pairs.select(F.shiftright(place, 5).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(31))).alias("b"))
    words = [0] * (bits // 32)
    for w, b in marks.groupBy("w").agg(F.bit_or("b")).collect():
        words[w] = b
    bitmap = F.from_json(F.lit("[" + ",".join(map(str, words)) + "]"), "array<long>")

    def test(hashes: Column, i: Column) -> Column:
        p = _pair(hashes, i).bitwiseAND(F.lit(bits - 1)).cast("int")
        return F.call_function("getbit", F.get(bitmap, F.shiftright(p, 5)), p.bitwiseAND(F.lit(31))) == 1

    return test


def drop_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with their columns."""
    own, gone = spare(docs.columns, "__id"), spare(docs.columns, "__gone")
    marked = identified(docs, key, text, own)
    found = _leaks(marked.select(F.col(own).alias("__id"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), items, item, item_text)
    return marked.join(found.select(F.col("__id").alias(gone)).distinct(), F.col(own) == F.col(gone), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whether it leaks items of ``benchmark``, and which."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    marked = identified(docs, "key", "text")
    found = _leaks(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text").groupBy("__id").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = marked.select("__id", F.col("key").alias("doc_id")).join(found, "__id", "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("leaked"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))
