"""Text measures, names of files and small codecs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that are space; a vertical tab is none, but goes with it from both ends of a text.
SPACE = r" \t\n\f\r"
#: A run of at least three signs that are neither letters, numbers nor space.
SIGN_RUN = rf"[^\p{{L}}\p{{N}}{SPACE}]{{3,}}"
#: Common Chinese characters.
CJK = "[一-龥]"


def rounded(x: Column) -> Column:
    """To six decimals: the nearest whole number of millionths of a double, halves away from zero, as SQL engines round by."""
    return F.round(x.cast("double") * 1e6) / 1e6


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b, F.lit(0)).cast("double")


def chunk_quality(text: Column, size: int) -> Column:
    """Half for length, 0.3 for few special signs, 0.1 for being there; 0 for an empty text."""
    special = F.length(F.regexp_replace(text, rf"[\p{{L}}\p{{Nd}}{SPACE}]", ""))
    score = 0.5 * F.least(F.lit(1.0), F.length(text) / float(size)) + 0.3 * (1 - _ratio(special, F.length(text))) + 0.1
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(score)


def gibberish_ratio(text: Column) -> Column:
    """The share of a text that runs of signs make up; 1 for an empty text."""
    runs = F.aggregate(F.regexp_extract_all(text, F.lit(f"({SIGN_RUN})"), F.lit(1)), F.lit(0), lambda s, x: s + F.length(x))
    return F.coalesce(_ratio(runs, F.length(text)), F.lit(1.0))


def words(text: Column) -> Column:
    return F.split(F.regexp_replace(text, rf"^[{SPACE}\x0B]+|[{SPACE}\x0B]+\z", ""), f"[{SPACE}]+", -1)



def mean_word_length(text: Column) -> Column:
    """0 for a blank text."""
    total = F.length(F.regexp_replace(text, f"[{SPACE}]", ""))
    return F.when((total == 0) | text.isNull(), 0.0).otherwise(_ratio(total, F.size(words(text))))


def words_per_char(text: Column) -> Column:
    blank = F.regexp_replace(text, f"[{SPACE}]", "") == ""
    return F.when(blank | text.isNull(), 0.0).otherwise(_ratio(F.size(words(text)), F.length(text)))


def chinese_ratio(text: Column) -> Column:
    return F.coalesce(_ratio(F.regexp_count(text, F.lit(CJK)), F.length(text)), F.lit(0.0))


def has_chinese(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK), F.lit(False))


def is_high_quality(text: Column) -> Column:
    """Long enough, few runs of signs, words of usual length, and Chinese either absent or a tenth."""
    mean = mean_word_length(text)
    good = (F.length(text) >= 100) & (gibberish_ratio(text) <= 0.15) & (mean >= 1.5) & (mean <= 20) & (words_per_char(text) >= 0.08)
    return F.coalesce(good & (~has_chinese(text) | (chinese_ratio(text) >= 0.1)), F.lit(False))


def quality_score(text: Column) -> Column:
    """0.3 for length, 0.4 for few runs of signs, 0.3 for words; 0 for an empty text."""
    length = 0.3 * F.least(F.lit(1.0), F.length(text) / 1000.0)
    clean = 0.4 * F.greatest(F.lit(0.0), 1 - 2 * gibberish_ratio(text))
    score = length + clean + 0.3 * F.least(F.lit(1.0), 10 * words_per_char(text))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(score)


def estimate_tokens_by_script(text: Column) -> Column:
    """Han characters count two thirds of a token, others a quarter; each part is rounded up."""
    han = F.regexp_count(text, F.lit(r"\p{IsHan}"))
    return F.coalesce((F.ceil(han / 1.5) + F.ceil((F.length(text) - han) / 4.0)).cast("int"), F.lit(0))


def estimate_tokens(length: Column) -> Column:
    """A third of the characters, rounded up."""
    return F.ceil(length / 3.0).cast("int")


def shorten(text: Column, n: int) -> Column:
    """At most ``n`` characters, then three dots."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def extension_of_name(name: Column) -> Column:
    """The lower-case text after the last dot; ``txt`` where there is none."""
    return F.when(F.coalesce(F.contains(name, F.lit(".")), F.lit(False)), F.lower(F.element_at(F.split(name, r"\.", -1), -1))).otherwise("txt")


def extension_of_url(url: Column) -> Column:
    """As of a name, without the query; ``html`` where there is none or it holds a slash."""
    last = F.element_at(F.split(F.split_part(url, F.lit("?"), F.lit(1)), r"\.", -1), -1)
    bare = F.split_part(url, F.lit("?"), F.lit(1))
    plain = F.coalesce(F.contains(bare, F.lit(".")) & ~F.contains(last, F.lit("/")) & (last != ""), F.lit(False))
    return F.when(plain, F.lower(last)).otherwise("html")


#: The loader of each extension; others are read as text.
LOADERS = {
    "pdf": ("pdf",),
    "html": ("html", "htm"),
    "word": ("docx", "doc"),
    "excel": ("xlsx", "xls"),
    "powerpoint": ("pptx", "ppt"),
    "image": ("png", "jpg", "jpeg", "tiff", "tif", "bmp", "webp", "gif"),
}


def loader_of(extension: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for loader, own in LOADERS.items():
        out = out.when(F.lower(extension).isin(*own), loader)
    return out.otherwise("text")


def image_format(content: Column) -> Column:
    """The kind of an image by its first bytes; png where they are unknown."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E47"), "png")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("47494638"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        .otherwise("png")
    )


def cache_key(path: Column, size: Column, modified: Column) -> Column:
    """A digest that changes with a file."""
    return F.md5(F.concat_ws("|", path, size.cast("string"), modified.cast("string")).cast("binary"))


def parse_metadata(text: Column) -> Column:
    """The map of a JSON object; empty for anything else."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(text, "map<string,string>"), empty)


def merge_metadata(base: Column, over: Column) -> Column:
    """Both maps; where a key is in both, ``over`` wins."""
    empty = F.create_map().cast("map<string,string>")
    base, over = F.coalesce(base, empty), F.coalesce(over, empty)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def first_filled(*values: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])
