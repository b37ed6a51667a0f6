"""Line dedup: repeated runs of lines, from a suffix array over line ids that is built by prefix doubling.

A line's id is a digest of 128 bits. Round by round, the rank of what starts at a position is refined from the ranks of
its first and its second half; ranks follow the order of the ids, so equal ranks are intervals of the suffix array whose
common prefix has at least the depth reached. Positions that stand alone in their interval drop out, and rounds go on
until none is left. Then intervals are followed back down: the positions that dropped out of an interval in one round are
parted by half as many lines, a quarter as many and so on, each time by the ranks of the round of that size, until each
is in the interval of its longest common prefix with any other. Those that went further leave one of each interval
behind as a witness, so that no round holds more than the positions in question. A run of lines that a position shares,
and that the position before does not reach, is a maximal repeated run.

All but the earliest position of an interval whose common prefix has the least length that counts are later copies, and
their lines go. Ranks are made from distinct pairs with partial aggregation, and joined back; a line that a third of all
documents share is counted where it lies, and AQE splits the join of its positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import identified, materialize, spare

#: A run of repeated lines counts from so many lines on, or, shorter, from a line of so many words on.
MIN_LINES, MIN_WORDS = 2, 50
#: What a blank line is made of, besides the feed that ends it.
BLANK = " \t\r\x0b\x0c"


def _ranked(positions: DataFrame, by: list[str], name: str) -> DataFrame:
    """``id``, ``pos``, ``words``, ``rank``, ``later`` of the positions whose ``by`` is not unique; rank ascends with ``by``, and all but the earliest are later."""
    groups = positions.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first")).where("n > 1")
    order = groups.repartitionByRange(*by).sortWithinPartitions(*by)
    ranks = materialize(order.select(*by, "first", F.monotonically_increasing_id().alias("rank")), "ranks")
    return materialize(positions.join(ranks, by).select("id", "pos", "words", "rank", (F.struct("id", "pos") != F.col("first")).alias("later")), name)


def _extended(ranked: DataFrame, by: DataFrame, shift: int, name: str) -> DataFrame:
    """Ranks of what is at a position in ``ranked``, followed by what is in ``by`` so many lines on."""
    second = by.select("id", (F.col("pos") - shift).alias("pos"), F.col("rank").alias("second"))
    return _ranked(ranked.select("id", "pos", "words", F.col("rank").alias("head")).join(second, ["id", "pos"]), ["head", "second"], name)


class SuffixArray:
    """Ranks of the repeated runs of 1, 2, 4, ... lines of ``lines(id, pos, line, words)``; ``pos`` counts 0, 1, 2 in a document.

    ``level(k)`` has the positions whose 2**k lines stand elsewhere too. Rounds are made when they are asked for, and kept.
    """

    def __init__(self, lines: DataFrame) -> None:
        self.levels, self.whole = [_ranked(lines, ["line", "words"], "lines")], False

    def level(self, k: int) -> DataFrame | None:
        """The positions of round k; none if no 2**k lines stand twice."""
        while len(self.levels) <= k and not self.whole:
            n = len(self.levels)
            following = _extended(self.levels[-1], self.levels[-1], 1 << (n - 1), f"depth{n}")
            if following.isEmpty():
                self.whole = True
            else:
                self.levels.append(following)
        return self.levels[k] if k < len(self.levels) else None

    def at_depth(self, depth: int) -> DataFrame:
        """The positions whose ``depth`` lines stand elsewhere too: two overlapping runs of a power of two."""
        k = depth.bit_length() - 1
        level = self.level(k)
        if level is None:
            return self.levels[0].limit(0)
        return level if depth == 1 << k else _extended(level, level, depth - (1 << k), f"lines{depth}")

    def shared(self, least: int) -> DataFrame:
        """``id``, ``pos``, ``lines``: how many lines from a position on stand elsewhere too, where it is ``least`` or more."""
        begin, state = least.bit_length() - 1, None  # shorter runs than those of this round do not count
        while self.level(len(self.levels)) is not None:
            pass  # rounds go on until nothing is left
        for k in range(len(self.levels) - 1, -1, -1):
            if k >= begin:
                state = self._dropped(k) if state is None else state.unionByName(self._dropped(k))
            if k and state is not None:
                state = self._parted(state, k - 1)
        if state is None:
            return self.levels[0].limit(0).select("id", "pos", F.lit(0).alias("lines"))
        return state.where(F.col("asks") & (F.col("lines") >= least)).select("id", "pos", "lines")

    def _dropped(self, k: int) -> DataFrame:
        """The positions of round k that dropped out in the next, and one of each interval of the next as a witness."""
        level = self.levels[k].select("id", "pos", F.lit(1 << k).alias("lines"), F.lit(k).alias("round"), F.col("rank").alias("interval"))
        if k + 1 == len(self.levels):
            return level.withColumn("asks", F.lit(True))
        further = self.levels[k + 1].select("id", "pos", "later")
        return level.join(further, ["id", "pos"], "left").where("later is null or not later").withColumn("asks", F.col("later").isNull()).drop("later")

    def _parted(self, state: DataFrame, k: int) -> DataFrame:
        """Intervals in which somebody asks, parted by the next 2**k lines; who shares these with another goes further."""
        place = ["round", "interval", "lines", "rank"]
        level = self.levels[k].select("id", F.col("pos").alias("at"), "rank")
        moved = materialize(state.withColumn("at", F.col("pos") + F.col("lines")).join(level, ["id", "at"], "left").drop("at"), "moved")
        groups = moved.where("rank is not null").groupBy(*place).agg(F.count("*").alias("n"), F.bool_or("asks").alias("asked"), F.min(F.struct("id", "pos")).alias("first"))
        groups = materialize(groups.where("n > 1 and asked").select(*place, "first", F.monotonically_increasing_id().alias("new")), "parted")
        joined = moved.join(groups.drop("first"), place, "left")
        went = F.col("new").isNotNull()
        stay = joined.select("id", "pos", (F.col("lines") + F.when(went, F.lit(1 << k)).otherwise(0)).alias("lines"), F.when(went, F.lit(-1 - k)).otherwise(F.col("round")).alias("round"), F.coalesce("new", "interval").alias("interval"), "asks")
        witness = groups.select("first.id", "first.pos", "lines", "round", "interval", F.lit(False).alias("asks"))
        return materialize(stay.unionByName(witness), "state")


def later_copies(array: SuffixArray, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``id``, ``pos`` of the lines that go."""
    every = F.explode(F.sequence(F.lit(0), F.lit(min_lines - 1)))
    runs = array.at_depth(min_lines).where("later").select("id", "pos", every.alias("k")).select("id", (F.col("pos") + F.col("k")).cast("int").alias("pos"))
    alone = array.levels[0].where(F.col("later") & (F.col("words") >= min_words)).select("id", "pos")
    return runs.unionByName(alone).distinct()


def maximal_runs(array: SuffixArray, min_lines: int = MIN_LINES) -> DataFrame:
    """``id``, ``pos``, ``lines``: runs of ``min_lines`` lines or more that stand elsewhere too, earlier or later, and are part of no longer one."""
    # what is shared from a position on ends no earlier than what is shared from the one before
    end = F.col("pos") + F.col("lines")
    before = F.lag(end).over(Window.partitionBy("id").orderBy("pos"))
    return array.shared(min_lines).withColumn("before", before).where((end > F.col("before")) | F.col("before").isNull()).select("id", "pos", "lines")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, runs: bool = False) -> DataFrame:
    """``docs`` with ``text`` less its later copies, ``n_lines`` and ``removed`` (line numbers, ascending); if ``runs`` is
    set, also ``n_runs`` and ``longest_run``, the number and the greatest length of its maximal repeated runs.

    Lines end at line feeds; a line's carriage return is part of it. A line goes if it lies in a run of ``min_lines`` lines
    or more that also starts earlier (in a row of smaller key, or earlier in the text), or if it has ``min_words`` words or
    more and stands earlier. Runs are taken from the texts as they are and do not cross rows. Lines of white space only are
    no part of a run and stay, unless all else goes: then the text is empty. A maximal repeated run has ``min_lines`` lines
    or more, stands elsewhere too (its first occurrence counts as well), and is part of no longer one of its text. A null
    text stays null and has no lines. Rows that repeat key and text are one document and stay alike; of one key with
    different texts, the order is by a hash of the text; null keys come first. Keys may be of any type that can be ordered.
    Other columns are kept; ``n_lines``, ``removed``, ``n_runs`` and ``longest_run`` of the input are replaced.
    """
    docs = docs.drop("n_lines", "removed", "n_runs", "longest_run")
    own, own2, gone, split = (spare(docs.columns, x) for x in ("__id", "__line_id", "__gone", "__lines"))
    columns = docs.columns
    docs = identified(docs, key, text, own)
    texts = docs.select(F.col(own).alias("id"), F.split(F.col(f"`{text}`"), "\n", -1).alias("lines"))
    count, distinct = docs.agg(F.count("*"), F.count_distinct(own)).first()
    if count != distinct:
        texts = texts.dropDuplicates(["id"])
    full = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), x.alias("x"))), lambda s: F.btrim(s["x"], F.lit(BLANK)) != "")
    lines = texts.select("id", F.posexplode(full).alias("pos", "s"))
    digest = F.substring(F.unhex(F.sha2("s.x", 256)), 1, 16)
    lines = lines.select("id", "pos", F.col("s.at").alias("at"), digest.alias("line"), F.size(F.split(F.btrim("s.x", F.lit(BLANK)), r"[ \t\r\x0b\x0c]+", -1)).alias("words"))
    places = lines.select("id", "pos", "at")
    array = SuffixArray(lines.drop("at"))
    found = places.join(later_copies(array, min_lines, min_words), ["id", "pos"]).groupBy(F.col("id").alias(own2)).agg(F.sort_array(F.collect_list("at")).alias(gone))
    joined = docs.join(found.hint("shuffle_hash"), F.col(own) == F.col(own2), "left").withColumn(split, F.split(F.col(f"`{text}`"), "\n", -1))
    removed = F.coalesce(gone, F.array().cast("array<int>"))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), removed), lambda i: F.get(F.col(split), i)), "\n")
    kept = F.when(F.btrim(kept, F.lit(BLANK + "\n")) == "", "").otherwise(kept)
    counted = []
    if runs:
        run_id, n, longest = (spare([*columns, own, own2, gone, split], x) for x in ("__run_id", "__runs", "__longest"))
        per = maximal_runs(array, min_lines).groupBy(F.col("id").alias(run_id)).agg(F.count("*").alias(n), F.max("lines").cast("long").alias(longest))
        joined = joined.join(per.hint("shuffle_hash"), F.col(own) == F.col(run_id), "left")
        counted = [F.coalesce(n, F.lit(0)).cast("long").alias("n_runs"), F.coalesce(longest, F.lit(0)).cast("long").alias("longest_run")]
    return joined.select(
        *[(F.when(F.col(gone).isNull(), F.col(f"`{c}`")).otherwise(kept).alias(c) if c == text else F.col(f"`{c}`")) for c in columns],
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
        removed.alias("removed"),
        *counted,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of repeated line runs, and its maximal repeated runs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, runs=True)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "n_runs", "longest_run", F.sha2("text", 256).alias("kept_sha256"))


_BLANK = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
#: The same by windows of two lines, single lines of 50 words, and common runs on the diagonals of all pairs of equal lines.
ORACLE = rf"""
with l as (
  select doc_id, i - 1 as ln, x, row_number() over (partition by doc_id order by i) - 1 as pos,
         len(regexp_split_to_array(trim(x, {_BLANK}), '[ \t\r\x0b\x0c]+')) as words
  from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
  where trim(x, {_BLANK}) != ''),
w as (select doc_id, ln, pos, x, words, lead(x) over (partition by doc_id order by pos) as y from l),
r as (
  select *, y is not null and row_number() over (partition by x, y order by doc_id, pos) > 1 as pair_later,
         words >= 50 and row_number() over (partition by x order by doc_id, pos) > 1 as line_later from w),
g as (select *, line_later or pair_later or coalesce(lag(pair_later) over (partition by doc_id order by pos), false) as gone from r),
n as (select doc_id, count(*) filter (gone) as n_removed, list(ln) filter (gone) as ats from g group by doc_id),
h as (select doc_id, pos, hash(x, y) as h from w where y is not null),
p as (select a.doc_id as d, a.pos as i, b.doc_id as e, a.pos - b.pos as shift from h a join h b on a.h = b.h and (a.doc_id != b.doc_id or a.pos != b.pos)),
t as (select d, min(i) as a, max(i) + 2 as b from (select *, i - row_number() over (partition by d, e, shift order by i) as island from p) group by d, e, shift, island),
u as (select d, a, max(b) as b from t group by d, a),
m as (select d, a, b, max(b) over (partition by d order by a rows between unbounded preceding and 1 preceding) as reach from u),
c as (select d as doc_id, count(*) as n_runs, max(b - a) as longest_run from m where reach is null or b > reach group by d),
k as (
  select d.doc_id, len(string_split(text, chr(10))) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(n_runs, 0) as n_runs, coalesce(longest_run, 0) as longest_run,
         case when coalesce(n_removed, 0) = 0 then text else
           array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: not list_contains(ats, i - 1)), chr(10)) end as kept
  from documents d left join n using (doc_id) left join c using (doc_id))
select doc_id, n_lines::bigint as n_lines, n_removed::bigint as n_removed, n_runs::bigint as n_runs, longest_run::bigint as longest_run,
       sha256(case when n_removed > 0 and trim(kept, {_BLANK} || chr(10)) = '' then '' else kept end) as kept_sha256
from k"""
