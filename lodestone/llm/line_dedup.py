"""Line dedup by prefix doubling over line-id sequences, in DataFrame operations only.

Every document is a sequence of line ids; all positions of all documents are suffixes. Prefix doubling
ranks suffixes by their first 1, 2, 4 ... lines: the rank for twice the length is the place of the pair
(own rank, rank of the suffix that many lines on) among all distinct pairs. The places come from a range
partitioning of the distinct pairs and a prefix sum of partition sizes, so nothing is sorted in one task
and a very common line costs one row. Suffixes of equal rank form an interval of the suffix array whose
longest common prefix has that length at least. Doubling stops at the shortest run that counts, as longer
prefixes only split intervals, and a suffix whose rank is unique is carried no further: every line of a later copy of a maximal run already lies in a window that
has an equal earlier one. Windows side by side with the same first copy make up the maximal runs.

What counts as a repeated run: ``min_lines`` lines, or fewer lines (one or two) of ``min_words`` words
together. Of equal runs all but the first, by doc_id and line, are deleted, as the input has them, and of a
run that overlaps its own first copy the lines behind that copy. Lines of a first copy that also lie in a
later copy of another run go with that: of ``A B C``, ``A B C D E``, ``C D E`` only ``A B C``, ``D E`` are left.

Defined results: lines without words are not part of the sequences and stay; a null text stays null, has
no lines and loses none; a null doc_id comes last in order; repeated rows are copies like any other; an
empty table gives an empty result; further columns are passed through by ``dedup`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

MIN_LINES, MIN_WORDS = 3, 50


def _words(line) -> F.Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def suffixes(rows: DataFrame) -> DataFrame:
    """``rows(uid, doc, text)`` -> ``(uid, doc, pos, i, r, words)``: ``i`` is the place in the sequence, ``r`` the first rank (the line's id)."""
    line = F.transform(F.split("text", "\n", -1), lambda x, n: F.struct(n.alias("pos"), F.xxhash64(x).alias("r"), _words(x).alias("words")))
    used = rows.select("uid", "doc", F.posexplode(F.filter(line, lambda x: x["words"] > 0)).alias("i", "x"))
    return used.select("uid", "doc", "x.pos", (F.col("i") + 1).alias("i"), "x.r", "x.words")


def dense(pairs: DataFrame) -> DataFrame:
    """``(r, s)`` -> ``(r, s, rank)`` of pairs that occur repeatedly: their place in order, found without a global sort in one task."""
    several = pairs.groupBy("r", "s").agg(F.count("*").alias("n")).where("n > 1").select("r", "s")
    dealt = shared.save(several.repartitionByRange("r", "s").withColumn("part", F.spark_partition_id()), "pairs")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("r", "s"))
    return dealt.withColumn("inside", inside).join(offsets.select("part", "before"), "part").select("r", "s", (F.col("before") + F.col("inside")).alias("rank"))


def extend(table: DataFrame, step: int) -> DataFrame:
    """``table`` ranked by ``r`` over some lines -> ranked over ``step`` lines more; suffixes unique by then, or too short, are left out.

    A repeated run begins, at every line of its first ``step``, with a repeated shorter one, so the row
    ``step`` rows on is the suffix ``step`` lines on or the longer run is unique.
    """
    w = Window.partitionBy("uid").orderBy("i")
    ahead = table.withColumn("s", F.lead("r", step).over(w)).withColumn("at", F.lead("i", step).over(w))
    if step == 1:
        ahead = ahead.withColumn("w2", F.col("words") + F.lead("words", 1).over(w))
    paired = shared.save(ahead.where(F.col("at") == F.col("i") + step).drop("at"), "paired")
    return paired.join(dense(paired.select("r", "s")), ["r", "s"]).drop("r", "s").withColumnRenamed("rank", "r")


def ranks(table: DataFrame, length: int) -> list[tuple[int, DataFrame]]:
    """Repeated suffixes ranked by one line, by two and, by doubling, by ``length`` lines."""
    several = table.groupBy("r").agg(F.count("*").alias("n")).where("n > 1").select("r")
    one = shared.save(table.join(several, "r", "left_semi"), "ranks")
    two = cur = shared.save(extend(one, 1), "ranks")
    have = 2
    while have < length:
        step = min(have, length - have)
        cur = shared.save(extend(cur, step), "ranks")
        have += step
    return [(1, one), (2, two), (have, cur)]


def _first(windows: DataFrame) -> DataFrame:
    """``windows(k, place, ...)`` -> those with an earlier equal one, and that one's place as ``first``."""
    least = windows.groupBy("k").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("k", "first")
    return windows.join(least, "k").where("place <> first")


def later_windows(rows: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``(uid, i, length, first)``: windows of lines that repeat an earlier one."""
    levels = ranks(suffixes(rows), max(min_lines, 2))
    out = None
    for (length, t), where in zip(levels, (f"words >= {min_words}", f"w2 >= {min_words}", "true"), strict=True):
        place = F.struct(F.col("doc").isNull().alias("none"), "doc", "uid", "i").alias("place")
        got = _first(t.where(where).select(F.col("r").alias("k"), place, "uid", "i")).select("uid", "i", F.lit(length).alias("length"), F.struct(F.col("first.uid").alias("uid"), F.col("first.i").alias("i")).alias("first"))
        out = got if out is None else out.unionByName(got)
    return shared.save(out, "later"), levels[0][1]


def runs(later: DataFrame) -> DataFrame:
    """Maximal repeated runs: ``(uid, i, lines, first_uid, first_i, gone)``, windows side by side at one distance from their first copies merged.

    ``gone`` is the first line to delete: ``i``, or, where a run overlaps its own first copy (a line or a
    few lines repeated over and over), the first line behind that copy, which stays whole.
    """
    w = Window.partitionBy("uid", "first.uid", F.col("i") - F.col("first.i")).orderBy("i", "length")
    reach = F.max(F.col("i") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("new", F.coalesce((F.col("i") > reach).cast("int"), F.lit(1)))
    named = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = named.groupBy("uid", F.col("first.uid").alias("first_uid"), (F.col("i") - F.col("first.i")).alias("apart"), "run")
    own = F.when(F.col("uid") == F.col("first_uid"), F.greatest("i", F.col("end") - F.col("apart"))).otherwise(F.col("i"))
    return g.agg(F.min("i").alias("i"), F.max(F.col("i") + F.col("length")).alias("end")).select("uid", "i", (F.col("end") - F.col("i")).alias("lines"), "first_uid", (F.col("i") - F.col("apart")).alias("first_i"), own.alias("gone"))


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies deleted from their texts, and ``lines_removed`` (in place of a column of that name)."""
    uid, gone_at, parts_at = (shared.free(docs, c) for c in ("uid", "gone", "parts"))
    kept = shared.save(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    rows = kept.select(F.col(uid).alias("uid"), F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    later, t = later_windows(rows, min_lines, min_words)
    gone = runs(later).select("uid", F.explode(F.sequence(F.col("gone"), F.col("i") + F.col("lines") - 1)).alias("i")).distinct()
    places = t.select("uid", "i", "pos").join(gone, ["uid", "i"]).groupBy(F.col("uid").alias(uid)).agg(F.sort_array(F.collect_list("pos")).alias(gone_at))
    got = kept.drop("lines_removed").join(places, uid, "left")
    # the lines between one deleted line and the next, so that the work stays in proportion to the text
    split = F.split(F.col(text_col), "\n", -1)
    bounds, ends = F.concat(F.array(F.lit(-1)), F.col(gone_at)), F.concat(F.col(gone_at), F.array(F.size(parts_at)))
    pieces = F.zip_with(bounds, ends, lambda a, b: F.slice(F.col(parts_at), a + 2, b - a - 1))
    out = got.withColumn(parts_at, F.when(F.col(gone_at).isNotNull(), split))
    text = F.when(F.col(gone_at).isNull(), F.col(text_col)).otherwise(F.array_join(F.flatten(pieces), "\n"))
    return out.withColumn(text_col, text).withColumn("lines_removed", F.when(F.col(gone_at).isNotNull(), F.size(gone_at)).otherwise(0).cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns if c != "lines_removed"], "lines_removed")


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` after line dedup: digest of the text left and the lines removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs.select("doc_id", "text")).select("doc_id", "lines_removed", F.char_length("text").cast("long").alias("chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE = r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
used as (
  select doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words,
         row_number() over (partition by doc_id order by pos) as i
  from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
w as (
  select *, lead(line, 1) over d as l2, lead(line, 2) over d as l3, words + lead(words, 1) over d as w2
  from used window d as (partition by doc_id order by i)),
wins as (
  select doc_id, i, 1 as n, md5(line) as k from w where words >= 50
  union all select doc_id, i, 2, md5(line || chr(10) || l2) from w where w2 >= 50
  union all select doc_id, i, 3, md5(line || chr(10) || l2 || chr(10) || l3) from w where l3 is not null),
later as (
  select * from (select doc_id, i, n, first_value(doc_id) over o as fd, first_value(i) over o as fi, row_number() over o as nth from wins window o as (partition by n, k order by doc_id, i)) where nth > 1),
joined as (select *, coalesce(i > max(i + n) over (partition by doc_id, fd, i - fi order by i, n rows between unbounded preceding and 1 preceding), true) as new from later),
named as (select *, sum(new::int) over (partition by doc_id, fd, i - fi order by i, n rows unbounded preceding) as run from joined),
runs as (select doc_id, fd, i - fi as apart, min(i) as i, max(i + n) as stop from named group by doc_id, fd, i - fi, run),
gone as (select distinct doc_id, unnest(range(case when doc_id = fd then greatest(i, stop - apart) else i end, stop)) as i from runs),
marked as (
  select l.doc_id, l.pos, l.line, g.i is not null as removed
  from lines l left join used u on u.doc_id = l.doc_id and u.pos = l.pos left join gone g on g.doc_id = u.doc_id and g.i = u.i),
done as (
  select doc_id, count(*) filter (where removed) as lines_removed,
         coalesce(string_agg(line, chr(10) order by pos) filter (where not removed), '') as text
  from marked group by doc_id)
select d.doc_id, coalesce(x.lines_removed, 0) as lines_removed, length(x.text) as chars_left, md5(x.text) as text_md5
from documents d left join done x on x.doc_id = d.doc_id
"""
