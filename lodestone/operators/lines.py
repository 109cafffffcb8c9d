"""Operators over the lines of files in order: scopes, proximity, sections.

Lines that are rows are ordered by windows. Where whole files are at hand, ``by_file`` works through each
file's text where it is read: nothing is shuffled or sorted, and a task holds one batch of files.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _w():
    return Window.partitionBy("file_id").orderBy("line")


#: Lines in a batch that a task gives back.
BATCH = 20_000


def by_file(files: DataFrame, of, result: str) -> DataFrame:
    """``files(file_id, text)`` -> ``(file_id, line, result)``; ``of(lines)`` gives a value (``result`` names it with its type) for each line of a text."""
    name, kind = result.split()

    def run(batches):
        for b in batches:
            ids, numbers, values = [], [], []
            for place, text in enumerate(b.column(1).to_pylist()):
                if text is None:
                    continue
                found = of(text.split("\n"))
                ids += [place] * len(found)
                numbers += range(1, len(found) + 1)
                values += found
                if len(ids) >= BATCH:
                    yield from told(b, ids, numbers, values)
                    ids, numbers, values = [], [], []
            yield from told(b, ids, numbers, values)

    def told(b, ids, numbers, values):
        for i in range(0, len(ids), BATCH):
            part = slice(i, i + BATCH)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids[part])), pa.array(numbers[part], pa.int32()), pa.array(values[part], {"long": pa.int64(), "boolean": pa.bool_()}[kind])], names=["file_id", "line", name])

    return files.select("file_id", "text").mapInArrow(run, f"file_id {files.schema['file_id'].dataType.simpleString()}, line int, {result}")


def depths(lines: list[str], opening: str = "{", closing: str = "}") -> list[int]:
    """``brace_depth`` of each line of a file."""
    total = low = 0
    out = []
    for x in lines:
        total += x.count(opening) - x.count(closing)
        low = min(low, total)
        out.append(total - low)
    return out


def within(flags: list[bool], distance: int = 5) -> list[bool]:
    """Whether a flag holds within ``distance`` places, by the last one before and the next one after."""
    far = len(flags) + distance + 1
    before, last = [], -far
    for i, f in enumerate(flags):
        last = i if f else last
        before.append(i - last <= distance)
    last = 2 * far
    for i in range(len(flags) - 1, -1, -1):
        last = i if flags[i] else last
        before[i] = before[i] or last - i <= distance
    return before


def brace_depth(lines: DataFrame, opening: str = "{", closing: str = "}") -> DataFrame:
    """``depth`` after each line: opening minus closing signs, never below 0 at the end of a line."""
    count = lambda s: F.char_length("content") - F.char_length(F.replace(F.col("content"), F.lit(s), F.lit("")))
    summed = lines.withColumn("net", count(opening) - count(closing)).withColumn("total", F.sum("net").over(_w().rowsBetween(Window.unboundedPreceding, 0)))
    low = F.least(F.lit(0), F.min("total").over(_w().rowsBetween(Window.unboundedPreceding, 0)))
    return summed.withColumn("depth", (F.col("total") - low).cast("long")).drop("net", "total")


def near(lines: DataFrame, flag, distance: int = 5) -> DataFrame:
    """``near``: whether ``flag`` holds within ``distance`` lines."""
    return lines.withColumn("near", F.coalesce(F.max(F.coalesce(flag, F.lit(False))).over(_w().rowsBetween(-distance, distance)), F.lit(False)))


def suppressed(lines: DataFrame, marker: str) -> DataFrame:
    """``suppressed``: the marker is in the line or in the one before."""
    own = F.contains("content", F.lit(marker))
    return lines.withColumn("suppressed", own | F.coalesce(F.lag(own).over(_w()), F.lit(False)))


def sections(lines: DataFrame) -> DataFrame:
    """``section``: the last ``[header]`` at or above the line."""
    header = F.nullif(F.regexp_extract("content", r"^\s*\[+([^\[\]]+)\]+\s*$", 1), F.lit(""))
    return lines.withColumn("section", F.last(header, ignorenulls=True).over(_w().rowsBetween(Window.unboundedPreceding, 0)))


def indent(content) -> F.Column:
    """Width of the leading white space, a tab counting 4."""
    lead = F.regexp_extract(content, r"^([ \t]*)", 1)
    return F.char_length(lead) + 3 * (F.char_length(lead) - F.char_length(F.replace(lead, F.lit("\t"), F.lit(""))))


def debt(lines: DataFrame, keywords=("TODO", "FIXME", "HACK", "XXX", "WORKAROUND", "TEMP"), old_days: int = 180) -> DataFrame:
    """Debt marks in comments, ``(file_id, line, keyword)``; TODO and XXX only when ``age_days`` (null: unknown) reaches ``old_days``."""
    found = F.upper(F.regexp_extract("content", rf"(?i)(?:#|//|/\*|--|<!--).*?\b({'|'.join(keywords)})\b", 1))
    hits = lines.withColumn("keyword", found).where("keyword <> ''")
    return hits.where(~F.col("keyword").isin("TODO", "XXX") | (F.col("age_days") >= old_days)).select("file_id", "line", "keyword")
