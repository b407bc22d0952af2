r"""Records of CSV files whose quoted fields hold line breaks, read by lines from files that stay split.

Whether a line begins inside a quoted field depends on all lines before it. A line is therefore a function from
"outside" or "inside" before it to the same after it: it keeps the state, swaps it, or ends in one whatever it was. Such
functions compose, so the lines of each file block are combined by a running window over the block, the blocks of a file
by a window over their few rows, and every line then knows the state it begins in. Lines of one record share the number
of its first line and are put together by it, across blocks if need be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _inside(escape: str) -> str:
    """Text inside quotes, as a pattern that never gives back."""
    return r'(?:[^"]|"")*+' if escape == '"' else r'(?:[^"\\]|\\.|"")*+'


def opens(line: Column, escape: str) -> Column:
    """Whether a line that begins outside quotes ends inside: its last field opens with a quote that nothing closes."""
    text = _inside(escape)
    field = rf'(?:"{text}"[^,]*+|[^",][^,]*+|)'
    return line.contains('"') & line.rlike(rf'(?s)^(?>{field},)*+"{text}\\?$')


def stays(line: Column, escape: str) -> Column:
    """Whether a line that begins inside quotes ends inside."""
    text = _inside(escape)
    rest = F.regexp_replace(line, rf'(?s)^{text}"[^,]*+,?', "")
    return ~line.contains('"') | line.rlike(rf"(?s)^{text}\\?$") | ((rest != line) & opens(rest, escape))


def text_lines(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, block, no, value): the lines of files, with the file block each begins in; ``no`` ascends within a block."""
    reader = spark.read.option("lineSep", "\n")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    block = F.col("_metadata.file_block_start")
    return reader.text(paths).select(path.alias("path"), block.alias("block"), F.monotonically_increasing_id().alias("no"), "value")


def csv_records(spark: SparkSession, paths: list[str], escape: str = "\\") -> DataFrame:
    """(path, record): the records of CSV files without their header line and without blank ones.

    A quote opens a field only where the field begins; ``escape`` is what stands before a quote inside quotes. A quote
    that the rest of its file never closes ends with its own line, and the lines after it are read by themselves.
    """
    lines = text_lines(spark, paths)
    line = F.regexp_replace("value", "\r$", "")
    lines = lines.withColumns({"swaps": opens(line, escape), "same": stays(line, escape)})
    # opens and stays: inside afterwards; neither: outside afterwards; opens but does not stay: swapped
    fixed = F.when(F.col("swaps") == F.col("same"), F.col("swaps").cast("int"))
    swap = (F.col("swaps") & ~F.col("same")).cast("int")
    lines = lines.select("path", "block", "no", "value", fixed.alias("fixed"), swap.alias("swap"))

    here = W.partitionBy("path", "block").orderBy("no")
    upto, before = here.rowsBetween(W.unboundedPreceding, 0), here.rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumn("turns", F.sum("swap").over(upto))
    reset = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns"))
    known = F.last(reset, ignorenulls=True)
    lines = lines.withColumns({"reset": known.over(before), "turned": F.coalesce(F.lag("turns").over(here), F.lit(0)), "reset_after": known.over(upto)})

    first = F.min(F.when(F.trim(line) != "", F.col("no")))
    ends = lines.groupBy("path", "block").agg(F.max_by(F.struct("reset_after", "turns"), "no").alias("e"), first.alias("head"))
    ends = ends.select("path", "block", "head", F.col("e.reset_after").alias("reset_after"), F.col("e.turns").alias("turns"))
    fixed_end = F.pmod(F.col("reset_after.fixed") + F.col("turns") - F.col("reset_after.turns"), F.lit(2))
    along = W.partitionBy("path").orderBy("block")
    ends = ends.withColumns({"all_turns": F.sum("turns").over(along.rowsBetween(W.unboundedPreceding, 0)), "end": fixed_end})
    mark = F.last(F.when(F.col("end").isNotNull(), F.struct("end", "all_turns")), ignorenulls=True)
    whole = W.partitionBy("path")
    state = lambda m, turns: F.pmod(F.coalesce(m["end"], F.lit(0)) + turns - F.coalesce(m["all_turns"], F.lit(0)), F.lit(2))
    ends = ends.withColumns({"now": mark.over(along.rowsBetween(W.unboundedPreceding, 0)), "was": mark.over(along.rowsBetween(W.unboundedPreceding, -1))})
    ends = ends.withColumns(
        {
            "begin": state(F.col("was"), F.col("all_turns") - F.col("turns")),
            "left": F.last(state(F.col("now"), F.col("all_turns"))).over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
            "header": F.min_by("head", F.when(F.col("head").isNotNull(), F.col("block"))).over(whole),
        }
    ).select(F.col("path").alias("path__"), F.col("block").alias("block__"), "begin", "left", "header")

    placed = lines.join(ends, (F.col("path") == F.col("path__")) & (F.col("block") == F.col("block__")))
    start = F.coalesce(F.col("reset.fixed"), F.col("begin"))
    outside = F.pmod(start + F.col("turned") - F.coalesce(F.col("reset.turns"), F.lit(0)), F.lit(2)) == 0
    begun = F.when(outside, F.col("no"))
    placed = placed.select("path", "block", "no", "value", "left", "header", begun.alias("begun"), F.last(begun, ignorenulls=True).over(upto).alias("record"))
    # a record that a block only goes on with began in an earlier one
    last = placed.groupBy("path", "block").agg(F.max("begun").alias("last"))
    last = last.select(
        F.col("path").alias("path__"),
        F.col("block").alias("block__"),
        F.last("last", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("earlier"),
        F.last("last", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("final"),
    )
    named = placed.join(last, (F.col("path") == F.col("path__")) & (F.col("block") == F.col("block__")))
    record = F.coalesce("record", "earlier")
    unclosed = (F.col("left") == 1) & (record == F.col("final"))
    named = named.withColumn("record", F.when(unclosed, F.col("no")).otherwise(record)).filter(F.col("record") != F.col("header"))
    parts = F.array_sort(F.collect_list(F.struct("block", "no", "value")))
    text = F.array_join(F.transform(parts, lambda p: p["value"]), "\n")
    records = named.groupBy("path", "record").agg(text.alias("text"))
    return records.select("path", F.regexp_replace("text", "\r$", "").alias("record")).filter(F.trim("record") != "")
