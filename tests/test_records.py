"""CSV records over line breaks against a reader that goes character by character, and against pandas."""

import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsieve.sources.csv_flows import scan_csv_dir
from flowsieve.sources.records import csv_records, opens, stays

CELLS = ["a", "", "7.5", '"x, y"', '"two\nlines"', '"quote "" inside"', '"\n\n"', '"""at both ends"""', 'stray" quote', "5'", '""', '"a\r\nb"', '"end\n"', "é", '"long ' + "word\n" * 9 + '"']


def content(rng, n):
    rows = [",".join(rng.choice(CELLS) for _ in range(3)) for _ in range(n)]
    return "k,l,m\n" + "\n".join(r if r != ",," else ",,z" for r in rows) + "\n"


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def plain_states(line, inside, escape):
    """Whether a line ends inside quotes, character by character."""
    begin, i = not inside, 0
    while i < len(line):
        c = line[i]
        if inside:
            if escape == "\\" and c == "\\" and i + 1 < len(line):
                i += 1
            elif c == '"' and line[i + 1 : i + 2] == '"':
                i += 1
            elif c == '"':
                inside, begin = False, False
        elif c == '"' and begin:
            inside, begin = True, False
        else:
            begin = c == ","
        i += 1
    return inside


@pytest.mark.parametrize("escape", ['"', "\\"])
def test_line_functions(spark, escape):
    rng = random.Random(3)
    lines = ["".join(rng.choice('",ab" \\') for _ in range(rng.randint(0, 14))) for _ in range(3_000)]
    df = spark.createDataFrame([(x,) for x in lines], "s string")
    for r in df.select("s", opens(F.col("s"), escape).alias("o"), stays(F.col("s"), escape).alias("t")).collect():
        assert (r.o, r.t) == (plain_states(r.s, False, escape), plain_states(r.s, True, escape)), r.s


@pytest.mark.parametrize("seed", range(4))
def test_files_with_breaks_equal_pandas(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    frames = []
    for i in range(4):
        text = content(rng, rng.choice([1, 5, 60]))
        text = text.replace("\nk", "\n\nk") if i == 2 else text
        (tmp_path / f"part {i}.csv").write_text(text, newline="")
        frames.append(pd.read_csv(io.StringIO(text, newline=""), dtype=str, keep_default_na=False))
    want = [tuple(x or None for x in row) for f in frames for row in f.itertuples(index=False)]
    got = sorted((tuple(r[c] or None for c in "klm") for r in scan_csv_dir(spark, str(tmp_path), '"').good.collect()), key=str)
    assert got == sorted(want, key=str)


def test_long_records_rejects_and_quotes_that_nothing_closes(spark, tmp_path, small_blocks):
    (tmp_path / "long.csv").write_text('\r\nk,l,m\r\n1,"' + "line\n" * 300 + '",2\r\n\r\n3,"a\nb",4,5\r\n6,7,8\r\n')
    (tmp_path / "open.csv").write_text('k,l,m\n1,"a\nb",2\n3,"never closed,4\n5,6,7\n8,9,10\n')
    parsed = scan_csv_dir(spark, str(tmp_path), '"')
    got = {tuple(r) for r in parsed.good.collect()}
    assert {("1", "line\n" * 300, "2"), ("6", "7", "8"), ("1", "a\nb", "2"), ("5", "6", "7"), ("8", "9", "10")} <= got
    assert len(got) == 6 and sum(r[0] == "3" for r in got) == 1
    assert [r.line for r in parsed.rejected.collect()] == ['3,"a\nb",4,5']
    records = csv_records(spark, [str(tmp_path / "open.csv")], '"').collect()
    assert sorted(r.record for r in records) == ['1,"a\nb",2', '3,"never closed,4', "5,6,7", "8,9,10"]


def test_backslash_dialect(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,l\n1,"say \\"hi\\"\nand, go"\n2,"c:\\\\"\n')
    assert sorted(tuple(r) for r in scan_csv_dir(spark, str(tmp_path)).good.collect()) == [("1", 'say "hi"\nand, go'), ("2", "c:\\")]
