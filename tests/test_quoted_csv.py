"""Quoted CSV cut into ranges, against the reader that takes a file whole."""

import csv
import random

import pytest

from threadloom.sources import quoted, readers

SCHEMA = "id long, a string, b string, n double"
KEYS = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in KEYS}
    spark.conf.set(KEYS[0], "2000b"), spark.conf.set(KEYS[1], "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def whole(spark, path):
    return spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def text(rng):
    return "".join(rng.choice(["x", "word ", '"', '""', ",", "\n", "\n\n", "é", ",\n", "日本"]) for _ in range(rng.choice([0, 1, 5, 40, 400])))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_are_those_of_the_whole_file_reader(spark, small_ranges, tmp_path, end):
    rng = random.Random(7)
    for part in range(3):
        with open(tmp_path / f"p{part}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerow(["id", "a", "b", "n"])
            for i in range(60):
                out.writerow([part * 1000 + i, text(rng), text(rng), rng.choice(["", "1.5", "-2"])])
    got = readers.read_tweets_csv(spark, str(tmp_path), SCHEMA)
    assert quoted._lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 10
    assert got.count() == 180 and as_rows(got) == as_rows(whole(spark, str(tmp_path)))


def test_record_over_many_ranges_and_edges(spark, small_ranges, tmp_path):
    long = "line\n" * 1500 + 'said "so",\n'
    body = "id,a,b,n\n" + f'1,"{long.replace(chr(34), chr(34) * 2)}",,2\n' + "\n" + '2,"","x",oops\n' + '3,"last\none",y,4'
    (tmp_path / "one.csv").write_text(body)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("id,a,b,n\n")
    got = as_rows(readers.read_tweets_csv(spark, str(tmp_path), SCHEMA))
    assert got == as_rows(whole(spark, str(tmp_path)))
    assert [r[0] for r in got] == [1, 2, 3] and got[0][1] == long and got[1][3] is None


def test_a_new_cut_in_the_second_pass_is_an_error(spark, tmp_path):
    (tmp_path / "one.csv").write_text("id,a,b,n\n1,x,y,2\n")
    lines = quoted._lines(spark, str(tmp_path))
    with pytest.raises(Exception, match="only in the second pass"):
        lines.mapInPandas(quoted._pieces({}), quoted.PIECES).collect()
