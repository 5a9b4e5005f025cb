import random
from collections import Counter

import pytest
from pyspark.sql import types as T

from tapewire.sources import quoted_csv as q

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType()), T.StructField("c", T.StringType())])


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k in keys:
        spark.conf.unset(k)


def cell(rng):
    kinds = ['"multi\nline, with ""quotes""\nand more"', '""', "", '5" wide', '"' + "long\n" * 250 + '"', '"x"', 'é"ü"', "plain", '"a,b"', '""""', '"\n"']
    return rng.choice(kinds)


def write(folder, files, rows, seed):
    rng = random.Random(seed)
    for f in range(files):
        end = "\r\n" if f % 2 else "\n"
        lines = ["a,b,c"]
        for i in range(rows):
            line = f"{cell(rng)},{i if rng.random() > 0.1 else 'none'},{cell(rng)}"
            line += ",extra" if rng.random() > 0.95 else ""
            lines += ["short"] if rng.random() < 0.03 else [line]
            lines += [""] if i % 50 == 0 else []
        with open(f"{folder}/f{f}.csv", "w", newline="", encoding="utf-8") as out:
            # a line break inside a field stays as it is; carriage returns end records only
            out.write(end.join(lines) + (end if f % 3 else ""))


def one_task(spark, path):
    options = dict(header=True, multiLine=True, escape='"', mode="DROPMALFORMED", enforceSchema=False)
    return Counter(map(tuple, spark.read.schema(SCHEMA).options(**options).csv(path).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_equal_the_reader_of_whole_files(small_ranges, tmp_path, seed):
    write(tmp_path, 3, 120, seed)
    spark, path = small_ranges, str(tmp_path)
    assert q._lines(spark, path).rdd.getNumPartitions() > 40
    want = one_task(spark, path)
    assert Counter(map(tuple, q.read_quoted(spark, path, SCHEMA).collect())) == want
    counts = q.malformed(spark, path, SCHEMA).first()
    assert counts.records == 360 and counts.records - counts.malformed == sum(want.values())
    bad = q.read_quoted(spark, path, SCHEMA, keep_malformed=True).where("_malformed IS NOT NULL").collect()
    assert len(bad) == counts.malformed and any("none" in r["_malformed"] for r in bad)


def test_a_field_longer_than_a_range(small_ranges, tmp_path):
    text = "line of text\n" * 400
    (tmp_path / "x.csv").write_text(f'a,b,c\n1st,1,"{text}"\n"{text}",2,end\n3rd,3,"{text}')  # the last one is never closed
    rows = q.read_quoted(small_ranges, str(tmp_path), SCHEMA).orderBy("b").collect()
    assert [tuple(r) for r in rows][:2] == [("1st", 1, text), (text, 2, "end")] and len(rows) == 3


def test_states_of_lines():
    assert not q.inside_after(b'a,"b"', False) and q.inside_after(b'a,"b', False) and q.inside_after(b'x ""', True)
    assert not q.inside_after(b'x",y', True) and q.inside_after(b'x","', True) and not q.inside_after(b'5" wide,b', False)
    assert not q.inside_after(b"", False) and q.inside_after(b"", True)


def test_header_of_other_names_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,c,b\n1,2,3\n")
    with pytest.raises(Exception, match="does not name"):
        q.read_quoted(spark, str(tmp_path), SCHEMA).collect()


def test_empty_file_and_header_alone(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    (tmp_path / "y.csv").write_text('"A", b,C\n')
    assert q.read_quoted(spark, str(tmp_path), SCHEMA).count() == 0
