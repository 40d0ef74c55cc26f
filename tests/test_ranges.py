"""The byte range source: every line and entry once, whatever the ranges."""

import re

import pytest
from pyspark.sql import functions as F

from waybill.functions.logtext import STAMP
from waybill.operators import levels
from waybill.sources import ranges, sinks, tables

HEAD = "17/03/29 10:04:4{} {} a.B: {}"
FILES = {
    "application_3_0001/container_3_0001_01_000001.log": "\n".join(
        ["ahead of all heads", "\tand more"] + [x for i in range(40) for x in (HEAD.format(i % 10, "INFO", "x" * (i % 7)), *["\tat é WARN"] * (i % 4))]
    ) + "\n",
    "application_3_0001/no_end.log": HEAD.format(1, "ERROR", "last") + "\n\tat the end",
    "application_3_0002/windows.log": HEAD.format(2, "WARN", "one") + "\r\n\r\n two\r\n",
    "application_3_0002/no_heads.log": "a\n\nb\n" * 20,
    "application_3_0002/long.log": HEAD.format(3, "DEBUG", "y" * 900) + "\n" + "z" * 700 + "\n" + HEAD.format(4, "no level", "") + "\n",
    "application_3_0003/empty.log": "",
    "application_3_0003/blank.log": "\n",
    "_hidden/x.log": "not read\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("ranges")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    (root / "application_3_0003" / "bytes.log").write_bytes(b"ok\n\xff\xfe bad INFO\n")
    return root


def plain():
    """Lines and entries of all files, line by line."""
    out = []
    for name, text in {**FILES, "application_3_0003/bytes.log": "ok\n\ufffd\ufffd bad INFO\n"}.items():
        if name.startswith("_"):
            continue
        at, head = 0, (None, None, None)
        for raw in text.split("\n")[: -1 if text.endswith("\n") else None] if text else []:
            line = raw.removesuffix("\r")
            m = re.match(STAMP, line)
            if m:
                level = re.search("INFO|WARN|ERROR|DEBUG", line)
                head = at, m[1], level[0] if level else ""
            out.append((line, name.split("/")[1], at, m is None, *head))
            at += len(raw.encode()) + 1
    return sorted(out, key=lambda r: r[1:3])


def rows_of(df):
    name = F.substring_index("file_path", "/", -1).alias("file_path")
    rest = [c for c in df.columns if c not in ("value", "file_path")]
    return sorted((tuple(r) for r in df.select("value", name, *rest).collect()), key=lambda r: r[1:3])


@pytest.mark.parametrize("range_bytes, block_bytes", [(0, 1 << 20), (64, 16), (57, 1), (300, 1000), (1000, 64)])
def test_any_ranges_give_the_same(spark, tree, range_bytes, block_bytes):
    want = plain()
    assert rows_of(ranges.scan_placed_lines(spark, str(tree), range_bytes, block_bytes)) == [r[:3] for r in want]
    assert rows_of(ranges.scan_entries(spark, str(tree), range_bytes, block_bytes)) == want


def test_paths_are_spelled_as_in_a_scan(spark, tree):
    from waybill.sources.text import scan_log_tree

    names = lambda df: {r[0] for r in df.select("file_path").distinct().collect()}
    assert names(ranges.scan_placed_lines(spark, str(tree))) == names(scan_log_tree(spark, str(tree)))
    assert names(ranges.scan_placed_lines(spark, f"file://{tree}")) == names(scan_log_tree(spark, str(tree)))


def test_one_file_no_files_and_no_folder(spark, tree, tmp_path):
    one = f"{tree}/application_3_0002/windows.log"
    assert [r[0] for r in rows_of(ranges.scan_placed_lines(spark, one))] == [HEAD.format(2, "WARN", "one"), "", " two"]
    assert ranges.scan_placed_lines(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="no_such"):
        ranges.scan_placed_lines(spark, f"{tmp_path}/no_such").count()


def test_sample_is_the_same_for_any_split_and_fair(spark, tree):
    whole, cut = (ranges.scan_placed_lines(spark, str(tree), n, 64) for n in (0, 100))
    first = levels.sample_log_entries(whole, 8).collect()
    assert first == levels.sample_log_entries(cut, 8).collect() and len(first) == 8
    # one line in three is a warning, and equal lines are lines of their own
    places = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "same WARN").otherwise("same INFO").alias("value"), F.lit("f").alias("file_path"), F.col("id").alias("line_start")
    )
    drawn = [r["log_level"] for r in levels.sample_log_entries(places, 600).collect()]
    assert 150 < drawn.count("WARN") < 250


def test_counts_and_sample_from_one_pass(spark, tree):
    lines = ranges.scan_placed_lines(spark, str(tree), 100, 64)
    frame, sample = levels.levels_and_sample(lines, 8)
    assert sample.collect() == levels.sample_log_entries(lines, 8).collect()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(frame) == key(levels.level_frame(lines))
    nothing = spark.createDataFrame([], "value string, file_path string, line_start long")
    assert [f.count() for f in levels.levels_and_sample(nothing)] == [0, 0]


def test_the_pass_has_no_shuffle(spark, tree):
    lines = ranges.scan_placed_lines(spark, str(tree))
    p = levels.sample_log_entries(lines)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in p and "Exchange" not in p and p.count("BatchScan") == 1


def test_metrics_come_with_the_rows_written(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") < 30, "a").alias("x"))
    got = sinks.write_csv_counted(df, f"{tmp_path}/t", n=F.count("*"), n_x=F.count("x"), top=F.max("id"))
    assert got == {"n": 100, "n_x": 30, "top": 99}
    assert tables.scan_csv(spark, f"{tmp_path}/t", "id long, x string").count() == 100
