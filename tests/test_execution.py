"""Interval unions and message templates against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from waybill.operators import execution, tasks, templates

ZERO = datetime.datetime(2021, 5, 1)


def plain(spans):
    """Second by second."""
    spans = [(a, b) for a, b in spans if a is not None and b is not None and b >= a]
    if not spans:
        return None
    first, last = min(a for a, _ in spans), max(b for _, b in spans)
    running = [sum(a <= s < b for a, b in spans) for s in range(first, last + 1)]
    marks = sorted({x for span in spans for x in span})
    gaps = [b - a for a, b in zip(marks, marks[1:]) if not running[a - first]]
    busy = sum(n > 0 for n in running[:-1])
    return first, last, len(spans), busy, last - first - busy, max(gaps, default=0), max(running)


def union_of(spark, spans, width):
    at = lambda s: None if s is None else ZERO + datetime.timedelta(seconds=s)
    df = spark.createDataFrame([(g, at(a), at(b)) for g, a, b in spans], "g string, a timestamp_ntz, b timestamp_ntz").repartition(3)
    seconds = lambda t: int((t - ZERO).total_seconds())
    return {
        r["g"]: (seconds(r["first_start"]), seconds(r["last_end"]), *r[3:]) for r in execution.interval_union(df, ["g"], "a", "b", width).collect()
    }


@pytest.mark.parametrize("width", [7, 100, 86400])
def test_union_of_intervals(spark, width):
    rng = random.Random(width)
    spans = []
    for g in range(25):
        for _ in range(rng.randrange(1, 12)):
            a = rng.randrange(400)
            spans.append((f"g{g}", a, rng.choice([a, a + rng.randrange(1, 30), a + rng.randrange(1, 90), a - 3, None])))
    got = union_of(spark, spans, width)
    for g in {s[0] for s in spans}:
        assert got.get(g) == plain([s[1:] for s in spans if s[0] == g]), g


def test_hot_group_is_cut_into_buckets(spark):
    spans = [("hot", 10 * i, 10 * i + 4) for i in range(3000)]
    assert union_of(spark, spans, 500) == {"hot": (0, 29994, 3000, 12000, 17994, 6, 1)}


def test_no_spans(spark):
    assert union_of(spark, [("x", None, None)], 60) == {} and union_of(spark, [], 60) == {}


def messages(spark, rows):
    return spark.createDataFrame(rows, "component string, message string").repartition(3)


def test_templates(spark):
    rows = [("a", f" lost block {i} of node-{i % 3} now") for i in range(50)]
    rows += [("a", f"user {chr(97 + i)}{chr(97 + i)} left") for i in range(12)]  # twelve words at one place vary
    rows += [("b", f"user {chr(97 + i)}{chr(97 + i)} left") for i in range(8)]  # eight do not
    rows += [("a", "plain text"), ("a", "plain  text "), ("a", "")]
    got = {(r["component"], r["template"]): r["n"] for r in templates.message_templates(messages(spark, rows)).collect()}
    assert got == {
        ("a", "lost block <*> of <*> now"): 50, ("a", "user <*> left"): 12, **{("b", f"user {chr(97 + i)}{chr(97 + i)} left"): 1 for i in range(8)},
        ("a", "plain text"): 2, ("a", ""): 1,
    }
    assert templates.message_templates(messages(spark, [])).count() == 0


def test_templates_are_bounded(spark):
    words = spark.range(20_000).select(F.lit("c").alias("component"), F.concat_ws(
        " ", F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.when(F.col("id") % 2 == 0, "ends").otherwise("fails")
    ).alias("message"))
    assert {(r["template"], r["n"]) for r in templates.message_templates(words).collect()} == {("<*> ends", 10_000), ("<*> fails", 10_000)}


def test_broadcast_reads(spark):
    path = "file:/x/application_5_0001/container_5_0001_01_000002.log"
    lines = [f"17/02/03 21:41:08 INFO b.T: Started reading broadcast variable {v}" for v in ("7", "7", "8", "x")]
    df = spark.createDataFrame([(v, path) for v in lines], "value string, file_path string")
    assert [tuple(r) for r in tasks.broadcast_reads(df).collect()] == [("application_5_0001", 3, 2)]
