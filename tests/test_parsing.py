"""Line and path grammar on hand-made lines."""

import datetime

import pytest
from pyspark.sql import functions as F

from waybill.functions import logtext, paths
from waybill.operators import records, tasks

T = "17/03/29 10:04:41"
LINES = {
    "normal": "17/02/03 21:39:58 INFO QueueMaster: Opened two queues",
    "python": "17/02/03 21:43:05 INFO python.PythonRunner: Times: total = 52, boot = -88, init = 131, finish = 9",
    "request": "17/02/03 21:40:12 INFO YarnAllocator: Will request 12 executor containers, "
               "each with 3 cores and 9216 MB memory including 1024 MB overhead",
    "start": "17/02/03 21:41:07 INFO executor.Executor: Running task 5.0 in stage 2.0 (TID 14)",
    "finish": "17/02/03 21:41:11 INFO executor.Executor: Finished task 5.0 in stage 2.0 (TID 14). "
              "1813 bytes result sent to driver",
    "failed": "17/02/03 21:41:12 ERROR executor.Executor: Exception in task 5.1 in stage 2.0 (TID 15)",
    "lost": "17/02/03 21:41:13 WARN scheduler.TaskSetManager: Lost task 5.1 in stage 2.0 (TID 15, n1, executor 2): x",
    "container": "17/02/03 21:40:13 INFO YarnAllocator: Container request (host: Any, capability: <memory:10240, vCores:3>)",
    "split": "17/02/03 21:41:08 INFO rdd.HadoopRDD: Input split: "
             "hdfs://192.168.7.2:8020/lake/trips/part-00017:73400320+524288",
    "block": f"{T} INFO storage.MemoryStore: Block broadcast_1 stored as bytes in memory "
             "(estimated size 4.1 KB, free 8.0 MB)",
    "capacity": f"{T} INFO storage.MemoryStore: MemoryStore started with capacity 1.5 GB",
    "trace": "\tat org.foo.INFORMATION",
    "inside": "17/03/29 10:04:43 TERRORIZE x",
    "bad date": "17/13/45 10:04:42 WARN a.B: bad date",
    "no colon": "17/03/29 11:00:00 WARN X.Y no colon",
    "empty": "",
    "indented": f" {T} INFO a.B: indented",
    "two": f"{T} WARN a.B: ERROR and INFO",
    "late": f"{T} the ERROR came before INFO",
    "joined": "17/03/29 10:04 WARNINFO: x",
    "null": None,
}
APP = "application_1485248649253_0052"
PATH = f"file:/logs/{APP}/container_1485248649253_0052_01_000001.log"


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(k, v, PATH) for k, v in LINES.items()]
    return spark.createDataFrame(rows, "name string, value string, file_path string")


def column(lines, expression):
    return {r["name"]: r["x"] for r in lines.select("name", expression.alias("x")).collect()}


def test_loose_level(lines):
    got = column(lines, logtext.log_level())
    assert got["normal"] == "INFO" and got["bad date"] == "WARN"
    assert got["trace"] == "INFO" and got["inside"] == "ERROR"
    assert got["two"] == "WARN" and got["late"] == "ERROR" and got["joined"] == "WARN"
    assert got["empty"] == "" and got["null"] is None


def test_loose_level_is_the_plain_regex(lines):
    plain = column(lines, F.regexp_extract("value", logtext.LEVEL, 1))
    assert column(lines, logtext.log_level()) == plain


def test_has_level_is_a_level(lines):
    level = column(lines, logtext.log_level())
    for name, got in column(lines, logtext.has_level()).items():
        assert got == (None if level[name] is None else level[name] != "")


def test_strict_level(lines):
    got = column(lines, logtext.log_level(mode="strict"))
    assert got["normal"] == "INFO" and got["no colon"] == "WARN"
    for name in ("trace", "inside", "late", "indented", "joined", "empty"):
        assert got[name] == ""
    with pytest.raises(ValueError):
        logtext.log_level(mode="other")


def test_timestamp(lines):
    text = column(lines, logtext.timestamp_text())
    assert text["normal"] == "17/02/03 21:39:58" and text["indented"] == "" and text["trace"] == ""
    at = column(lines, logtext.event_time())
    assert at["normal"] == datetime.datetime(2017, 2, 3, 21, 39, 58)
    assert text["bad date"] != "" and at["bad date"] is None
    assert at["empty"] is None and at["null"] is None


def test_parse_agrees_with_a_pattern_parse(spark):
    days = spark.sql("SELECT explode(sequence(date'2000-01-01', date'2099-12-31')) AS d")
    text = days.select(F.date_format("d", "yy/MM/dd 23:59:58").alias("t"))
    slow = F.try_to_timestamp("t", F.lit("yy/MM/dd HH:mm:ss")).cast("timestamp_ntz")
    assert text.filter(~logtext.parse_stamp("t").eqNullSafe(slow)).count() == 0
    odd = ["17/02/29 00:00:00", "16/02/29 00:00:00", "17/01/01 24:00:00", "17/01/01 10:60:00",
           "17/00/10 10:00:00", "17/04/31 10:00:00", "17/01/01 10:00:60"]
    bad = spark.createDataFrame([(x,) for x in odd], "t string")
    assert bad.filter(~logtext.parse_stamp("t").eqNullSafe(slow)).count() == 0
    assert bad.filter(logtext.parse_stamp("t").isNotNull()).count() == 1


def test_component(lines):
    got = column(lines, logtext.component())
    assert got["normal"] == "QueueMaster" and got["python"] == "python.PythonRunner"
    assert got["no colon"] == "" and got["inside"] == ""


def test_records(lines):
    parsed = records.parse_log_record(lines)
    assert parsed.columns == ["timestamp", "log_level", "component", "message"]
    full = records.enrich_log_record(lines).collect()
    # a time stamp is enough, also without a level; an impossible date stays as null
    assert len(full) == sum(1 for v in LINES.values() if v and v[:2] == "17" and v[14] == ":")
    assert {r["app_number"] for r in full} == {"0052"}
    counts = records.timestamp_rejects(lines).first()
    assert counts["n_rejected"] == 1 and counts["n_stamped"] == len(full)


def test_lines_outside_an_application_are_kept_unless_dropped(spark):
    df = spark.createDataFrame([(LINES["normal"], "file:/logs/other.log")], "value string, file_path string")
    row = records.enrich_log_record(df).first()
    assert row["application_id"] == "" and row["cluster_id"] == "" and row["app_number"] == ""
    assert records.enrich_log_record(df, drop_unidentified=True).count() == 0


def test_path_ids(spark):
    df = spark.createDataFrame([(PATH,), ("file:/x/container_1_0002_01_000003.log",), ("y",)], "file_path string")
    got = paths.with_application_ids(df).select(
        "*", paths.container_id().alias("c"), paths.container_role(paths.container_id()).alias("role"),
        paths.cluster_start_time().alias("start"),
    ).collect()
    assert got[0]["application_id"] == APP and got[0]["cluster_id"] == "1485248649253"
    assert [r["role"] for r in got] == ["application_master", "executor", ""]
    assert got[0]["start"] == datetime.datetime(2017, 1, 24, 9, 4, 9, 253000)
    assert got[1]["start"] is None


def test_task_statistics(lines):
    task = tasks.task_durations(lines).collect()
    assert [(r["stage"], r["tid"], r["duration_sec"]) for r in task] == [("2.0", 14, 4)]
    assert tasks.python_times(lines).first()["boot_ms"] == -88
    ask = tasks.resource_requests(lines).first()
    assert (ask["executors"], ask["total_cores"], ask["total_memory_mb"]) == (12, 36, 12 * 9216)
    assert tasks.input_bytes(lines).first()["input_bytes"] == 524288
    memory = tasks.block_memory(lines).first()
    assert memory["stored_bytes"] == round(4.1 * 1024) and memory["max_capacity_bytes"] == 3 * 2**29
    assert tasks.unfinished_tasks(lines).count() == 0
    failed = tasks.failed_tasks(lines).collect()
    assert [(r["stage"], r["task"], r["n_failures"], r["last_attempt"]) for r in failed] == [("2.0", 5, 1, 1)]
    asked = tasks.container_requests(lines).first()
    assert (asked["host"], asked["memory_mb"], asked["v_cores"], asked["n_containers"]) == ("Any", 10240, 3, 1)
