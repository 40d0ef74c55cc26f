"""Files by their metadata: empty ones counted, nothing read."""

import time

import pytest

from waybill.operators import usage
from waybill.sources.files import create_empty, scan_file_metadata
from waybill.sources.text import scan_log_tree


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    for app, name, data in [
        ("application_12_0001", "container_12_0001_01_000001.log", b"one\ntwo"), ("application_12_0001", "container_12_0001_01_000002.log", b""),
        ("application_12_0002/deep", "container_12_0002_01_000001.log", b""), ("other place", "a b.txt", "é\n".encode()), ("other place", "_hidden", b"x"),
    ]:
        (root / app).mkdir(parents=True, exist_ok=True)
        (root / app / name).write_bytes(data)
    return root


def test_empty_files_and_odd_names(spark, tree):
    files = scan_file_metadata(spark, str(tree))
    got = {r["file_path"].rsplit("/", 1)[1]: (r["length"], r["modified_at"] is None) for r in files.collect()}
    assert got == {
        "container_12_0001_01_000001.log": (7, False), "container_12_0001_01_000002.log": (0, True),
        "container_12_0002_01_000001.log": (0, True), "a%20b.txt": (3, False),
    }
    lines = scan_log_tree(spark, str(tree))
    # names are spelled as a scan of lines spells them
    assert {r[0] for r in lines.select("file_path").distinct().collect()} == {r["file_path"] for r in files.collect() if r["length"]}
    assert scan_file_metadata(spark, str(tree), "*.txt").count() == 1


def test_inventory(spark, tree):
    files = scan_file_metadata(spark, str(tree))
    assert usage.dataset_inventory(files).first().asDict() == {"n_applications": 2, "n_files": 4, "n_empty_files": 2, "n_bytes": 10}
    assert usage.inventory_with_lines(files, scan_log_tree(spark, str(tree))).first()["n_lines"] == 3
    top = [tuple(r) for r in usage.top_apps_by_files(files).collect()]
    assert top == [("application_12_0001", 2, 1, 7), ("application_12_0002", 1, 1, 0)]
    roles = {(r["application_id"], r["role"], r["n_containers"]) for r in usage.containers_per_app(files).collect()}
    assert roles == {
        ("application_12_0001", "application_master", 1), ("application_12_0001", "executor", 1), ("application_12_0002", "application_master", 1),
    }


def test_only_empty_files(spark, tmp_path):
    create_empty(spark, f"{tmp_path}/application_12_0001/container_12_0001_01_000001.log")
    files = scan_file_metadata(spark, str(tmp_path))
    assert usage.dataset_inventory(files).first().asDict() == {"n_applications": 1, "n_files": 1, "n_empty_files": 1, "n_bytes": 0}


def test_containers_of_all_applications(spark, tmp_path):
    """More applications than a written tree holds, one of them with empty logs, and events that write nothing."""
    import datetime

    from waybill.plans import catalog

    at = lambda day: datetime.datetime(2024, 1, day, 3)
    rows = [(e, at(1 + 3 * (e % 10)), e // 10 % 30, "view", 1.5) for e in range(600)]
    rows += [(10_000 + i, at(1), 900 + i, "view", None) for i in range(3)]
    rows += [(20_000, at(1), 950, None, 1.0), (20_001, at(1), 951, "other", 1.0), (20_002, at(1), None, "view", 1.0), (20_003, None, 952, "view", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for e, ts, user, kind, _ in rows:
        if e % 97 and kind == "view" and ts and user is not None:
            want.setdefault(user * 10 + (ts.day - 1) // 3, set()).add(e % 3)
    got = {}
    for r in catalog.QUERIES["containers_per_app"](spark, str(tmp_path)).collect():
        got.setdefault(int(r["application_id"].rsplit("_", 1)[1]), {})[r["role"]] = r["n_containers"]
    named = lambda nos: {k: n for k, n in (("application_master", int(0 in nos)), ("executor", len(nos - {0}))) if n}
    assert len(want) > 250 and 39 in want and got == {a: named(nos) for a, nos in want.items()}


def test_no_line_is_read(spark, sf_dir):
    from waybill.plans import catalog

    for name in ("dataset_inventory", "top_apps_by_files", "containers_per_app", "files_per_app"):
        df = catalog.QUERIES[name](spark, sf_dir)
        p = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        assert "content" not in p and "Scan text" not in p and p.count("ReadSchema") == p.count("ReadSchema: struct<>"), name


def test_rows_read_are_files(spark, sf_dir):
    from waybill.plans.demo_logs import container_logs

    root = container_logs(spark, sf_dir)
    files = scan_file_metadata(spark, root)
    n = files.count()
    context = spark.sparkContext
    quantiles = context._gateway.new_array(context._jvm.double, 0)

    def records():
        time.sleep(0.5)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
        return sum(s.inputRecords() for s in context._jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))

    before = records()
    usage.dataset_inventory(files).collect()
    assert records() - before <= n
