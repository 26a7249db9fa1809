"""Safe sinks, counts on the way, checked lines, and fetching that goes on."""

from __future__ import annotations

import os
from urllib.error import HTTPError, URLError

import pytest
from pyspark.sql import functions as F

from mediaflow.operators import fetching, payload
from mediaflow.sources import tables
from tests.conftest import plan_of, rows_of


def failing(df):
    """The rows, of which the last makes its task fail."""
    return df.withColumn("v", F.when(F.col("id") == 9, F.raise_error(F.lit("a bad row"))).otherwise(F.col("v")))


@pytest.fixture
def rows(spark):
    return spark.range(10).select("id", (F.col("id") % 3).cast("int").alias("label"), F.lit("old").alias("v"))


def files_below(path):
    return sorted(name for name in os.listdir(path) if not name.startswith("."))


def test_partitions_are_replaced_one_by_one(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(rows, path, partition_by=["label"])
    untouched = [name for name in os.listdir(f"{path}/label=0")]
    new = rows.filter("label = 1").withColumn("v", F.lit("new"))
    tables.replace_partitions(new, path, ["label"])
    found = rows_of(spark.read.parquet(path).select("id", "label", "v"))
    assert found == sorted([(i, i % 3, "new" if i % 3 == 1 else "old") for i in range(10)], key=repr)
    assert os.listdir(f"{path}/label=0") == untouched
    tables.replace_partitions(new.limit(0), path, ["label"])
    assert rows_of(spark.read.parquet(path).select("id", "label", "v")) == found
    with pytest.raises(Exception, match="a bad row"):
        tables.replace_partitions(failing(rows.withColumn("v", F.lit("newer"))), path, ["label"])
    assert rows_of(spark.read.parquet(path).select("id", "label", "v")) == found
    with pytest.raises(ValueError):
        tables.replace_partitions(new, path, [])
    with pytest.raises(Exception):
        tables.replace_partitions(new, path, ["other"])


@pytest.mark.parametrize("partition_by", [[], ["label"]])
def test_a_failed_overwrite_leaves_the_old_table(spark, rows, tmp_path, partition_by):
    path = str(tmp_path / "t")
    tables.write_table(rows, path, partition_by=partition_by)
    with pytest.raises(Exception, match="a bad row"):
        tables.write_table(failing(rows), path, overwrite=True, partition_by=partition_by)
    assert rows_of(spark.read.parquet(path).select("id", "label", "v")) == rows_of(rows)
    assert files_below(tmp_path) == ["t"]
    stored = spark.read.parquet(path)
    tables.write_table(stored.filter("id < 4").withColumn("v", F.lit("new")), path, overwrite=True, partition_by=partition_by)
    assert rows_of(spark.read.parquet(path).select("id", "v")) == [(i, "new") for i in range(4)]
    assert files_below(tmp_path) == ["t"]
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_table(rows, path)
    tables.write_table(rows, str(tmp_path / "u"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "u")).count() == 10


def test_counts_are_taken_by_the_job_that_writes(spark, rows, tmp_path):
    gaps = rows.withColumn("v", F.when(F.col("id") > 1, F.col("v"))).withColumn("label", F.nullif("label", F.lit(2)))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "write and count")
    counts = tables.write_counted(gaps, str(tmp_path / "t"), "label", [0, 1], ["v"])
    jobs = tracker.getJobIdsForGroup("counted")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert counts == {"rows_in": 10, "dropped": 2, "rows_out": 8, "per_label": {0: 3, 1: 2, None: 3}}
    assert stored.count() == 8 and stored.filter("label = 0").count() == 3
    none = tables.write_counted(gaps.filter("id < 0"), str(tmp_path / "u"), "label", [0], ["v"])
    assert none == {"rows_in": 0, "dropped": 0, "rows_out": 0, "per_label": {0: 0, None: 0}}


# --- checked lines

LINES = [
    "id,f0,f1,label", "1,0.5,2,a", "2,x,2,b", "3,1,2", "4,1,2,c,d", "", None, "5,,2,a", "id,again,in,there", "6, 7 ,1e3,a", '7,"1","2","q,r"', "8,NaN,-inf,a",
]


def test_bad_lines_keep_their_text(spark):
    lines = spark.createDataFrame([(line,) for line in LINES], "value string")
    found = {(r["bad_line"] if r["problem"] else r["id"]): r for r in tables.checked_lines(lines, 2).collect()}
    bad = {line: r["problem"] for line, r in found.items() if r["problem"]}
    assert bad == {"2,x,2,b": "number", "3,1,2": "width", "4,1,2,c,d": "width", "": "width", "5,,2,a": "number", '7,"1","2","q,r"': "width"}
    assert found["1"]["features"] == [0.5, 2.0] and found["6"]["features"] == [7.0, 1000.0] and found["1"]["category"] == "a"
    assert str(found["8"]["features"]) == "[nan, -inf]"
    assert all(r["features"] is None and r["category"] is None and r["id"] is None for r in found.values() if r["problem"])
    quoted = tables.checked_lines(lines, 2, quoted=True).collect()
    good = {r["id"]: (r["features"], r["category"]) for r in quoted if not r["problem"]}
    assert set(good) == {"1", "6", "7", "8"} and good["7"] == ([1.0, 2.0], "q,r")
    assert sorted(r["bad_line"] for r in quoted if r["problem"]) == sorted(["2,x,2,b", "3,1,2", "4,1,2,c,d", "", "", "5,,2,a"])
    scored = tables.checked_lines(lines.filter("value = '3,1,2'"), 2, train=False).first()
    assert (scored["id"], scored["features"], scored["category"]) == ("3", [1.0, 2.0], tables.UNKNOWN_LABEL)


def test_good_and_bad_lines_come_from_one_scan(spark, tmp_path):
    lines = spark.createDataFrame([(line,) for line in LINES], "value string")
    lines.write.text(str(tmp_path / "lines"))
    checked = tables.checked_lines(spark.read.text(str(tmp_path / "lines")), 2)
    assert plan_of(checked).count("FileScan text") == 1
    tables.write_checked(checked, str(tmp_path / "checked"))
    good, bad = (tables.read_checked(spark, str(tmp_path / "checked"), side) for side in (False, True))
    assert good.columns == ["id", "features", "category"] and sorted(r["id"] for r in good.collect()) == ["1", "6", "8"]
    assert bad.columns == ["problem", "bad_line"] and bad.count() == 7
    assert "PartitionFilters: [isnotnull(is_bad" in plan_of(bad)
    empty = tables.checked_lines(lines.limit(0), 2)
    assert empty.count() == 0


# --- fetching


class Host:
    """Answers from a folder; writes down every call. References with 'busy' fail twice."""

    def __init__(self, root):
        self.root = str(root)

    def calls(self, reference=None):
        names = [name.rpartition("#")[0] for name in os.listdir(f"{self.root}/calls")]
        return names if reference is None else names.count(reference)

    def __call__(self, reference):
        name = reference.rsplit("/", 1)[-1]
        nth = sum(1 for call in os.listdir(f"{self.root}/calls") if call.startswith(f"{name}#"))
        open(f"{self.root}/calls/{name}#{nth}", "w").close()
        if "busy" in name and nth < 2:
            raise HTTPError(reference, 503, "busy", None, None)
        if "gone" in name:
            raise HTTPError(reference, 404, "not found", None, None)
        if "down" in name:
            raise URLError(ConnectionRefusedError("no host"))
        return f"body of {name}".encode()


def no_wait(seconds):
    pass


def test_runs_fetch_each_reference_once_and_retry_the_rest(spark, tmp_path):
    os.mkdir(tmp_path / "calls")
    host, path = Host(tmp_path), str(tmp_path / "attempts")
    names = [f"http://H{i % 2}.example/{name}" for i, name in enumerate(["a", "b", "c", "a", "busy", "gone", "down"])]
    refs = spark.createDataFrame([(i, name) for i, name in enumerate([*names, None])], "i int, url string")
    options = {"tries": 1, "most_tries": 3, "sleep": no_wait}
    fetching.fetch_missing(refs.filter("i < 3"), "url", host, path, **options)
    assert sorted(host.calls()) == ["a", "b", "c"]
    fetching.fetch_missing(refs, "url", host, path, **options)
    # 'a' stands under two hosts and so for two references.
    assert sorted(host.calls()) == sorted(["a", "b", "c", "a", "busy", "gone", "down"])
    for _ in range(4):
        fetching.fetch_missing(refs, "url", host, path, slices=2, **options)
    assert {name: host.calls(name) for name in ("a", "b", "busy", "gone", "down")} == {"a": 2, "b": 1, "busy": 3, "gone": 1, "down": 3}
    found = {r["i"]: r for r in fetching.with_fetched(refs, "url", path).collect()}
    assert len(found) == 8 and found[0]["payload"] == found[3]["payload"] == b"body of a" and found[0]["error"] is None
    assert found[4]["payload"] == b"body of busy" and found[4]["error"] is None
    assert "404" in found[5]["error"] and "ConnectionRefused" in found[6]["error"] or "no host" in found[6]["error"]
    assert found[7]["payload"] is None and found[7]["error"] is None
    attempts = fetching.read_attempts(spark, path)
    assert attempts.filter("fetched").groupBy("reference").count().filter("count > 1").isEmpty()
    assert attempts.filter("permanent").count() == 1
    assert fetching.read_attempts(spark, str(tmp_path / "none")).count() == 0


def test_a_host_that_fails_is_left_alone_for_longer_each_time():
    waits = []

    def fetch(reference):
        if reference.startswith("bad"):
            raise OSError("down")
        if reference == "none":
            raise FileNotFoundError(reference)
        return b"x"

    out = fetching._ask(["bad1", "bad2", "none", "good", "good2"], fetch, 3, 1.0, waits.append)
    assert waits == [1.0, 2.0, 4.0, 8.0, 16.0, 32.0]
    assert [(r[0], r[1], r[4]) for r in out] == [("bad1", 3, False), ("bad2", 3, False), ("none", 1, True), ("good", 1, False), ("good2", 1, False)]
    waits.clear()
    fetching._ask(["bad"] * 4, fetch, 5, 20.0, waits.append)
    assert max(waits) == fetching.LONGEST_WAIT


def test_hosts(spark):
    urls = ["http://A.example:80/x?y", "https://b.example", "file:///tmp/x", "x.png", None, "ftp://c/x//y"]
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in frame.select(fetching.host_of("u")).collect()] == ["a.example:80", "b.example", "", "", None, "c"]


@pytest.mark.parametrize(
    "failure, final",
    [(HTTPError("u", 404, "", None, None), True), (HTTPError("u", 429, "", None, None), False), (HTTPError("u", 500, "", None, None), False),
     (URLError(FileNotFoundError("x")), True), (URLError(TimeoutError()), False), (FileNotFoundError("x"), True), (OSError("x"), False), (ValueError("unknown url type"), True)],
)
def test_which_failures_are_final(failure, final):
    assert payload.is_permanent(failure) is final


def test_http_fetcher_asks_again_only_where_that_may_help(monkeypatch):
    import urllib.request

    calls, waits = [], []
    monkeypatch.setattr(payload.time, "sleep", waits.append)

    def answer(code):
        def urlopen(url, timeout):
            calls.append(url)
            raise HTTPError(url, code, "", None, None)

        return urlopen

    for code, wanted in ((404, 1), (410, 1), (503, 3), (429, 3)):
        calls.clear()
        monkeypatch.setattr(urllib.request, "urlopen", answer(code))
        with pytest.raises(HTTPError):
            payload.http_fetcher("http://x/")("y")
        assert len(calls) == wanted
    assert waits == [1.0, 2.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        payload.http_fetcher(attempts=0)
