import io
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from weftlog.sources import runs
from weftlog.sources.files import numbered_lines
from weftlog.sources.ranges import RunLogReader, lines_between, ranged_lines

TEXTS = [b"", b"\n", b"a", b"a\n", b"a\r\nb\rc\n\r\n\r\rd", b"\r\n\r\n", b"long " * 50 + b"\r\nx\n" + b"y" * 99 + b"\r", "äö\n中\r\n".encode() * 9, b"\n\r\n\r"]


@pytest.mark.parametrize("text", TEXTS)
def test_ranges_give_each_line_once_wherever_they_are_cut(text):
    expected = re.split(rb"\r\n|\n|\r", text)
    expected = expected[:-1] if not expected[-1] else expected
    for split in (1, 2, 3, 5, 8, 64, 1000):
        for chunk in (1, 2, 7, 1000):
            found = [line for start in range(0, len(text), split) for line in lines_between(io.BytesIO(text), start, min(start + split, len(text)), chunk)]
            assert found == expected, (split, chunk)


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    for run in ("a b", "b", "c"):
        for pod in ("p", "q-1", "empty"):
            path = root / run / "istio" / "access_logs" / f"{pod}.log"
            path.parent.mkdir(parents=True, exist_ok=True)
            body = "" if pod == "empty" else "﻿" + "".join(f" {run} {pod} {i} ä{'x' * (i % 50)} {end}" for i in range(400) for end in [["\n", "\r\n", "\r", "\n\n"][i % 4]])
            path.write_bytes(body.encode())
    return str(root)


@pytest.mark.parametrize("split", [2003, 1 << 20])
def test_lines_equal_those_of_the_text_reader(spark, logs, split):
    columns = ["run_dir", "file", "lineno", "line"]
    expected = numbered_lines(spark, f"{logs}/*", runs.LOGS).select(*columns).collect()
    found = ranged_lines(spark, f"{logs}/*", runs.LOGS, split=split).select(*columns).collect()
    assert len(expected) == 6 * 500 and sorted(found) == sorted(expected)


def test_filters_on_runs_prune_listing(spark, logs):
    reader = RunLogReader(f"{logs}/*", runs.LOGS, 1000)
    other = GreaterThan(("nth",), 3)
    assert list(reader.pushFilters([In(("run_dir",), (f"file:{logs}/b", f"file:{logs}/c")), other, EqualTo(("run_dir",), f"file:{logs}/c")])) == [other]
    parts = reader.partitions()
    assert {r[1] for p in parts for r in p.ranges} == {f"file:{logs}/c"}
    assert all(sum(r[4] - r[3] for r in p.ranges) <= 1000 for p in parts)
    wanted = [f"file:{logs}/a%20b", f"file:{logs}/nowhere"]
    rows = ranged_lines(spark, f"{logs}/*", runs.LOGS, wanted)
    assert [r[0] for r in rows.select("run_dir").distinct().collect()] == wanted[:1] and rows.count() == 2 * 500


def test_spark_hands_its_filter_to_the_source(spark, logs):
    ranged_lines(spark, f"{logs}/*", runs.LOGS, [])  # registers the source
    load = lambda: spark.read.format("run_logs").options(root=f"{logs}/*", name=runs.LOGS, splitBytes=20_000).load()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        every, one = load(), load().where(F.col("run_dir") == f"file:{logs}/c")
        assert every.rdd.getNumPartitions() >= 6 > one.rdd.getNumPartitions() and one.count() == 2 * 500
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_no_files_give_no_rows(spark, tmp_path):
    assert ranged_lines(spark, f"{tmp_path}/*", runs.FLOWS).count() == 0
    assert ranged_lines(spark, f"{tmp_path}/nowhere/*", runs.FLOWS, []).count() == 0


def test_numbers_are_dense(spark, logs):
    rows = ranged_lines(spark, f"{logs}/*", runs.LOGS, split=4001).groupBy("run_dir", "file").agg(F.countDistinct("lineno").alias("n"), F.max("lineno").alias("last"))
    assert {(r.n, r.last) for r in rows.collect()} == {(500, 500)}


def test_run_files_of_several_ranges(spark, monkeypatch):
    """Files of runs that several tasks sort and write have their lines once and in order."""
    import duckdb

    from weftlog.plans import catalog, run_queries

    monkeypatch.setattr(run_queries, "LINES", 200)
    duck = duckdb.connect()
    duck.execute("CREATE VIEW orders AS FROM '/root/testdata/sf0.001/orders.parquet'")
    found = duck.execute(catalog.ORACLES["pruned_run_lines"])
    order = [d[0] for d in found.description]
    rows = catalog.QUERIES["pruned_run_lines"](spark, "/root/testdata/sf0.001").select(*order).collect()
    assert sorted(map(tuple, rows)) == sorted(found.fetchall())


def test_folder_of_parts_stands_for_a_file(spark, tmp_path):
    """Lines of a log in parts, plain or compressed, are numbered through, in order of the parts' names."""
    import gzip

    for run, kind in (("a b", "plain"), ("b", "gz"), ("c", "file")):
        log = tmp_path / run / "cilium" / "flows.jsonl"
        texts = ["".join(f"line {i}\n" for i in range(first, first + n)) for first, n in ((1, 300), (301, 1), (302, 500))]
        (log.parent if kind == "file" else log).mkdir(parents=True)
        if kind == "file":
            log.write_text("".join(texts))
            continue
        (log / "_SUCCESS").write_text("")
        for i, text in enumerate(texts):
            (log / f"part-{i}.txt").write_text(text) if kind == "plain" else (log / f"part-{i}.txt.gz").write_bytes(gzip.compress(text.encode()))
    of = lambda rows: sorted((r.run_dir.rpartition("/")[2], r.file, r.lineno, r.line) for r in rows.collect())
    expected = [(run, "cilium/flows.jsonl", i, f"line {i}") for run in ("a%20b", "b", "c") for i in range(1, 802)]
    assert of(numbered_lines(spark, f"{tmp_path}/*", runs.FLOWS)) == expected
    for split in (101, 1 << 20):
        dirs = [f"file:{tmp_path}/a%20b", f"file:{tmp_path}/c"]
        assert of(ranged_lines(spark, f"{tmp_path}/*", runs.FLOWS, dirs, split)) == [x for x in expected if x[0] != "b"]


def test_lines_of_runs_are_written_once(spark, tmp_path, monkeypatch):
    from weftlog.plans import run_queries

    monkeypatch.setattr(run_queries, "LINES", 200)
    bytes_, found = {}, {}
    for codec in ("none", "gzip"):
        monkeypatch.setattr(run_queries, "fresh", lambda spark, name, codec=codec: f"file://{tmp_path}/{codec}/{name}")
        lines = numbered_lines(spark, run_queries.write_runs(spark, "/root/testdata/sf0.001", codec), runs.FLOWS)
        found[codec] = sorted((r.run_dir.rpartition("/")[2], r.lineno, r.line) for r in lines.collect())
        text = [x for x in (tmp_path / codec).rglob("part-*.txt*") if x.stat().st_size]
        assert text and all(x.relative_to(tmp_path / codec).parts[0] == "runs" for x in text)
        bytes_[codec] = sum(x.stat().st_size for x in text)
    assert found["none"] == found["gzip"] and bytes_["gzip"] < bytes_["none"] / 4
