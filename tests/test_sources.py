import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewheel.operators.runtimes import run_metrics
from tidewheel.plans.state import LoopState, materialize, new_folder, state_root
from tidewheel.sources import runs as run_files
from tidewheel.sources import text as files


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_lines(spark, tmp_path):
    path = put(tmp_path / "t.txt", "one\n\n  two\nthree\n")
    assert rows(files.read_lines(spark, path)) == [("",), ("  two",), ("one",), ("three",)]
    assert files.read_lines(spark, path, min_partitions=3).rdd.getNumPartitions() == 3


def test_read_delimited_picks_columns_of_lines_that_end_in_a_separator(spark, tmp_path):
    path = put(tmp_path / "customer.tbl", '1|C "x"|addr|15|phone|711.56|BUILDING|note|\n2|D|a|3|p|-1.5|AUTO|n|\n')
    schema = "k bigint, name string, address string, nation int, phone string, bal double, segment string, note string"
    got = files.read_delimited(spark, path, schema, columns=["k", "bal", "name"], trailing_sep=True)
    assert rows(got) == [(1, 711.56, 'C "x"'), (2, -1.5, "D")]


def test_read_delimited_skips_comments_and_rejects_bad_rows(spark, tmp_path):
    path = put(tmp_path / "e", "# head\n1\t2\n3\t4\n")
    assert rows(files.read_delimited(spark, path, "a bigint, b bigint", sep="\t", comment="#")) == [(1, 2), (3, 4)]
    bad = put(tmp_path / "bad", "1\tx\n")
    with pytest.raises(Exception):
        files.read_delimited(spark, bad, "a bigint, b bigint", sep="\t").collect()


def test_write_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, 1e-7, "b c")], "a int, b double, c string")
    path = str(tmp_path / "out")
    files.write_delimited(df, path, sep="|")
    assert rows(files.read_delimited(spark, path, df.schema, sep="|")) == rows(df)
    with pytest.raises(Exception):
        files.write_delimited(df, path, sep="|")
    files.write_delimited(df.limit(1), path, sep="|", mode="overwrite")
    assert files.read_delimited(spark, path, df.schema, sep="|").count() == 1


def test_read_edges(spark, tmp_path):
    tab = put(tmp_path / "a", "% c\n1\t2\n2\t2\n1\t2\n")
    assert rows(files.read_edges(spark, tab)) == [(1, 2), (1, 2), (2, 2)]
    space = put(tmp_path / "b", "# c\nx   y z\ny x\n")
    assert rows(files.read_edges(spark, space, sep=r"\s+", comment="#", id_type="string")) == [("x", "y"), ("y", "x")]
    bad = put(tmp_path / "c", "1\tx\n")
    with pytest.raises(Exception):
        files.read_edges(spark, bad).collect()


def test_points_and_vectors(spark, tmp_path):
    first = put(tmp_path / "a", "11.3,1.0 0.42\n-2,1 2 3\n")
    assert rows(files.read_labeled_points(spark, first)) == [(-2.0, [1.0, 2.0, 3.0]), (11.3, [1.0, 0.42])]
    bracketed = put(tmp_path / "c", "(11.3,[1.0,0.42])\n(-2.0,[1.0, 2.0,3.0])\n")
    assert rows(files.read_labeled_points(spark, bracketed)) == [(-2.0, [1.0, 2.0, 3.0]), (11.3, [1.0, 0.42])]
    last = put(tmp_path / "b", "1.0 0.42 11.3\n")
    assert rows(files.read_labeled_points(spark, last, "label_last")) == [(11.3, [1.0, 0.42])]
    vectors = put(tmp_path / "v", "1 2 3\n4.5\n")
    assert rows(files.read_vectors(spark, vectors)) == [([1.0, 2.0, 3.0],), ([4.5],)]


def write_run(root, name, exit_code, runtime, hosts=()):
    put(root / name / "state.json", json.dumps({"name": name, "runExitCode": exit_code, "runTime": runtime}, indent=1))
    for host, samples in hosts:
        lines = ['"p"'] * 6 + ['"time","usr","sys","idl","wai","hiq","siq","usr","recv","send","read","writ"']
        lines += [",".join(map(str, [k, u, 1, 2, 3, 4, 5, 99, 6, 7, 8, w])) for k, (u, w) in enumerate(samples)]
        put(root / name / "logs" / "stat" / "v1" / f"{host}.example.org.csv", "\n".join(lines) + "\n")


def test_run_states_and_host_metrics(spark, tmp_path):
    root = tmp_path / "suite"
    write_run(root, "wc.top004.run01", 0, 1500, [("h1", [(10.0, 1.5), (20.0, 2.5)]), ("boss", [(0, 0)])])
    write_run(root, "wc.top004.run02", 3, 9, [("h1", [(5.0, 1.0)])])
    write_run(root, "wc.top060.run01", 0, 700, [("h2", [(1.0, 9.0)])])
    write_run(root, "sort.top004.run01", 0, 50, [("h1", [(2.0, 3.0)])])
    write_run(root, "wc.top004.run01.bak", 0, 1)
    write_run(root, "wc.top004.run100", 0, 1)
    put(root / "sort.top008.run01" / "state.json", '{"runTime": 5}')
    runs, failed = run_files.read_run_states(spark, str(root))
    assert rows(runs) == [("sort", 4, 1, 50), ("wc", 4, 1, 1500), ("wc", 60, 1, 700)]
    assert sorted(map(tuple, failed.collect()), key=str) == [
        ("sort", 8, 1, None, "sort.top008.run01"),
        ("wc", 4, 2, 3, "wc.top004.run02"),
        (None, None, None, None, "wc.top004.run01.bak"),
        (None, None, None, None, "wc.top004.run100"),
    ]

    metrics = run_files.read_host_metrics(spark, f"{root}/*.top*.run*", "boss", logs="logs/stat/*/*.csv")
    got = rows(metrics.select("suite", "nodes", "run", "host", "seq", "usr", "siq", "recv", "writ"))
    assert got == [
        ("sort", 4, 1, "h1", 0, 2.0, 5.0, 6.0, 3.0),
        ("wc", 4, 1, "h1", 0, 10.0, 5.0, 6.0, 1.5),
        ("wc", 4, 1, "h1", 1, 20.0, 5.0, 6.0, 2.5),
        ("wc", 4, 2, "h1", 0, 5.0, 5.0, 6.0, 1.0),
        ("wc", 60, 1, "h2", 0, 1.0, 5.0, 6.0, 9.0),
    ]
    rolled = run_metrics(metrics, runs).select("run_key", "host", "samples", "avg_usr", "max_writ", "runtime_ms")
    assert rows(rolled) == [
        ("sort.top004.run01", "h1", 1, 2.0, 3.0, 50),
        ("wc.top004.run01", "h1", 2, 15.0, 2.5, 1500),
        ("wc.top060.run01", "h2", 1, 1.0, 9.0, 700),
    ]


def test_a_log_of_many_blocks_is_read_by_many_tasks(spark, tmp_path):
    """Blocks end within lines, within the header, and several of different files share a task."""
    root = tmp_path / "suite"
    samples = {f"h{k}": [(float(i), float(k)) for i in range(n)] for k, n in enumerate((3000, 7, 0, 900))}
    write_run(root, "wc.top004.run01", 0, 1, list(samples.items()) + [("boss", [(0, 0)])])
    path = root / "wc.top004.run01" / "logs" / "stat" / "v1" / "h1.example.org.csv"
    path.write_text(path.read_text().replace("\n4,", "\n\n4,"))  # an empty line counts as a second
    want = {(h, i, u) for h, of in samples.items() for i, (u, _) in enumerate(of) if h != "h1"}
    want |= {("h1", i + (i > 3), u) for i, (u, _) in enumerate(samples["h1"])}
    before = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("61", "4000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            read = run_files.read_host_metrics(spark, f"{root}/*.top*.run*", "boss", logs="logs/stat/*/*.csv")
            assert {tuple(r) for r in read.select("host", "seq", "usr").collect()} == want
            if size == "4000":
                tasks = spark.read.text(f"{root}/*/logs/stat/*/*.csv").rdd.getNumPartitions()
                assert tasks > 20
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_state_goes_below_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert state_root(spark) == root
    assert new_folder(spark, "x").startswith(root) and new_folder(spark, "x") != new_folder(spark, "x")


def test_materialize_and_loop_versions(spark, tmp_path):
    df = spark.range(10).withColumn("y", F.col("id") * 2)
    out = materialize(df, str(tmp_path / "m"), 3, single_file=True)
    assert rows(out) == rows(df) and (tmp_path / "m" / "iteration_3").is_dir()
    for path, kept in ((None, ["iteration_1", "iteration_2"]), (str(tmp_path / "k"), ["iteration_0", "iteration_1", "iteration_2"])):
        loop = LoopState(spark, "t", path)
        current = df
        for step in range(3):
            current = loop.advance(current.withColumn("y", F.col("y") + 1), "rows", step)
        assert current.agg(F.sum("y")).first()[0] == 90 + 30
        import os

        assert sorted(os.listdir(f"{loop.path}/rows")) == kept
