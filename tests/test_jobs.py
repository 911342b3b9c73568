import pytest

from tidewheel.jobs import main


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def lines(path):
    return sorted(line for part in path.glob("part-*") for line in part.read_text().splitlines())


@pytest.fixture
def run(spark):
    return lambda *a: main([str(x) for x in a], spark)


def test_text_jobs(run, tmp_path):
    text = put(tmp_path / "t", "the Cat\nsat\n\n")
    run("wordcount", text, tmp_path / "wc")
    assert lines(tmp_path / "wc") == [",1", "cat,1", "sat,1", "the,1"]
    run("grep", text, "at", tmp_path / "g", 2)
    assert lines(tmp_path / "g") == ["sat", "the Cat"]


def test_relational_jobs(run, tmp_path):
    c = put(tmp_path / "c", "1|c1|addr|0|ph|10.5|AUTOMOBILE|x|\n2|c2|addr|0|ph|1|BUILDING|x|\n")
    o = put(tmp_path / "o", "7|1|F|1.0|1995-03-01|1-URGENT|clerk|0|x|\n8|2|F|1.0|1995-03-01|1-URGENT|clerk|0|x|\n")
    item = "{}|1|1|1|1|100.0|0.5|0|R|F|1995-04-01|1995-04-01|1995-04-01|i|m|c|\n"
    i = put(tmp_path / "l", item.format(7) + item.format(7) + item.format(8))
    n = put(tmp_path / "n", "0|NOWHERE|0|c|\n")
    run("shipping-priority", "--lineitem", i, "--customer", c, "--orders", o, "--output", tmp_path / "q3")
    assert lines(tmp_path / "q3") == ["7|100.0|1995-03-01|0"]
    run("returned-items", c, o, i, n, tmp_path / "q10")
    assert lines(tmp_path / "q10") == ["1|c1|addr|NOWHERE|10.5|100.0", "2|c2|addr|NOWHERE|1.0|50.0"]
    run("suite-runtimes", put(tmp_path / "e", "1,s,a\n"), put(tmp_path / "r", "1,5\n1,6\n1,9\n"), "s", tmp_path / "sr")
    assert lines(tmp_path / "sr") == ["s,a,5,9,6"]


def test_graph_jobs(run, tmp_path):
    edges = put(tmp_path / "e", "% note\n1\t2\n2\t1\n2\t3\n")
    run("components", edges, tmp_path / "cc", 10, "--through", tmp_path / "state")
    assert lines(tmp_path / "cc") == ["1 1", "2 1", "3 1"]
    words = put(tmp_path / "w", "a b\nb a\n")
    run("pagerank", words, tmp_path / "pr", 3)
    assert lines(tmp_path / "pr") == ["a 1.0", "b 1.0"]
    run("pagerank", edges, tmp_path / "bulk", 1, "--mode", "bulk", "--pages", 3, "--stats", tmp_path / "stats")
    assert [line.split()[0] for line in lines(tmp_path / "bulk")] == ["1", "2", "3"]
    run("pagerank", edges, tmp_path / "delta", 2, "--mode", "delta", "--pages", 3)
    assert len(lines(tmp_path / "delta")) == 2
    assert lines(tmp_path / "stats") == ["distribute,1,2,3"]


def test_learning_jobs(run, tmp_path, capsys):
    run("gen-kmeans", tmp_path / "km", "--points", 300, "-k", 3, "--skew", "1,2,3")
    assert len(lines(tmp_path / "km" / "points")) == 300 and len(lines(tmp_path / "km" / "centers")) == 3
    run("kmeans", tmp_path / "km" / "points", tmp_path / "km" / "centers", tmp_path / "out", 3, "--through", tmp_path / "steps")
    assert len(lines(tmp_path / "out")) == 300 and (tmp_path / "steps" / "iteration_3").is_dir()
    run("kmeans-auto", tmp_path / "km" / "points", 3, 5)
    run("gen-linreg", tmp_path / "lr", "--points", 200)
    run("linreg", tmp_path / "lr", tmp_path / "theta", 2000)
    theta0, theta1 = map(float, lines(tmp_path / "theta")[0].split())
    assert theta1 == pytest.approx(2, abs=0.05) and theta0 == pytest.approx(0, abs=0.05)
    run("gen-features", tmp_path / "f", "--points", 100, "--dimension", 3)
    run("linreg-sgd", tmp_path / "f", tmp_path / "w")
    assert len(lines(tmp_path / "w")) == 3
    run("gen-features", tmp_path / "fl", "--points", 100, "--dimension", 3, "--layout", "label_last")
    run("sgd", tmp_path / "fl", tmp_path / "wi", "--intercept")
    assert len(lines(tmp_path / "wi")) == 4
    assert "wssse" in capsys.readouterr().out


def test_runtime_jobs(run, tmp_path):
    for nodes in (4, 8, 12, 16):
        for k in range(1, 4):
            put(tmp_path / "s" / f"x.top{nodes:03d}.run{k:02d}" / "state.json", f'{{"runExitCode": 0, "runTime": {60000 + 480000 // nodes + k}}}')
    put(tmp_path / "s" / "x.top020.run01" / "state.json", '{"runExitCode": 2, "runTime": 1}')
    run("parse-runs", tmp_path / "s", tmp_path / "runs")
    ended = lines(tmp_path / "runs" / "runs" / "suite=x")
    assert len(ended) == 12
    assert lines(tmp_path / "runs" / "failed") == ["x.top020.run01,2"]
    table = put(tmp_path / "x.csv", "Nodes,Runtime\n" + "\n".join(ended) + "\n")
    run("fit-runtimes", table, tmp_path / "curve", "--points", 10)
    assert len(lines(tmp_path / "curve" / "curves")) >= 10 and len(lines(tmp_path / "curve" / "models")) == 1
    run("learning-curves", table, tmp_path / "lc", "--smallest", 3, "--largest", 4, "--iterations", 3)
    assert len(lines(tmp_path / "lc" / "draws")) >= 6 and len(lines(tmp_path / "lc" / "average")) >= 6
