import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, ODD, odd_documents
from tidewheel.llm import quality, urls
from tidewheel.llm.queries import URL_RULES

SCHEMA = "label int, features array<double>"


def classes(n=400, seed=1):
    rng = np.random.default_rng(seed)
    d = len(quality.FEATURES)
    zero = rng.standard_normal((n, d)) * np.linspace(0.5, 2, d)
    one = rng.standard_normal((2 * n, d)) * 0.4 + 1
    return zero, one


def test_fit_is_that_of_numpy(spark):
    zero, one = classes()
    rows = [(k, r.tolist()) for k, x in enumerate((zero, one)) for r in x] + [(2, zero[0].tolist()), (None, zero[0].tolist())]
    model = quality.fit(spark.createDataFrame(rows, SCHEMA), pool=0.1, diagonal=0.2, floor=0.01)
    spreads = [np.cov(x.T, bias=True) for x in (zero, one)]
    pooled = (spreads[0] * len(zero) + spreads[1] * len(one)) / (len(zero) + len(one))
    x = np.concatenate([zero[:50], one[:50]])
    logs = []
    for k, own in enumerate(spreads):
        cov = 0.9 * (0.8 * own + 0.2 * np.diag(np.diag(own))) + 0.1 * pooled + 0.01 * np.eye(len(own))
        gap = x - (zero, one)[k].mean(axis=0)
        distance = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap)
        prior = np.log((len(zero), len(one))[k] / (len(zero) + len(one)))
        logs.append(prior - 0.5 * distance - 0.5 * np.linalg.slogdet(cov)[1])
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-9)


def test_too_few_labels(spark):
    def scores(rows):
        return quality.fit(spark.createDataFrame(rows, SCHEMA)).score(np.zeros((1, len(quality.FEATURES))))[0]

    zeros = [0.0] * len(quality.FEATURES)
    assert scores([]) == 0.5
    assert scores([(1, zeros)]) == 1
    assert scores([(0, zeros)]) == 0
    assert 0 <= scores([(0, zeros), (1, zeros)]) <= 1


def test_statistics_of_odd_rows(spark):
    df = odd_documents(spark)
    rows = df.select("doc_id", quality.features(F.col("text")).alias("f"), "score").collect()
    assert len(rows) == len(ODD)
    assert all(np.isfinite(r["f"]).all() and len(r["f"]) == len(quality.FEATURES) for r in rows)
    assert all(not any(r["f"]) for r in rows if r["doc_id"] in (1, 2, 3))
    model = quality.Discriminant([None, None], [None, None], [0.0, 0.0])
    assert df.limit(0).select(quality.score(quality.features(F.col("text")), model)).collect() == []


def test_labels_of_one_key(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,), (None,)], "doc_id long")
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (1, 0), (2, 0), (None, 1), (3, None), (3, 5)], "doc_id long, quality int"
    )
    assert sorted(map(tuple, quality.labelled(docs, labels).collect())) == [(1, 1), (2, 0)]


def test_held_out_accuracy(spark):
    from tidewheel.llm.queries import op9_quality

    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in op9_quality(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.95


URLS = [
    "https://www.example.com/en/1?x=/de/", "http://a.example.com/en/2", "http://example.com/en", "HTTP://B.COM/x", "x://c.net/es/9#f",
    "http://c.net/de/1", "http://notnet/es/1", "http://net/es/", None, "", "no scheme/en/", "a://b://c.com/x", "http://com", "http://com/",
    "http://É.COM/en/é", "http://h.org/a/b/c//d/", "http://c.net\n/fr/1", "http://u:p@w.net:80/fr/2",
]


def parts(url):
    found = re.search(r"^.*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = found.groups() if found else ("", "")
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def test_rules_decide_as_said(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string").selectExpr("*", "'clash' host", "'clash' verdict")
    rows = urls.filter_urls(df, URL_RULES).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path = parts(r["url"])
        assert (r["host"], r["path"]) == (host, path)
        fits = [x for x in URL_RULES if ("." + host).endswith("." + x.host) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert r["rule"] == (best.name if best else None)
        assert r["verdict"] == (best.verdict if best else r["verdict"]) and r["verdict"] in ("allow", "block")


def test_tree_rejects_bad_templates_only(spark):
    rows = []
    for i in range(200):
        rows.append((f"http://h/news/{i}", 0 if i % 4 == 0 else None))
        rows.append((f"http://h/spam/{i}.html", 1 if i % 4 == 0 else None))
        rows.append((f"http://h/user/name{chr(97 + i % 26)}{chr(97 + i // 26)}/page", 1 if i % 10 == 0 else None))
        rows.append((f"http://new/spam/{i}", None))
    df = spark.createDataFrame(rows, "url string, bad int")
    found = urls.filter_urls(df, [], F.col("bad")).collect()
    verdicts = {}
    for r in found:
        verdicts.setdefault((r["host"], r["path"].split("/")[1]), set()).add(r["verdict"])
    assert verdicts == {
        ("h", "news"): {"allow"}, ("h", "spam"): {"block"}, ("h", "user"): {"block"}, ("new", "spam"): {"allow"}
    }
    templates = {r["template"] for r in found if r["host"] == "h"}
    assert {"news/{n}", "spam/{n}.html", "user/*/page"} <= templates


def test_similar_branches_are_merged(spark):
    rows = [(f"http://h/a/x{c}/p", int(i < 5)) for c in "bcd" for i in range(6)]
    rows += [("http://h/a/xe/p", 1)]
    judged = urls.filter_urls(spark.createDataFrame(rows, "url string, bad int"), [], F.col("bad")).collect()
    assert len({round(r["badness"], 9) for r in judged if not r["url"].endswith("xe/p")}) == 1


def plain_templates(shapes, tree=urls.Tree()):
    """Templates by host and shape, level after level, in plain Python."""
    parts = {key: [] for key in shapes}
    for level in range(max(len(shape) for _, shape in shapes)):
        children = {}
        for (host, shape), n in shapes.items():
            if level < len(shape):
                seen = children.setdefault((host, *parts[host, shape]), {})
                seen[shape[level]] = seen.get(shape[level], 0) + n
        for host, shape in shapes:
            if level < len(shape):
                seen = children[(host, *parts[host, shape][:level])]
                variable = len(seen) >= tree.many and sum(seen.values()) <= len(seen) * tree.repeats
                parts[host, shape].append(urls.ANY if variable else shape[level])
    return {key: "/".join(found) for key, found in parts.items()}


def test_wildcards_below_wildcards(spark):
    bad = [(f"http://h/u/name{a}{b}/slug-{a}{b}{c}", 1) for a in "abcdef" for b in "efghi" for c in "jk"]
    good = [(f"http://h/w/name{a}{b}/slug-{a}{b}{c}", 0) for a in "abcdef" for b in "efghi" for c in "jk"]
    df = spark.createDataFrame(bad + good, "url string, bad int")
    found = urls.filter_urls(df, [], F.col("bad")).collect()
    assert {(r["template"], r["verdict"]) for r in found} == {("u/*/*", "block"), ("w/*/*", "allow")}


def test_the_tree_decides_on_whole_pages(spark):
    # Few hosts, and paths whose second and third segments vary, out of every page's url; the label says en or de.
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    lang, name = F.substring(path, 2, 2), F.substring_index(host, ".", 1)
    kind = F.element_at(F.split(host, r"\."), -1)
    word = F.translate(F.regexp_extract(path, r"(\d+)", 1), "0123456789", "abcdefghij")
    made = F.concat(F.lit("http://"), kind, F.lit("/"), lang, F.lit("/"), word, F.lit("/"), name, word, F.lit("/p"))
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("url is not null")
    pages = pages.select("page_id", made.alias("url"), (lang == "en").cast("int").alias("bad"))
    found = urls.filter_urls(pages, [], F.col("bad")).collect()
    assert len(found) == pages.count()
    shapes = {}
    for r in found:
        key = (r["host"], tuple(re.sub(r"\d+", "{n}", r["path"]).strip("/").split("/")))
        shapes[key] = shapes.get(key, 0) + 1
    want = plain_templates(shapes)
    for r in found:
        key = (r["host"], tuple(re.sub(r"\d+", "{n}", r["path"]).strip("/").split("/")))
        assert r["template"] == want[key]
    assert any(t.count("*") > 1 for t in want.values())
    blocked = {r["template"] for r in found if r["verdict"] == "block"}
    assert blocked and all(t.startswith("en/") or t == "en" for t in blocked)


def test_counts_change_under_wildcards(spark):
    # Alone, the children of each name are variable; together "same" repeats, so they are not.
    rows = {("h", ("r", f"n{i}", s)): 1 for i in range(9) for s in ("same", "one", "two")}
    rows |= {("h", ("q", "x", f"s{i}", "t")): 1 + i % 2 for i in range(12)}
    df = spark.createDataFrame([(h, list(s), n, 0, 0) for (h, s), n in rows.items()],
                               "host string, shape array<string>, rows long, labels long, bad long")
    found = {(r["host"], tuple(r["shape"])): r["template"] for r in urls.templates(df).collect()}
    assert found == plain_templates(rows)


def test_long_paths_and_empty_tables(spark):
    df = spark.createDataFrame([("http://h/" + "a/" * 3000, 1), (None, 2)], "url string, page_id int")
    assert len(urls.filter_urls(df, URL_RULES).collect()) == 2
    assert urls.filter_urls(df.limit(0), URL_RULES).collect() == []
    assert spark.createDataFrame([], DOCS).count() == 0
