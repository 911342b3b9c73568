"""URL filters: host and path rules, and a path-template tree for what no rule decides.

The tree is built per host. Segments of a path are its levels; numbers and other variable
segments become wildcards, branches with similar shares of bad pages are merged, and a
template is rejected when its smoothed share of bad pages is too high.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import checkpointed

ALLOW, BLOCK = "allow", "block"
ANY = "*"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Tree:
    """What decides about templates.

    A node with at least ``many`` different children, on average met at most ``repeats`` times,
    has a wildcard in place of its children. Branches below one node are merged with their
    siblings if each has ``least`` labels and its bad share is within ``similar`` standard
    errors of theirs. A template is rejected if ``(bad + prior * strength) / (labels + strength)``
    is at least ``reject``.
    """

    many: int = 8
    repeats: float = 2.0
    least: int = 5
    similar: float = 1.96
    prior: float = 0.1
    strength: float = 5.0
    reject: float = 0.5


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without a host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _first_match(rules: Sequence[UrlRule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def _segments(path: Column) -> Column:
    """Path segments with every run of digits, and every long hexadecimal run, as one mark."""
    plain = F.regexp_replace(path, r"[0-9a-fA-F]{16,}|[0-9]+(?:[-_][0-9]+)*", "{n}")
    return F.split(F.regexp_replace(plain, "^/+|/+$", ""), "/+")


def generalised(shapes: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """``shapes`` (one row per host and shape) with ``parts``: its segments, variable ones as wildcards.

    Whether a node's children are variable is counted under the wildcards above it. All levels are
    counted at once, again until no part changes any more: a level is settled one round after
    those above it, so rounds follow wildcards below wildcards, not the depth of paths.
    """
    state = checkpointed(shapes.withColumn("parts", F.col("shape")))
    while True:
        nodes = state.select(
            "host", "rows", "shape", "parts", F.posexplode("shape").alias("level", "child")
        ).withColumn("node", F.xxhash64("level", F.slice("parts", F.lit(1), F.col("level"))))
        variable = (
            nodes.groupBy("host", "node", "child")
            .agg(F.sum("rows").alias("rows"))
            .groupBy("host", "node")
            .agg(F.count("*").alias("children"), F.sum("rows").alias("rows"))
            .where((F.col("children") >= tree.many) & (F.col("rows") <= F.col("children") * F.lit(tree.repeats)))
            .select("host", "node", F.lit(True).alias("variable"))
        )
        part = F.when(F.col("variable"), F.lit(ANY)).otherwise(F.col("child"))
        made = (
            nodes.drop("parts")
            .join(variable, ["host", "node"], "left")
            .groupBy("host", "shape")
            .agg(F.array_sort(F.collect_list(F.struct("level", part.alias("part")))).alias("made"))
            .select("host", "shape", F.transform("made", lambda m: m["part"]).alias("made"))
        )
        state = checkpointed(
            state.join(made, ["host", "shape"]).select(
                *shapes.columns, F.col("made").alias("parts"), (F.col("made") != F.col("parts")).alias("changed")
            )
        )
        if state.where("changed").isEmpty():
            return state.drop("changed")


def templates(shapes: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """The template of each row of host, shape (array of segments), rows, labels and bad (long).

    Adds ``template`` (string), ``branch`` (string, what it was merged to), ``badness``
    (double, the smoothed share) and ``rejected`` (boolean). ``shapes`` has one row per host
    and shape. Paths may be of any depth.
    """
    rows = generalised(shapes, tree).withColumn("depth", F.size("parts"))
    # Siblings are templates of one depth below one first segment.
    top = F.when(F.col("depth") > 1, F.element_at("parts", 1)).otherwise(F.lit(""))
    rows = rows.withColumn("top", top).withColumn("template", F.concat_ws("/", "parts"))
    siblings = ["host", "depth", "top"]
    counted = rows.groupBy(*siblings, "template").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    enough = F.col("labels") >= tree.least
    shares = (
        counted.where(enough).groupBy(*siblings).agg((F.sum("bad") / F.sum("labels")).alias("share"))
    )
    labels = F.nullif("labels", F.lit(0))
    error = F.sqrt(F.col("share") * (1 - F.col("share")) / labels)
    alike = enough & (F.abs(F.col("bad") / labels - F.col("share")) <= F.lit(tree.similar) * error)
    branch = F.when(alike, F.concat_ws("/", "top", F.lit("~"))).otherwise(F.col("template"))
    branched = counted.join(shares, siblings, "left").withColumn("branch", branch)
    badness = (F.sum("bad") + tree.prior * tree.strength) / (F.sum("labels") + tree.strength)
    judged = branched.groupBy(*siblings, "branch").agg(badness.alias("badness"))
    return (
        rows.join(branched.select(*siblings, "template", "branch"), [*siblings, "template"])
        .join(judged, [*siblings, "branch"])
        .select("host", "shape", "template", "branch", "badness")
        .withColumn("rejected", F.col("badness") >= tree.reject)
    )


def filter_urls(
    pages: DataFrame, rules: Sequence[UrlRule], bad: Column | None = None, url: str = "url", tree: Tree = Tree()
) -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and badness.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest
    one decides. Elsewhere the template does. ``bad`` is a label (1, 0 or null) for urls; where
    it is null or not given, a rule's verdict is the label, and other urls have none. A null
    url, or one without ``://``, has an empty host and path, which no rule fits. Columns with the names of the results are
    replaced; repeated rows each count. No rows, no result.
    """
    made = ["host", "path", "rule", "verdict", "template", "badness"]
    own = [c for c in pages.columns if c not in made]
    host, path = F.col("host"), F.col("path")
    rows = pages.select(*own, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumns(
        {
            "rule": _first_match(rules, host, path, lambda r: r.name),
            "__said": _first_match(rules, host, path, lambda r: r.verdict),
            "__shape": _segments(path),
        }
    )
    by_rule = F.when(F.col("__said").isNotNull(), (F.col("__said") == BLOCK).cast("int"))
    label = by_rule if bad is None else F.coalesce(bad.cast("int"), by_rule)
    shapes = rows.groupBy("host", F.col("__shape").alias("shape")).agg(
        F.count("*").alias("rows"),
        F.count(label).cast("long").alias("labels"),
        F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("bad"),
    )
    judged = templates(shapes, tree).withColumnsRenamed({"host": "__host", "shape": "__judged"})
    verdict = F.coalesce("__said", F.when(F.col("rejected"), BLOCK).otherwise(ALLOW))
    return rows.join(
        judged, (host == F.col("__host")) & (F.col("__shape") == F.col("__judged")), "left"
    ).select(*own, "host", "path", "rule", verdict.alias("verdict"), "template", "badness")
