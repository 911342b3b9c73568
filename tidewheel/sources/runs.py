"""Result folders of benchmark runs: exit states and per-host metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Lines before the header of a host metrics file, and the columns read from it; fixed values.
METRIC_PREAMBLE_LINES = 6
METRIC_COLUMNS = ("usr", "sys", "idl", "wai", "hiq", "siq", "recv", "send", "read", "writ")

_RUN_FOLDER = r"(?:^|[/=])([^/=]+)\.top(\d{3})\.run(\d{2})(?:/|$)"


def _run_of(path) -> list:
    """Experiment, scale-out and run that a folder is named after; all null if it has another name."""

    def part(group: int):
        return F.when(path.rlike(_RUN_FOLDER), F.regexp_extract(path, _RUN_FOLDER, group))

    return [part(1).alias("suite"), part(2).cast("int").alias("nodes"), part(3).cast("int").alias("run")]


def read_run_states(
    spark: SparkSession, suite_dir: str, state_file: str = "state.json"
) -> tuple[DataFrame, DataFrame]:
    """``(suite, nodes, run, runtime_ms)`` of runs that ended well, and ``(suite, nodes, run, exit_code, folder)`` of the rest.

    Reads the state file in every ``<suite>.topNNN.runNN`` folder below ``suite_dir``; experiments
    may share scale-outs and runs. The rest are runs with another exit code, with none (null),
    and folders with another name, such as ``x.top004.run01.bak``, which have a folder only.
    """
    path = F.col("_metadata.file_path")
    states = (
        spark.read.schema("runExitCode int, runTime bigint")
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(f"{suite_dir.rstrip('/')}/*.top*.run*/{state_file}")
        .select(*_run_of(path), F.element_at(F.split(path, "/"), -2).alias("folder"), "runExitCode", "runTime")
    )
    ended_well = F.col("runExitCode").eqNullSafe(F.lit(0)) & F.col("suite").isNotNull()
    runs = states.filter(ended_well).select("suite", "nodes", "run", F.col("runTime").alias("runtime_ms"))
    exit_code = F.when(F.col("suite").isNotNull(), F.col("runExitCode")).alias("exit_code")
    return runs, states.filter(~ended_well).select("suite", "nodes", "run", exit_code, "folder")


def read_host_metrics(
    spark: SparkSession,
    run_dir: str,
    master: str,
    logs: str = "logs/dstat/*/*.csv",
    host_pattern: str = r"([^/.\-]+)(?:\.[^/]*)?\.csv$",
) -> DataFrame:
    """``(suite, nodes, run, host, seq, usr ... writ)``: one row per sample line of every host but the master.

    ``run_dir`` is one run folder or a pattern over many, and the first group of
    ``host_pattern`` finds the host in the path of a file. Files are read block by block, by as many
    tasks as Spark makes of them: lines are counted within their block, and a file's blocks are
    numbered from its start by their counts. Columns are found by their names in the header.
    Files below folders that are not named ``<suite>.topNNN.runNN`` are left out.
    """
    path = F.col("_metadata.file_path")
    host = F.regexp_extract(path, host_pattern, 1)
    # The lines of a block follow each other in one partition, so their numbers there are in a row.
    lines = (
        spark.read.text(f"{run_dir.rstrip('/')}/{logs}")
        .select(
            path.alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"),
            F.replace("value", F.lit('"'), F.lit("")).alias("line"),
            *_run_of(path),
            host.alias("host"),
        )
        .filter((F.col("host") != master) & F.col("suite").isNotNull())
    )
    blocks = lines.groupBy("path", "block").agg(F.min("place").alias("first"), F.count("*").alias("lines"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0))).drop("lines")
    number = F.col("before") + F.col("place") - F.col("first")
    numbered = lines.join(blocks, ["path", "block"]).withColumn("number", number)
    headers = numbered.filter(F.col("number") == METRIC_PREAMBLE_LINES).select("path", F.split("line", ",").alias("header"))
    samples = numbered.filter((F.col("number") > METRIC_PREAMBLE_LINES) & (F.trim("line") != ""))
    values = samples.join(headers, "path").withColumn("values", F.split("line", ","))
    # The first of several columns of one name is taken.
    return values.select(
        "suite",
        "nodes",
        "run",
        "host",
        (F.col("number") - (METRIC_PREAMBLE_LINES + 1)).cast("int").alias("seq"),
        *[
            F.element_at("values", F.array_position("header", name).cast("int")).cast("double").alias(name)
            for name in METRIC_COLUMNS
        ],
    )
