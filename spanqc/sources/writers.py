"""Writers. Spark commits each task's files, so no partial rows are seen."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(frame: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None) -> None:
    """JSON lines in UTF-8, null fields written; ``mode='append'`` adds to what is there."""
    out = frame if files is None else frame.coalesce(files)
    out.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(frame: DataFrame, path: str, mode: str = "errorifexists", report: bool = False) -> None:
    """CSV with a header; texts keep blanks at their ends. A report, which is short, goes to one file."""
    out = frame.coalesce(1) if report else frame
    out.write.mode(mode).options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_splits(records: DataFrame, path: str, info: dict | None = None, by: str = "split") -> None:
    """Records by split, and a small document about them in ``info``."""
    records.write.partitionBy(by).option("ignoreNullFields", False).json(f"{path}/{by}s")
    spark = records.sparkSession
    spark.createDataFrame([(json.dumps(info or {}, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/info")


def write_experiment(root: str, metrics: DataFrame, kinds: DataFrame | None = None, predictions: DataFrame | None = None, config: dict | None = None, gold: DataFrame | None = None, by: Sequence[str] = ("model", "dataset", "mode"), mode: str = "append") -> None:
    """An experiment's results below ``root``, in folders by model, dataset and mode: metrics, those by kind and on the gold set, predictions, configuration."""
    keys = list(by)
    metrics.coalesce(1).write.mode(mode).partitionBy(*keys).option("header", True).csv(f"{root}/metrics")
    if kinds is not None:
        kinds.coalesce(1).write.mode(mode).partitionBy(*keys).option("header", True).csv(f"{root}/metrics_by_kind")
    if gold is not None:
        gold.coalesce(1).write.mode(mode).partitionBy(*keys).option("header", True).csv(f"{root}/gold")
    if predictions is not None:
        predictions.write.mode(mode).partitionBy(*keys).option("ignoreNullFields", False).json(f"{root}/predictions")
    if config is not None:
        rows = metrics.select(*keys).distinct().withColumn("config", F.lit(json.dumps(config, sort_keys=True)))
        rows.coalesce(1).write.mode(mode).json(f"{root}/config")


def completed(root_frame: DataFrame, planned: DataFrame, by: Sequence[str] = ("model", "dataset", "mode")) -> DataFrame:
    """Planned runs with whether they have results."""
    done = root_frame.select(*by).distinct().withColumn("_done", F.lit(True))
    return planned.join(done, list(by), "left").withColumn("completed", F.coalesce("_done", F.lit(False))).drop("_done")
