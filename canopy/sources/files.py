"""Readers and writers: catalogues, prediction files, listings, runs, reports and the prepared cache."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTIONS = "instance_id long, filename string, level int, label string, prediction string, confidence double, threshold double, known_label boolean"


def read_catalogue(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_predictions(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Short rows are padded with nulls."""
    return spark.read.csv(path, schema=PREDICTIONS, sep=sep, header=True, mode="PERMISSIVE", enforceSchema=True)


def write_predictions(df: DataFrame, path: str, sep: str = ",") -> None:
    df.select(*(c.split(" ")[0] for c in PREDICTIONS.split(", "))).write.csv(path, header=True, sep=sep)


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def prepared_cache(df: DataFrame, source: str, args: dict, base: str) -> DataFrame:
    """The frame as stored under a key of source, columns (the hierarchy's among them) and arguments; written on the first call."""
    key = hashlib.sha1(json.dumps({"source": source, "columns": df.columns, "args": args}, sort_keys=True).encode()).hexdigest()[:8]
    path, spark = f"{base}/key={key}", df.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small table as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_union(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in paths])


def catalogue_from_listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, class_folder, filename, size, modified for all files below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("class_folder"), F.element_at(parts, -1).alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_runs(spark: SparkSession, root: str, name: str = "config.json") -> DataFrame:
    """run_id (first two parts of the folder's name), run_dir and config, from one JSON file a run."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name).select("value", F.element_at(F.split(F.input_file_name(), "/"), -2).alias("run_dir"))
    return files.select(F.substring_index("run_dir", "-", 2).alias("run_id"), "run_dir", F.col("value").alias("config"))


def catalogue_from_predictions(pred: DataFrame, levels: Sequence[str]) -> DataFrame:
    """One row an instance with its label at each level; set is '0'."""
    cols = [F.max(F.when(F.col("level") == n, F.col("label"))).alias(c) for n, c in enumerate(levels)]
    return pred.groupBy("instance_id", "filename").agg(*cols).withColumn("set", F.lit("0"))


def read_yaml_runs(spark: SparkSession, root: str, section: str | None = None, name: str = "config.yaml") -> DataFrame:
    """run_id, run_dir, name, config (as JSON), readable: one YAML file a run, in folders <date>-<time>-<name>.

    section: take the configuration from below this key (none there: {}). A file that isn't YAML has no config and is not
    readable: the caller leaves it out or reports it. Needs PyYAML on the executors.
    """

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        def config(text: str) -> str | None:
            try:
                found = yaml.safe_load(text) or {}
            except yaml.YAMLError:
                return None
            if section is not None:
                found = (found.get(section) if isinstance(found, dict) else None) or {}
            return json.dumps(found, default=str, ensure_ascii=False)

        for frame in frames:
            yield pd.DataFrame({"run_dir": frame["run_dir"], "config": [config(t) for t in frame["value"]]})

    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name).select("value", F.element_at(F.split(F.input_file_name(), "/"), -2).alias("run_dir"))
    rest = F.substring("run_dir", F.length(F.substring_index("run_dir", "-", 2)) + 2, F.length("run_dir"))
    run_name = F.when(F.size(F.split("run_dir", "-")) > 2, rest).otherwise(F.col("run_dir"))
    return files.mapInPandas(of, "run_dir string, config string").select(F.substring_index("run_dir", "-", 2).alias("run_id"), "run_dir", run_name.alias("name"), "config", F.col("config").isNotNull().alias("readable"))
