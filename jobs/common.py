"""What the jobs share: configuration files, logs, and tables that may not be there yet (in any store that Spark reads)."""

from __future__ import annotations

import json
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger("foliary.jobs")


def read_config(path: str) -> dict:
    """A small JSON file on the machine that the command line runs on."""
    with open(path) as file:
        return json.load(file)


def stored(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table that an earlier run may have written; empty where there is none."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def begin_log() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
