"""A session with the settings that the operators count on; on a cluster the cluster's own settings stay."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def get_session(name: str = "sawmill", **settings: str) -> SparkSession:
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | settings
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own on a single machine, where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sawmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
