"""Results that several later steps read: written once, to the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame

#: Spark's setting: what a query shuffled is deleted when the query ends, not when the driver next collects its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` checkpointed: its rows are written to the shared folder, its lineage is cut, and what was shuffled to make it is
    deleted. Where the folder is unset, a session within one machine gets a temporary one; elsewhere that is an error, as executors
    could not read it."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = f"file://{tempfile.mkdtemp(prefix='tidemill-')}"
        spark.sparkContext.setCheckpointDir(found)
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        return df.select("*").checkpoint()  # the setting holds for frames made under it
    finally:
        spark.conf.set(RELEASE, before)
