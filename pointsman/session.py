"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Scratch folders of local sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def build_session(app: str = "pointsman", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster leave `master` and `shuffle_partitions` unset: the submit command and
    adaptive execution decide them.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
    )
    if master:
        # A local master runs everything in the driver, whose default heap is 1 GB.
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        b = b.config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder the session names in spark.checkpoint.dir.

    Only a local session without that setting falls back to a temporary folder; on a
    cluster a machine-local folder would not be visible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        # The setting cannot be changed in a running session, so the folder is kept here.
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="pointsman-")
        _LOCAL[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/pointsman/{name}-{uuid.uuid4().hex}"


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Over all tasks: a fixed count, since adaptive execution would merge small partitions."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table written to the shared folder, and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fetched(small: DataFrame, max_rows: int = 100_000) -> DataFrame | None:
    """A summary of at most `max_rows` rows as a local table without lineage, else None.

    Summaries (cutoffs per dataset, borders per group, a lambda sweep) are referred to many
    times; fetching them once keeps later plans from repeating their whole input.
    """
    table = small.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return None
    return small.sparkSession.createDataFrame(table, small.schema)


def summary(small: DataFrame) -> DataFrame:
    """A table that is referred to many times: local if small, else written to the shared folder."""
    local = fetched(small)
    return written(small, "summary") if local is None else local


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = 100_000) -> DataFrame:
    """Join with a summary: broadcast when it has at most `max_rows` rows, shuffled otherwise."""
    local = fetched(small, max_rows)
    return big.join(small, on, how) if local is None else big.join(F.broadcast(local), on, how)
