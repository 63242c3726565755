"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows that go to Python at a time where they hold vectors or texts.
BATCH_ROWS = 1000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.inMemoryColumnarStorage.batchSize"


def build_session(app: str = "facetloom", **conf: object) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` entries win."""
    settings: dict[str, object] = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    session without one gets a folder of its own; a cluster without one is an error,
    since a folder of one machine is lost with that machine.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    current = context.getCheckpointDir()
    if shared:
        plain = shared.rstrip("/").removeprefix("file://").removeprefix("file:")
        if current is None or f"{plain}/" not in current:
            context.setCheckpointDir(shared)
        return shared
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="facetloom-checkpoint-")
    context.setCheckpointDir(own)
    return own


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with batches of ``BATCH_ROWS`` rows, for Python and in kept tables, unless the session sets another number.

    The usual ten thousand vectors or texts of some kilobytes take tens of megabytes in each of many buffers.
    """
    conf = df.sparkSession.conf
    for name in _BATCHES:
        if conf.get(name) == "10000":
            conf.set(name, str(BATCH_ROWS))
    return df


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written rows.

    Cuts lineage and fixes values that a recomputation could change.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
