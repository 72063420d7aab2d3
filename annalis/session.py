"""Session settings and the folder for data that Spark writes between steps."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


#: Most bytes of rows that a task hands to Python at once.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Paths staged for the table that ``staged_alone`` builds just now.
_STEPS: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("staged steps", default=None)


def build_session(app: str = "annalis", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.optimizer.windowGroupLimitThreshold": "100000",  # lists up to this length are cut before the shuffle
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the cluster's checkpoint folder.

    Only a local session may fall back to a temporary folder of the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="annalis-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, **options: object) -> DataFrame:
    """Write a table that several steps read, with ``options`` of the writer, and read it back.

    The lineage ends at files in the shared folder, so a lost executor only repeats
    reads, and no step computes the table a second time.
    """
    path = shared_folder(df.sparkSession, label)
    if (steps := _STEPS.get()) is not None:
        steps.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def staged_alone(build: Callable[[], DataFrame], label: str) -> DataFrame:
    """The table of ``build``, staged; the tables that were staged to build it are deleted then.

    Only this table may be read afterwards, so ``build`` must hand out none of its steps.
    """
    steps: list[str] = []
    token = _STEPS.set(steps)
    try:
        df = build()
    finally:
        _STEPS.reset(token)
    out = staged(df, label)
    spark = out.sparkSession
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, steps):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Tables written inside hand their rows to Python in batches of about BATCH_BYTES at most.

    Spark's own limit is a number of rows, so that whole texts of a file make one batch, which
    a task holds several times over.
    """
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before) if before is not None else spark.conf.unset(_BATCH)
