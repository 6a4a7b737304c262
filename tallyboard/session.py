"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


# A join that feeds a window or an aggregation on the same key is split too where a key
# is hot; Spark adds a shuffle only when it finds such a key at run time. A sort-merge join
# becomes a hash join only where every partition was measured to be below the threshold.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Tables dealt by a part of the join keys meet as they lie.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}


class Scratch:
    """What a session wrote to the shared folder: its own folder, paths and named tables."""

    def __init__(self):
        self.folder: str | None = None
        self.paths: list[str] = []
        self.tables: dict[tuple, object] = {}


_SCRATCH: weakref.WeakKeyDictionary[SparkSession, Scratch] = weakref.WeakKeyDictionary()


def scratch(spark: SparkSession) -> Scratch:
    return _SCRATCH.setdefault(spark, Scratch())


@atexit.register
def _release_all() -> None:
    for spark in list(_SCRATCH):
        release(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Session settings that the operators count on."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def get_session(cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is tested under."""
    return tune(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyboard")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as
    in local tests, is a temporary folder used, once per session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    own = scratch(spark)
    own.folder = own.folder or tempfile.mkdtemp(prefix="run-tallyboard-")
    return own.folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder, deleted by :func:`release` or at exit."""
    paths = scratch(spark).paths
    paths.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return paths[-1]


def release(spark: SparkSession) -> None:
    """Delete what this session wrote to the shared folder. Frames that read it end."""
    own = scratch(spark)
    own.tables.clear()
    paths = own.paths
    with contextlib.suppress(Exception):  # the JVM may be gone at exit
        while paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def version(spark: SparkSession, folder: str) -> str:
    """A digest of the paths, sizes and times of all files below a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame of :func:`materialize` that nothing reads any more."""
    names = {name.rsplit("/", 2)[-2] for name in df.inputFiles()}
    own, spark = scratch(df.sparkSession), df.sparkSession
    for kept in [p for p in own.paths if p.rsplit("/", 1)[-1] in names]:
        path = spark._jvm.org.apache.hadoop.fs.Path(kept)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        own.paths.remove(kept)


def spread(df: DataFrame) -> DataFrame:
    """Spread heavy row-by-row text work over all cores where the input has too few splits.

    A large input has more splits than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def stored_table(spark: SparkSession, key: tuple[str, ...], build) -> DataFrame:
    """A table written once per session under ``key`` in the shared folder, then read.

    ``key`` should hold the :func:`version` of the files that the table is made of.
    ``build`` gives the frame the first time. Many operators read the same facts; a
    stored table also survives the loss of any executor.
    """
    kept = scratch(spark).tables
    if key not in kept:
        df = build()
        path = scratch_path(spark, key[-1])
        df.write.parquet(path)
        kept[key] = (path, df.schema)
    path, schema = kept[key]
    return spark.read.schema(schema).parquet(path)
