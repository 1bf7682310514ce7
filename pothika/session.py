"""Session helpers shared by all operators: lineage cuts, size-checked broadcast, salted look-ups."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured size stays below this.
BROADCAST_BYTES = 16 << 20
#: A key is hot in a look-up if it has more rows than this, and more than this share of all; so there are at most 1 / share.
HOT_ROWS, HOT_SHARE = 200_000, 1 / 200
#: Parts into which the rows of a hot key are spread.
SALTS = 16

_RUN = uuid.uuid4().hex
_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: the one that the cluster names in spark.checkpoint.dir.

    Where none is named, a local master (as in tests) gets a temporary one; on a cluster that is an error, as
    every executor would write to its own disk.
    """
    sc = spark.sparkContext
    set_before = sc._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pothika-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/pothika-{_RUN}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _delete_all() -> None:
    for folder, spark in _left.items():
        try:
            delete(spark, folder)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the files.

    The files outlive lost executors, and the plan starts afresh with their true size: checkpoint() would keep the estimate
    of the plan before, which joins multiply from round to round.
    """
    spark = df.sparkSession
    folder = _folder(spark)
    _left[folder] = spark
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_slices(slices: Iterable[DataFrame]) -> DataFrame:
    """Frames of one schema cut one after the other, as one; the shuffle files of each are deleted before the next begins, so the
    disk holds those of one at a time."""
    key, schema, paths = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None, []
    for df in slices:
        spark, schema = df.sparkSession, schema or df.schema
        folder = _folder(spark)
        _left[folder] = spark
        paths.append(f"{folder}/{uuid.uuid4().hex}")
        before = spark.conf.get(key, "false")
        spark.conf.set(key, "true")
        try:
            df.write.parquet(paths[-1])
        finally:
            spark.conf.set(key, before)
    return spark.read.schema(schema).parquet(*paths)


def cut_counting(df: DataFrame, what: Column) -> tuple[DataFrame, int]:
    """cut(df), and how many of its rows fulfil a condition, counted as they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(what).alias("n")))
    return out, seen.get["n"] or 0


def released(*cuts: DataFrame) -> None:
    """Delete the files of cuts that no later plan reads."""
    for df in cuts:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if f"pothika-{_RUN}" in folder:
                delete(df.sparkSession, folder)


def broadcast_if_small(df: DataFrame, row_bytes: int | None = None, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if its rows fit into limit, counted by a bound of their size or, without one, by twice their
    length as JSON; else df as it is.

    df should be cut or cheap, as it is read for that. The second value says which it was.
    """
    if row_bytes is None:
        small = 2 * (df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0) <= limit
    else:
        small = df.limit(limit // row_bytes + 1).count() * row_bytes <= limit
    return (F.broadcast(df), True) if small else (df, False)


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows join table on key, where a key may hold a third of rows while table has it once; how: inner, left or left_semi.

    Keys with more than hot_rows rows and a fixed share of all are few by proof, so they go to all tasks: their rows are spread over
    SALTS parts, and only their rows of the table are copied. Other keys are joined as they are. rows should be cut
    or cheap, as it is counted.
    """
    if rows.limit(hot_rows + 1).count() <= hot_rows:
        return rows.join(table, key, how)
    n = rows.count()
    hot = F.broadcast(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > max(hot_rows, n * HOT_SHARE)).select(key, F.lit(True).alias("_hot")))
    spread = [c for c in rows.columns if c != key] or [key]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    salted = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    copies = table.join(hot, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
