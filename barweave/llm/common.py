"""What several operators share: the shared folder, and text taken as it is or as ''."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_FOLDERS: dict[str, tuple[SparkSession, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session's own below ``spark.checkpoint.dir``, which driver and executors share.

    Where all run in one process (a local master, as in tests), a temporary folder stands in for a missing
    setting; on a cluster its lack is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = top or "file://" + tempfile.mkdtemp(prefix="barweave-")
        _FOLDERS[app] = spark, f"{top.rstrip('/')}/barweave-{app}-{uuid.uuid4().hex[:8]}"
    return _FOLDERS[app][1]


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Delete what :func:`written` wrote for ``df``, once nothing reads it any more."""
    where = getattr(df, "_barweave_path", None)
    if where:
        fs, path = _path(spark, where)
        fs.delete(path, True)


@atexit.register
def _clean() -> None:
    for spark, where in _FOLDERS.values():
        try:
            fs, path = _path(spark, where)
            fs.delete(path, True)
        except Exception:  # the session has ended already; there is nothing to delete with
            continue


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: computed once, and lineage is cut."""
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out._barweave_path = where
    return out


def left_joined(rows: DataFrame, table: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Left join of ``rows`` with ``table``, whose keys are unique, where some keys may hold a large part of all rows.

    Keys that hold a thousandth of the rows or more (so there are at most ``share`` of them) are broadcast and do not
    meet in one task; the others are shuffled. ``rows`` is read twice and should be written.
    """
    n = rows.count()
    heavy = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") >= max(1000, n / share)).select(key)
    heavy = F.broadcast(written(heavy, "heavy"))  # at most `share` rows
    common = rows.join(heavy, key, "left_semi").join(F.broadcast(table.join(heavy, key, "left_semi")), key, "left")
    return rows.join(heavy, key, "left_anti").join(table, key, "left").unionByName(common)


def whole_text(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _small_batches(spark: SparkSession) -> None:
    """At most 1000 rows in an Arrow batch, so that a run of very long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > 1000:
        spark.conf.set(key, "1000")


def _give_back() -> None:
    """A worker that has done its part returns memory that it has freed, as it stays for the stages that follow."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc: nothing to ask for
        return


_HELD: dict = {}


def held(key: tuple, make):
    """What this process has made for ``key``. It holds one thing at a time: the stages of a pipeline follow one another in the same workers."""
    if key not in _HELD:
        _HELD.clear()
        _give_back()
        _HELD[key] = make()
    return _HELD[key]


def kind_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _parsed(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def per_text(docs: DataFrame, make, made: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the columns ``made`` for every row; ``make`` takes a list of texts and returns Arrow columns."""
    _small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    schema = f"doc_id {kind_of(rows, 'doc_id')}, {made}"
    names = ["doc_id", *(f.name for f in _parsed(made).fields)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *make(batch.column(1).to_pylist())], names)
        _give_back()

    return rows.mapInArrow(run, schema)


def row_schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def filtered(docs: DataFrame, keep, text_col: str = "text") -> DataFrame:
    """Whole rows for whose text ``keep`` (a list of texts to a list of booleans) says so."""
    _small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(keep([t or "" for t in batch.column(at).to_pylist()]), pa.bool_()))
        _give_back()

    return docs.mapInArrow(run, row_schema(docs))


def extended(docs: DataFrame, make, name: str, kind: str, text_col: str = "text") -> DataFrame:
    """Whole rows with one more column, which ``make`` gives for a list of texts."""
    _small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            new = make([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, name])
        _give_back()

    return docs.mapInArrow(run, f"{row_schema(docs)}, `{name}` {kind}")
