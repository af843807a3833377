"""Helpers shared by the corpus operators: shared folders, saved tables, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the white space that separates words.
WS = r"[\x20\x09-\x0D]"
#: Bytes that one broadcast may hold, as ``checked`` estimates them.
BROADCAST_BYTES = 48 << 20

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only where all runs on one machine may the setting be missing: a temporary folder stands in then."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, _own.get(app) or "file://" + tempfile.mkdtemp(prefix="shared-"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster ships it by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (paths, root) if x)


def save(df: DataFrame, label: str, by: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder (``by`` names a column of folders) and read it again.

    A task that is lost later re-reads the table; nothing upstream runs again."""
    spark = df.sparkSession
    importable(spark)
    path = shared_dir(spark, label)
    (df.write.partitionBy(by) if by else df.write).options(**(options or {})).parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    if _scratches:
        _scratches[-1].made.append((saved, path))
    return saved


_scratches: list[Scratch] = []


class Scratch:
    """Tables that ``save`` writes inside the block and that are not kept are deleted behind it: nothing that goes on may read
    them, neither a plan nor a repeated task. Kept ones belong to the block around it, if there is one."""

    def __init__(self) -> None:
        self.made: list[tuple[DataFrame, str]] = []
        self.kept: list[DataFrame] = []

    def keep(self, *tables: DataFrame) -> None:
        self.kept += tables

    def __enter__(self) -> Scratch:
        _scratches.append(self)
        return self

    def __exit__(self, *_) -> None:
        _scratches.remove(self)
        for table, path in self.made:
            if any(table is k for k in self.kept):
                if _scratches:
                    _scratches[-1].made.append((table, path))
                continue
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the columns file and at: where each row's content lies. What does not come from Parquet
    files is written first."""
    from pyspark.errors import AnalysisException

    where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").cast("long").alias("at")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    try:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *where)
    except AnalysisException:
        return save(rows, "content").select("doc_id", "text", *where)


def fits(small: DataFrame, most: int | None = None) -> bool:
    """Whether the rows of a saved table take at most ``most`` bytes: numbers, and the lengths of what is not one."""
    most = BROADCAST_BYTES if most is None else most
    width = F.lit(16 + 8 * len(small.columns))
    for name, kind in small.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
    return (small.agg(F.sum(width.cast("long"))).first()[0] or 0) <= most


def checked(small: DataFrame, most: int | None = None) -> DataFrame:
    """``small`` (a saved table) marked for broadcast if it ``fits``; else as it is, for a shuffled join, whose hot keys the
    adaptive planner splits."""
    return F.broadcast(small) if fits(small, most) else small


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def local_path(uri: str) -> str | None:
    """The path of a file: address (a mount that all machines share), else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def filesystem(uri: str):
    """A pyarrow file system and the path in it, for any address it can open (file, hdfs, s3, gs)."""
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)


def read_columns(files: list[str], *names: str) -> list:
    """Columns of a saved table, as numpy arrays (lists where they hold bytes), read by a worker from the shared folder."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    tables = []
    for file in files:
        fs, path = filesystem(file)
        tables.append(pq.read_table(path, filesystem=fs, columns=list(names), partitioning=None))
    whole = pa.concat_tables(tables)
    return [x.to_pylist() if pa.types.is_binary(x.type) else x.to_numpy() for x in (whole.column(n) for n in names)]


def single_thread_env() -> None:
    """Python workers share cores with others of the same executor."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["OMP_NUM_THREADS"] = "1"


#: Rows that Spark hands to a Python worker at once: the JVM and the worker both hold whole batches, and documents are long.
BATCH_ROWS = 2_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def apart(df: DataFrame) -> DataFrame:
    """The same plan in a clone of its session with shorter batches for Python; the user's session keeps its own."""
    spark = df.sparkSession
    clone = spark._jsparkSession.cloneSession()
    own = SparkSession(spark.sparkContext, clone)
    if not 0 < int(own.conf.get(ARROW_ROWS, "10000")) <= BATCH_ROWS:
        own.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    plan = df._jdf.queryExecution().logical()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(clone, plan), own)


#: Rows of an Arrow batch that are turned into Python values at once: documents are long, and values take several times
#: the room of the batch.
SLICE_ROWS = 1_000

#: What a worker keeps from one task to the next: the newest thing alone, by name, and for how many seconds without a task.
_resident: dict = {}
REST_SECONDS = 2.0
_turn = {"task": 0, "lock": threading.Lock()}


def resident(name, make):
    """``make()``, kept by this worker for its next tasks until another thing (or a task without one) takes its place, or no
    task comes for a while: idle workers stay alive beside those that work."""
    if name not in _resident:
        release()
        _resident[name] = make()
        trim()
    return _resident[name]


def release() -> None:
    """Drop what earlier tasks left in this worker, and give its memory back to the system."""
    _resident.clear()
    trim()


def trim() -> None:
    """Give memory that is free back to the system."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def worker_setup(keeps: bool = False) -> None:
    """At the start of every task: ``keeps`` says that the task has a resident thing of its own."""
    single_thread_env()
    with _turn["lock"]:
        _turn["task"] += 1
    if not keeps:
        release()


def worker_done(keeps: bool = False) -> None:
    """At the end of every task."""
    if not keeps:
        return release()
    ended = _turn["task"]

    def expire() -> None:
        with _turn["lock"]:
            if _turn["task"] == ended:  # no task has begun since
                release()

    timer = threading.Timer(REST_SECONDS, expire)
    timer.daemon = True
    timer.start()


def map_rows(df: DataFrame, schema: str, work, keeps: bool = False) -> DataFrame:
    """``work(batches)`` over Arrow batches as lists: it gets an iterator of {column: list} and yields {column: list}.

    Lists have at most ``SLICE_ROWS`` rows; nothing of one task is held beyond them unless ``work`` holds it. ``keeps``:
    ``work`` uses ``resident``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    importable(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        worker_setup(keeps)
        slices = (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS))
        lists = ({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in slices)
        try:
            for out in work(lists):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        finally:
            del slices, lists
            worker_done(keeps)

    return apart(df).mapInArrow(run, schema)


def filter_rows(df: DataFrame, column: str, work, keeps: bool = False) -> DataFrame:
    """The rows of ``df`` that ``work(values)`` says True for, with all their columns: ``values`` are up to ``SLICE_ROWS``
    values of ``column``. Each row stands for itself, so nulls, repeated rows and shared ids need no key."""
    importable(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        worker_setup(keeps)
        try:
            for b in batches:
                at = b.schema.get_field_index(column)
                mask: list[bool] = []
                for i in range(0, b.num_rows, SLICE_ROWS):
                    mask.extend(work(b.column(at).slice(i, SLICE_ROWS).to_pylist()))
                yield b.filter(pa.array(mask, pa.bool_()))
        finally:
            worker_done(keeps)

    return apart(df).mapInArrow(run, df.schema)


def stay(docs: DataFrame, key: Column, verdicts: DataFrame, twins: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay where copies go, with all their columns.

    ``verdicts`` (key, keep, doc_id, n_chars): of the rows with this key none stays (``keep`` false), or only those of this
    doc_id and number of code points; keys without a verdict stay. ``twins`` (key): more than one row would stay; the one
    whose columns come first as JSON does."""
    its, chars, keep, of, n = (f"{x}_{uuid.uuid4().hex}" for x in ("key", "chars", "keep", "id", "n"))  # docs may have any names
    own = docs.withColumns({its: key, chars: F.length(text_or_empty()).cast("long")})
    v = checked(verdicts.select(F.col("key").alias(its), F.col("keep").alias(keep), F.col("doc_id").alias(of), F.col("n_chars").alias(n)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & F.coalesce(F.col(chars) == F.col(n), F.lit(True))
    kept = own.join(v, its, "left").where(F.col(keep).isNull() | (F.col(keep) & same))
    if twins.isEmpty():
        return kept.select(*docs.columns)
    few = checked(twins.select(F.col("key").alias(its)))
    whole = F.struct(*(F.col(f"`{x}`") for x in docs.columns))
    one = kept.join(few, its, "left_semi").groupBy(its).agg(F.min_by(whole, F.to_json(whole)).alias(keep)).select(f"{keep}.*")
    return kept.join(few, its, "left_anti").select(*docs.columns).unionByName(one)


class Memory:
    """A bounded memory of computed values in two generations: when the younger one is full it becomes the older, and
    values that are asked for again move back, so common ones stay."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys) -> list:
        """Those of ``keys`` that must be computed; all others are in ``new`` now, and stay there until the next call."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        # A difference with a dict looks each key up; one with its keys() would walk through all of them.
        unknown = set(keys).difference(self.new)
        out = unknown.difference(self.old)
        unknown -= out
        self.new.update(zip(unknown, map(self.old.__getitem__, unknown)))
        return list(out)
