"""What the operators of this subpackage share: tables, shared storage, text expressions and distributed ranks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the contracts: white space is space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session names none (local tests) a temporary folder of this machine takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = there.get() if there.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cotejo-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: short lineage, nothing on one executor only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cotejo/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._cotejo_path = path
    return stored


def release(*stored: DataFrame) -> None:
    """Delete tables of stage_table that no later plan reads, and let Spark drop the shuffle files of finished jobs."""
    for df in stored:
        path = getattr(df, "_cotejo_path", None)
        if path:
            remove_folder(df.sparkSession, path)
    give_back()
    if stored:
        stored[0].sparkSession._jvm.System.gc()


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as df needs to have no such column (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Files that are numbered by a broadcast table of their paths; tables of more files are stored once with their numbers.
MAX_FILES = 100_000
_FILE_ROWS = 1 << 40


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a row number `name` that is the same in every job that reads the result, however files are split.

    Rows of a Parquet scan have their file's number and their place in the file, which readers know; nothing is written. Any
    other plan is stored once, with numbers given on the way. docs must not have a column `name`.
    """
    path, place = fresh(docs, "_file_path"), fresh(docs, "_file_row")
    located = files = None
    if "_metadata#" in docs._jdf.queryExecution().analyzed().metadataOutput().toString():
        try:
            located = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
            files = [r[0] for r in located.select(path).distinct().limit(MAX_FILES + 1).collect()]
        except AnalysisException:  # files of a kind whose readers give no places
            pass
    if files is None or len(files) > MAX_FILES:
        return stage_table(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    if len(files) <= 1:
        return located.withColumn(name, F.col(place)).drop(path, place)
    numbers = docs.sparkSession.createDataFrame([(f, i * _FILE_ROWS) for i, f in enumerate(sorted(files))], f"`{path}` string, `{name}` long")
    return located.join(F.broadcast(numbers), path).withColumn(name, F.col(name) + F.col(place)).drop(path, place)


#: Rows up to which a stored table of a few columns of bounded width (about 50 bytes) is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 1_000_000


def small_side(stored: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """stored, marked for broadcast if it has at most `rows` rows."""
    return F.broadcast(stored) if stored.count() <= rows else stored


def arrow_batches(spark: SparkSession, rows: int) -> None:
    """Bound what one Arrow batch of whole texts holds in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives freed memory back to the system when its task ends, since workers live on between tasks."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return task


def give_back() -> None:
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of text, in order."""
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Texts of one byte a character take the cheap way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def seeded_hash(seed: int, *keys: Column) -> Column:
    """60 uniform bits from md5 of "seed:key...", which any SQL engine can form again."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_slice(h: Column, slices: int) -> Column:
    """Slice 0 to slices - 1 of a 60-bit hash, in the hash's own order."""
    return F.floor(F.shiftright(h, 30) * F.lit(slices) / F.lit(1 << 30)).cast("int")


def with_ranks(df: DataFrame, groups: list[str], piece: Column, order: list[str], rank: str, total: str) -> DataFrame:
    """Add each row's 0-based rank within its group, and the group's number of rows.

    piece cuts a group into ordered pieces: it rises with `order` and keeps pieces small, so no task ever sorts a whole
    group. Rank = rows of the earlier pieces + rank within the piece. Only the counts of the pieces meet per group, and
    their number is bounded by the caller. df is read twice: pass a stored table. groups must not be null.
    """
    at = df.withColumn("_piece", piece)
    counts = at.groupBy(*groups, "_piece").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *groups,
        "_piece",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(Window.partitionBy(*groups)).alias(total),
    )
    within = F.row_number().over(Window.partitionBy(*groups, "_piece").orderBy(*order))
    ranked = at.withColumn("_within", within).join(starts, [*groups, "_piece"])
    return ranked.withColumn(rank, F.col("_start") + F.col("_within") - 1).drop("_piece", "_within", "_start")
