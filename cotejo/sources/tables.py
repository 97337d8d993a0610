"""Tables whose cells are all text: CSV, zipped CSV, delimited text, raw grids of spreadsheets."""

from __future__ import annotations

import csv
import io
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions.text import free_name, number_of, strip

#: Cells that the CSV reader takes as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
_SNIFF_BYTES, _SNIFF_LINES = 1 << 16, 20


def sniff_encoding(head: bytes, declared: str | None = None) -> str:
    """The declared encoding if it fits, else UTF-8, else Latin-1. head may end inside a character."""
    for name in [declared] * bool(declared) + ["utf-8"]:
        try:
            head.decode(name)
            return name
        except UnicodeDecodeError as e:
            if e.start >= len(head) - 4 and len(head) >= _SNIFF_BYTES:
                return name
        except LookupError:
            continue
    return "ISO-8859-1"


def sniff_separator(head: bytes) -> str:
    """The separator of , ; | or tab that the first lines suggest, else a comma."""
    text = head[:_SNIFF_BYTES].decode("latin-1")
    try:
        return csv.Sniffer().sniff("\n".join(text.splitlines()[:_SNIFF_LINES]), delimiters=",;|\t").delimiter
    except csv.Error:
        return ","


def file_head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file or of a folder's first file, from whatever store Spark reads."""
    first = spark.read.format("binaryFile").load(path).select("path").orderBy("path").first()
    if first is None:
        return b""
    jvm, at = spark._jvm, first[0]
    target = jvm.org.apache.hadoop.fs.Path(at)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, _SNIFF_BYTES)))
    finally:
        stream.close()


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotation marks, as where a quoted cell goes on in the next line."""
    marks = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not spark.read.text(path).filter(marks % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None, missing: tuple[str, ...] = MISSING, quoted_breaks: bool | None = None) -> DataFrame:
    """All columns as text, with `_pos` in file order; missing cells are null. Separator, encoding and whether quoted cells hold
    line breaks are told or found. Files with such cells are read whole by a task each, others in splits."""
    head = file_head(spark, path) if separator is None or encoding is None else b""
    quoted_breaks = has_quoted_breaks(spark, path) if quoted_breaks is None else quoted_breaks
    df = (
        spark.read.option("header", True).option("inferSchema", False).option("sep", separator or sniff_separator(head)).option("encoding", encoding or sniff_encoding(head))
        .option("multiLine", quoted_breaks).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(path)
    )
    names = [c.lstrip("﻿") for c in df.columns]
    cells = [F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")).alias(n) for c, n in zip(df.columns, names)]
    return df.select(*cells, F.monotonically_increasing_id().alias("_pos"))


def zip_member(names: list[str]) -> str:
    """The one data file of an archive, system entries aside."""
    data = [n for n in names if not n.endswith("/") and "__MACOSX" not in n and not os.path.basename(n).startswith(".")]
    if len(data) != 1:
        raise ValueError(f"the archive should hold one file; it holds {len(data)}")
    return data[0]


def read_csv_zip(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """CSV inside a ZIP on the driver's disk, unpacked in a stream to `folder`, which executors can read."""
    with zipfile.ZipFile(path) as archive:
        member = zip_member(archive.namelist())
        target = os.path.join(folder, f"{os.path.basename(path)}.csv")
        with archive.open(member) as source, open(target, "wb") as out:
            shutil.copyfileobj(source, out, 1 << 20)
    return read_csv(spark, target)


def header_row(rows: list[list[object]], limit: int = 15) -> int:
    """Index of the row that looks most like a header: the share of distinct texts that are no numbers, a fifth ahead."""
    best, at = -1.0, 0
    width = max((len(r) for r in rows), default=1)
    for i, row in enumerate(rows[:limit]):
        texts = {str(c).strip() for c in row if c is not None and str(c).strip() and not _is_number(str(c))}
        share = len(texts) / max(1, width)
        if share > best + 0.2:
            best, at = share, i
    return at


def _is_number(text: str) -> bool:
    return number_of(text) is not None


def table_from_grid(spark: SparkSession, grid: list[list[object]]) -> DataFrame:
    """A sheet's cells as a table of text: header found, blank names numbered, repeated names told apart, empty rows and
    columns left out."""
    if not grid:
        return spark.createDataFrame([], "_pos long")
    top = header_row(grid)
    width = max(len(r) for r in grid)
    rows = [[None if c is None or str(c).strip() == "" else str(c) for c in [*r, *[None] * (width - len(r))]] for r in grid[top + 1 :]]
    keep = [j for j in range(width) if any(r[j] is not None for r in rows) or (j < len(grid[top]) and grid[top][j] not in (None, ""))]
    names: list[str] = []
    for j in keep:
        given = grid[top][j] if j < len(grid[top]) else None
        names.append(free_name(str(given).strip() if given not in (None, "") else f"column_{j + 1}", names))
    data = [(*[r[j] for j in keep], i) for i, r in enumerate(rows) if any(r[j] is not None for j in keep)]
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame(data, f"{schema}, _pos long" if names else "_pos long")


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A workbook's fullest sheet, or the named one. Needs a spreadsheet engine of pandas on the driver."""
    import pandas as pd

    sheets = pd.read_excel(path, sheet_name=None if sheet is None else [sheet], header=None, dtype=object)
    best = max(sheets.values(), key=lambda s: int(s.notna().sum().sum()))
    return table_from_grid(spark, best.where(best.notna(), None).values.tolist())


def stripped(df: DataFrame) -> DataFrame:
    """df with every text cell trimmed; blank cells stay "" as in delimited record files."""
    return df.select(*[strip(c).alias(c) if t == "string" and not c.startswith("_") else F.col(c) for c, t in df.dtypes])


def write_tables(frames: dict[str, DataFrame], path: str, limit: int | None = None, format_: str = "parquet", order: dict[str, list[str]] | None = None) -> DataFrame:
    """Each frame as a folder under path, whole, or cut to `limit` rows after its order, as worksheets need; returns (table, n_rows, written)."""
    notes = []
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        n = df.count()
        rows = df.orderBy(*order[name]) if order and name in order else df
        rows = rows.limit(limit) if limit is not None and n > limit else rows
        rows.write.mode("overwrite").format(format_).option("header", True).save(f"{path}/{name[:31]}")
        notes.append((name[:31], n, n if limit is None else min(n, limit)))
    return spark.createDataFrame(notes, "table string, n_rows long, written long")


def temporary_folder() -> str:
    """For tests and single machines."""
    return tempfile.mkdtemp(prefix="cotejo-")


def csv_bytes(rows: list[list[str]], separator: str = ",") -> bytes:
    out = io.StringIO()
    csv.writer(out, delimiter=separator).writerows(rows)
    return out.getvalue().encode()
