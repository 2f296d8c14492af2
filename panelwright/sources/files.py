"""Folder scans: one job over all files, the symbol is the file name without its extension."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright import schemas
from panelwright.functions.numbers import to_day, to_number
from panelwright.functions.text import padded_symbol

# A date guard for factor rows: earlier dates are placeholders.
FIRST_FACTOR_DATE = "1900-01-01"
# Files up to this size are read whole for their header.
WHOLE_BYTES = 1 << 20
# What Spark's CSV reader trims from a line to see if it is blank.
BLANKS = "".join(map(chr, range(0x21)))
# The first line of a text that holds more than blanks.
FIRST_LINE = r"(?<![^\r\n])([\x00-\x20&&[^\r\n]]*+[^\x00-\x20][^\r\n]*)"
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def file_order() -> Column:
    """Position of a row within its text file, as a long that grows with it.

    Splits of one file start at growing offsets, and ids grow within a task. The row part of the id
    (its low 33 bits) is below the bytes that the task reads, which are at most the distance to the
    next split, so offset and row add up to a growing number. It must be taken right at the scan,
    before any shuffle.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") + row


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)


def _plain(path: Column) -> Column:
    """A path as it is named in its file system; the readers' metadata have it as an encoded URI."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _symbol(path: Column) -> Column:
    """The nearest ``symbol=`` folder above a file, or else the file's name."""
    plain = _plain(path)
    folder = F.regexp_extract(plain, r".*/symbol=([^/]+)/", 1)
    return F.when(F.length(folder) > 0, folder).otherwise(_stem(plain))


def _read_text_columns(
    spark: SparkSession, path: str, names: list[str], required: set[str]
) -> DataFrame:
    """Named columns of every CSV below a folder, as text. Each file has a header of its own.

    Headers are read apart from the data. Files whose headers put the named columns in the same places
    share a layout, and each layout is one CSV scan, so every byte of data is read once and only columns
    that are used are parsed. Columns may be reordered, further ones are ignored, absent ones are NULL.
    A file without a required column fails the job; empty files add nothing.
    """
    layouts: dict[tuple[int | None, ...], tuple[int, list[str]]] = {}
    for file, line in first_lines(spark, path):
        titles = [cell.strip() for cell in next(csv.reader([line.removeprefix("\ufeff")]))]
        for name in required - set(titles):
            raise ValueError(f"missing column {name} in {file}")
        places = tuple(titles.index(name) if name in titles else None for name in names)
        width, members = layouts.get(places, (0, []))
        members.append(file)
        layouts[places] = (max(width, len(titles)), members)
    if not layouts:
        return spark.createDataFrame([], ", ".join(f"{n} string" for n in ("symbol", *names)) + ", ingest_seq long")
    parts = []
    for places, (width, members) in layouts.items():
        cells = [F.lit(None).cast("string") if at is None else F.col(f"c{at}") for at in places]
        reader = spark.read.schema(", ".join(f"c{at} string" for at in range(width)))
        with listing_tasks(spark):
            rows = reader.options(header=True, recursiveFileLookup=True).csv([_literal(file) for file in members])
        parts.append(
            rows.select(
                _symbol(F.col("_metadata.file_path")).alias("symbol"),
                *[cell.alias(name) for cell, name in zip(cells, names, strict=True)],
                file_order().alias("ingest_seq"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _literal(file: str) -> str:
    """A path without glob patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", file)


def first_lines(spark: SparkSession, path: str, threads: int = 16) -> list[tuple[str, str]]:
    """(file, first line that is not blank) of every file below a folder that has one.

    Files of at most ``WHOLE_BYTES`` give theirs to one scan over all of them: reading such a file whole
    takes little longer than opening it. Of larger ones the driver reads the beginning through Hadoop's
    file systems; nothing else of them. Which names count as hidden, and which lines as blank, is up to
    Spark's readers.
    """
    with listing_tasks(spark):
        whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = whole.where(F.col("_metadata.file_size") <= WHOLE_BYTES).select(
        _plain(F.col("_metadata.file_path")).alias("file"), F.regexp_extract("value", FIRST_LINE, 1).alias("line")
    )
    lines = [(row.file, row.line) for row in small.where("line <> ''").collect()]
    large = [row.path for row in listed.where(F.col("length") > WHOLE_BYTES).select("path").collect()]
    return sorted([*lines, *_first_lines_of(spark, large, threads)])


def _first_lines_of(spark: SparkSession, found: list[str], threads: int) -> list[tuple[str, str]]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    # Looked up once: every step of a package name is a call to the JVM.
    location_of, reader_of, stream_reader_of = (
        jvm.org.apache.hadoop.fs.Path, jvm.java.io.BufferedReader, jvm.java.io.InputStreamReader
    )
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first_line(file: str) -> tuple[str, str] | None:
        location = location_of(file)
        stream = location.getFileSystem(conf).open(location)
        try:
            codec = codecs.getCodec(location)
            bytes_ = codec.createInputStream(stream) if codec else stream
            reader = reader_of(stream_reader_of(bytes_, "UTF-8"))
            line = reader.readLine()
            while line is not None and not line.strip(BLANKS):
                line = reader.readLine()
            return None if line is None else (file, line)
        finally:
            stream.close()

    with ThreadPoolExecutor(threads) as pool:
        return [line for line in pool.map(first_line, found) if line]


@contextmanager
def listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Have Spark list many folders in a few tasks for every core, unless the session says how many.

    By default each of up to 10,000 folders is a task, which takes far longer to start than to run.
    """
    if spark.conf.get(LISTING_TASKS) != "10000":
        yield
        return
    spark.conf.set(LISTING_TASKS, str(max(32, 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.unset(LISTING_TASKS)


def read_bar_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw bars of every CSV in a folder, coerced, with ``ingest_seq`` for keep-last rules."""
    names = ["date", *schemas.PRICE_FIELDS]
    text = _read_text_columns(spark, path, names, {"date"})
    return text.select(
        "symbol",
        to_day(F.col("date")).alias("date"),
        *[to_number(F.col(name)).alias(name) for name in schemas.PRICE_FIELDS],
        "ingest_seq",
    )


def read_factor_files(spark: SparkSession, path: str) -> DataFrame:
    """Adjustment factors of every CSV in a folder, without null or placeholder dates."""
    text = _read_text_columns(spark, path, ["date", "f", "s", "u"], {"date"})
    rows = text.select(
        "symbol",
        to_day(F.col("date")).alias("date"),
        *[to_number(F.col(name)).alias(name) for name in ("f", "s", "u")],
        "ingest_seq",
    )
    return guard_factor_dates(rows)


def guard_factor_dates(factors: DataFrame) -> DataFrame:
    return factors.where(F.col("date") > F.lit(FIRST_FACTOR_DATE).cast("date"))


def read_adjusted_files(spark: SparkSession, path: str) -> DataFrame:
    """Adjusted bars of every CSV in a folder; files without rows add nothing."""
    names = schemas.column_names(schemas.ADJUSTED)[1:]
    text = _read_text_columns(spark, path, names, {"date"})
    return text.select(
        "symbol",
        to_day(F.col("date")).alias("date"),
        *[to_number(F.col(name)).alias(name) for name in names[1:]],
    )


def read_series_files(spark: SparkSession, path: str, value: str = "close") -> DataFrame:
    """(symbol, date, close) of every CSV in a folder of single-asset series, without nulls.

    All files are one scan; the first row of a date counts.
    """
    text = _read_text_columns(spark, path, ["date", value], {"date", value})
    rows = text.select(
        "symbol", to_day(F.col("date")).alias("date"), to_number(F.col(value)).alias("close"), "ingest_seq"
    ).where("date IS NOT NULL AND close IS NOT NULL")
    return rows.groupBy("symbol", "date").agg(F.min_by("close", "ingest_seq").alias("close"))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row per symbol with a CSV file: its size. The file content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option(
        "recursiveFileLookup", True
    ).load(path)
    sized = files.select(_symbol(F.col("path")).alias("symbol"), F.col("length").alias("bytes"))
    return sized.groupBy("symbol").agg(F.sum("bytes").alias("bytes"))


def count_file_rows(bars: DataFrame, inventory: DataFrame) -> DataFrame:
    """Inventory with the number of data rows in each file; files without rows count 0."""
    counted = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    return inventory.join(counted, "symbol", "left").select(
        "symbol", "bytes", F.coalesce("rows", F.lit(0).cast("long")).alias("rows")
    )


def read_catalog(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """Catalog of symbols and names: all text, nulls as empty strings, first row per symbol.

    Rows count in the order of the file, or by a column of whole numbers if the catalog is cut into
    several files.
    """
    names = schemas.column_names(schemas.CATALOG)
    sequence = F.col(order).cast("long") if order else file_order()
    return shape_catalog(
        spark.read.option("header", True).csv(path).select(*names, sequence.alias("ingest_seq"))
    )


def shape_catalog(catalog: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Six-character symbols, empty names for nulls, the first row of each symbol by ``order``."""
    order = F.col(order)
    filled = catalog.select(
        padded_symbol(F.coalesce("symbol", F.lit(""))).alias("symbol"),
        F.coalesce("name", F.lit("")).alias("name"),
        order.alias("seq"),
    )
    return filled.groupBy("symbol").agg(F.min_by("name", "seq").alias("name"))


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.QUALITY).parquet(path)


def read_quality_report(spark: SparkSession, path: str) -> DataFrame:
    """Quality table from its CSV report; unparseable dates and numbers become NULL."""
    kinds = dict(field.split() for field in schemas.QUALITY.split(","))
    text = spark.read.option("header", True).csv(path)
    return text.select(
        *[
            (to_day(F.col(name)) if kind == "date" else F.col(name).try_cast(kind)).alias(name)
            for name, kind in kinds.items()
        ]
    )


UNIVERSE_REQUIRED = ("asset", "signal_symbol", "signal_name", "defensive")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Universe configuration; raises when columns are missing or an asset repeats."""
    return validate_universe(spark.read.option("header", True).csv(path))


def validate_universe(universe: DataFrame) -> DataFrame:
    missing = set(UNIVERSE_REQUIRED) - set(universe.columns)
    if missing:
        raise ValueError(f"universe lacks columns {sorted(missing)}")
    filled = universe.na.fill("")
    repeated = filled.groupBy("asset").count().where("count > 1").limit(1)
    if not repeated.isEmpty():
        raise ValueError("universe assets must be unique")
    return filled.withColumn("defensive", F.col("defensive").cast("int"))
