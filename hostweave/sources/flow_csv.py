"""Reading flow logs and host-pair tables, and writing every result table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hostweave.functions.columns import bare_host, parse_time, scenario_of
from hostweave.operators.scale import partitions_for
from hostweave.sources import flow_log, stores
from hostweave.sources.schema import FLOW_COLUMNS

# Most tasks that open files by themselves.
FILE_TASKS = 10_000


def _opened(spark: SparkSession, files: list[str], told: Callable[[str], list[tuple]], schema: str) -> list:
    """Rows that ``told`` gives for each file, in one job whose tasks open the files by themselves."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row for file in batch.column(0).to_pylist() for row in told(file)]
            columns = list(zip(*found, strict=True)) if found else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    fields = T._parse_datatype_string(schema).fields
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    table = spark.createDataFrame([(f,) for f in files], "file STRING")
    return table.repartition(min(len(files), FILE_TASKS)).mapInArrow(rows, schema).collect()


def _headers_at_front(file: str, needed: list[str]) -> list[tuple]:
    """(file, header) of every different header in the first bytes of a file; one null if there is none."""
    with flow_log.open_range(file) as stream:
        head = stream.read(flow_log.HEAD_BYTES)
    lines = re.split(rb"\r\n|\n|\r", head)
    if len(head) >= flow_log.HEAD_BYTES:
        lines.pop()  # it may go on
    texts = [line.decode("utf-8", "replace").strip("\ufeff\r\n") for line in lines]
    found = {tuple(flow_log.names_in(t)): t for t in reversed(texts) if flow_log.is_header(t, needed)}
    return [(file, h) for h in found.values()] or ([(file, None)] if any(t.strip() for t in texts) else [])


def _headers_by_scan(spark: SparkSession, path: str | list[str], needed: list[str]) -> list[tuple]:
    """The same from all lines, for stores that only Spark can read."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    fields = F.transform(F.split(F.lower("value"), ","), lambda name: F.btrim(name, F.lit("\" \t\r\ufeff")))
    is_header = reduce(and_, [F.array_contains(fields, name.lower()) for name in needed])
    likely = F.contains(F.lower("value"), F.lit(needed[0].lower()))  # spares splitting every line
    headers = F.explode_outer(F.collect_set(F.when(likely & is_header, F.col("value"))))
    return [(r.file, r.header and r.header.strip("\ufeff\r\n")) for r in lines.groupBy("file").agg(headers.alias("header")).collect()]


def file_headers(spark: SparkSession, path: str | list[str], needed: list[str]) -> dict[str, list[str]]:
    """Files by header line. A header is a line that has all ``needed`` names in any case.

    Tasks read the first ``flow_log.HEAD_BYTES`` of each file; the scan of the rows finds other headers further down.
    Raises if a file with lines has no header there, or several different ones.
    """
    files = list(spark.read.option("recursiveFileLookup", True).text(path).inputFiles())
    if not files:
        return {}
    if all(map(stores.is_known, files)):
        rows = [tuple(r) for r in _opened(spark, files, lambda file: _headers_at_front(file, needed), "file STRING, header STRING")]
    else:
        rows = _headers_by_scan(spark, path, needed)
    by_file: dict[str, set[str]] = {}
    for file, header in rows:
        by_file.setdefault(file, set()).update([header] if header else [])
    found: dict[str, list[str]] = {}
    for file, headers in sorted(by_file.items()):
        if len(headers) != 1:
            raise ValueError(f"{file}: {len(headers)} different headers with {', '.join(needed)}")
        found.setdefault(headers.pop(), []).append(file)
    return found


def read_text_columns(spark: SparkSession, path: str | list[str], needed: list[str]) -> DataFrame:
    """All columns of CSV files with a header as text in lower-case names, plus ``scenario`` from the name of the log.

    Columns go by the names in each file's own header, in any case and order; a column that a file lacks is null there.
    A line that repeats the header, as in concatenated files, is left out. A file that cannot be read to its end fails.
    """
    parts = []
    for header, files in file_headers(spark, path, needed).items():
        names = [n.strip("\" \t\r") for n in header.split(",")]
        if len({n.lower() for n in names}) < len(names):
            raise ValueError(f"{files[0]}: the header repeats a name")
        schema = ", ".join(f"`{n}` STRING" for n in names)
        reader = spark.read.option("header", True).option("enforceSchema", True).option("ignoreCorruptFiles", False)
        part = reader.option("recursiveFileLookup", True).schema(schema).csv([unquote(f) for f in files])
        part = part.select(*[F.col(f"`{n}`").alias(n.lower()) for n in names], scenario_of(F.col("_metadata.file_path")).alias("scenario"), "_metadata")
        again = reduce(and_, [F.lower(F.btrim(n)).eqNullSafe(n) for n in map(str.lower, needed)])
        other = reduce(and_, [F.lower(F.btrim(n)).isin([x.lower() for x in names]) for n in map(str.lower, needed)])
        fails = F.raise_error(F.concat(F.col("_metadata.file_path"), F.lit(f": 2 different headers with {', '.join(needed)}"))).cast("boolean")
        parts.append(part.where(F.when(again, False).when(other, fails).otherwise(True)).drop("_metadata"))
    if not parts:
        schema = ", ".join(f"`{n.lower()}` STRING" for n in needed)
        return spark.createDataFrame([], f"{schema}, scenario STRING")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def _count_lines(file: str) -> list[tuple]:
    """(file, lines, whether it cannot be read to its end)."""
    n, last = 0, b"\n"
    try:
        with flow_log.open_range(file) as stream:
            while data := stream.read(flow_log.BLOCK_BYTES):
                n += data.count(b"\n") + data.count(b"\r") - data.count(b"\r\n") - (last == b"\r" and data[:1] == b"\n")
                last = data[-1:]
    except (OSError, EOFError) as error:
        if isinstance(error, FileNotFoundError | PermissionError):
            raise
        return [(file, None, True)]
    return [(file, n + (last not in b"\r\n"), False)]


def check_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, rows, skipped): every file under ``path``, its lines, and whether it cannot be read to its end.

    One job reads all files side by side; in stores that only Spark can read it is one job per file.
    """
    files = sorted(spark.read.option("recursiveFileLookup", True).text(path).inputFiles())
    schema = "file STRING, rows LONG, skipped BOOLEAN"
    if files and all(map(stores.is_known, files)):
        return spark.createDataFrame(sorted(map(tuple, _opened(spark, files, _count_lines, schema))), schema)
    rows = []
    for file in files:
        try:
            rows.append((file, spark.read.option("ignoreCorruptFiles", False).text(unquote(file)).count(), False))
        except Exception as error:  # a broken file fails in many ways, all inside the job
            if not re.search("EOF|gzip|zip|Zlib|Corrupt|corrupt|Checksum|FAILED_READ_FILE", str(error)):
                raise
            rows.append((file, None, True))
    return spark.createDataFrame(rows, schema)


def readable_files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Files that can be read whole; the others are left out whole, see ``check_files``."""
    return [unquote(r.file) for r in check_files(spark, path).where("NOT skipped").collect()]


def read_flows(spark: SparkSession, path: str | list[str], skip_corrupt: bool = False) -> DataFrame:
    """Typed flows of all logs under ``path``; values that do not parse become null, absent columns too.

    With ``skip_corrupt`` files that cannot be read to their end are left out whole.
    """
    raw = read_text_columns(spark, readable_files(spark, path) if skip_corrupt else path, ["SrcAddr", "DstAddr"])
    return typed(raw)


def typed(raw: DataFrame) -> DataFrame:
    """Flows from columns of text that are named as in a log, in any case."""
    there = {c.lower() for c in raw.columns}
    columns = []
    for header, name, kind in FLOW_COLUMNS:
        text = F.col(f"`{header.lower()}`") if header.lower() in there else F.lit(None).cast("string")
        if isinstance(kind, T.TimestampType):
            value = parse_time(text)
        elif isinstance(kind, T.StringType):
            value = text
        else:
            value = text.try_cast(kind)
        columns.append(value.alias(name))
    return raw.select("scenario", *columns)


def scan_flows(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Typed flows by the data source ``flow_log``; with ``columns`` (our names) only those are parsed."""
    kept = [(header, name) for header, name, _ in FLOW_COLUMNS if columns is None or name in columns]
    raw = flow_log.scan(spark, path, [header for header, _ in kept])
    return typed(raw).select("scenario", *[name for _, name in kept])


def ingest(spark: SparkSession, path: str | list[str], out: str) -> DataFrame:
    """Read the logs once and store them as Parquet by scenario; scenarios that are not in the logs stay."""
    write_table(read_flows(spark, path), out)
    return read_table(spark, out)


def read_pairs(spark: SparkSession, path: str | list[str], src: str = "source", dst: str = "destination") -> DataFrame:
    """Only the two host columns of a flow table, whatever they are called, as flows."""
    raw = read_text_columns(spark, path, [src, dst])
    ends = [bare_host(F.col(f"`{name.lower()}`")) for name in (src, dst)]
    return raw.select("scenario", ends[0].alias("src_addr"), ends[1].alias("dst_addr"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, one folder per scenario unless told otherwise; folders that get no rows stay as they are."""
    parts = partition_by if partition_by is not None else [c for c in ("scenario",) if c in df.columns]
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", False).parquet(path)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """A stored degree histogram without its empty cells."""
    return read_table(spark, path).where("n >= 1")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_flows_csv(flows: DataFrame, path: str, start: str = "StartTime") -> None:
    """CSV parts whose concatenation is in order of the start time, and of the other columns within one time."""
    order = [start, *[c for c in flows.columns if c != start]]
    # as many parts as the rows need, whatever the session's number of partitions
    parts = partitions_for(flows.sparkSession, flows.count())
    write_csv(flows.repartitionByRange(parts, *order).sortWithinPartitions(*order), path)


def write_distribution(properties: DataFrame, path: str, column: str) -> None:
    """One value of the property per line in ascending order."""
    ordered = properties.orderBy(column, "id")
    ordered.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_profile(profile: DataFrame, path: str) -> None:
    """Bot profile as whole numbers."""
    kept = [c for c in profile.columns if not c.startswith("mean_")]
    write_csv(profile.select(*[F.col(c).cast("long").alias(c) if c != "scenario" else F.col(c) for c in kept]), path)


def write_log(flows: DataFrame, path: str, headers: Sequence[str] | None = None) -> None:
    """Typed flows as flow logs that ``read_flows`` can read, one folder per scenario if there are scenarios.

    ``headers`` gives the names and order of the columns in the file, in any case.
    """
    kinds = {header.lower(): (name, kind) for header, name, kind in FLOW_COLUMNS}
    columns = []
    for header in headers or [header for header, _, _ in FLOW_COLUMNS]:
        name, kind = kinds[header.lower()]
        value = F.date_format(name, "yyyy/MM/dd HH:mm:ss.SSSSSS") if isinstance(kind, T.TimestampType) else F.col(name)
        columns.append(value.alias(header))
    keys = [c for c in ("scenario",) if c in flows.columns]
    writer = flows.select(*keys, *columns).write.mode("overwrite").option("header", True)
    (writer.partitionBy(*keys).option("partitionOverwriteMode", "dynamic") if keys else writer).csv(path)
