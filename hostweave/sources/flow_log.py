"""Flow logs as a Spark data source, ``spark.read.format("flow_log")``.

One partition per range of a file; a task reads its file's header from the first bytes, then its own range, and parses
only the columns asked for. Columns go by the names in each file's own header, in any case and order; those that a file
lacks are null. All are text; ``read_flows`` gives them their types.

    spark.dataSource.register(FlowLogSource)
    spark.read.format("flow_log").schema("SrcAddr STRING, DstAddr STRING, scenario STRING").load("logs/")

The schema says which columns to read, whatever they are called; without one it is that of a flow log. ``scenario`` is the
name of the log up to its first dot; read by ``scan``, a filter on it leaves out the files of other scenarios unopened.

Defined cases: an empty file has no rows; a first line without the ``needed`` names (default SrcAddr,DstAddr) fails, and
so does a different header further down; a line that repeats the header is left out. A line with too few fields has nulls
at its end, with too many it loses the rest. Bytes that are no UTF-8 become replacement characters. A compressed file is
one range, and fails if it cannot be read to its end.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv as pacsv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from hostweave.sources import stores
from hostweave.sources.schema import FLOW_COLUMNS

# Most bytes read for a header, read in steps; bytes of a range; bytes parsed together.
HEAD_BYTES, HEAD_STEP = 64 << 10, 4 << 10
RANGE_BYTES = 64 << 20
BLOCK_BYTES = 8 << 20

QUIET = "\" \t\r﻿"


def names_in(line: str) -> list[str]:
    """Names in a header line, in lower case and without quotes."""
    return [name.strip(QUIET).lower() for name in line.split(",")]


def is_header(line: str, needed: Sequence[str]) -> bool:
    return {n.lower() for n in needed} <= set(names_in(line))


def first_line(head: bytes) -> str | None:
    """The first line with anything in it, if it ends within ``head``."""
    for line in re.split(rb"\r\n|\n|\r", head)[:-1]:
        text = line.decode("utf-8", "replace").lstrip("﻿")
        if text.strip():
            return text
    return None


def read_head(stream) -> str | None:
    """The first line of a file, of which at most HEAD_BYTES are read; None if there is none."""
    head = b""
    while len(head) < HEAD_BYTES:
        more = stream.read(HEAD_STEP)
        found = first_line(head + more if more else head + b"\n")
        if found is not None or not more:
            return found
        head += more
    raise ValueError(f"no line ends within {HEAD_BYTES} bytes")


def open_range(file: str):
    """The file for reading; a compressed one can only be read from its start."""
    store, path = stores.store(file)
    return store.open_input_stream(path, compression="detect") if stores.is_packed(file) else store.open_input_file(path)


def scenario_of(file: str) -> str:
    """As ``columns.scenario_of``."""
    name = re.search(r"([^/.]+)(\.[^/]*)?(/part-[^/]*)?$", file)
    return re.sub("^scenario=", "", name[1]) if name else ""


@dataclass
class FlowRange(InputPartition):
    """Lines that start at ``start`` or later and before ``end`` (None: all)."""

    file: str
    start: int
    end: int | None


def line_blocks(stream, start: int, end: int | None) -> Iterator[bytes]:
    """The lines of a range, some MB at a time; a line belongs to the range in which it starts."""
    at = max(start - 1, 0)
    if end is not None:
        stream.seek(at)
    first, held, aligned = at, b"", start == 0
    while True:
        data = stream.read(BLOCK_BYTES if end is None else max(min(BLOCK_BYTES, end - at), HEAD_STEP))
        if not data:
            break
        held += data
        at += len(data)
        if not aligned:
            cut = held.find(b"\n") + 1
            if not cut:
                first, held = at, b""
                if at >= end:
                    return
                continue
            first, held, aligned = first + cut, held[cut:], True
        if end is not None and first >= end:
            return
        if end is not None and at >= end:
            cut = held.find(b"\n", max(end - 1 - first, 0)) + 1
            if cut:
                yield held[:cut]
                return
            continue
        cut = held.rfind(b"\n") + 1
        if cut:
            yield held[:cut]
            first, held = first + cut, held[cut:]
    if held and aligned and (end is None or first < end):
        yield held


def parse(block: bytes, names: list[str], wanted: list[str], needed: list[str], file: str) -> pa.Table:
    """Columns of a block of lines as text, without lines that repeat the header."""
    odd: list[str] = []

    def keep(row) -> str:
        odd.append(row.text)
        return "skip"

    used = [n for n in names if n in {*wanted, *needed}]
    try:
        read = pacsv.read_csv(
            pa.BufferReader(block),
            pacsv.ReadOptions(column_names=names, use_threads=False, block_size=max(len(block), 1 << 10)),
            pacsv.ParseOptions(invalid_row_handler=keep),
            pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), include_columns=used, null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=False),
        )
    except pa.ArrowInvalid as error:
        if "UTF8" in str(error) or "UTF-8" in str(error):
            return parse(block.decode("utf-8", "replace").encode(), names, wanted, needed, file)
        if "Empty CSV" not in str(error) or odd:
            raise
        read = pa.table({n: pa.array([], pa.string()) for n in used})
    if odd:
        rows = [(row + [None] * len(names))[: len(names)] for row in csv.reader(odd)]
        more = {n: pa.array([r[i] or None for r in rows], pa.string()) for i, n in enumerate(names) if n in used}
        read = pa.concat_tables([read, pa.table({n: more[n] for n in used})])
    # few blocks have a header in them
    low = block.lower()
    if needed[0].lower().encode() in low:
        for line in re.split(rb"\r\n|\n|\r", block):
            if needed[0].lower().encode() in line.lower():
                text = line.decode("utf-8", "replace")
                if is_header(text, needed) and names_in(text) != names:
                    raise ValueError(f"{file}: 2 different headers with {', '.join(needed)}")
        again = None
        for n in needed:
            same = pc.fill_null(pc.equal(pc.utf8_lower(pc.utf8_trim(read.column(n), QUIET)), n), False)
            again = same if again is None else pc.and_(again, same)
        read = read.filter(pc.invert(again))
    return read


class FlowLogReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.fields = [f.name for f in schema.fields]
        if any(f.dataType.simpleString() != "string" for f in schema.fields):
            raise ValueError("a flow log has columns of text")
        path = options.get("path") or "[]"
        self.paths = json.loads(path) if path.startswith("[") else [path]
        self.needed = [n.strip().lower() for n in options.get("needed", "SrcAddr,DstAddr").split(",")]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.scenarios: set[str] | None = None

    def partitions(self) -> Sequence[FlowRange]:
        out = []
        for path in self.paths:
            for file, size in stores.files_under(path):
                if self.scenarios is not None and scenario_of(file) not in self.scenarios:
                    continue
                if stores.is_packed(file):
                    out.append(FlowRange(file, 0, None))
                else:
                    out += [FlowRange(file, a, min(a + self.range_bytes, size)) for a in range(0, size, self.range_bytes)]
        return out

    def read(self, partition: FlowRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        with open_range(partition.file) as stream:
            header = read_head(stream)
        if header is None:
            return
        if not is_header(header, self.needed):
            raise ValueError(f"{partition.file}: 0 different headers with {', '.join(self.needed)}")
        names = names_in(header)
        if len(set(names)) < len(names):
            raise ValueError(f"{partition.file}: the header repeats a name")
        wanted = [f.lower() for f in self.fields]
        scenario = scenario_of(partition.file)
        with open_range(partition.file) as stream:
            for block in line_blocks(stream, partition.start, partition.end):
                table = parse(block, names, wanted, self.needed, partition.file)
                n = table.num_rows
                columns = []
                for name in wanted:
                    if name in names:
                        columns.append(table.column(name))
                    else:
                        columns.append(pa.chunked_array([pa.array([scenario if name == "scenario" else None] * n, pa.string())]))
                yield from pa.table(columns, self.fields).to_batches()


class PruningReader(FlowLogReader):
    """Leaves out files by a filter on the scenario; only for sessions that push filters to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("scenario",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.scenarios = values if self.scenarios is None else self.scenarios & values
            else:
                yield f


class FlowLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flow_log"

    def schema(self) -> str:
        return ", ".join(f"{header} STRING" for header, _, _ in FLOW_COLUMNS) + ", scenario STRING"

    def reader(self, schema: StructType) -> FlowLogReader:
        return (PruningReader if self.options.get("prune") == "true" else FlowLogReader)(schema, self.options)


def scan(spark: SparkSession, path: str | list[str], columns: Sequence[str], needed: Sequence[str] = ("SrcAddr", "DstAddr"), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The named columns of all logs under the paths as text, and ``scenario``."""
    spark.dataSource.register(FlowLogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = ", ".join(f"`{c}` STRING" for c in [*columns, "scenario"])
    reader = spark.read.format("flow_log").option("needed", ",".join(needed)).option("rangeBytes", range_bytes).option("prune", "true")
    return reader.schema(schema).load(json.dumps([path] if isinstance(path, str) else list(path)))
