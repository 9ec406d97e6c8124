"""FASTQ files: a reader that splits plain files exactly, a data source, and writers."""

from __future__ import annotations

import gzip
import io
import re
from pathlib import PurePath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.operators.evaluate import paired
from readloom.operators.split import split_by_barcodes
from readloom.session import Scratch, ship

SCHEMA = "file_idx int, read_idx bigint, header string, seq string, plus string, qual string"
MAX_LINE = 100_000
SPLIT_BYTES = 64 << 20
#: Tasks of a scan at most; beyond that the ranges grow.
MAX_TASKS = 20_000


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local name or of a URI (file, hdfs, s3, gs and what else pyarrow reads)."""
    if re.match("file:/[^/]", path):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str) -> io.BufferedReader:
    where, name = located(path)
    return open(name, "rb") if isinstance(where, fs.LocalFileSystem) else io.BufferedReader(where.open_input_file(name), 1 << 20)


def size_of(path: str) -> int:
    where, name = located(path)
    info = where.get_file_info(name)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def is_gzip(path: str) -> bool:
    """By the two magic bytes, whatever the file is called."""
    with opened(path) as f:
        return f.read(2) == b"\x1f\x8b"


def _line(raw: bytes, zipped: bool, limit: int, path: str) -> str:
    """One LF is dropped, then one CR; a CR on the last, unended line of a gzip file stays."""
    ended = raw.endswith(b"\n")
    if ended:
        raw = raw[:-1]
    if raw.endswith(b"\r") and (ended or not zipped):
        raw = raw[:-1]
    if len(raw) > limit:
        raise ValueError(f"{path} has a line of more than {limit} bytes")
    return raw.decode("utf-8", "replace")


def records(path: str, start: int, end: int | None, first_line: int, limit: int = MAX_LINE):
    """(read_idx, four lines) of the records whose header starts in [start, end); first_line counts the line ends before ``start``.

    A record is four lines, and an incomplete one at the end of the file is dropped. Whether a line
    starts a record follows from its number alone, as ``@`` may start a quality line too.
    """
    zipped = start == 0 and is_gzip(path)
    with opened(path) as raw_file, (gzip.open(raw_file, "rb") if zipped else raw_file) as f:
        at, number = 0, 0
        if start:
            f.seek(start - 1)
            skipped = f.readline()
            number = first_line + (0 if skipped == b"\n" else 1)
            at = start - 1 + len(skipped)
        while number % 4:
            skipped = f.readline()
            if not skipped:
                return
            number, at = number + 1, at + len(skipped)
        while end is None or at < end:
            raw = [f.readline(limit + 3) for _ in range(4)]
            if not raw[3]:
                if any(len(x) > limit + 2 for x in raw):
                    raise ValueError(f"{path} has a line of more than {limit} bytes")
                return
            at += sum(map(len, raw))
            yield number // 4, *(_line(x, zipped, limit, path) for x in raw)
            number += 4


def _count_lines(batches):
    for b in batches:
        counts = []
        for path, start, end in zip(*(c.to_pylist() for c in b.columns[1:4])):
            n = 0
            with opened(path) as f:
                f.seek(start)
                left = end - start
                while left > 0 and (block := f.read(min(left, 1 << 20))):
                    n += block.count(b"\n")
                    left -= len(block)
            counts.append(n)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64())], names=["file_idx", "start", "n"])


def _read_ranges(limit: int):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int32(), pa.int64(), *[pa.string()] * 4]

    def run(batches):
        for b in batches:
            for idx, path, start, end, first in zip(*(c.to_pylist() for c in b.columns)):
                rows = []
                for r in records(path, start, end, first, limit):
                    rows.append((idx, *r))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def read_fastq(spark: SparkSession, paths: list[str], max_line: int = MAX_LINE, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Reads of the files in their order, columns of SCHEMA.

    Plain files are cut into byte ranges read in parallel: a first pass counts line ends by range, so
    every range knows the number of its first line and with it where records start. Gzip files
    cannot be cut and take one task each. Paths are local names or URIs all executors can read.
    """
    ship(spark)
    sizes, zipped = [size_of(p) for p in paths], [is_gzip(p) for p in paths]
    split_bytes = max(split_bytes, sum(sizes) // MAX_TASKS)
    ranges = []
    for i, path in enumerate(paths):
        step = max(1, sizes[i]) if zipped[i] else split_bytes
        for start in range(0, max(1, sizes[i]), step):
            ranges.append((i, path, start, None if zipped[i] else min(sizes[i], start + step)))
    shape = "file_idx int, path string, start bigint, end bigint"
    first: dict[tuple[int, int], int] = {}
    cut = [r for r in ranges if r[3] is not None]
    if any(r[2] for r in cut):
        made = spark.createDataFrame(cut, shape).repartition(min(len(cut), MAX_TASKS)).mapInArrow(_count_lines, "file_idx int, start bigint, n bigint")
        total = 0
        for idx, start, n in sorted(tuple(r) for r in made.collect()):
            total = total if start else 0
            first[idx, start] = total
            total += n
    rows = [(*r, first.get((r[0], r[2]), 0)) for r in ranges]
    parts = spark.createDataFrame(rows, shape + ", first_line bigint").repartition(min(max(1, len(rows)), MAX_TASKS))
    return parts.mapInArrow(_read_ranges(max_line), SCHEMA)


class _File(InputPartition):
    def __init__(self, idx: int, path: str):
        self.idx, self.path = idx, path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.limit = int(options.get("maxline", MAX_LINE))

    def partitions(self):
        return [_File(i, p) for i, p in enumerate(self.paths)]

    def read(self, part):
        for r in records(part.path, 0, None, 0, self.limit):
            yield (part.idx, *r)


class FastqSource(DataSource):
    """``spark.read.format("fastq").option("paths", "a.fastq,b.fastq.gz")``: one partition a file."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def write_fastq(lines: DataFrame, path: str, single: bool = False) -> None:
    """Writes records, given as one text of four lines each, as text files; ``single`` makes one file."""
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def record() -> Column:
    """A read as one text of four lines; a null plus is written as ``+``, other nulls as empty lines."""
    text = lambda c, d="": F.coalesce(F.col(c), F.lit(d))
    return F.concat_ws("\n", text("header"), text("seq"), text("plus", "+"), text("qual"))


def lines_of(reads: DataFrame) -> DataFrame:
    """Reads as records for ``write_fastq``."""
    return reads.select(record().alias("value"))


def write_pieces(lines: DataFrame, folder: str, name, zipped: bool = False) -> list[str]:
    """Writes (number, value) rows as one FASTQ file for each number, called ``name(number)``, and returns their paths in order.

    The order of rows within a partition is kept, and a number's rows should be in one partition. Files are
    written by the executors under the folder and then renamed, so the folder may be on any file system Spark and pyarrow know.
    """
    raw = f"{folder}/_written"
    lines.select("number", "value").write.mode("overwrite").partitionBy("number").option("compression", "gzip" if zipped else "none").text(raw)
    where, at = located(folder)
    made = {}
    for info in where.get_file_info(fs.FileSelector(f"{at}/_written", recursive=True)):
        found = re.search(r"/number=(\d+)/part-[^/]*$", info.path)
        if found and info.type == fs.FileType.File:
            if int(found[1]) in made:
                raise ValueError(f"piece {found[1]} came from several partitions")
            made[int(found[1])] = info.path
    for number, path in made.items():
        where.move(path, f"{at}/{name(number)}")
    where.delete_dir(f"{at}/_written")
    return [f"{folder}/{name(n)}" for n in sorted(made)]


def split_file(reads: DataFrame, source: str, start: int, length: int, size: int, folder: str) -> tuple[list[str], int]:
    """Cuts a barcode-sorted file into pieces ``stem_0001.fastq`` and so on of ``size`` barcodes each, gzipped if it was.

    Returns the pieces and how many reads were skipped, being too short for a barcode.
    """
    scratch = Scratch(reads.sparkSession)
    pieces = scratch.put(split_by_barcodes(reads, start, length, size))
    ordered = pieces.repartition("file_no").sortWithinPartitions("file_no", "read_idx")
    paths = write_pieces(ordered.select(F.col("file_no").alias("number"), record().alias("value")), folder, lambda n: split_name(source, n), source.endswith(".gz"))
    skipped = reads.count() - pieces.count()
    scratch.drop(pieces)
    return paths, skipped


def read_pairs(spark: SparkSession, first: list[str], second: list[str], max_line: int = MAX_LINE) -> DataFrame:
    """Reads of the first files with their mates (header2, seq2, plus2, qual2) at the same place of the second files.

    As many second files as first ones are needed; a read without a mate fails.
    """
    if len(first) != len(second):
        raise ValueError("each file of reads needs a file of mates")
    return paired(read_fastq(spark, first, max_line), read_fastq(spark, second, max_line))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Writes pairs, such as those of ``read_pairs``, as two folders ``path_1`` and ``path_2`` in the same order."""
    scratch = Scratch(pairs.sparkSession)
    done = scratch.put(pairs)
    write_fastq(lines_of(done), f"{path}_1")
    mates = done.select(*(F.col(f"{c}2").alias(c) for c in ("header", "seq", "plus", "qual")))
    write_fastq(lines_of(mates), f"{path}_2")
    scratch.drop(done)


def split_name(path: str, number: int) -> str:
    """Name of the number-th piece of a file; ``.fastq`` and ``.fq`` stay together with ``.gz``."""
    found = re.fullmatch(r"(.*?)((?:\.(?:fastq|fq))?\.[^.]*|)", PurePath(path).name)
    return f"{found[1]}_{number:04d}{found[2]}"
