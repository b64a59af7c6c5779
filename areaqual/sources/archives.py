"""CSV members of zip archives, as a Spark data source whose partitions are the members.

The driver reads only the directory at the end of each archive, by range, and makes one partition of every wanted
member. A task seeks to its member and unpacks it as a stream, in batches of bounded size, so neither an archive nor a
member is ever held whole. A compressed member itself cannot be split. Unpack once, store the result by year as
Parquet and query that.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from areaqual.operators import rejects

BATCH_ROWS = 50_000
LONGEST_FIELD = 1 << 27

# Fixed value: members with county or metropolitan rows, in lower case with underscores.
COUNTY_OR_METRO = "_county|_msa"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, which may be a URI of any store that pyarrow knows, and the path within it."""
    if re.match(r"file:/[^/]", path):
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[str]:
    """The files that a path names: itself, those in a directory, or those that fit a pattern in the last part."""
    store, inner = open_store(path)
    scheme = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if any(c in inner.rsplit("/", 1)[-1] for c in "*?["):
        found = [f for f in store.get_file_info(fs.FileSelector(inner.rsplit("/", 1)[0])) if fnmatch.fnmatch(f.path, inner)]
    else:
        found = [store.get_file_info(inner)]
        if found[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if found[0].type == fs.FileType.Directory:
            found = store.get_file_info(fs.FileSelector(inner))
    return sorted(scheme + f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


@dataclass
class Member(InputPartition):
    """One member of one archive."""

    path: str
    name: str

    def __init__(self, path: str, name: str) -> None:
        super().__init__(None)
        self.path, self.name = path, name


class ZipMembers(DataSource):
    """Rows of the wanted members, all columns as text.

    Options: ``paths`` and ``columns`` (JSON lists), ``wanted`` (a pattern on names in lower case with underscores),
    ``only_member`` (the archive must hold exactly that file), ``sep``, ``encoding``. Every member starts with a header
    line; columns are matched by name, and a member that lacks one, or has a line longer than its header, stops the run.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in json.loads(self.options["columns"])])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _MemberReader(dict(self.options), schema.fieldNames())


class _MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.columns = columns
        self.paths = json.loads(options["paths"])
        self.wanted = options.get("wanted", COUNTY_OR_METRO)
        self.only_member = options.get("only_member")
        self.sep, self.encoding = options.get("sep", ","), options.get("encoding", "utf-8")

    def partitions(self) -> Sequence[InputPartition]:
        found = []
        for path in (p for given in self.paths for p in _listed(given)):
            store, inner = open_store(path)
            with store.open_input_file(inner) as file, zipfile.ZipFile(file) as archive:
                found += [Member(path, n) for n in self._members([i.filename for i in archive.infolist() if not i.is_dir()], path)]
        return found or [InputPartition(None)]

    def _members(self, names: list[str], path: str) -> list[str]:
        if self.only_member is None:
            return [n for n in names if re.search(self.wanted, n.lower().strip().replace(" ", "_"))]
        if len(names) != 1:
            raise ValueError(f"{path} holds {len(names)} files, expected one")
        if names[0] != self.only_member:
            raise ValueError(f"{path} holds {names[0]}, expected {self.only_member}")
        return names

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Member):
            return
        csv.field_size_limit(LONGEST_FIELD)
        store, inner = open_store(partition.path)
        where = f"{partition.name} in {partition.path}"
        with store.open_input_file(inner) as file, zipfile.ZipFile(file) as archive, archive.open(partition.name) as raw:
            lines = csv.reader(io.TextIOWrapper(raw, self.encoding, newline=""), delimiter=self.sep)
            header = [c.strip().lstrip("\ufeff") for c in next(lines, [])]
            lacking = sorted(set(self.columns) - set(header))
            if lacking:
                raise ValueError(f"{where} lacks the columns {lacking}")
            places = [header.index(c) for c in self.columns]
            held: list[list[str | None]] = []
            for line in lines:
                if not line:
                    continue
                if len(line) > len(header):
                    raise ValueError(f"{where} has a line of {len(line)} fields, its header has {len(header)}")
                held.append([line[p] or None if p < len(line) else None for p in places])
                if len(held) >= BATCH_ROWS:
                    yield self._batch(held)
                    held = []
            if held:
                yield self._batch(held)

    def _batch(self, rows: list[list[str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=self.columns)


def read_members(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], **options: str) -> DataFrame:
    """Rows of the members of archives; see :class:`ZipMembers` for the options."""
    spark.dataSource.register(ZipMembers)
    paths = [paths] if isinstance(paths, str) else list(paths)
    given = {"paths": json.dumps(paths), "columns": json.dumps(list(columns)), **options}
    return spark.read.format(ZipMembers.name()).options(**given).load()


# The columns of the quarterly census that the rules use.
FACT_COLUMNS = ["area_fips", "area_title", "year", "industry_code", "own_code", "annual_avg_emplvl"]
FACT_TYPES = {"year": "int", "own_code": "int", "annual_avg_emplvl": "bigint"}


def read_zipped_facts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return read_members(spark, paths, FACT_COLUMNS)


def land_zipped_facts(
    spark: SparkSession, paths: str | Sequence[str], target: str, policy: rejects.Policy = rejects.KEEP
) -> None:
    """Unpack yearly archives into Parquet by year; years in ``paths`` replace earlier copies.

    Rows are brought together by year, and adaptive execution splits a year by its size into as many files as it needs.
    A year or number that is none is treated as ``policy`` says.
    """
    facts = rejects.checked(read_zipped_facts(spark, paths), FACT_TYPES, "facts", policy)
    facts = facts.withColumns({c: facts[c].try_cast(t) for c, t in FACT_TYPES.items()})
    writer = facts.hint("rebalance", "year").write
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(target)


def read_zipped_mines(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The mines archive holds exactly one pipe-delimited file."""
    return read_members(spark, paths, columns, only_member="Mines.txt", sep="|", encoding="latin-1")
