"""Directories of key files as a Spark data source: read in pieces, pruned by identifier and label, written with commit and abort.

A file is named by its sample: an identifier, an optional class label, and a suffix that tells triplet keys from frequencies. The source
lists the directory once, drops names that the key mode does not take, refuses two files of one identifier and label, and deals
the files to tasks by bytes; a large file is cut at line ends. Filters on ``identifier``, ``label`` and ``kind`` drop files before any is
opened, where the session lets Python sources see filters (``spark.sql.python.filterPushdown.enabled``).

Rows read: (identifier, kind, label, file, at, text), ``at`` being the byte where the line begins, so that it orders the lines of a file.
Rows written: (identifier, label, text) and any further columns, which order the lines; see ``write_lines``.

Options: ``path``; ``suffix``; ``recursive`` (true or false); ``mode`` (auto, chain, no_chain, cross, or any, which takes every name);
``anywhere`` (true: the suffix may be followed by more); ``bytes`` (of a task).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from molkeys.functions.identifiers import LABELS

NAME = "keydirectory"
# Suffixes of key files.
KEYS, FREQUENCIES = ".keys_theta29_dist18", ".keys_Freq_theta29_dist18"
SCHEMA = "identifier string, kind string, label string, file string, at bigint, text string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
KINDS = {"chain": {"PDB_CHAIN", "PDB_CHAIN_GROUP"}, "no_chain": {"PDB_CHAIN_SEQ_RESIDUE"}}
KINDS |= dict.fromkeys(("auto", "cross"), KINDS["chain"] | KINDS["no_chain"]) | {"any": {"RAW"} | KINDS["chain"] | KINDS["no_chain"]}


def name_parts(name: str) -> tuple[str, str, str]:
    """(kind, identifier, label) of a file's name without suffix, by the rules of ``identifiers.parse_identifier``."""
    parts = [p.strip(" ") for p in name.split("_") if p.strip(" ")]
    label = parts[-1].upper() if len(parts) >= 4 and parts[-1].upper() in LABELS else ""
    parts = parts[:-1] if label else parts
    is_id = lambda s: re.fullmatch("[A-Za-z0-9]{4}", s)
    is_number = lambda s: re.fullmatch("-?[0-9]+[A-Za-z]?", s)
    if len(parts) >= 4 and is_id(parts[0]) and is_number(parts[2]):
        return "PDB_CHAIN_SEQ_RESIDUE", "_".join([parts[0].upper(), parts[1], parts[2], parts[3].upper()]), label
    if len(parts) >= 4 and is_number(parts[0]) and is_id(parts[1]):
        return "PDB_CHAIN_SEQ_RESIDUE", "_".join([parts[1].upper(), parts[2], parts[0], parts[3].upper()]), label
    if len(parts) == 3 and is_id(parts[0]) and not is_number(parts[2]):
        return "PDB_CHAIN_GROUP", "_".join([parts[0].upper(), parts[1], parts[2].upper()]), label
    if len(parts) == 2 and is_id(parts[0]):
        return "PDB_CHAIN", f"{parts[0].upper()}_{parts[1]}", label
    return "RAW", name.strip(" "), label


@dataclass(frozen=True)
class KeyFile:
    identifier: str
    kind: str
    label: str
    path: str
    size: int


@dataclass
class Pieces(InputPartition):
    """Stretches (file, first byte, end) of files that one task reads."""

    pieces: list[tuple[KeyFile, int, int]]


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class KeyReader(DataSourceReader):
    """Files by their listing; ``kept`` holds what filters said."""

    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", KEYS)
        self.recursive, self.anywhere = (options.get(o, "false").lower() == "true" for o in ("recursive", "anywhere"))
        self.kinds, self.bytes = KINDS[options.get("mode", "auto")], int(options.get("bytes", 32 << 20))
        self.kept: list[tuple[str, str, object]] = []

    def files(self) -> list[KeyFile]:
        """The key files of the directory in the order of their paths; two of one identifier and label are an error."""
        store, root = store_of(self.path)
        if store.get_file_info(root).type != fs.FileType.Directory:
            raise NotADirectoryError(self.path)
        found, seen = [], {}
        for info in sorted(store.get_file_info(fs.FileSelector(root, recursive=self.recursive)), key=lambda i: i.path):
            at = info.base_name.find(self.suffix) if self.anywhere else len(info.base_name) - len(self.suffix) if info.base_name.endswith(self.suffix) else -1
            if info.type != fs.FileType.File or at < 0 or re.search(r"/[_.][^/]*/", info.path[len(root) :]):
                continue
            kind, identifier, label = name_parts(info.base_name[:at])
            if kind not in self.kinds:
                continue
            if (other := seen.setdefault((identifier, label), info.path)) != info.path:
                raise ValueError(f"two key files of {identifier} {label}: {other} and {info.path}")
            found.append(KeyFile(identifier, kind, label, info.path, info.size))
        return found

    def wanted(self, file: KeyFile) -> bool:
        tests = {"=": lambda a, b: a == b, "in": lambda a, b: a in b, "starts": lambda a, b: a.startswith(b)}
        return all(tests[how](getattr(file, name), value) for name, how, value in self.kept)

    def partitions(self) -> list[Pieces]:
        out, now, room = [], [], self.bytes
        for file in filter(self.wanted, self.files()):
            for at in range(0, file.size, self.bytes):
                end = min(at + self.bytes, file.size)
                if now and end - at > room:
                    out.append(Pieces(now))
                    now, room = [], self.bytes
                now.append((file, at, end))
                room -= end - at
        return [*out, Pieces(now)]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        for file, start, end in partition.pieces:
            with store.open_input_file(file.path) as source:
                begin, lines = lines_of_piece(source, start, end)
            at = begin
            for k in range(0, len(lines), 10_000):
                block = lines[k : k + 10_000]
                places = []
                for line in block:
                    places.append(at)
                    at += len(line) + 1
                text = [line.rstrip(b"\r").decode(errors="replace") for line in block]
                same = [pa.array([v] * len(block), pa.string()) for v in (file.identifier, file.kind, file.label, file.path)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(places, pa.int64()), pa.array(text, pa.string())], names=["identifier", "kind", "label", "file", "at", "text"])


def lines_of_piece(source, start: int, end: int, step: int = 64 << 10) -> tuple[int, list[bytes]]:
    """The lines that begin in a stretch of a file, whole, and where the first of them begins."""
    begin = start
    if start:  # the line that begins before the stretch is another piece's
        begin, tail = start - 1, b""
        while (hit := tail.find(b"\n")) < 0:
            begin += len(tail)
            if not (tail := source.read_at(step, begin)):
                return end, []
        begin += hit + 1
    if begin >= end:
        return end, []
    data = source.read_at(end - begin, begin)
    while not data.endswith(b"\n"):
        more = source.read_at(step, begin + len(data))
        if not more:
            break
        cut = more.find(b"\n")
        data += more if cut < 0 else more[: cut + 1]
    return begin, data.removesuffix(b"\n").split(b"\n")


class PrunedKeyReader(KeyReader):
    """The reader that takes filters on a file's identifier, label and kind."""

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in ("identifier", "label", "kind"):
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self.kept.append((name, "=", f.value))
            elif isinstance(f, In):
                self.kept.append((name, "in", set(f.value)))
            elif isinstance(f, StringStartsWith):
                self.kept.append((name, "starts", f.value))
            elif not isinstance(f, IsNotNull):  # none of the three is ever null
                yield f


@dataclass
class Written(WriterCommitMessage):
    """The files (final name, temporary path) of a task."""

    files: list[tuple[str, str]]


class KeyWriter(DataSourceWriter):
    """Each task writes its samples into a folder of its own; the commit puts all in place, or an abort removes them."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"], options.get("suffix", KEYS), overwrite
        self.at = [columns.index(c) for c in ("identifier", "label", "text")]
        self.run = f"_run-{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        store, root = store_of(self.path)
        folder = f"{root}/{self.run}/{uuid.uuid4().hex}"  # of this attempt: one that is lost leaves nothing in place
        store.create_dir(folder, recursive=True)
        files, name, out = [], None, None
        done = set()
        try:
            for row in rows:
                identifier, label, text = (row[i] for i in self.at)
                if (own := f"{identifier}_{label}" if label else identifier) != name:
                    if own in done or "/" in own:
                        raise ValueError(f"lines of {own} are not together, or it cannot be a file's name")
                    if out:
                        out.close()
                    name, out = own, store.open_output_stream(f"{folder}/{own}{self.suffix}")
                    done.add(own)
                    files.append((f"{own}{self.suffix}", f"{folder}/{own}{self.suffix}"))
                out.write(text.encode() + b"\n")
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages) -> None:
        store, root = store_of(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [n for n, _ in files]
        twice = {n for n in names if names.count(n) > 1} if len(set(names)) < len(names) else set()
        there = {i.base_name for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(self.suffix)}
        if twice or (not self.overwrite and there & set(names)):
            self.abort(messages)
            raise ValueError(f"more than one file of {sorted(twice or there & set(names))[:3]}")
        for name in there if self.overwrite else ():
            store.delete_file(f"{root}/{name}")
        for name, path in files:
            store.move(path, f"{root}/{name}")
        store.delete_dir(f"{root}/{self.run}")

    def abort(self, messages) -> None:
        store, root = store_of(self.path)
        if store.get_file_info(f"{root}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.run}")


class KeyDirectory(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> KeyReader:
        return KeyReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> KeyWriter:
        return KeyWriter(dict(self.options), schema.names, overwrite)


class PrunedKeyDirectory(KeyDirectory):
    def reader(self, schema) -> KeyReader:
        return PrunedKeyReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session; it takes filters where the session hands them out, for it is an error to take them elsewhere."""
    pruned = (spark.conf.get(PUSHDOWN, "false") or "false").lower() == "true"
    spark.dataSource.register(PrunedKeyDirectory if pruned else KeyDirectory)


def read_lines(spark: SparkSession, path: str, suffix: str = KEYS, recursive: bool = False, mode: str = "auto", **options) -> DataFrame:
    """(identifier, kind, label, file, at, text) of the key files of a directory."""
    register(spark)
    return spark.read.format(NAME).options(suffix=suffix, recursive=str(recursive).lower(), mode=mode, **options).load(path)


def write_lines(rows: DataFrame, path: str, order: list[str], suffix: str = KEYS, mode: str = "append") -> None:
    """Write (identifier, label, text) as one file a sample, lines in the order of the given columns. A sample is one file, so one task."""
    register(rows.sparkSession)
    together = rows.repartition("identifier", "label").sortWithinPartitions("identifier", "label", *order)
    together.select("identifier", F.coalesce("label", F.lit("")).alias("label"), "text").write.format(NAME).option("suffix", suffix).mode(mode).save(path)


def write_frequencies(freq: DataFrame, path: str, mode: str = "append") -> None:
    """Frequency files of (identifier, label, key, freq)."""
    text = F.concat_ws("\t", F.col("key").cast("string"), F.col("freq").cast("string"))
    write_lines(freq.select("identifier", "label", "key", text.alias("text")), path, ["key"], FREQUENCIES, mode)


def read_frequencies(spark: SparkSession, path: str, mode: str = "any", **options) -> DataFrame:
    """(identifier, label, file, at, key, freq) of frequency files; ``at`` orders the lines of a file."""
    part = F.split("text", "\t")
    lines = read_lines(spark, path, FREQUENCIES, mode=mode, anywhere="true", **options).where(F.trim("text") != "")
    return lines.select("identifier", "label", "file", "at", F.trim(part[0]).try_cast("bigint").alias("key"), F.trim(F.get(part, F.lit(1))).try_cast("bigint").alias("freq"))


def write_records(records: DataFrame, path: str, mode: str = "append") -> None:
    """Triplet-key files of (identifier, label, the twenty fields of a key line)."""
    fields = [F.col(c).cast("string") for c in records.columns if c not in ("identifier", "label")]
    write_lines(records.select("identifier", "label", F.concat_ws("\t", *fields).alias("text")), path, ["text"], KEYS, mode)
