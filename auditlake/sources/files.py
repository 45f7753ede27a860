"""Sources: a folder tree, or any table with a path and a text column."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dims import ALL_EXTENSIONS, C_EXTENSIONS, SKIP_DIRS
from ..session import materialized

OUTPUT_DIR = "_fixed"
NON_CHARACTER = "\U0010FFFE"  # stands in for genuine U+FFFD while bad bytes are dropped


def extension(path: Column) -> Column:
    """Lower-case suffix; the leading dots of a hidden file do not start one."""
    return F.lower(F.regexp_extract(text.basename(path), r"(?s)^\.*[^.].*(\.[^.]*)$", 1))


def language_of(path: Column) -> Column:
    return F.when(extension(path).isin(C_EXTENSIONS), "c").otherwise("cpp")


def is_c_file(path: Column) -> Column:
    return extension(path).isin(C_EXTENSIONS)


def is_source(path: Column, root: str = "", extensions: Sequence[str] = ALL_EXTENSIONS,
              skip_dirs: Sequence[str] = SKIP_DIRS) -> Column:
    """Known extension and no skipped directory below ``root``."""
    below = F.substr(path, F.lit(len(root) + 1))
    parts = F.split(below, "/", -1)
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    skipped = F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in skip_dirs]))
    return extension(path).isin(list(extensions)) & ~skipped


def decode(content: Column) -> Column:
    """Bytes to text: undecodable bytes are dropped, all line ends become ``\\n``."""
    s = F.replace(content.cast("string"), F.lit("�"), F.lit(NON_CHARACTER))
    s = F.replace(F.make_valid_utf8(s), F.lit("�"), F.lit(""))
    return normalize_newlines(F.replace(s, F.lit(NON_CHARACTER), F.lit("�")))


def normalize_newlines(code: Column) -> Column:
    return F.regexp_replace(code, r"\r\n?", "\n")


def plain_path(uri: Column) -> Column:
    """A path without the scheme of local files."""
    return F.regexp_replace(uri, r"^file:/+", "/")


# ---------------------------------------------------------------- folders: listed and read by tasks

LISTING = "path string, length bigint, modified bigint, folder boolean, error string"
READ_MOST = (1 << 31) - 1 - (1 << 20)  # a text is one value of a row, which a JVM array must hold
READ_SLICE = 1 << 25


def open_store(uri: str):
    """File system and path of a uri, as pyarrow knows it. Pass another function where stores need
    settings of their own."""
    from pyarrow import fs

    scheme, colon, rest = re.sub("^file:/+", "file:///", uri).partition(":")
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}" if colon else uri)


def absolute(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark's own sources see it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def _lister(store: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def entries(uri: str) -> Iterator[tuple]:
            head = uri[:uri.index(":") + 1] if ":" in uri else ""
            try:
                system, path = store(uri)
                children = system.get_file_info(fs.FileSelector(path))
            except (OSError, ValueError) as problem:  # the folder becomes a row with its reason
                yield uri, None, None, False, str(problem)
                return
            for x in children:
                if x.type == fs.FileType.Directory and isinstance(system, fs.LocalFileSystem) and os.path.islink(x.path):
                    continue  # links to folders are not followed
                broken = x.type in (fs.FileType.NotFound, fs.FileType.Unknown)
                at = f"{uri.rstrip('/')}/{x.base_name}" if head else x.path
                yield (at, x.size, x.mtime_ns and x.mtime_ns // 1_000_000, x.type == fs.FileType.Directory,
                       "not a readable file" if broken else None)
            if isinstance(system, fs.LocalFileSystem):  # which leaves links that lead nowhere out
                for name in set(os.listdir(path)) - {x.base_name for x in children}:
                    yield f"{uri.rstrip('/')}/{name}", None, None, False, "no such file behind the link"

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                found = list(entries(uri))
                for at in range(0, len(found), 10_000):
                    columns = list(zip(*found[at:at + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                        pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], ["path", "length", "modified", "folder", "error"])
    return run


def list_files(spark: SparkSession, path: str, extensions: Sequence[str] = ALL_EXTENSIONS,
               skip_dirs: Sequence[str] = SKIP_DIRS, store: Callable = open_store) -> DataFrame:
    """path, length, modified, error of every source file below ``path`` (or of the one file):
    hidden, empty and very large files as well. A folder that cannot be listed and an entry that
    is no readable file are rows with an error.

    Folders are rows: tasks list those of one level, and the next round takes the folders that
    they found. A round is one job, so the driver sees depths, never names. Skipped names
    count below ``path`` only."""
    root = absolute(spark, path)
    info = spark.createDataFrame([(root,)], "path string").coalesce(1).mapInArrow(_kind_of(store), "folder boolean, length bigint, modified bigint, error string").first()
    if not info.folder:
        only = spark.createDataFrame([(root, info.length, info.modified, info.error)], "path string, length bigint, modified bigint, error string")
        return only.where(extension(F.col("path")).isin(list(extensions)))
    name = text.basename(F.col("path"))
    wanted = extension(F.col("path")).isin(list(extensions))
    skipped = [*skip_dirs, OUTPUT_DIR]
    level, found = spark.createDataFrame([(root,)], "path string"), []
    wide = spark.sparkContext.defaultParallelism
    while True:
        here = materialized(level.repartition(wide, "path").mapInArrow(_lister(store), LISTING))
        found.append(here.where("NOT folder").where(wanted | (F.col("error").isNotNull() & F.col("length").isNull())))
        level = here.where("folder").where(~name.isin(skipped)).select("path")
        if level.isEmpty():
            break
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.select("path", "length", "modified", "error")


def _kind_of(store: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                folder, length, modified, error = False, None, None, None
                try:
                    system, path = store(uri)
                    x = system.get_file_info(path)
                    folder, length = x.type == fs.FileType.Directory, x.size
                    modified = x.mtime_ns and x.mtime_ns // 1_000_000
                    error = "no such file or folder" if x.type == fs.FileType.NotFound else None
                except (OSError, ValueError) as problem:
                    error = str(problem)
                yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([length], pa.int64()), pa.array([modified], pa.int64()),
                                                  pa.array([error], pa.string())], ["folder", "length", "modified", "error"])
    return run


def _reader(store: Callable, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(uri: str, error: str | None) -> tuple[bytes | None, str | None]:
            if error is not None:
                return None, error
            try:
                system, path = store(uri)
                with system.open_input_stream(path) as stream:
                    parts, size = [], 0
                    while part := stream.read(READ_SLICE):
                        size += len(part)
                        if size > most:
                            return None, f"larger than {most} bytes"
                        parts.append(part)
                return b"".join(parts), None
            except (OSError, ValueError) as problem:  # the file becomes a row with its reason
                return None, str(problem)

        for batch in batches:
            for uri, error in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content, error = read(uri, error)
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([content], pa.binary()), pa.array([error], pa.string())],
                                                 ["path", "content", "error"])
    return run


def read_listed(listed: DataFrame, store: Callable = open_store, most: int = READ_MOST) -> DataFrame:
    """file_path, language, code, error of listed files (``path`` and ``error``), read by tasks. A
    file that cannot be opened, or is larger than ``most``, has a null code and its reason."""
    read = listed.select("path", "error").mapInArrow(_reader(store, most), "path string, content binary, error string")
    return read.select(plain_path(F.col("path")).alias("file_path"), language_of(F.col("path")).alias("language"),
                       decode(F.col("content")).alias("code"), "error")


def load_files(spark: SparkSession, path: str, extensions: Sequence[str] = ALL_EXTENSIONS,
               skip_dirs: Sequence[str] = SKIP_DIRS, store: Callable = open_store, most: int = READ_MOST) -> DataFrame:
    """file_path, language, code, error of every source file below ``path`` (or of one file), empty
    ones and hidden names as well. ``path`` may be relative or have a scheme. What cannot be
    listed or read has a null code and a reason, which ``errors`` reports."""
    listed = list_files(spark, path, extensions, skip_dirs, store)
    return read_listed(spread(listed), store, most)


def spread(listed: DataFrame) -> DataFrame:
    """Names dealt out again, a few for each task, since the files behind them are heavy."""
    return listed.repartition(4 * listed.sparkSession.sparkContext.defaultParallelism, "path")


def from_table(df: DataFrame, path: str, code: str) -> DataFrame:
    """Any table of paths and texts as files."""
    return df.select(F.col(path).alias("file_path"), language_of(F.col(path)).alias("language"),
                     normalize_newlines(F.col(code)).alias("code"))


def valid(files: DataFrame) -> DataFrame:
    return files.where(F.col("file_path").isNotNull() & F.col("code").isNotNull())


def errors(files: DataFrame) -> DataFrame:
    """Rows that cannot be scanned, with the reason; the scan goes on without them."""
    reason = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    return files.where(F.col("file_path").isNull() | F.col("code").isNull()).select(
        "file_path", F.concat(F.coalesce("file_path", F.lit("")), F.lit(": "), F.when(F.col("file_path").isNull(), "no path")
                              .otherwise(F.coalesce(reason, F.lit("no text")))).alias("error"))
