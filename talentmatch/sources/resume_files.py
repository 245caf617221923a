"""résumé files -> text.

Tasks list and read the files, ``binaryFile`` where they cannot; admission,
decoding and the fallback from a format reader to the plain decode are column
expressions.  Format readers are those of :mod:`formats`; text extracted
upstream can take their place as a column.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmatch.functions import constants as K
from talentmatch.sources.formats import READERS, extracted_text


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot ('' when none)."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))


def admitted(name: Column, size: Column) -> Column:
    """Non-empty name with a dot, extension pdf/docx/txt (any case)
    and at most 16 MiB."""
    ok_ext = F.coalesce(extension(name).isin(list(K.ALLOWED_EXTENSIONS)), F.lit(False))
    return (F.coalesce(name != "", F.lit(False)) & ok_ext
            & F.coalesce(size <= K.MAX_UPLOAD_BYTES, F.lit(False)))


def too_large(size: Column) -> Column:
    """Over 16 MiB: the whole request is refused, its form with it."""
    return F.coalesce(size > K.MAX_UPLOAD_BYTES, F.lit(False))


#: Two noncharacters that stand for a genuine U+FFFD while bad bytes are dropped.
_KEPT = "\ufdd0\ufdd1"


def decode_text(content: Column) -> Column:
    """A4: UTF-8 decode dropping undecodable bytes; CRLF and CR become LF.

    Valid input is used as is; invalid sequences are replaced by U+FFFD by
    ``make_valid_utf8`` and then removed, a U+FFFD that the file itself holds
    being kept."""
    bad = F.lit("\ufffd")
    raw = content.cast("string")
    dropped = F.replace(F.make_valid_utf8(F.replace(raw, bad, F.lit(_KEPT))), bad, F.lit(""))
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(dropped, F.lit(_KEPT), bad))
    return F.regexp_replace(text, "\r\n?", "\n")


def with_fallback(extracted: Column, decoded: Column) -> Column:
    """A5: text from a format reader when it produced one, else the plain
    decode of the same bytes."""
    return F.coalesce(extracted, decoded)


def file_text(name: Column, content: Column, readers: Mapping[str, Callable[[bytes], str]] = READERS) -> Column:
    """A4 and A5: the text of a file by its format's reader, else decoded."""
    return with_fallback(extracted_text(F.coalesce(extension(name), F.lit("")), content, readers), decode_text(content))


def land_texts(texts: DataFrame, id_col: str, path: str) -> None:
    """Write ``texts(id_col, text)`` under path, a file ``<id_col>=<id>.txt``
    for each id, in a folder for each task.  Spark's own writer makes a folder
    for every id, and one commit per folder costs more than the text."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def land(batches):
        where, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        folder = os.path.join(root, f"part-{TaskContext.get().partitionId()}")
        where.create_dir(folder, recursive=True)
        last, held, files = None, [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and key != last:
                    write(where, folder, last, held)
                    held, files = [], files + 1
                last = key
                held.append(text or "")
        if held:
            write(where, folder, last, held)
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    def write(where, folder, key, lines):
        with where.open_output_stream(os.path.join(folder, f"{id_col}={'' if key is None else key}.txt")) as out:
            out.write("".join(x + "\n" for x in lines).encode())

    dealt = texts.select(id_col, "text").repartition(n, id_col).sortWithinPartitions(id_col, "text")
    dealt.mapInArrow(land, "files long").agg(F.sum("files")).collect()  # one row


#: What Spark's file readers take for a pattern.
_PATTERN = set("{}[]*?\\")
#: Most rows of a batch of listed files; a batch of contents also ends at so many bytes.
_BATCH_ROWS, _BATCH_BYTES = 10_000, 4 << 20


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    """The store of a full path, and the path inside it."""
    if root.startswith("file:"):
        return fs.LocalFileSystem(), root.removeprefix("file:")
    return fs.FileSystem.from_uri(root)


def _folder(spark: SparkSession, path: str) -> str | None:
    """``path`` in full, as Spark's readers name it, where it is a folder that
    tasks can list: no pattern, and in a store that pyarrow opens."""
    if _PATTERN & set(path):
        return None
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toString().rstrip("/")
    try:
        where, base = _opened(root)
        return root if where.get_file_info(base).type == fs.FileType.Directory else None
    except (pa.ArrowException, OSError, ImportError):
        return None


def _seen(name: str, is_file: bool) -> bool:
    """False for names that Spark's file readers pass over: hidden ones, those
    of files being copied and what is not text."""
    if name.encode(errors="ignore").decode() != name:
        return False
    marked = name.startswith(".") or (name.startswith("_") and "=" not in name)
    kept = name.startswith(("_metadata", "_common_metadata"))
    return (kept or not (marked or name.endswith("._COPYING_"))) and not (is_file and marked)


def _entries(where: fs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """Names in a folder with the sizes of files, null for folders; files of
    no bytes and links to nothing are left out, as by Spark's file readers."""
    if isinstance(where, fs.LocalFileSystem):  # one entry at a time
        with os.scandir(folder) as found:
            for x in found:
                if x.is_symlink() and not os.path.exists(x.path):
                    continue
                if x.is_dir():
                    yield x.name, None
                elif x.is_file() and x.stat().st_size:
                    yield x.name, x.stat().st_size
    else:
        for x in where.get_file_info(fs.FileSelector(folder)):
            if x.type == fs.FileType.Directory or x.type == fs.FileType.File and x.size:
                yield x.base_name, x.size


def _listed(spark: SparkSession, root: str, tasks: int) -> DataFrame:
    """``(name, length)`` of the files under ``root``, each name from there on.
    One task lists the first level, all walk the folders found there; neither
    the driver nor a task holds the whole list."""
    types = {"name": pa.string(), "length": pa.int64()}

    def walk(deep: bool):
        def walked(batches):
            where, base = _opened(root)
            for batch in batches:
                for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if length is not None:
                        yield name, length
                        continue
                    folders = [name]
                    while folders:
                        at = folders.pop()
                        for x, size in _entries(where, base + at):
                            if not _seen(x, size is not None):
                                continue
                            if deep and size is None:
                                folders.append(f"{at}/{x}")
                            else:
                                yield f"{at}/{x}", size

        def run(batches):
            for rows in batched(walked(batches), _BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], [*types])

        return run

    schema = "name string, length long"
    top = spark.range(1).select(F.lit("").alias("name"), F.lit(None).cast("long").alias("length")).mapInArrow(walk(False), schema)
    return top.repartition(tasks, "name").mapInArrow(walk(True), schema).repartition(tasks, "name")


def _with_content(files: DataFrame, root: str) -> DataFrame:
    """The listed ``files`` with the bytes of those that are admitted."""

    def read(batches):
        where, base = _opened(root)

        def joined(rows, contents):
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(contents, pa.binary())], [*rows.schema.names, "content"])

        for batch in batches:
            done, contents, held = 0, [], 0
            for path, ok in zip(batch.column("path").to_pylist(), batch.column("admitted").to_pylist()):
                if held >= _BATCH_BYTES:
                    yield joined(batch.slice(done, len(contents)), contents)
                    done, contents, held = done + len(contents), [], 0
                data = None
                if ok:
                    with where.open_input_stream(base + path.removeprefix(root), compression=None) as f:
                        data = f.read()
                    held += len(data)
                contents.append(data)
            yield joined(batch.slice(done), contents)

    return files.mapInArrow(read, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema) + ", content binary")


def read_resume_files(spark: SparkSession, path: str, recursive: bool = True,
                      readers: Mapping[str, Callable[[bytes], str]] = READERS) -> DataFrame:
    """``(path, file, length, admitted, too_large, text)`` for every file
    under path; only admitted files are read, the others are listed (a huge
    file's bytes are never loaded).

    Tasks list and read a folder.  ``binaryFile``, whose list of all files is
    held by the driver, takes what they cannot: a pattern, a single file, a
    store that pyarrow does not open, and ``recursive=False``."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    root = _folder(spark, path) if recursive else None
    if root is not None:
        files = _listed(spark, root, tasks).select(F.concat(F.lit(root), "name").alias("path"), "length")
    else:
        # small files count as much as large ones when splits are cut, a few to a
        # split: a table of them would be tens of thousands of tasks
        files = (spark.read.format("binaryFile")
                 .option("recursiveFileLookup", str(recursive).lower())
                 .load(path)).coalesce(4 * tasks)
    name = basename(F.col("path"))
    ok = admitted(name, F.col("length"))
    listed = ["path", name.alias("file"), "length", ok.alias("admitted"), too_large(F.col("length")).alias("too_large")]
    if root is not None:
        files = _with_content(files.select(*listed), root)
    else:
        files = files.where((F.col("length") <= K.MAX_UPLOAD_BYTES) & ok).select(*listed, "content").unionByName(
            files.where(~ok).select(*listed, F.lit(None).cast("binary").alias("content")))
    return files.withColumn("text", file_text(F.col("file"), F.col("content"), readers)).drop("content")
