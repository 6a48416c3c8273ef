"""Reading trees: compression by content, driver-side inputs, and Spark tables of trees."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import os
from collections.abc import Iterable, Mapping
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ship import ship
from .newick import split_block, validate_newick

_MAGIC = ((b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"), (b"\x28\xb5\x2f\xfd", "zstd"))


def sniff(data: bytes) -> str:
    """Format by magic bytes: gzip, bzip2, xz, zstd or text."""
    return next((name for magic, name in _MAGIC if data.startswith(magic)), "text")


def sniff_column(content: Column) -> Column:
    """The same as a built-in expression over a binary column."""
    head = F.hex(F.substring(content, 1, 6))
    out = F.lit("text")
    for magic, name in reversed(_MAGIC):
        out = F.when(head.startswith(magic.hex().upper()), name).otherwise(out)
    return out


def decompress(data: bytes, source: str = "input") -> str:
    """Text of possibly compressed bytes; ValueError naming the source if they are damaged or not UTF-8."""
    kind = sniff(data)
    try:
        if kind == "gzip":
            data = gzip.decompress(data)
        elif kind == "bzip2":
            data = bz2.decompress(data)
        elif kind == "xz":
            data = lzma.decompress(data)
        elif kind == "zstd":
            try:
                import zstandard
            except ImportError as e:
                raise ImportError(f"{source} is zstd-compressed; install zstandard to read it") from e
            parts = []
            while data:
                frame = zstandard.ZstdDecompressor().decompressobj()
                parts.append(frame.decompress(data))
                if not frame.eof:
                    raise ValueError("truncated")
                data = frame.unused_data
            data = b"".join(parts)
    except ImportError:
        raise
    except Exception as e:
        raise ValueError(f"{source}: damaged {kind} data ({e})") from e
    try:
        return str(data, "utf-8")
    except UnicodeError as e:
        raise ValueError(f"{source}: not UTF-8 text") from e


class NewickFile:
    """A path, bytes or binary stream that opens as decompressed text."""

    def __init__(self, source: str | os.PathLike | bytes | io.IOBase, label: str | None = None):
        self.source = source
        self.label = label or (str(source) if isinstance(source, (str, os.PathLike)) else "input")

    def _raw(self) -> bytes:
        if isinstance(self.source, (bytes, bytearray)):
            return bytes(self.source)
        if hasattr(self.source, "read"):
            return self.source.read()
        return Path(self.source).read_bytes()

    def detect(self) -> str:
        """Name of the format."""
        return sniff(self._raw())

    @staticmethod
    def decompress_bytes(data: bytes, label: str = "input") -> str:
        """Text of the bytes."""
        return decompress(data, label)

    def read(self) -> str:
        """The whole text."""
        return decompress(self._raw(), self.label)

    def __enter__(self) -> io.StringIO:
        self._text = io.StringIO(self.read())
        return self._text

    def __exit__(self, *exc) -> None:
        self._text.close()


def _file(path: str | os.PathLike) -> list[str]:
    try:
        text = NewickFile(path).read()
    except OSError as e:
        raise ValueError(f"can't read {path}: {e}") from e
    try:
        return split_block(text)
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from None


def _atom(x: str | os.PathLike) -> list[str]:
    if isinstance(x, os.PathLike):
        return _file(x)
    if not isinstance(x, str):
        raise TypeError(f"trees must be strings or paths, not {type(x).__name__}")
    if "\n" in x:
        return split_block(x)
    if x.lstrip()[:1] == "(":
        return [validate_newick(x)]
    return _file(x) if os.path.exists(x) else [validate_newick(x)]


def _group(name: str, value: object) -> list[str]:
    if isinstance(value, (str, os.PathLike)):
        return _atom(value)
    if not isinstance(value, (list, tuple)):
        raise TypeError(f"group {name!r} must be a string, a path or a list of them")
    if not value:
        raise ValueError(f"Group '{name}' is empty")
    return [t for x in value for t in _atom(x)]


def group_label(trees: Iterable[str]) -> str:
    """Label of an unnamed collection; the order of its trees doesn't matter."""
    return hashlib.blake2b("".join(sorted(trees)).encode(), digest_size=5).hexdigest()


def normalize_input(data: object) -> dict[str, list[str]]:
    """Trees by group from a mapping, a list, a block, a single tree or a path."""
    if isinstance(data, Mapping):
        if not data:
            raise ValueError("no groups")
        return {str(k): _group(str(k), v) for k, v in data.items()}
    if isinstance(data, (list, tuple)):
        if not data:
            raise ValueError("no trees")
        trees = [t for x in data for t in _atom(x)]
    elif isinstance(data, (str, os.PathLike)):
        trees = _atom(data)
    else:
        raise TypeError(f"can't read trees from {type(data).__name__}")
    return {group_label(trees): trees}


def tree_table(spark: SparkSession, data: object) -> DataFrame:
    """``(tree_id, group, newick)`` of driver-side input; groups in order of their names."""
    groups = normalize_input(data)
    rows = [(g, t) for g in sorted(groups) for t in groups[g]]
    frame = pd.DataFrame({"tree_id": range(len(rows)), "group": [r[0] for r in rows], "newick": [r[1] for r in rows]})
    return spark.createDataFrame(frame, "tree_id bigint, group string, newick string")


def read_trees(spark: SparkSession, path: str, group: Column | None = None) -> DataFrame:
    """``(tree_id, group, source, line_no, newick)`` of all files under a path, read by executors.

    Files may be compressed, whatever their names, and are read whole, one a task; see
    :func:`read_lines` for large plain ones. The group is the file's name by default.
    ``tree_id`` is the file's place among the paths in order, shifted by 32 bits, plus
    the line number, so it is unique and doesn't depend on partitioning.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def lines(batches):
        for pdf in batches:
            for source, content in zip(pdf["path"], pdf["content"]):
                text = decompress(content, source)
                kept = [(i, x.strip()) for i, x in enumerate(text.splitlines(), 1) if x.strip() and not x.strip().startswith("#")]
                yield pd.DataFrame({"source": source, "line_no": [i for i, _ in kept], "newick": [x for _, x in kept]})

    rows = files.mapInPandas(lines, "source string, line_no int, newick string")
    # paths only: their order is one small sort
    order = files.select(F.col("path").alias("source")).distinct().withColumn("file_no", F.row_number().over(Window.orderBy("source")) - 1)
    rows = rows.join(order, "source")
    key = F.shiftleft(F.col("file_no").cast("bigint"), 32) + F.col("line_no")
    name = F.element_at(F.split("source", "/"), -1)
    return rows.select(key.alias("tree_id"), (group if group is not None else name).alias("group"), "source", "line_no", "newick")


def read_lines(spark: SparkSession, path: str, group: Column | None = None) -> DataFrame:
    """``(tree_id, group, source, newick)`` of plain text files with a tree a line, which are split over tasks.

    Blank lines and lines that start with ``#`` are left out. ``tree_id`` is unique; it
    numbers the lines of each split, so it depends on how files are split.
    """
    t = F.trim(F.col("value"))
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("tree_id"), F.col("_metadata.file_path").alias("source"), t.alias("newick"))
    rows = rows.where((F.col("newick") != "") & ~F.col("newick").startswith("#"))
    name = F.element_at(F.split("source", "/"), -1)
    return rows.select("tree_id", (group if group is not None else name).alias("group"), "source", "newick")
