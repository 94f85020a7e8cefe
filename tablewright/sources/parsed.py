"""Packages that an external PDF parser leaves: run the parser, then read members of its ZIP files."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def run_parser(pdf: str, out_dir: str, command: Sequence[str], name: str = "result.zip") -> str:
    """Run an external parser on one PDF; returns the path of its package.

    ``{pdf}`` and ``{out}`` in the command's words stand for the input and the package. This is a step before Spark: a missing or other
    than PDF input, a failing parser and a missing package raise an error.
    """
    source, package = Path(pdf), Path(out_dir) / name
    if not source.exists():
        raise FileNotFoundError(f"no such PDF: {source}")
    if source.suffix.lower() != ".pdf":
        raise ValueError(f"not a PDF: {source}")
    package.parent.mkdir(parents=True, exist_ok=True)
    done = subprocess.run([w.replace("{pdf}", str(source)).replace("{out}", str(package)) for w in command], capture_output=True, text=True)
    if done.returncode or not package.exists():
        raise RuntimeError(f"the parser failed on {source}: {done.stderr[-500:]}")
    return str(package)


def read_packages(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(path, member, content) of the members of ZIP packages below ``path`` whose names end in ``suffix``; read on the executors, nothing is unpacked to disk."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import zipfile

        for batch in batches:
            for where, raw in zip(batch.column(0), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw.as_buffer())) as package:
                    for info in package.infolist():
                        if not info.is_dir() and info.filename.endswith(suffix):
                            yield pa.record_batch([pa.array([where.as_py()]), pa.array([info.filename]), pa.array([package.read(info)], pa.binary())], names=["path", "member", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInArrow(work, "path string, member string, content binary")
