"""Readers: array archives, MAT v5 files, STL meshes, JSON, decks, tables of text, checkpoints.

Files are read by Spark (binaryFile, text, json, parquet), so any path that
Spark can open will do, and each file is decoded in a task.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARRAYS = "path string, name string, shape array<int>, k long, value double"


def _arrays(path: str, arrays: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    for name, a in arrays.items():
        if a.dtype.kind not in "biuf":
            continue
        flat = np.ascontiguousarray(a, dtype=np.float64).ravel()
        for at in range(0, len(flat), 1 << 18):
            part = flat[at : at + (1 << 18)]
            yield pd.DataFrame({"path": path, "name": name, "shape": [list(a.shape)] * len(part), "k": np.arange(at, at + len(part)), "value": part})


def _read(spark: SparkSession, path: str, decode) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield from _arrays(name, decode(bytes(content)))

    return files.mapInPandas(work, ARRAYS)


def decode_npz(content: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        return {n: z[n] for n in z.files}


#: MAT v5 storage kinds to NumPy's.
MAT_KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_MATRIX, MAT_COMPRESSED = 14, 15


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # up to four bytes beside the tag
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (-size % 8 if kind != MAT_COMPRESSED else 0)


def decode_mat(content: bytes) -> dict[str, np.ndarray]:
    """The numeric arrays of a MAT v5 file; other variables are skipped."""
    order = "<" if content[126:128] == b"IM" else ">"
    out: dict[str, np.ndarray] = {}
    for kind, body in _elements(content[128:], order):
        if kind == MAT_COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body), order))
        if kind != MAT_MATRIX:
            continue
        parts = list(_elements(body, order))
        shape = np.frombuffer(parts[1][1], order + "i4")
        name = parts[2][1].rstrip(b"\0").decode("latin-1")
        if len(parts) > 3 and parts[3][0] in MAT_KINDS and not name.startswith("__"):
            values = np.frombuffer(parts[3][1], order + MAT_KINDS[parts[3][0]])
            if values.size == np.prod(shape):
                out[name] = values.reshape(shape, order="F")
    return out


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """path, name, shape, k (place in C order), value of all numeric arrays."""
    return _read(spark, path, decode_npz)


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """The same for MAT v5 files."""
    return _read(spark, path, decode_mat)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .npz or .mat; else an error."""
    for suffix, read in ((".npz", read_npz), (".mat", read_mat)):
        if path.endswith(suffix):
            return read(spark, path)
    raise ValueError(f"no reader for {path}")


def required(arrays: DataFrame, name: str) -> DataFrame:
    """Rows of one array; an error if no file holds it."""
    found = arrays.filter(F.col("name") == name)
    if found.isEmpty():
        raise KeyError(name)
    return found


def as_voxels(array: DataFrame) -> DataFrame:
    """path, x, y, z, value of three-dimensional arrays."""
    ny, nz = F.col("shape")[1], F.col("shape")[2]
    return array.filter(F.size("shape") == 3).select(
        "path", F.floor(F.col("k") / (ny * nz)).cast("int").alias("x"), (F.floor(F.col("k") / nz) % ny).cast("int").alias("y"), (F.col("k") % nz).cast("int").alias("z"), "value"
    )


def describe(arrays: DataFrame) -> DataFrame:
    """path, name, shape and count of each array."""
    return arrays.groupBy("path", "name", "shape").agg(F.count("*").alias("n"))


def decode_stl(content: bytes) -> np.ndarray:
    """(triangles, 9) corner coordinates of a binary or text STL file."""
    if len(content) >= 84 and len(content) == 84 + 50 * struct.unpack_from("<I", content, 80)[0]:
        kind = np.dtype([("n", "<f4", 3), ("v", "<f4", 9), ("a", "<u2")])
        return np.frombuffer(content, kind, offset=84)["v"].astype(np.float64)
    rows = [line.split()[1:4] for line in content.decode("latin-1").splitlines() if line.strip().startswith("vertex")]
    return np.array(rows, np.float64).reshape(-1, 9)


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """path, n, ax..cz for each triangle of STL files."""
    names = [f"{v}{a}" for v in "abc" for a in "xyz"]
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                t = decode_stl(bytes(content))
                out = pd.DataFrame(t, columns=names)
                out.insert(0, "n", np.arange(len(t)))
                out.insert(0, "path", name)
                yield out

    return files.mapInPandas(work, "path string, n long, " + ", ".join(f"{n} double" for n in names))


def read_deck(spark: SparkSession, path: str) -> DataFrame:
    """deck (path), n (line number from 0), line. Lines are numbered inside each
    file; a file is one task's."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("deck"), "value")
    return text.select("deck", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("n", "line"))


def read_node_table(spark: SparkSession, path: str) -> DataFrame:
    """node_id, u1, u2, u3 of white-space separated text."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(parts.alias("p"))
    return rows.select(F.col("p")[0].cast("double").cast("long").alias("node_id"), *[F.col("p")[i].cast("double").alias(f"u{i}") for i in (1, 2, 3)])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def list_files(spark: SparkSession, path: str, patterns: list[str] | None = None) -> DataFrame:
    """path, size, sha256 of files below a folder, by name patterns of SQL LIKE."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if patterns:
        keep = F.lit(False)
        for p in patterns:
            keep = keep | F.element_at(F.split("path", "/"), -1).like(p)
        files = files.filter(keep)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def resume_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest iteration of a checkpoint folder (iter=N); `design` is the next
    design where one was written."""
    runs = spark.read.parquet(path)
    newest = runs.agg(F.max("iter")).first()[0]
    last = runs.filter(F.col("iter") == newest)
    return last.withColumn("design", F.coalesce("next_design", "design")) if "next_design" in last.columns else last
