"""Token-id files: flat unsigned integers and 64-bit document offsets, memory-mapped.

Documents are range-partitioned by id and sorted, each task streams its partition into three flat files
(ids as uint16 or uint32, token offsets and document ids as 64-bit integers) and reports its size; prefix sums
over those sizes give every partition its base.  The manifest of bases makes the parts one sequence of ids.

Defined results: null text is empty and has the end id alone; null document ids come first and stay null;
equal ids are ordered by the text's hash, equal rows are written as often as they occur; an empty table gives
no parts; other columns are ignored.  A task writes under names of its own attempt and reports them, so the task of a
lost executor is simply run again; the manifest names the attempts that count, and the others' files are removed.
"""

from __future__ import annotations

import json
import mmap
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.shared import blocks, prepare, scratch, wanted
from tablewright.llm.tokens import encoder

#: Stands for a null document id in the id file.
NO_ID = -(1 << 63)
#: A part's files.
KINDS = ("ids", "offsets", "docs")


@dataclass
class TokenFiles:
    """A written corpus: its folder, the integer type and one entry per part with its bases."""

    path: str
    dtype: str
    parts: list[dict]

    @property
    def tokens(self) -> int:
        return sum(p["tokens"] for p in self.parts)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file://"):  # a URI can't hold every sign that a path can
        return pafs.LocalFileSystem(), path[7:]
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode whole texts, append ``end_id`` to each and write all ids in ascending id order."""
    spark = docs.sparkSession
    prepare(spark)
    path = path or scratch(spark, "tokens")
    fs, local = _filesystem(path)
    fs.create_dir(local, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        fs, local = _filesystem(path)
        e = encoder(tokenizer)
        if not 0 <= end_id <= np.iinfo(e.dtype).max:
            raise ValueError(f"end id {end_id} does not fit the tokenizer's {np.dtype(e.dtype).name} files")
        docs = tokens = 0
        name = f"part-{part:06d}-{attempt}"
        files: list = []
        for batch in batches:
            ids_of = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8")
            for block in blocks(batch.column(1)):
                if not files:
                    files = [fs.open_output_stream(f"{local}/{name}.{kind}") for kind in KINDS]
                ids, offs = e.encode(block)
                n = len(block)
                out = np.insert(ids, offs[1:], end_id)
                ends = tokens + offs[1:] + np.arange(1, n + 1)
                files[0].write(out.astype(e.dtype).tobytes())
                files[1].write(ends.astype("<u8").tobytes())
                files[2].write(ids_of[block.first : block.first + n].tobytes())
                docs, tokens = docs + n, int(ends[-1])
        for f in files:
            f.close()
        if files:
            yield pa.RecordBatch.from_pydict({"name": pa.array([name]), "part": pa.array([part], pa.int64()), "docs": pa.array([docs], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "wide": pa.array([e.dtype == np.uint32])})

    source = wanted(docs, id_col, text_col).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    ordered = source.repartitionByRange(F.col(id_col).asc_nulls_first(), F.xxhash64(text_col)).sortWithinPartitions(F.col(id_col).asc_nulls_first(), F.xxhash64(text_col), text_col)
    # One row per part comes to the driver, never per document.
    rows = sorted(ordered.mapInArrow(write, "name string, part long, docs long, tokens long, wide boolean").collect(), key=lambda r: r.part)
    parts, doc_base, token_base = [], 0, 0
    for r in rows:
        parts.append({"name": r.name, "docs": r.docs, "tokens": r.tokens, "doc_base": doc_base, "token_base": token_base})
        doc_base, token_base = doc_base + r.docs, token_base + r.tokens
    out = TokenFiles(path, "uint32" if any(r.wide for r in rows) else "uint16", parts)
    counted = {f"{p['name']}.{kind}" for p in parts for kind in KINDS}
    for found in fs.get_file_info(pafs.FileSelector(local)):
        if found.base_name.startswith("part-") and found.base_name not in counted:
            fs.delete_file(found.path)
    with fs.open_output_stream(f"{local}/manifest.json") as f:
        f.write(json.dumps({"dtype": out.dtype, "parts": parts}).encode())
    return out


def open_tokens(path: str) -> TokenFiles:
    """The files that an earlier write left at a path."""
    fs, local = _filesystem(path)
    with fs.open_input_stream(f"{local}/manifest.json") as f:
        found = json.loads(f.read())
    return TokenFiles(path, found["dtype"], found["parts"])


def _mapped(path: str, name: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where the folder is a mounted one, else read by its file system."""
    fs, local = _filesystem(path)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(f"{local}/{name}", "rb") as f:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype)
    with fs.open_input_file(f"{local}/{name}") as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read_part(files: TokenFiles, part: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, token offsets in the part (documents + 1) and ids of one part."""
    name = part["name"]
    ends = _mapped(files.path, f"{name}.offsets", "<u8")
    return _mapped(files.path, f"{name}.docs", "<i8"), np.concatenate([[0], ends]).astype(np.int64), _mapped(files.path, f"{name}.ids", "<u2" if files.dtype == "uint16" else "<u4")


def read_tokens(spark: SparkSession, files: TokenFiles, *, with_ids: bool = True) -> DataFrame:
    """One row per document from the files: doc_id, start (ids before it), n_tokens, ids_crc32 and, if wanted, ids."""
    prepare(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                docs, offs, ids = read_part(files, part)
                for at in range(0, len(docs), 1000):
                    to = min(len(docs), at + 1000)
                    flat = ids[offs[at] : offs[to]].astype("<u4")
                    cut = (offs[at : to + 1] - offs[at]).tolist()
                    view = memoryview(flat).cast("B")
                    crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    own = docs[at:to]
                    cols = {"doc_id": pa.array(own, mask=own == NO_ID), "start": pa.array(part["token_base"] + offs[at:to]), "n_tokens": pa.array(np.diff(offs[at : to + 1])), "ids_crc32": pa.array(crcs, pa.int64())}
                    if with_ids:
                        cols["ids"] = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat.astype(np.int64)))
                    yield pa.RecordBatch.from_pydict(cols)

    fields = "name string, docs long, tokens long, doc_base long, token_base long"
    table = spark.createDataFrame([tuple(p.values()) for p in files.parts], fields)
    return table.repartition(max(1, len(files.parts))).mapInArrow(read, schema)
