"""Token counts by separator scan over flat token files.

A token file is nothing but ids of fixed width, each document followed by an
end-of-document id; there is no index.  It is read as blocks of any size, in any
order, that begin and end anywhere: each block is searched for the separator in
one vectorised pass and says how many it holds, how many ids stand before the
first and after the last, and the lengths between.  A prefix scan over blocks,
in two levels, gives each block the documents before it and the ids that the
document it begins in already has, and so stitches documents across blocks.

Defined results: null and empty texts have no tokens (the separator follows at
once); a file that doesn't end with a separator ends its last document; files
without blocks have no documents; an empty table gives no rows; repeated rows
and null ids count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm.store import Scratch
from loamline.llm.token_ids import default_path, encoder

EOD, DTYPE, BLOCK_IDS, GROUP = 50256, "<u2", 1 << 18, 1024
FILE = "file long, block long, data binary, ids array<long>"


def write_files(docs: DataFrame, tokenizer: str | None = None, eod: int = EOD, dtype: str = DTYPE, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (file, block, data) of flat token files, one file for each partition, and rows (file, ids) that name a file's documents in order.

    Blocks are cut by size alone.  The ids' rows have data null and in `block` the number of documents before them.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        end = np.array([eod], dtype).tobytes()
        width, block, held, docs_before = np.dtype(dtype).itemsize * block_ids, 0, bytearray(), 0

        def rows(got: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))], names=["file", "block", "data", "ids"])

        for b in batches:
            got = []
            for t in b.column(1):
                held += np.frombuffer(enc.ids(t.as_py() or "", special=False), "<u4").astype(dtype).tobytes() + end
                while len(held) >= width:
                    got.append((part, block, bytes(held[:width]), None))
                    del held[:width]
                    block += 1
            if b.num_rows:
                got.append((part, docs_before, None, b.column(0).to_pylist()))
                docs_before += b.num_rows
            yield rows(got)
        if held:
            yield rows([(part, block, bytes(held), None)])
        enc.forget()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, FILE)


def read_files(spark: SparkSession, path: str, dtype: str = DTYPE, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks (file, block, data) of raw token files below a path, by Spark's own reader; `file` is a path."""
    width = np.dtype(dtype).itemsize * block_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = raw.as_py()
                at = list(range(0, len(raw), width))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(range(len(at)), pa.int64()), pa.array([raw[i : i + width] for i in at], pa.binary())], names=["file", "block", "data"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(cut, "file string, block long, data binary")


def scan(data: bytes, eod: int, dtype: str) -> tuple[int, int, int, int, np.ndarray]:
    """Of a block: its ids, separators, ids before the first and after the last, and the documents' lengths between."""
    ids = np.frombuffer(data, dtype)
    at = np.flatnonzero(ids == eod)
    if not len(at):
        return len(ids), 0, len(ids), len(ids), at
    return len(ids), len(at), int(at[0]), len(ids) - 1 - int(at[-1]), np.diff(at) - 1


def count(blocks: DataFrame, eod: int = EOD, dtype: str = DTYPE, keep: Scratch | None = None, group: int = GROUP) -> DataFrame:
    """(file, document, n_tokens): each document's ids without its separator; `document` numbers a file's from 0."""
    keep = keep or Scratch(blocks.sparkSession, "token-counts")
    kind = dict(blocks.dtypes)["file"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(x.as_py(), eod, dtype) for x in b.column(2)]
            cols = [pa.array([x[i] for x in got], pa.int64()) for i in range(4)]
            inner = pa.array([x[4].tolist() for x in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, inner], names=["file", "block", "n", "seps", "head", "tail", "inner"])

    scanned = keep.save(blocks.select("file", "block", "data").mapInArrow(run, f"file {kind}, block long, n long, seps long, head long, tail long, inner array<long>"))
    part = scanned.select("file", "block", F.floor(F.col("block") / group).alias("grp"), "n", "seps", "tail")
    # What a run of blocks hands on: its separators, and the ids after its last separator, or all its ids if it has none.
    over = "(partition by file, grp order by block rows between unbounded preceding and 1 preceding)"
    inside = part.selectExpr("*", f"coalesce(sum(seps) over {over}, 0) as s0", f"coalesce(sum(n) over {over}, 0) as before", "sum(n) over (partition by file, grp order by block) - tail as sep_end")
    inside = inside.selectExpr("*", f"max(case when seps > 0 then sep_end end) over {over} as cut")
    groups = part.groupBy("file", "grp").agg(F.sum("n").alias("gn"), F.sum("seps").alias("gs"))
    ends = inside.groupBy("file", "grp").agg(F.max(F.expr("case when seps > 0 then sep_end end")).alias("gcut"))
    up = "(partition by file order by grp rows between unbounded preceding and 1 preceding)"
    groups = groups.join(ends, ["file", "grp"]).selectExpr("*", f"coalesce(sum(gn) over {up}, 0) as g_ids", f"coalesce(sum(gs) over {up}, 0) as g_docs")
    groups = groups.selectExpr("file", "grp", "g_ids", "g_docs", f"coalesce(max(g_ids + gcut) over {up}, 0) as g_cut", "row_number() over (partition by file order by grp desc) = 1 as last_group")
    placed = inside.join(groups, ["file", "grp"]).selectExpr(
        "file", "block", "g_docs + s0 as docs_before", "g_ids + before - coalesce(g_ids + cut, g_cut) as carried", "last_group and row_number() over (partition by file, grp order by block desc) = 1 as last"
    )
    rows = scanned.join(placed, ["file", "block"])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, number, size = [], [], []
            for f, seps, head, tail, inner, before, carried, last in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                own = [carried + head, *inner] if seps else []
                rest = tail if seps else carried + head
                if last and rest:
                    own.append(rest)
                files += [f] * len(own)
                number += range(before, before + len(own))
                size += own
            yield pa.RecordBatch.from_arrays([pa.array(files, b.column(0).type), pa.array(number, pa.int64()), pa.array(size, pa.int64())], names=["file", "document", "n_tokens"])

    return rows.select("file", "seps", "head", "tail", "inner", "docs_before", "carried", "last").mapInArrow(lengths, f"file {kind}, document long, n_tokens long")


def count_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of each document, by way of flat token files."""
    keep = Scratch(docs.sparkSession, "token-counts")
    files = keep.save(write_files(docs, tokenizer, id_col=id_col, text_col=text_col))
    counted = count(files.filter("data is not null"), keep=keep)
    named = files.filter("ids is not null").select("file", "block", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("block") + F.col("i")).alias("document"), "doc_id")
    return named.join(counted, ["file", "document"]).select("doc_id", "n_tokens")
