"""Token counts from flat token files by scanning for separators.

A token file is nothing but 16-bit token ids, one after the other, with an end-of-document
id after each document; there is no index. ``scan`` cuts the bytes into blocks, finds the
separators of a block with one vector comparison and describes the block by what an
associative operator needs: ids before the first separator, after the last one, and the
whole documents between. A prefix scan over those descriptions, block by block within a file,
stitches the documents that cross block boundaries, so blocks may be scanned in any order
and on any machine, and only the few numbers of a block are ever brought together.

``write_token_files`` makes such files from texts with Spark's own text writer, so they can
be written to any store that Spark writes to: ids are big-endian, and the end id is
``END`` = 0xC480, whose two bytes are the UTF-8 form of U+0100, which is the writer's line
separator. Ids come from a fixed public byte-level vocabulary of 50,256 ids, so no token
equals the separator. A document's first ``HEAD`` ids spell its doc_id in base ``BASE``, so
documents can be told apart in a file without an index.

Files are read whole by Spark's binary reader, so a file must fit in a task; the writer
closes a file after ``ROWS`` documents. A null or empty text has no tokens and still has its
header. Repeated documents are counted each. A last document without a separator counts and
is marked ``closed = false``. Empty files and no files give no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from knotwork.llm.lm import word_pieces
from knotwork.llm.textkernel import slices, utf8, word_hashes, words
from knotwork.storage import cut, shared_dir

END, HEAD, BASE, ROWS, BLOCK = 0xC480, 5, 50_000, 4000, 1 << 18
_SEPARATOR = "Ā"


def header(doc_id: int | None) -> np.ndarray:
    """Ids that spell a document's id; all ``BASE`` for null."""
    if doc_id is None:
        return np.full(HEAD, BASE, ">u2")
    value, out = doc_id + (1 << 63), []
    for _ in range(HEAD):
        out.append(value % BASE)
        value //= BASE
    return np.array(out, ">u2")


def doc_ids(heads: np.ndarray) -> list[int | None]:
    """The ids spelt by rows of header ids."""
    out: list[int | None] = []
    for row in heads.tolist():
        if row[0] == BASE:
            out.append(None)
            continue
        value = 0
        for x in reversed(row):
            value = value * BASE + x
        out.append(value - (1 << 63))
    return out


def encode(column, ids: list) -> list[bytes]:
    """Header and token ids of each text, as big-endian 16-bit bytes.

    A text is cut at white space; a word is encoded with a space before it, once for each worker.
    """
    data, offsets = utf8(column)
    out = []
    for a, b in slices(offsets):
        raw = data[offsets[a] : offsets[b]]
        _, starts, ends, per = words(raw, offsets[a : b + 1] - offsets[a])
        key, first, inverse = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        flat, begin, size = word_pieces(raw.tobytes(), starts[first], ends[first], key)
        inverse = inverse.ravel()
        doc = np.repeat(np.arange(b - a), np.diff(per))
        count = size[inverse] if len(size) else np.zeros(0, np.int64)
        total = HEAD + np.bincount(doc, count, minlength=b - a).astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(total)])
        made = np.zeros(edge[-1], ">u2")
        made[edge[:-1, None] + np.arange(HEAD)] = np.stack([header(x) for x in ids[a:b]])
        at = np.cumsum(count) - count
        place = np.arange(count.sum()) - np.repeat(at, count)
        made[np.repeat(at + HEAD * (doc + 1), count) + place] = flat[np.repeat(begin[inverse] if len(begin) else at, count) + place]
        out += [made[x:y].tobytes() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
    return out


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents as flat token files below ``path``."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(encode(batch.column(1), batch.column(0).to_pylist()), pa.binary())], names=["line"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    lines = rows.mapInArrow(run, "line binary").select(F.col("line").cast("string").alias("value"))
    lines.write.option("lineSep", _SEPARATOR).option("maxRecordsPerFile", ROWS).text(path)


def describe(tokens: np.ndarray, end: int, head: int):
    """What a block is to the prefix scan: (ids, separators, ids before the first separator, ids
    after the last one, first ids of the block, first ids after the last separator, whole
    documents inside as (sizes, first ids))."""
    at = np.flatnonzero(tokens == end)
    if not len(at):
        return len(tokens), 0, len(tokens), len(tokens), tokens[:head], tokens[:head], (np.zeros(0, np.int64), np.zeros((0, head), np.int64))
    begin, size = at[:-1] + 1, np.diff(at) - 1
    grid = begin[:, None] + np.arange(head)
    first = np.where(np.arange(head)[None, :] < size[:, None], tokens[np.minimum(grid, len(tokens) - 1)], -1)
    tail = len(tokens) - 1 - at[-1]
    return len(tokens), len(at), int(at[0]), int(tail), tokens[: min(head, at[0])], tokens[at[-1] + 1 :][:head], (size, first)


_BLOCKS = "file string, block long, n long, seps long, lead long, tail long, lead_ids array<int>, tail_ids array<int>, sizes array<long>, heads array<int>"


def scan_blocks(spark: SparkSession, path: str, end: int = END, head: int = HEAD, block: int = BLOCK) -> DataFrame:
    """A description of every block of every file below ``path``."""

    def run(batches):
        kinds = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = ["file", "block", "n", "seps", "lead", "tail", "lead_ids", "tail_ids", "sizes", "heads"]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.frombuffer(content.as_buffer(), ">u2") if content.is_valid else np.zeros(0, ">u2")
                rows = []
                for k, a in enumerate(range(0, len(tokens), block)):
                    n, seps, lead, tail, x, y, (sizes, heads) = describe(tokens[a : a + block].astype(np.int32), end, head)
                    rows.append((name, k, n, seps, lead, tail, x.tolist(), y.tolist(), sizes.tolist(), heads.ravel().tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, _BLOCKS)


def stitch(blocks: DataFrame, head: int = HEAD) -> DataFrame:
    """``(file, ordinal, n, first, closed)`` of every document: the prefix scan over blocks.

    ``n`` counts ids without separators, ``first`` holds the document's first ids. Within a
    file, ``run`` numbers the separators before each block; ids that lie before a block's
    first separator go to the document opened by an earlier block.
    """
    order = W.partitionBy("file").orderBy("block")
    numbered = blocks.withColumn("run", F.coalesce(F.sum("seps").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = numbered.select(
        "file", F.posexplode("sizes").alias("k", "n"), "run", "heads"
    ).select("file", (F.col("run") + 1 + F.col("k")).alias("ordinal"), "n", F.filter(F.slice("heads", F.col("k") * head + 1, head), lambda x: x >= 0).alias("first"), F.lit(True).alias("closed"))
    # the pieces of documents at block edges: each block's head piece, and its tail piece after the last separator
    lead = numbered.select("file", F.col("run").alias("ordinal"), "block", F.lit(0).alias("side"), F.col("lead").alias("n"), F.col("lead_ids").alias("ids"), (F.col("seps") > 0).alias("ends"))
    tail = numbered.where("seps > 0").select("file", (F.col("run") + F.col("seps")).alias("ordinal"), "block", F.lit(1).alias("side"), F.col("tail").alias("n"), F.col("tail_ids").alias("ids"), F.lit(False).alias("ends"))
    # ids of the document before each piece: a document over any number of blocks keeps few pieces
    earlier = W.partitionBy("file", "ordinal").orderBy("block", "side").rowsBetween(W.unboundedPreceding, -1)
    edge = (
        lead.unionByName(tail)
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .groupBy("file", "ordinal")
        .agg(
            F.sum("n").alias("n"), F.max("ends").alias("closed"),
            # the first ids lie in the document's first pieces: at most one piece for each id is needed
            F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.when((F.size("ids") > 0) & (F.col("before") < head), F.struct("block", "side", "ids")))), lambda x: x["ids"])), 1, head).alias("first"),
        )
        .where("n > 0 or closed")
        .select("file", "ordinal", "n", "first", "closed")
    )
    return inner.unionByName(edge)


def count_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, n_tokens, closed, file, ordinal)`` of the token files below ``path``."""

    def run(batches):
        for batch in batches:
            heads = [(x + [BASE] * HEAD)[:HEAD] for x in batch.column(2).to_pylist()]
            n = [max(0, x - HEAD) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids(np.array(heads, np.int64).reshape(-1, HEAD)), pa.int64()), pa.array(n, pa.int64()), batch.column(3), batch.column(0), batch.column(4)], names=["doc_id", "n_tokens", "closed", "file", "ordinal"])

    # a few numbers a block, used three times
    found = stitch(cut(scan_blocks(spark, path))).select("file", "n", "first", "closed", "ordinal")
    return found.mapInArrow(run, "doc_id long, n_tokens long, closed boolean, file string, ordinal long")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents as token files in the shared folder and count from the files."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files/{uuid.uuid4().hex}"
    write_token_files(docs, path, id_col, text_col)
    return count_tokens(spark, path)
