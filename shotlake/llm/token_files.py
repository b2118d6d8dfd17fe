"""Token ids in binary files: canonical length-limited Huffman codes in independent blocks.

Format, written through Spark so that any store will do: a Parquet folder `blocks` with a row for each block of whole
documents in ascending doc_id order,

  part, block        int     order of the blocks
  start              long    ids of this part before the block
  doc_ids            array   of the documents, NULL where it is
  doc_tokens         array   ids of each document
  payload            binary  codes, most significant bit first, each document from a new byte on
  checkpoints        binary  for every STEP-th id of each document the bit it starts at, uint64 little-endian

and a Parquet folder `codebook` with (id, length). Codes are canonical: by length, then by id.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.llm.common import drop, folder, written
from shotlake.llm.tokens import byte_level

LIMIT, STEP, BLOCK_TOKENS, BLOCKS_AT_ONCE, END = 16, 256, 1 << 16, 16, 0
PART_TOKENS = 1 << 25


# codes --------------------------------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The lengths of an optimal prefix code with no length over `limit` (package-merge); 0 for ids without a count."""
    used = np.flatnonzero(counts)
    n, lengths = len(used), np.zeros(len(counts), np.uint8)
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    if n < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(float)
    level, leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        level = np.concatenate([leaves, level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)])
        order = np.argsort(level, kind="stable")
        level = level[order]
        leaf.append(order < n)
    taken, own = 2 * n - 2, np.zeros(n, int)
    for flags in reversed(leaf):
        k = int(flags[:taken].sum())
        own[:k] += 1
        taken = 2 * (taken - k)
    lengths[used] = own
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, right-aligned."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[np.count_nonzero(lengths == 0):].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) by the next LIMIT bits."""
    ids, sizes = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.uint8)
    used = np.flatnonzero(lengths)
    first = codes[used].astype(np.int64) << (LIMIT - lengths[used].astype(np.int64))
    order = np.argsort(first)
    spans = np.int64(1) << (LIMIT - lengths[used][order].astype(np.int64))
    end = int(spans.sum())
    ids[:end], sizes[:end] = np.repeat(used[order], spans), np.repeat(lengths[used][order], spans)
    return ids, sizes


def pack(ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the ids of several documents in a row (`docs`: ids of each): the bytes, each document from a new byte
    on; where each document's bytes start, and their end; the bit within its document where each id starts."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    edge = np.concatenate([[0], np.cumsum(docs)])
    bits = np.concatenate([[0], ends])[edge]
    own = np.diff(bits)
    at = np.concatenate([[0], np.cumsum((own + 7) // 8)])
    within = begins - np.repeat(bits[:-1], docs)
    place = within + np.repeat(at[:-1] * 8, docs)
    value = codes[ids].astype(np.int64) << (24 - (place & 7) - size)
    out = np.zeros(int(at[-1]) + 3)
    for k in range(3):  # no two codes share a bit, so sums are unions
        out += np.bincount((place >> 3) + k, weights=(value >> (16 - 8 * k)) & 255, minlength=len(out))[: len(out)]
    return out[: int(at[-1])].astype(np.uint8), at, within


def unpack(payload: np.ndarray, begins: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Decode streams of `counts` ids that start at bits `begins`, all streams step by step together; ids stream by stream."""
    ids, sizes = table
    data = np.concatenate([payload, np.zeros(4, np.uint8)]).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    at, left = begins[order].astype(np.int64), counts[order]
    out = np.zeros((int(counts.max()) if len(counts) else 0, len(counts)), np.uint32)
    n = len(counts)
    for step in range(len(out)):
        while n and left[n - 1] <= step:
            n = int(np.searchsorted(-left, -step, side="left"))
        here = at[:n] >> 3
        word = (data[here] << 16) | (data[here + 1] << 8) | data[here + 2]
        peek = (word >> (8 - (at[:n] & 7))) & ((1 << LIMIT) - 1)
        out[step, order[:n]] = ids[peek]
        at[:n] += sizes[peek]
    return out.T[np.arange(len(out))[None, :] < counts[:, None]]


# writing ------------------------------------------------------------------------------------------------------

def token_ids(docs: DataFrame, file: str) -> DataFrame:
    """(doc_id, ids, counts): the ids of each document with the end id, as little-endian bytes, and a last row for each
    task with how often it met each id."""
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = byte_level(file)
        end = np.array([END], tokenizer.dtype).tobytes()
        total = np.zeros(tokenizer.size + 1, np.int64)
        for df in batches:
            ids = [x + end for x in tokenizer.encode(df["text"])]
            for lo in range(0, len(ids), 200):
                total += np.bincount(np.frombuffer(b"".join(ids[lo:lo + 200]), tokenizer.dtype), minlength=len(total))
            yield pd.DataFrame({"doc_id": df["doc_id"].astype("Int64"), "ids": ids, "counts": None})
        yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "ids": [None], "counts": [total.astype("<i8").tobytes()]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(encode, "doc_id long, ids binary, counts binary")


def count_ids(ids: DataFrame) -> np.ndarray:
    """How often each id occurs; the driver sees one row for each id of the vocabulary at most."""
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for part in df["counts"]:
                n = np.frombuffer(part, "<i8")
                used = np.flatnonzero(n)
                yield pd.DataFrame({"id": used, "n": n[used]})

    rows = (ids.where("counts IS NOT NULL").select("counts").mapInPandas(spread, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    out[rows["id"]] = rows["n"]
    return out


def encode_documents(ids: DataFrame, dtype: str, lengths: np.ndarray, codes: np.ndarray) -> DataFrame:
    """(doc_id, row, n, bits, checkpoints): each document's own bytes and the bits at which every STEP-th id starts."""
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for lo in range(0, len(df), 500):
                part = df.iloc[lo:lo + 500]
                arrays = [np.frombuffer(x, dtype) for x in part["ids"]]
                sizes = np.array([len(x) for x in arrays])
                data, at, bits = pack(np.concatenate(arrays).astype(np.int64), sizes, lengths, codes)
                edge = np.concatenate([[0], np.cumsum(sizes)])
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "row": part["row"], "n": sizes,
                    "bits": [data[a:b].tobytes() for a, b in zip(at, at[1:])],
                    "checkpoints": [bits[a:b:STEP].astype("<u8").tobytes() for a, b in zip(edge, edge[1:])]})

    return ids.mapInPandas(encode, "doc_id long, row long, n long, bits binary, checkpoints binary")


BLOCK = "part int, block int, start long, doc_ids array<long>, doc_tokens array<long>, payload binary, checkpoints binary"


def to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of whole documents of a sorted part, a little over BLOCK_TOKENS ids each."""
    from pyspark import TaskContext

    part, block, start, held, n = TaskContext.get().partitionId(), 0, 0, [], 0

    def cut():
        shift, marks = 0, []
        for _, _, bits, points in held:
            marks.append(np.frombuffer(points, "<u8") + np.uint64(8 * shift))
            shift += len(bits)
        ids = [None if pd.isna(h[0]) else int(h[0]) for h in held]
        return pd.DataFrame({"part": [part], "block": [block], "start": [start], "doc_ids": [ids], "doc_tokens": [[int(h[1]) for h in held]],
                             "payload": [b"".join(h[2] for h in held)], "checkpoints": [np.concatenate(marks).astype("<u8").tobytes()]})

    for df in batches:
        for row in zip(df["doc_id"], df["n"], df["bits"], df["checkpoints"]):
            held.append(row)
            n += row[1]
            if n >= BLOCK_TOKENS:
                yield cut()
                block, start, held, n = block + 1, start + n, [], 0
    if held:
        yield cut()


def write_tokens(docs: DataFrame, path: str, file: str = "byte_bpe_50k.json") -> None:
    """Write the ids of every whole text of `docs` (doc_id, text) to `path` in ascending doc_id order.

    NULL texts are empty ones, NULL ids come first, rows of one id are ordered by place of reading;
    an empty table gives files without blocks. Nothing but the counts of ids passes the driver.
    """
    dtype = byte_level(file).dtype.str
    table = ids = written(token_ids(docs, file).withColumn("row", F.monotonically_increasing_id()), "ids")
    counts = count_ids(ids)
    ids = ids.where("ids IS NOT NULL").select("doc_id", "row", "ids")
    lengths = code_lengths(counts)
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // PART_TOKENS)
    coded = encode_documents(ids, dtype, lengths, canonical(lengths))
    # ranges come from the written ids, not from another round of encoding; rows of one id can part by their row
    ranged = coded.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "row")
    ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row").mapInPandas(to_blocks, BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop(table)
    used = np.flatnonzero(lengths)
    book = pd.DataFrame({"id": used, "length": lengths[used].astype(int)})
    spark.createDataFrame(book, "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")


# reading ------------------------------------------------------------------------------------------------------

def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if asked for, ids) of the documents in the files at `path`; blocks are
    decoded where they are read, each on its own."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"]] = book["length"]
    codes = canonical(lengths)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = decoding_table(lengths, codes)
        for df in batches:
            for lo in range(0, len(df), BLOCKS_AT_ONCE):
                some = df.iloc[lo:lo + BLOCKS_AT_ONCE]
                each_block = [np.asarray(t, np.int64) for t in some["doc_tokens"]]
                tokens = np.concatenate(each_block)
                docs = np.array(list(map(len, each_block)))
                # the streams of all these blocks, in one row of bytes
                bytes_before = np.cumsum([0, *map(len, some["payload"])])[:-1]
                begins = np.concatenate([np.frombuffer(p, "<u8").astype(np.int64) + 8 * b for p, b in zip(some["checkpoints"], bytes_before)])
                streams = (tokens + STEP - 1) // STEP
                counts = np.full(int(streams.sum()), STEP, np.int64)
                counts[np.cumsum(streams) - 1] = tokens - (streams - 1) * STEP
                got = unpack(np.frombuffer(b"".join(some["payload"]), np.uint8), begins, counts, table).astype("<u4")
                edge = np.concatenate([[0], np.cumsum(tokens)])
                each = [got[a:b] for a, b in zip(edge, edge[1:])]
                first = np.cumsum(docs) - docs  # of a block, among these documents
                start = edge[:-1] - np.repeat(edge[first], docs) + np.repeat(some["start"].to_numpy(), docs)
                out = {"part": np.repeat(some["part"].to_numpy(), docs), "doc_id": pd.array([x for names in some["doc_ids"] for x in names], "Int64"),
                       "start": start, "n_tokens": tokens, "ids_crc32": [zlib.crc32(x.tobytes()) for x in each]}
                yield pd.DataFrame(out | ({"ids": [x.astype(np.int64) for x in each]} if ids else {}))

    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    rows = blocks.mapInPandas(decode, "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
    # a row for each file part: as many as tasks wrote
    sizes = blocks.select("part", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()
    before, total = {}, 0
    for part, n in sorted(sizes):
        before[part] = total
        total += n
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "part int, before long")
    rows = rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("start") + F.col("before"))
    return rows.drop("part", "before")


def token_file_rows(docs: DataFrame, file: str = "byte_bpe_50k.json") -> DataFrame:
    """Write `docs` to new files in the shared folder and read them back."""
    path = f"{folder(docs.sparkSession)}/llm-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, file)
    return read_tokens(docs.sparkSession, path, ids=False)
