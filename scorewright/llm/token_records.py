"""Operator 1: token ids as length-delimited binary records with a separate offset index.

Record layout (all integers little-endian)::

    length   8 bytes   bytes of the payload
    check    4 bytes   masked CRC-32 of the length field
    payload            doc_id (8 bytes, signed), then the ids, 2 or 4 bytes each
    check    4 bytes   masked CRC-32 of the payload
    end      1 byte    0x0A

The mask rotates a checksum right by 15 bits and adds 0xA282EAD8, so that a
checksum stored inside checked data stays harmless.  Spark's own writer commits
the shard files (a lost task leaves nothing behind), one per range of doc_id.
The index is read off the committed shards, which verifies every checksum.

Null text is an empty document; a null id is written as 2^63-1; rows repeated under
one id are all written, ordered by their text; other columns are ignored.  An empty
table gives an empty folder and an empty index.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewright.llm.common import keyed, public_id, stage
from scorewright.llm.tokens import encoder, vocabulary_path
from scorewright.session import scratch_path

_HEAD, _CHECK, _END = struct.Struct("<Q"), struct.Struct("<I"), b"\n"
_AROUND = _HEAD.size + 2 * _CHECK.size + len(_END)
INDEX = "shard int, path string, offset long, length long, doc_id long, n_tokens long, before long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """All but the end byte, which the text sink writes after each row."""
    head = _HEAD.pack(len(payload))
    return b"".join((head, _CHECK.pack(masked(head)), payload, _CHECK.pack(masked(payload))))


def unframe(content: bytes, at: int) -> bytes:
    """The payload of the record that starts at ``at``; raises on any damage."""
    head = content[at:at + 8]
    if len(head) < 8 or _CHECK.unpack_from(content, at + 8)[0] != masked(head):
        raise ValueError(f"damaged record length at byte {at}")
    size = _HEAD.unpack(head)[0]
    payload = content[at + 12:at + 12 + size]
    if len(payload) < size or _CHECK.unpack_from(content, at + 12 + size)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_records(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0,
                  shard_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append ``end_id`` to each and write the shards in ascending doc_id order.

    The texts are range-partitioned once; each task encodes its sorted range and streams the
    frames to its shard.  ``shard_bytes`` of text go to a shard, so a reader holds little at a time.
    """
    vocabulary = vocabulary or vocabulary_path()
    rows = keyed(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(total // shard_bytes + 1, rows.sparkSession.sparkContext.defaultParallelism)

    def frames(batches):
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_pydict({"frame": pa.array(
                    [frame(struct.pack("<q", d) + enc.encode(t) + end)
                     for d, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist())], pa.binary())})

    (rows.repartitionByRange(int(shards), "doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(frames, "frame binary").select(F.col("frame").cast("string"))
     .write.option("lineSep", "\n").text(path))


def _payload_ids(payload: bytes, width: int) -> np.ndarray:
    return np.frombuffer(payload, f"<u{width}", offset=8)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "path", "content"))


def build_index(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """One row per record: where it is, whose it is, its tokens, the tokens before it in its shard."""
    def entries(batches):
        for batch in batches:
            for shard, name, content in zip(*(batch[c] for c in ("shard", "path", "content"))):
                data, at, before, out = content.as_py(), 0, 0, []
                while at < len(data):
                    payload = unframe(data, at)
                    ids = _payload_ids(payload, width)
                    size = len(payload) + _AROUND
                    out.append((at, size, struct.unpack_from("<q", payload)[0], len(ids), before, crc_of_ids(ids)))
                    at, before = at + size, before + len(ids)
                if out:
                    cols = [pa.array(c, pa.int64()) for c in zip(*out)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard.as_py()] * len(out), pa.int32()), pa.array([name.as_py()] * len(out)), *cols],
                        names=["shard", "path", "offset", "length", "doc_id", "n_tokens", "before", "ids_crc32"])

    return _shards(spark, path).mapInArrow(entries, INDEX)


def read_records(spark: SparkSession, path: str, wanted: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, offset, ids) of the index rows ``wanted`` (a shuffled read takes them in any order):
    only the named byte ranges are decoded, shard by shard."""
    ranges = wanted.groupBy("shard").agg(F.collect_list("offset").alias("offsets"))

    def pick(batches):
        for batch in batches:
            for content, offsets in zip(batch["content"], batch["offsets"].to_pylist()):
                data = content.as_py()
                payloads = [unframe(data, o) for o in offsets]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([struct.unpack_from("<q", p)[0] for p in payloads], pa.int64()),
                    "offset": pa.array(offsets, pa.int64()),
                    "ids": pa.array([_payload_ids(p, width).astype("int32") for p in payloads], pa.list_(pa.int32()))})

    return (_shards(spark, path).join(ranges, "shard").select("content", "offsets")
            .mapInArrow(pick, "doc_id long, offset long, ids array<int>"))


def token_records(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write the records, index them and return the index with each document's global ``start``."""
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    path = path or scratch_path(spark, "token-records")
    write_records(docs, path, vocabulary, end_id)
    index, _ = stage(build_index(spark, path, encoder(vocabulary).dtype.itemsize), "token-index")
    # one row per shard: its tokens, then those of all shards before it
    sizes = index.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    ahead = sizes.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_ahead"))
    return index.join(ahead, "shard").select(
        public_id(), (F.col("_ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32",
        "path", "offset", "length")
