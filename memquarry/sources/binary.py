"""Binary forms of vectors and log frames, decoded to rows.

A *vector blob* repeats: length of the id (1 byte), id, dim little-endian floats.
A *log file* repeats frames: magic, length and CRC-32 of the body, body (JSON of the
frame: tenant, sequence, time and effects). A torn frame at the end of the last file
is dropped, any other damage is an error.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"MQF2"
HEAD = struct.Struct("<4sII")


def encode_vectors(rows: list[tuple[str, list[float]]]) -> bytes:
    return b"".join(bytes([len(i.encode())]) + i.encode() + np.asarray(v, "<f4").tobytes() for i, v in rows)


def decode_vectors(blob: bytes, dim: int) -> list[tuple[str, list[float]]]:
    """The rows of a blob; one that does not end with a whole row is an error."""
    out, at = [], 0
    while at < len(blob):
        n = blob[at]
        past = at + 1 + n + 4 * dim
        if n == 0 or past > len(blob):
            raise ValueError(f"truncated vector at byte {at}")
        v = np.frombuffer(blob, "<f4", dim, at + 1 + n)
        if not np.isfinite(v).all():
            raise ValueError(f"vector at byte {at} is not finite")
        out.append((blob[at + 1 : at + 1 + n].decode(), v.tolist()))
        at = past
    return out


def vectors_of(blobs: DataFrame, blob_col: str, dim: int) -> DataFrame:
    """(id, embedding) of all blobs; null blobs give nothing."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [r for b in p[blob_col] if b is not None for r in decode_vectors(bytes(b), dim)]
            yield pd.DataFrame(rows, columns=["id", "embedding"])

    return blobs.select(blob_col).mapInPandas(work, "id string, embedding array<float>")


def packed(rows: DataFrame, id_col: str, vector_col: str, blob: str) -> DataFrame:
    """A blob per batch of rows: the form that ``vectors_of`` reads."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                yield pd.DataFrame({blob: [encode_vectors(list(zip(p["id"], p["v"])))]})

    return rows.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("v")).mapInPandas(work, f"{blob} binary")


def encode_frame(frame: dict) -> bytes:
    body = json.dumps(frame, sort_keys=True).encode()
    return HEAD.pack(MAGIC, len(body), zlib.crc32(body)) + body


def decode_frames(data: bytes, torn_end: bool) -> Iterator[dict]:
    at = 0
    while at < len(data):
        whole = at + HEAD.size <= len(data)
        magic, n, crc = HEAD.unpack_from(data, at) if whole else (b"", 0, 0)
        body = data[at + HEAD.size : at + HEAD.size + n]
        if not whole or magic == MAGIC and len(body) < n:
            if torn_end:
                return
            raise ValueError(f"torn frame at byte {at}")
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError(f"damaged frame at byte {at}")
        yield json.loads(body)
        at += HEAD.size + n


FRAME_ROWS = "tenant_id string, seq bigint, effect_no int, ts_ns bigint, type int, key string, space string, id string, value string, vector array<float>, expires_at bigint"


_NAMES = [c.split()[0] for c in FRAME_ROWS.split(", ")]


def _rows(frames: Iterator[dict]) -> pd.DataFrame:
    rows = [[f.get("tenant_id"), f["seq"], i, f.get("ts_ns"), *(e.get(k) for k in _NAMES[4:])] for f in frames for i, e in enumerate(f["effects"])]
    return pd.DataFrame(rows, columns=_NAMES).astype({"seq": "int64", "effect_no": "int32", "ts_ns": "Int64", "type": "Int32", "expires_at": "Int64"})


def read_log(spark: SparkSession, folder: str, current: str = "log.current") -> DataFrame:
    """The effects of all log files of a folder, a row each. Only the file being written
    (``current``) may end with a torn frame."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "log.*").load(folder).select("path", "content")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for path, data in zip(p["path"], p["content"]):
                yield _rows(decode_frames(bytes(data), path.endswith("/" + current)))

    return files.mapInPandas(work, FRAME_ROWS)


def packed_frames(changes: DataFrame, blob: str) -> DataFrame:
    """A blob of frames per batch of transactions (tenant_id, seq), effects in order."""
    frames = changes.groupBy("tenant_id", "seq").agg(F.max("ts_ns").alias("ts_ns"), F.to_json(F.array_sort(F.collect_set(F.struct("effect_no", *_NAMES[4:])))).alias("effects"))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                made = (encode_frame({"tenant_id": t, "seq": s, "ts_ns": None if pd.isna(n) else int(n), "effects": json.loads(e)}) for t, s, n, e in zip(p["tenant_id"], p["seq"].tolist(), p["ts_ns"], p["effects"]))
                yield pd.DataFrame({blob: [b"".join(made)]})

    return frames.mapInPandas(work, f"{blob} binary")


def frames_of(blobs: DataFrame, blob: str) -> DataFrame:
    """The effects of all frames of all blobs, which must be whole; null blobs give nothing."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for b in p[blob]:
                if b is not None:
                    yield _rows(decode_frames(bytes(b), False))

    return blobs.select(blob).mapInPandas(work, FRAME_ROWS)
