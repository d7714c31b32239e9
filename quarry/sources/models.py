"""Static embedding models from binary files: a vocabulary and one vector for each token.

Layout, little-endian: 8 bytes of magic, three 32-bit counts (tokens, dimensions, bytes of vocabulary), the SHA-256 of the payload in the
last 32 of 220 header bytes; then token offsets (one more than tokens), the tokens with a zero byte after each, and the
weights as 32-bit floats."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

HEADER, DIGEST = 220, 188
#: Bounds of a model: it is broadcast whole, so its size is checked before it is read.
BYTES_MAX, TOKENS_MAX, DIMENSIONS_MAX = 256 << 20, 1 << 20, 512


def parsed(content: bytes, magic: bytes) -> tuple[list[str], np.ndarray]:
    """Tokens and their vectors; ValueError if anything does not fit."""
    head, payload = content[:HEADER], content[HEADER:]
    count, dims, size = (int(x) for x in np.frombuffer(head[8:20], "<u4")) if len(head) == HEADER else (0, 0, 0)
    if head[:8] != magic or not 0 < count <= TOKENS_MAX or not 0 < dims <= DIMENSIONS_MAX:
        raise ValueError("not a model of this kind")
    if len(payload) != 4 * (count + 1) + size + 4 * count * dims or hashlib.sha256(payload).digest() != head[DIGEST:]:
        raise ValueError("the model's payload is damaged")
    at = np.frombuffer(payload[: 4 * (count + 1)], "<u4")
    words = payload[4 * (count + 1) : 4 * (count + 1) + size]
    if at[0] != 0 or at[-1] != size or (np.diff(at.astype(np.int64)) <= 0).any() or any(words[e - 1] != 0 for e in at[1:].tolist()):
        raise ValueError("the model's vocabulary is damaged")
    tokens = [words[a : b - 1].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    weights = np.frombuffer(payload[4 * (count + 1) + size :], "<f4").reshape(count, dims)
    if len(set(tokens)) != count or not np.isfinite(weights).all():
        raise ValueError("the model's tokens repeat, or weights are not finite")
    return tokens, weights


def vocabulary(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """token_id, token, v of a model file, read by Spark, so that the path may be in any store."""
    found = spark.read.format("binaryFile").load(path)
    row = found.where(f"length <= {BYTES_MAX}").first()
    if row is None:
        raise ValueError("no model of an allowed size at that path")
    tokens, weights = parsed(bytes(row.content), magic)
    count, dims = weights.shape
    made = pa.table({"token_id": pa.array(range(count), pa.int32()), "token": tokens, "v": pa.FixedSizeListArray.from_arrays(pa.array(weights.reshape(-1)), dims).cast(pa.list_(pa.float32()))})
    return spark.createDataFrame(made)
