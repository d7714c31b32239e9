"""Token counts by a map-side two-tier lookup.

Tier one is a compact broadcast table of frequent pre-token lengths (at most TABLE_ENTRIES entries and
TABLE_BYTES bytes, whatever the corpus); tier two is each worker's bounded cache, whose misses the
tokenizers library encodes. Nothing is shuffled and counts are exact whatever the table holds: the
table only saves encodings.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.tokens import encoder

#: Bounds of the broadcast table, and of the rows from which its entries are picked: their number and bytes of each, and the
#: share of rows that are looked at until there are enough.
TABLE_ENTRIES, TABLE_BYTES, SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_SHARE = 32_768, 1 << 20, 1_000, 1 << 14, 0.05


def frequent_lengths(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES, rows: int = SAMPLE_ROWS, seed: int = 7) -> bytes:
    """The compressed table (pre-token, token count) of pre-tokens that occur more than once in `rows` texts of at most
    SAMPLE_BYTES bytes. Only as many partitions are read as hold that many sampled rows, not the corpus."""
    sample = docs.select("text").where(F.octet_length("text") <= SAMPLE_BYTES)
    found = pa.array([r.text for r in sample.sample(fraction=SAMPLE_SHARE, seed=seed).limit(rows).collect()], pa.string())
    enc, seen = encoder(path), {}
    for cut in enc.cuts(found):
        times = np.bincount(cut.chunk, minlength=len(cut.piece_ends) - 1)[: len(cut.piece_ends) - 1]
        count = np.bincount(cut.piece, np.repeat(times, np.diff(cut.piece_ends)), len(cut.keys))
        for key, n in zip(cut.keys, count.tolist()):
            seen[key] = seen.get(key, 0) + n
    lines, size = [], 0
    for key, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries]:
        size += len(key.encode()) + 4
        if n < 2 or size > TABLE_BYTES:
            break
        if key and len(key) <= 40 and "\x00" not in key and "\x01" not in key:
            lines.append(f"{key}\x00{len(enc.pieces[key]) // 4}")
    return zlib.compress("\x01".join(lines).encode())


def unpacked(blob: bytes) -> dict[str, int]:
    raw = zlib.decompress(blob).decode()
    return {c: int(n) for c, _, n in (x.rpartition("\x00") for x in raw.split("\x01"))} if raw else {}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, table: bytes | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    path: the tokenizers file. A null text counts as empty (0 bytes, 0 tokens); null and repeated ids
    pass through; an empty table gives an empty table; other columns are ignored. Special strings in
    a text are tokens, as the library's default has it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path) if table is None else table)
    stamp = uuid.uuid4().hex

    def run(batches):
        enc = encoder(path)
        enc = enc if enc.known else encoder(path, unpacked(sent.value), stamp)
        for batch in batches:
            n = enc.counted(batch.column(1))
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
