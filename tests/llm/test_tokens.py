"""Token counts, packing and token files against the tokenizers library."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarry.llm import tokens
from quarry.llm.packing import cuts, pack
from quarry.llm.token_counts import count_tokens
from quarry.llm.token_files import digests, read_metadata, read_tokens, write_tokens
from quarry.llm.tokens import Generations, encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(struct.pack(f"<{len(values)}I", *values))


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_cached_ids_equal_the_library(path, rows, monkeypatch):
    texts = [r[1] or "" for r in rows] + ["don't  stop", " lead", "trail ", "a\n\nb \n c", "I'LL we've", "cafés ÉTÉ", "x y z", "²½ 3ª", "é ẞ İI", "a\x7fb", "'s 's''re", "\r\n\r\n"]
    rng = random.Random(3)
    odd = " \n\t'sdrélm.!0１ªßİ\x0b\x0c\u3000\x85é中-ÉÀ×÷\x1f"
    texts += ["".join(rng.choices(odd, k=rng.randint(0, 30))) for _ in range(2000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "SLICE", 4096)
    monkeypatch.setattr(tokens, "GATHER", 100)
    got = []
    for ids, n in encoder(path).encoded(pa.array([*texts, None])):
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [*want, []]
    assert encoder(path).counted(pa.array(texts)).tolist() == [len(x) for x in want]


def test_generations_are_bounded():
    g = Generations(len, 3)
    assert [g[x] for x in ("a", "bb", "ccc", "dddd", "a")] == [1, 2, 3, 4, 1]
    assert len(g) <= 3 and len(g.old) <= 3


def test_counts(docs, none, rows):
    got = Counter(tuple(r) for r in count_tokens(docs, BYTES).collect())
    want = Counter((i, len((t or "").encode()), n := len(ids(BYTES, t)), n > 1024) for i, t, *_ in rows)
    assert got == want
    assert count_tokens(none, BYTES).collect() == []


def test_cuts_fill_their_class():
    for n in range(1, 5000, 7):
        parts = cuts(n, 2048, 0.03)
        assert sum(parts) == n and all(0 < p <= 2048 for p in parts)


def test_packing(docs, none, rows):
    got = pack(docs, BYTES).collect()
    want = Counter()
    by_doc = defaultdict(list)
    for i, t, *_ in rows:
        by_doc[i].append([*ids(BYTES, t), 1])
    pieces = defaultdict(list)
    for r in got:
        assert any(crc(d[r.start : r.start + r.length]) == r.ids_crc32 and len(d) == r.doc_tokens for d in by_doc[r.doc_id])
        pieces[r.sequence_id].append(r)
        want[r.doc_id] += r.length
    assert want == Counter({i: sum(map(len, d)) for i, d in by_doc.items()})
    for s in pieces.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(2048 - sum(r.length for r in s) for s in pieces.values()) < 2 * 2048
    assert pack(none, BYTES).collect() == []


def test_files(spark, docs, none, rows, tmp_path):
    path = write_tokens(docs, WORDS, f"file://{tmp_path}/t")
    got = sorted(digests(read_tokens(spark, path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    want = Counter((i, crc([*ids(WORDS, t), 2])) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.tokens[-1] for r in read_tokens(spark, path, [7]).collect()] == [2]
    plan = read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "tokens#" not in plan.replace("n_tokens#", "")
    assert digests(read_tokens(spark, write_tokens(none, WORDS))).collect() == []


def test_layout_of_files(spark, tmp_path):
    """Bounded row groups, encodings and page indexes, as the files have them."""
    import pyarrow.parquet as pq

    from quarry.llm.token_files import LAYOUT

    rng = random.Random(4)
    some = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    df = spark.createDataFrame(some, "doc_id long, text string")
    path = write_tokens(df, WORDS, f"file://{tmp_path}/t", partitions=1, layout={**LAYOUT, "parquet.block.row.count.limit": "100", "parquet.page.row.count.limit": "20"})
    metas = [pq.ParquetFile(f).metadata for f in tmp_path.glob("t/*.parquet")]
    groups = [m.row_group(i) for m in metas for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 400 and max(g.num_rows for g in groups) <= 100
    columns = [g.column(i) for g in groups for i in range(g.num_columns)]
    encodings = {c.path_in_schema: set(c.encodings) for c in columns}
    assert any(e & {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} for e in encodings.values()) and "RLE_DICTIONARY" in encodings["tokens.list.element"] | encodings.get("tokens.array", set())
    assert all(c.has_column_index and c.has_offset_index and c.compression == "ZSTD" for c in columns)
    # beyond the bound of a dictionary numbers are delta-encoded
    wide = spark.range(400).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 50), i -> conv(xxhash64(id, i), 10, 36))) AS text")
    path = write_tokens(wide, WORDS, f"file://{tmp_path}/w", partitions=1, layout={**LAYOUT, "parquet.dictionary.page.size": "64"})
    metas = [pq.ParquetFile(f).metadata for f in tmp_path.glob("w/*.parquet")]
    found = {e for m in metas for i in range(m.num_row_groups) for j in range(m.row_group(i).num_columns) if "tokens" in m.row_group(i).column(j).path_in_schema and "n_tokens" != m.row_group(i).column(j).path_in_schema for e in m.row_group(i).column(j).encodings}
    assert "DELTA_BINARY_PACKED" in found
