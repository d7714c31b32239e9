"""The pipeline's stages on odd tables: nulls in any column, empty and very long texts, repeated rows, ties, no rows, clashing names."""

import random
from collections import Counter

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from quarry.llm import langid, quality

from .conftest import prose
from .test_near_dups import brute

CLASHES = ["_gone", "_row", "_g", "distance", "kept", "component", "n", "a`b", "doc", "_x0", "_lang", "_share", "words", "stage col"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(12)
    item = prose(rng, 40)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(120)]
    rows = [(i, t, "en" if i % 3 else "fr", "s") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[4], (200, texts[5], "en", "s"), (None, prose(rng, 100), "en", "s"), (None, texts[6], None, None)]
    rows += [(300, None, "en", "s"), (301, "", "en", "s"), (302, " \n\t", None, "s"), (303, "12 34", "en", None), (304, prose(rng, 20_000), "en", "s"), (305, texts[7] + " " + item, "en", "s"), (306, "x" * 300_000, "en", "s")]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, item), (2, None), (None, item[:50])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)], F.lit(None).cast("string").alias("empty"))
    return df.repartition(3, "text"), rows, folder


def left(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_keep_columns_and_empty_tables(spark, odd):
    df, _, folder = odd
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, df.where("false"), folder)
        assert out.dtypes == df.dtypes and out.collect() == []
    assert cp.pack(spark, df.where("false"), folder).collect() == []


def test_quality_stage(spark, odd):
    df, rows, folder = odd
    out = cp.quality_rules(spark, df, folder)
    assert out.columns == df.columns and out.select(CLASHES[0], F.col("`a``b`")).distinct().collect() == [(0, CLASHES.index("a`b"))]
    judged = Counter((r.doc_id, r.n_words) for r in quality.judged(df).where("kept").collect())
    assert Counter((i, len(t.split())) for i, t in left(out).elements()) == judged
    gone = {300, 301, 302, 303, 306}
    assert all(i not in gone for i, _ in left(out)) and left(out)[(3, rows[3][1])] == 3 and (None, rows[6][1]) in left(out)


def test_language_stage(spark, odd):
    df, _, folder = odd
    out = cp.language_id(spark, df, folder)
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 != 2
    accepted = Counter(r.doc_id for r in langid.identify(df, langid.fit(df, training)).where("accepted").collect())
    assert Counter(i for i, _ in left(out).elements()) == accepted and not {300, 301, 302, 303} & set(accepted)
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert cp.language_id(spark, unlabelled, folder).collect() == []


def test_near_dedup_stage(spark, odd):
    df, rows, folder = odd
    groups = brute([r for r in rows if r[0] is not None])
    want = Counter((r[0], r[1]) for r in rows if r[0] is None or groups[r[0]] == r[0])
    assert left(cp.near_dedup(spark, df, folder)) == want and not any(i == 200 for i, _ in want)


def test_decontamination_stage(spark, odd):
    df, rows, folder = odd
    assert left(cp.decontaminate(spark, df, folder)) == Counter((r[0], r[1]) for r in rows if r[0] != 305)


def test_packing_stage(spark, odd):
    df, rows, folder = odd
    got = cp.pack(spark, df, folder).collect()
    assert Counter(r.doc_id for r in got if r.start == 0) == Counter(r[0] for r in rows)
    assert {r.doc_tokens for r in got if r.doc_id in (300, 301)} == {1}


def test_tables_of_a_stage_go_when_its_result_stands(spark, odd):
    from quarry.llm.common import settled, shared_dir

    df, _, folder = odd
    fs = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda: {s.getPath().getName() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)))}
    before = names()
    out = settled(spark, lambda: cp.quality_rules(spark, df, folder), "kept")
    assert len(names() - before) == 1 and out.count() > 100
