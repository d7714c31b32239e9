"""The engine's functions in SQL: temporary functions of plain expressions, Arrow functions, and a table function of tokens."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quarry.functions import fuzzy, text

#: Functions that are one SQL expression: parameters, result, body.
EXPRESSIONS = {
    "path_parent": ("p STRING", "STRING", "regexp_replace(p, '/[^/]*$', '')"),
    "path_name": ("p STRING", "STRING", "element_at(split(p, '/'), -1)"),
    "path_within": ("p STRING, r STRING", "BOOLEAN", "r = '/' OR p = r OR startswith(p, concat(r, '/'))"),
    "usage_decay": ("v DOUBLE, ts BIGINT, now BIGINT", "DOUBLE", "v * pow(2D, -greatest(now - ts, 0) / 1209600D)"),
    "usage_boost": ("w DOUBLE, most DOUBLE, half DOUBLE", "INT", "CASE WHEN w <= 0 THEN 0 ELSE CAST(round(most * w / (w + half)) AS INT) END"),
}


@udtf(returnType="pos int, token string, start int")
class Tokenize:
    """tokenize(text): the normalised tokens of a name, their numbers and where they start."""

    def eval(self, name: str):
        if name is None:
            return
        norm, toks, _, _, starts = text.analysis(name)
        at = 0
        for k, t in enumerate(toks):
            at = next(i for i in range(at, len(norm)) if starts[i] and norm.startswith(t, i))
            yield k, t, at
            at += len(t)


def register(spark: SparkSession) -> None:
    for name, (parameters, result, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udf.register("fold_name", text.folded)
    spark.udf.register("fuzzy_score", fuzzy.optimal)
    spark.udtf.register("tokenize", Tokenize)
