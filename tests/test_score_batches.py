"""How many rows a scorer gets at once."""

from pyspark.sql import types as T

from tidings.operators.scoring import score_batches


def test_a_scorer_gets_bounded_batches(spark):
    def factory():
        return lambda words: [(len(words), None if w is None else [w, w]) for w in words]

    out = T.StructType([T.StructField("n", T.LongType()), T.StructField("twice", T.ArrayType(T.StringType()))])
    df = spark.range(0, 1000, 1, 1).selectExpr("id", "array(id, id + 1) AS other", "CASE WHEN id % 7 > 0 THEN concat('w', id) END AS word")
    rows = score_batches(df, ["word"], out, factory).collect()
    assert [(r.id, r.other, r.word) for r in rows] == [(r.id, r.other, r.word) for r in df.collect()]
    assert [r.twice for r in rows] == [None if r.word is None else [r.word] * 2 for r in rows]
    assert max(r.n for r in rows) <= 256
