"""How the training rows of the text classifier are cut into parts."""

from tidings.operators import evaluate


def test_parts_grow_in_number_and_not_in_size(spark, monkeypatch):
    parts = []

    class Recorder:
        def fit(self, train):
            parts.append((train.rdd.getNumPartitions(), train.count()))
            return self

        def transform(self, test):
            return test.selectExpr("0.0D AS label_index", "0.0D AS prediction")

    monkeypatch.setattr(evaluate, "text_classifier", lambda *a, **k: Recorder())
    monkeypatch.setattr(evaluate, "ROWS_PER_PART", 10)
    df = spark.range(0, 95, 1, 2).selectExpr("concat('word', id) AS text", "'a' AS lang")
    evaluate.evaluate_text_classifier(df, df, "text", "lang")
    assert parts == [(10, 95)]
