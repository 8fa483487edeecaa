from pyspark.sql.classic.dataframe import DataFrame

from tallymill.llm import pii


def test_training_holds_no_row_objects(spark, monkeypatch):
    """Proposals reach the driver in columns."""
    monkeypatch.setattr(DataFrame, "collect", lambda self: (_ for _ in ()).throw(AssertionError("rows are collected")))
    model = pii.train(spark, 720)
    assert set(model.threshold) >= {"secret", "account"}
