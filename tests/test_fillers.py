import pytest

from weftlink.operators.learn import as_list


def test_too_many_fillers_are_refused(spark):
    df = spark.createDataFrame([(t,) for t in ("of", "the", "and")], "token string")
    assert as_list(df, 3) == ["and", "of", "the"]
    with pytest.raises(ValueError, match="more than 2"):
        as_list(df, 2)
