"""The comparison of Spark's rows with the oracle's."""

import pandas as pd

from litspark.plans.oracle_check import compare


def test_whole_numbers_beside_nulls_meet_their_oracle():
    oracle = pd.DataFrame({"n": pd.array([0, None, 10], dtype="Int64")})
    assert compare(pd.DataFrame({"n": [0.0, None, 10.0]}), oracle)[0]
    assert not compare(pd.DataFrame({"n": [0.0, None, 10.5]}), oracle)[0]
    assert not compare(pd.DataFrame({"n": [0.0, 1.0, 10.0]}), oracle)[0]
