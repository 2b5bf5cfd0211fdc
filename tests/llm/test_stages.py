"""Pipeline stages on odd, clashing and empty tables."""

import corpus_pipeline as cp
import pytest

from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name,stage", cp.STAGES[:-1])
def test_stage_keeps_columns_and_values(spark, odd, clashing, none, name, stage):
    """Columns named as the operators' own keep their values; nulls, empties and repeats don't crash."""
    plain = sorted(map(tuple, stage(spark, odd, SF_SMALL).collect()), key=repr)
    out = stage(spark, clashing, SF_SMALL)
    assert out.columns == clashing.columns and out.dtypes == clashing.dtypes
    rows = [tuple(r) for r in out.collect()]
    assert all(v == "own" for r in rows for v in r[len(odd.columns) :])
    assert sorted((r[: len(odd.columns)] for r in rows), key=repr) == plain
    assert stage(spark, none, SF_SMALL).count() == 0


def test_last_stage_on_odd_tables(spark, odd, clashing, none):
    stage = cp.STAGES[-1][1]
    rows = stage(spark, clashing, SF_SMALL).collect()
    assert len(rows) == odd.count() and sorted(map(tuple, rows), key=repr) == sorted(map(tuple, stage(spark, odd, SF_SMALL).collect()), key=repr)
    assert stage(spark, none, SF_SMALL).count() == 0
