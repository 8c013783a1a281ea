"""Lists as bytes."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millstone.functions.id_codec import unzip_ids, unzipped, zip_ids, zipped


@pytest.mark.parametrize("kind", [pa.int16(), pa.int32(), pa.int64()])
def test_a_list_comes_back(kind):
    for ids in ([], [0], [255, 0], [256, 7], [-1, 2**15 - 1], [None], [3, None, 300], list(range(0, 30000, 7))):
        one = pa.array(ids, kind)
        assert unzip_ids(zip_ids(one), kind).equals(one)
    assert len(zip_ids(pa.array([101, 116, 97] * 500, kind))) < 300


def test_a_column_comes_back_with_its_nulls(spark):
    rows = [(1, [5, None, 70000]), (2, None), (3, []), (None, [1])]
    df = spark.createDataFrame(rows, "k long, ids array<int>")
    got = zipped(df, "ids").select("k", "_n", unzipped("_zip").alias("ids")).collect()
    assert [(r.k, r.ids) for r in got] == rows and [r._n for r in got] == [3, None, 0, 1]
    assert zipped(df.where(F.lit(False)), "ids").count() == 0
