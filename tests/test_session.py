import types

import pytest

from vespera.session import materialize, scratch_dir


def fake(master, conf=None, checkpoint=None):
    context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint)
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default: conf), sparkContext=context)


def test_shared_folder_comes_from_the_session():
    assert scratch_dir(fake("spark://x", "hdfs:///shared")) == "hdfs:///shared"
    assert scratch_dir(fake("spark://x", None, "hdfs:///set")) == "hdfs:///set"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(fake("spark://x"))


def test_materialized_rows_and_schema(spark):
    df = spark.createDataFrame([(1, ["a"], None)], "i long, a array<string>, d date")
    back = materialize(df, "t")
    assert back.schema == df.schema and back.collect() == df.collect()
    assert materialize(df.limit(0), "t").count() == 0
