"""Where intermediate tables are written."""

from types import SimpleNamespace

import pytest

from biotope.session import materialize, shared_folder


def fake(setting=None, checkpoint=None, master="local[8]"):
    folder = SimpleNamespace(isDefined=lambda: checkpoint is not None, get=lambda: checkpoint)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: folder)))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: setting), sparkContext=context)


def test_the_named_folder_is_used():
    assert shared_folder(fake("hdfs://nn/checkpoints/"), "stage").startswith("hdfs://nn/checkpoints/stage-")
    assert shared_folder(fake(checkpoint="hdfs://nn/set", master="yarn"), "stage").startswith("hdfs://nn/set/stage-")


def test_a_folder_of_our_own_only_in_local_mode():
    first, second = shared_folder(fake(), "stage"), shared_folder(fake(), "stage")
    assert first != second
    assert first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(fake(master=master), "stage")


def test_a_missing_table_is_an_error(spark):
    path = shared_folder(spark, "nothing")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)


def test_materialized_tables_keep_rows_and_schema(spark):
    df = spark.range(7).selectExpr("id", "cast(id as string) as name", "if(id > 3, null, id / 2) as half")
    written = materialize(df, "test")
    assert written.schema.fieldNames() == df.schema.fieldNames()
    assert written.exceptAll(df).count() == 0 and written.count() == 7
