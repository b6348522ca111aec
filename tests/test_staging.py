from pathlib import Path
from types import SimpleNamespace

import pytest

from gradeloom import staging


def session(master, setting=None, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder, setCheckpointDir=lambda path: None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: setting))


def test_the_named_folder_is_used():
    assert staging.shared_dir(session("yarn", "hdfs://shared/tables/")) == "hdfs://shared/tables"
    assert staging.shared_dir(session("yarn", None, "hdfs://shared/app")) == "hdfs://shared/app"


def test_a_cluster_must_name_a_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(session("yarn"))
    assert staging.shared_dir(session("local[2]"))


def test_staged_tables_keep_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None, [1.5]), (2, "x", [])], "a int, b string, c array<double>")
    staged = staging.stage(df)
    assert staged.schema == df.schema and sorted(staged.collect()) == sorted(df.collect())


def test_temporary_tables_go_at_the_end(spark):
    with staging.temporary_tables(spark):
        staged = staging.stage(spark.range(3), "numbers")
        files = staged.inputFiles()
        assert staged.count() == 3
    kept = staging.stage(spark.range(3), "numbers")
    assert not any(Path(file.removeprefix("file:")).exists() for file in files)
    assert kept.count() == 3
