from pathlib import Path

from tessera import scratch


def test_materialise_writes_to_the_shared_folder_and_clean_removes_it(spark):
    df = scratch.materialise(spark.range(5).withColumnRenamed("id", "n"), "numbers")
    assert sorted(r.n for r in df.collect()) == [0, 1, 2, 3, 4]
    where = df.inputFiles()[0]
    assert where.startswith(scratch.shared_dir(spark).replace("file://", "file:"), 0) or scratch.shared_dir(spark).split("://")[-1] in where
    path = Path(where.replace("file://", "").replace("file:", ""))
    assert path.exists()
    scratch.clean(spark)
    assert not path.exists()


def test_empty_table_keeps_its_schema(spark):
    df = scratch.materialise(spark.range(0), "none")
    assert df.columns == ["id"] and df.count() == 0


def test_released_tables_are_gone(spark):
    from pathlib import Path

    from tessera import scratch

    one, two = scratch.materialise(spark.range(3), "one"), scratch.materialise(spark.range(4), "two")
    at = [Path(t._written_to.removeprefix("file://")) for t in (one, two)]
    assert all(p.exists() for p in at)
    scratch.release(one)
    assert not at[0].exists() and two.count() == 4
