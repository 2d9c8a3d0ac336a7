import pytest
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.operators.versions import VersionedTable


@pytest.fixture
def table(spark):
    return VersionedTable(spark, storage.fresh_path(spark, "versions"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_swap_and_back(spark, table):
    assert table.history() == [] and table.current() is None
    with pytest.raises(LookupError):
        table.read()
    assert table.write(spark.range(3)) == 1
    before = table.read()
    assert table.write(spark.range(5).withColumn("wide", F.lit("x"))) == 2
    # a frame that was read stays what it was
    assert ids(before) == [0, 1, 2] and before.columns == ["id"]
    assert ids(table.read()) == [0, 1, 2, 3, 4] and table.read().columns == ["id", "wide"]
    assert table.rollback() == 3 and table.read().columns == ["id"] and ids(table.read(2)) == [0, 1, 2, 3, 4]
    assert table.rollback(2) == 4 and table.current() == table.history()[1][1]
    with pytest.raises(LookupError):
        table.rollback(9)
    with pytest.raises(LookupError):
        table.read(9)


def test_a_failed_write_leaves_what_held(spark, table):
    table.write(spark.range(3))
    with pytest.raises(Exception, match="no luck"):
        table.write(spark.range(3).withColumn("x", F.when(F.col("id") == 2, F.raise_error(F.lit("no luck")))))
    assert [n for n, _ in table.history()] == [1] and ids(table.read()) == [0, 1, 2]
    with pytest.raises(LookupError):  # nor can half a version be made to hold
        table.point("nothing")


def test_of_two_writers_one_wins(spark, table):
    table.write(spark.range(1))
    mine, theirs = table.stage(spark.range(2)), table.stage(spark.range(3))
    assert table.point(theirs, after=1) == 2
    with pytest.raises(RuntimeError):
        table.point(mine, after=1)
    assert ids(table.read()) == [0, 1, 2] and len(table.history()) == 2
    assert table.point(mine) == 3 and ids(table.read()) == [0, 1]


def test_empty_partitioned_views_and_pruning(spark, table):
    table.write(spark.range(4).withColumn("p", F.col("id") % 2), "p")
    table.view("versions_now")
    assert spark.table("versions_now").where("p = 1").count() == 2
    table.write(spark.range(0))
    assert table.read().count() == 0 and table.read().columns == ["id"]
    never = table.stage(spark.range(1))
    first = table.history()[0][1]
    assert table.prune(1) == sorted([first, never]) and table.read().count() == 0
    with pytest.raises(ValueError):
        table.prune(0)
