import glob

import pytest
from pyspark.sql import functions as F

from lexgauge.operators import hash_tree
from lexgauge.operators.hash_tree import tree_diff, write_snapshot
from lexgauge.operators.snapshots import snapshot_diff

ROWS = "id bigint, name string, checksum string"


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def versions(spark, count=3_000):
    old = spark.range(count).select("id", F.concat(F.lit("n"), "id").alias("name"), F.md5(F.col("id").cast("string")).alias("checksum"))
    new = (
        old.where("id % 1000 <> 7")
        .withColumn("checksum", F.when(F.col("id") == 11, "other").otherwise(F.col("checksum")))
        .union(spark.range(9_000, 9_002).selectExpr("id", "'new'", "'c'"))
    )
    return old, new


def files_read(df):
    """Files that the scans of an executed plan opened."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            found += node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_equal_to_the_full_comparison(spark, tmp_path):
    old, new = versions(spark)
    a = write_snapshot(old, str(tmp_path / "a"), "id", leaves=64, fanout=8)
    b = write_snapshot(new, str(tmp_path / "b"), "id", leaves=64, fanout=8)
    found = tree_diff(a, b)
    assert plain(found) == plain(snapshot_diff(old, new, "id"))
    leaves = hash_tree.changed_leaves(a, b)
    assert 0 < len(leaves) <= 6
    all_files = len(glob.glob(f"{tmp_path}/[ab]/rows/leaf=*/*.parquet"))
    assert all_files >= 128 and 0 < files_read(found) <= 2 * len(leaves) * all_files // 128


def test_files_of_equal_leaves_are_never_opened(spark, tmp_path):
    old, new = versions(spark)
    a = write_snapshot(old, str(tmp_path / "a"), "id", leaves=64, fanout=8)
    b = write_snapshot(new, str(tmp_path / "b"), "id", leaves=64, fanout=8)
    expected, leaves = plain(snapshot_diff(old, new, "id")), hash_tree.changed_leaves(a, b)
    for path in glob.glob(f"{tmp_path}/[ab]/rows/leaf=*/*.parquet"):
        if int(path.split("leaf=")[1].split("/")[0]) not in leaves:
            with open(path, "wb") as file:
                file.write(b"no parquet")
    for path in glob.glob(f"{tmp_path}/[ab]/rows/leaf=*/.*.crc"):
        if int(path.split("leaf=")[1].split("/")[0]) not in leaves:
            with open(path, "wb") as file:
                file.write(b"")
    assert plain(tree_diff(a, b)) == expected


def test_equal_snapshots_read_no_rows(spark, tmp_path):
    old, _ = versions(spark, 200)
    a = write_snapshot(old, str(tmp_path / "a"), "id", leaves=16, fanout=4)
    b = write_snapshot(old.repartition(7).orderBy(F.desc("id")), str(tmp_path / "b"), "id", leaves=16, fanout=4)
    assert hash_tree.changed_leaves(a, b) == []
    found = tree_diff(a, b)
    assert plain(found) == [] and files_read(found) == 0


def test_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], ROWS)
    rows = [(1, "a", "x"), (2, None, None), (3, "c", "z"), (3, "c", "z"), (4, "d", "p"), (4, "d", "q"), (None, "e", "y")]
    old = spark.createDataFrame(rows, ROWS)
    new = spark.createDataFrame([r for r in rows if r[2] != "q"] + [(5, "leaf", "l")], ROWS)
    for number, (first, second) in enumerate([(empty, old), (old, empty), (empty, empty), (old, new), (old, old)]):
        a = write_snapshot(first, str(tmp_path / f"a{number}"), "id", leaves=8, fanout=2)
        b = write_snapshot(second, str(tmp_path / f"b{number}"), "id", leaves=8, fanout=2)
        assert plain(tree_diff(a, b)) == plain(snapshot_diff(first, second, "id"))


def test_different_trees_are_refused(spark, tmp_path):
    old, _ = versions(spark, 20)
    a = write_snapshot(old, str(tmp_path / "a"), "id", leaves=8, fanout=2)
    b = write_snapshot(old, str(tmp_path / "b"), "id", leaves=16, fanout=2)
    with pytest.raises(ValueError, match="trees"):
        tree_diff(a, b)


def test_changes_turn_the_old_into_the_new(spark, tmp_path):
    old, new = versions(spark)
    a = write_snapshot(old, str(tmp_path / "a"), "id", leaves=64, fanout=8)
    b = write_snapshot(new, str(tmp_path / "b"), "id", leaves=64, fanout=8)
    changes = hash_tree.write_changes(a, b, str(tmp_path / "c"))
    kept = old.join(changes.select("id"), "id", "left_anti")
    patched = kept.unionByName(changes.where("change <> 'removed'").drop("change"))
    assert plain(patched) == plain(new)


def test_a_hot_key_is_split(spark, tmp_path):
    rows = spark.range(5_000).selectExpr("IF(id % 3 = 0, 1, id) AS id", "'n' AS name", "md5(string(id)) AS checksum")
    a = write_snapshot(rows, str(tmp_path / "a"), "id", leaves=8, fanout=2)
    b = write_snapshot(rows.where("checksum <> md5('300')"), str(tmp_path / "b"), "id", leaves=8, fanout=2)
    assert [r["change"] for r in tree_diff(a, b).collect()] == ["changed"]
