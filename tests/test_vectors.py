"""A table of vectors by model: pruned scans, replaced and purged models."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.operators import vectors


def test_put_scan_and_purge(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = lambda m, ids: spark.createDataFrame([(i, [float(i)], m) for i in ids], "id long, vector array<double>, model string")
    vectors.put(rows("a", range(6)).union(rows("b/x y", range(4))).union(rows(None, [9])), path)
    of = lambda m: sorted(r["id"] for r in vectors.of_model(spark, path, m).collect())
    plan = vectors.of_model(spark, path, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan and "PushedFilters: []" in plan
    files = lambda m: {r[0] for r in vectors.of_model(spark, path, m).select(F.input_file_name()).collect()}
    other = files("b/x y")
    assert other and all("/model=b" in f for f in other)
    vectors.put(rows("a", [1, 2, 3]), path)
    assert of("a") == [1, 2, 3] and of("b/x y") == [0, 1, 2, 3]
    vectors.purge(spark, path, "a", spark.createDataFrame([(1,), (1,), (77,)], "id long"))
    assert of("a") == [2, 3] and files("b/x y") == other  # not one file of the other is touched
    vectors.purge(spark, path, "a", spark.createDataFrame([(2,), (3,)], "id long"))
    assert of("a") == []
    vectors.purge(spark, path, "absent")
    assert of("b/x y") == [0, 1, 2, 3]
    vectors.put(rows("c", [5]), path)
    vectors.purge(spark, path, "b/x y")
    assert of("b/x y") == [] and of("c") == [5]
