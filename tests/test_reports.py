"""Result files: what is left out is not read."""

from rasterloom.sources import reports


def test_scan_exports_are_not_opened(spark, tmp_path):
    rows = spark.createDataFrame([("a", 5, 0.5, None), ("b", 6, 0.6, 1.0)], reports.RESULTS)
    reports.write_results(rows, f"{tmp_path}/x_1.csv")
    reports.write_failures(rows.selectExpr("name", "'why' AS error_msg"), f"{tmp_path}/x_1.failed.csv")
    reports.write_scan(spark.range(900).selectExpr("id AS img_id", "id AS hidx", "1 AS r", "2 AS g", "3 AS b"), f"{tmp_path}/x_1.hilbert.csv")
    (tmp_path / "alone.csv").write_text("name,compressed_size,compression_ratio,error\nc,7,0.7,\n")
    got = reports.read_results(spark, str(tmp_path))
    assert sorted((r.display_name, r.name, r.compressed_size, r.error) for r in got.collect()) == [("alone", "c", 7, None), ("x_1", "a", 5, None), ("x_1", "b", 6, 1.0)]
    leaves = got._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.size() == 1 and leaves.apply(0).metrics().apply("numOutputRows").value() == 3
