from skyloom.sources.tables import derby_archive, read_jdbc

ROW = "star_id bigint, n int, x double, name string"


def test_a_database_is_a_file_that_any_process_reads(spark, tmp_path):
    """No memory of the driver is named by the URL, values come back as they are, and parts hold all rows."""
    names = ["a", " lead", "trail  ", 'q"uo"te', "com,ma", "li\nne", "", None, "Été Ωμ", "\\back"]
    rows = [(i * 7 - 20, None if i % 3 == 0 else i, [0.1, -1e-300, None, 1.7976931348623157e308][i % 4], names[i % 10]) for i in range(40)]
    df = spark.createDataFrame(rows, ROW).repartition(3)
    url = derby_archive(df, str(tmp_path), "stars")
    assert ":memory:" not in url and str(tmp_path) in url and len(list(tmp_path.iterdir())) == 1
    got = read_jdbc(spark, url, "stars", "star_id", 4).toDF("star_id", "n", "x", "name")
    assert sorted(map(tuple, got.collect())) == sorted(rows) and got.rdd.getNumPartitions() == 4
    none = read_jdbc(spark, derby_archive(df.limit(0), str(tmp_path / "none"), "stars"), "stars", "star_id", 4)
    assert none.count() == 0 and len(none.columns) == 4
