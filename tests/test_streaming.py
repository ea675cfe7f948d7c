from netquarry.streaming.diffs import change_counts, stream_diffs

SCHEMA = "device string, stanza string, element string, ts timestamp, attr string, val string"
STATES = [
    [("2024-01-01", {"x": "1", "y": "1"})],
    [("2024-01-02", {"x": "2", "z": "1"}), ("2023-12-31", {"x": "9"})],
    [("2024-01-03", {"x": "2", "z": "1"})],
]


def test_stream_of_snapshots(spark, tmp_path):
    for k, batch in enumerate(STATES):
        rows = [("d", "ACL", "a", ts, a, v) for ts, attrs in batch for a, v in attrs.items()]
        spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).selectExpr("device", "stanza", "element", "cast(ts as timestamp) ts", "attr", "val").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 0:
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            query = stream_diffs(stream).writeStream.format("memory").queryName("diffs").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").start()
        query.processAllAvailable()
    query.stop()
    got = {(str(r["ts"].date()), r["change"], r["attr"], r["old"], r["new"]) for r in spark.table("diffs").collect()}
    assert got == {("2024-01-01", "Addition", None, None, None), ("2024-01-02", "Modification", "x", "1", "2"), ("2024-01-02", "Deletion", "y", "1", None), ("2024-01-02", "Addition", "z", None, "1")}


def test_counts_by_window(spark, tmp_path):
    rows = [("d", "ACL", f"a{k % 3}", f"2024-01-01 0{k % 2}:10:00", "x", "1") for k in range(8)]
    spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).selectExpr("device", "stanza", "element", "cast(ts as timestamp) ts", "attr", "val").write.parquet(str(tmp_path / "in"))
    query = change_counts(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "check")).outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = {r["window"]["start"].hour: (r["stanza"], r["elements"], r["rows"]) for r in spark.table("counts").collect()}
    assert got == {0: ("ACL", 3, 4), 1: ("ACL", 3, 4)}
