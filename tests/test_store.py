"""How tables lie in their files."""

from pyspark.sql import functions as F

from ledgerloom.sources.store import Store


def test_files_hold_ranges_of_ids(spark, tmp_path):
    store = Store(spark, str(tmp_path / "ledger"))
    rows = spark.range(3000).select(
        F.md5(F.col("id").cast("string")).alias("id"),
        F.lit("2025-01-01").alias("created_at"),
        F.lit("main").alias("account"),
        F.lit("2025-01-01").alias("import_timestamp"),
        F.concat(F.lit("file"), F.col("id").cast("string")).alias("source_file"),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store.append("imported_statements", rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    stored = store.read("imported_statements").withColumn("file", F.input_file_name())
    spans = sorted(tuple(r) for r in stored.groupBy("file").agg(F.min("id"), F.max("id")).select("min(id)", "max(id)").collect())
    assert len(spans) > 1
    assert all(before[1] < after[0] for before, after in zip(spans, spans[1:]))
    for file in {r.file for r in stored.select("file").collect()}:
        ids = [r.id for r in spark.read.parquet(file).collect()]
        assert ids == sorted(ids)
    assert [r.id for r in store.read_ordered("imported_statements").collect()] == sorted(r.id for r in rows.collect())


def test_empty_tables_stay_readable(spark, tmp_path):
    store = Store(spark, str(tmp_path / "ledger"))
    nothing = store.read("accounts")
    store.append("accounts", nothing)
    assert store.read_ordered("accounts").count() == 0
