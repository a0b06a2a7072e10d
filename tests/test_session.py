from weftline import session


def test_small_inputs_are_spread_and_stored_tables_come_back(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = session.spread(spark.read.parquet(f"{tmp_path}/t"))
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(100).repartition(16)).rdd.getNumPartitions() == 16
    back = session.stored(df, "x")
    assert back.count() == 100 and session.workspace(spark) in back.inputFiles()[0]
