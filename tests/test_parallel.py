from tellurion.plans.parallel import spread


def test_small_tables_are_spread_and_others_left_alone(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    small = spark.read.parquet(str(tmp_path / "t"))
    assert small.rdd.getNumPartitions() == 1 and spread(small).rdd.getNumPartitions() == 4
    many = spark.range(0, 10, 1, 9)
    assert spread(many) is many
    shuffled = small.groupBy("id").count()
    assert spread(shuffled) is shuffled
