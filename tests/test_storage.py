from pyspark.sql import functions as F

from latticeworks.storage import clear, drop_table, materialize, new_path, parallelism, release


def test_materialize_and_drop(spark, data):
    first = materialize(spark.range(10).withColumn("x", F.lit(None).cast("string")), "ten")
    assert first.count() == 10 and first.columns == ["id", "x"]
    assert materialize(spark.range(0), "none").count() == 0
    path = first.inputFiles()[0].rsplit("/", 1)[0]
    drop_table(first)
    assert not spark.sparkContext._jvm.java.io.File(path.removeprefix("file://").removeprefix("file:")).exists()
    release(spark)


def test_parallelism(spark, data):
    df = spark.read.parquet(f"{data}/lineitem.parquet")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parallelism(df) == least and parallelism(df, 1000) > 50
    assert parallelism(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a long")) == least


def test_clear(spark):
    kept = materialize(spark.range(3), "kept")
    place = new_path(spark, "x").rsplit("/", 1)[0]
    assert place in kept.inputFiles()[0]
    clear(spark)
    assert not spark.sparkContext._jvm.java.io.File(place).exists()


def test_spread_goes_by_what_is_read(spark, data):
    """Not by what Spark expects of joins, which multiplies."""
    from latticeworks.storage import spread

    own = spark.read.parquet(f"{data}/nation.parquet")
    many = own.join(own.withColumnRenamed("n_name", "a"), "n_regionkey").join(own.withColumnRenamed("n_name", "b"), "n_regionkey")
    assert spread(many).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spread(many, 64).rdd.getNumPartitions() > 100 and spread(own, 1 << 30).count() == 25
