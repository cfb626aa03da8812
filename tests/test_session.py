"""The shared folder and work tables."""

from veritrail.session import clear_work, materialize, shared_dir


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)
    df = materialize(spark.range(3), "t")
    assert df.count() == 3 and materialize(spark.range(0), "t").count() == 0
    assert all(p.startswith("file:") and "/veritrail/t-" in p for p in df.inputFiles())
    clear_work(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/veritrail")
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
