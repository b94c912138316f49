from urlshift.operators.replace import Step
from urlshift.streaming.rewrite import rewrite_stream


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"https://h{i % 15}.com/x") for i in range(100)], "i long, t string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    steps = [Step(n + 1, n, 1, f"//h{n}.com", f"//n{n}.test") for n in range(15)]
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = (
        rewrite_stream(stream, steps).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    job.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [(i, f"https://n{i % 15}.test/x") for i in range(100)]
