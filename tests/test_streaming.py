from conftest import rows
from kmergrid.config import SketchConfig
from kmergrid.operators.sketch import sketch_plan
from kmergrid.streaming import counts
from test_sketch import make_sequences


def test_stream_equals_batch(spark, tmp_path):
    config = SketchConfig(11, 40, min_cov=3, track_cov=True)
    df = spark.createDataFrame(make_sequences(8), "sample string, seq string")
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in df.randomSplit([0.5, 0.5], seed=1):
        part.coalesce(2).write.mode("append").parquet(inbox)
        stream = counts.sequence_stream(spark, inbox, files_per_batch=1)
        counts.store_counts(stream, out, str(tmp_path / "ckpt"), 11).awaitTermination()
    assert rows(counts.current_sketch(spark, out, config)) == rows(sketch_plan(df, config))
