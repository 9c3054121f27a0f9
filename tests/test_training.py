"""Training passes over stored counts, not over the texts."""

from pyspark.sql import functions as F

from sieveline import catalog
from sieveline.operators import scoring


def test_rows_are_computed_once_for_all_passes(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(x):
        seen.add(1)
        return ["bad", "x"] if x % 3 == 0 else ["good", "x"]

    rows = spark.range(60, numPartitions=2).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"), words("id").alias("tokens"))
    model = scoring.train_logistic(rows, "tokens", "label", features=64, maxIter=10)
    assert seen.value == 60
    plain = spark.createDataFrame([(1, ["bad", "x"]), (0, ["good", "x"])], "label int, tokens array<string>")
    assert all(r.prediction == r.label for r in model.transform(plain).collect())


def test_train_model_reads_texts_once_and_predicts_every_document(spark, tmp_path):
    docs = [(i, "rude words here" if i % 4 == 0 else "kind words there") for i in range(1, 41)] + [(41, None), (42, "")]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1, 39)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = catalog.train_model(spark, str(tmp_path))
    assert not [f for f in out.inputFiles() if "documents.parquet" in f]
    got = {r.doc_id: (r.y, r.predicted) for r in out.collect()}
    assert len(got) == 42 and all(got[i] == (int(i % 4 == 0), int(i % 4 == 0)) for i in range(1, 39)) and got[40] == (0, 1) and got[41] == got[42] == (0, 0)
