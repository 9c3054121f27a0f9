"""Results with a status, versions of models, and training over sequences."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import inference, scoring, sequence
from sieveline.operators.inference import LexiconModel, ModelStore, predict, predicted


@pytest.fixture
def store(spark, tmp_path):
    return ModelStore(spark, f"file://{tmp_path}/models")


class Broken:
    def logits(self, windows):
        raise RuntimeError("no such device")


class Late(LexiconModel):
    """Fails on the last window only."""

    def logits(self, windows):
        if any("poison" in w for w in windows):
            raise RuntimeError("poison")
        return super().logits(windows)


def test_statuses_and_their_order():
    model = LexiconModel({"evil": 3.0, "good": -3.0})
    status = lambda t, m=model: (lambda r: (r["status"], r["message"]))(predicted(t, m, "v"))
    assert status(["evil"]) == ("success", None)
    assert status(None, None) == ("error", "Input_Error_Invalid_Text_Input_Type")
    assert status([], None) == ("error", "Model_Not_Loaded")
    assert status([]) == ("error", "Input_Error_Empty_After_Tokenization")
    assert status(["other"]) == ("error", "No_Logits")
    assert status(["other"] * 513) == ("error", "Windowing_Error_No_Results")
    assert status(["x"], Broken()) == ("error", "Inference_Err: no such device")
    # a window that fails spoils the text, also behind windows that have results; one without logits doesn't
    assert status(["evil"] * 40_000 + ["poison"], Late({"evil": 3.0})) == ("error", "Inference_Err: poison")
    r = predicted(["other"] * 600 + ["evil"] + ["other"] * 400 + ["good"] * 300, model, "v")
    assert (r["status"], r["label"], r["windowed"], r["window_count"]) == ("success", "Malicious", True, 3)
    assert predicted(["good"], model, "v")["label"] == "Benign" and predicted(["evil", "good"], model, "v")["index"] == 0


@pytest.mark.parametrize(("n", "windows"), [(1, 0), (512, 0), (513, 2), (800, 3), (896, 3), (897, 3), (1000, 3)])
def test_windows_of_a_text(n, windows):
    r = predicted(["a"] * n, LexiconModel({"a": 0.001}), "v")
    assert r["window_count"] == windows and r["p_malicious"] == pytest.approx(inference.softmax(0, min(n, 512) * 0.001)[1])


def test_versions(spark, store):
    assert store.versions() == [] and store.select("1.2.3") is None
    store.save("1.2.3", LexiconModel({"a": 1.0}))
    assert store.select("1.2.3.dev4") == "1.2.3" and store.select("1.2.4") is None
    store.save("default", LexiconModel({"a": -1.0}))
    assert store.select("1.2.4") == "default" and store.versions() == ["1.2.3", "default"]
    assert store.load("1.2.3").weights == {"a": 1.0}
    with pytest.raises(ValueError):
        store.save("1.2.3", LexiconModel({}))
    with pytest.raises(ValueError):
        store.save("../x", LexiconModel({}))
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    got = {(v, r.id): r.prediction for v in ("1.2.3", "7.7.7") for r in predict(rows, "text", store, v).collect()}
    assert got["1.2.3", 1].label == "Malicious" and got["7.7.7", 1].label == "Benign" and got["7.7.7", 1].version == "default"
    assert got["1.2.3", 2].message == inference.INVALID


def test_a_worker_loads_a_model_once_and_hands_it_back(spark, store, tmp_path):
    closed = tmp_path / "closed"

    class Noted(LexiconModel):
        def close(self):
            with open(closed, "a") as f:
                f.write(f"{os.getpid()}\n")

    for version in ("5.0.1", "5.0.2"):
        store.save(version, Noted({"a": 1.0}))
    loads = spark.sparkContext.accumulator(0)
    rows = spark.range(4000).select(F.col("id"), F.lit("a b").alias("text")).repartition(16)
    who = F.udf(lambda _: os.getpid(), "int")
    pids = predict(rows, "text", store, "5.0.1", loads=loads).withColumn("pid", who(F.col("prediction.label"))).select("pid").distinct().count()
    assert pids <= 8 and 1 <= loads.value <= 8, "16 tasks, but a load for each worker process only"
    again = loads.value
    predict(rows, "text", store, "5.0.1", loads=loads).write.format("noop").mode("overwrite").save()
    assert loads.value <= again + 4
    predict(rows, "text", store, "5.0.2", loads=loads).write.format("noop").mode("overwrite").save()
    assert closed.exists() and loads.value > again


def test_order_of_tokens_is_learned(spark, store):
    r = random.Random(1)
    rows = []
    for i in range(1200):
        tokens = [r.choice("abcdefgh") for _ in range(r.randint(3, 30))]
        at = r.randint(0, len(tokens))
        bad = r.random() < 0.4
        tokens[at:at] = ["fetch", "exec"] if bad else ["exec", "fetch"]
        rows.append((i, tokens, int(bad)))
    rows += [(-1, [], 1), (-2, ["a"], None)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, label int")
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0 AND id >= 0")
    model = sequence.train_sequence(train, "tokens", "label", store, rounds=6, workers=4)
    assert store.versions() == [f"step-{k:04}" for k in range(1, 7)]
    found = predict(test.withColumn("text", F.concat_ws(" ", "tokens")), "text", _saved(spark, store, model), "1.0.0")
    f1 = scoring.binary_metrics(found.withColumn("p", F.col("prediction.index")), "label", "p").first()["f1"]
    plain = scoring.train_logistic(train.where("size(tokens) > 0 AND label IS NOT NULL"), "tokens", "label", maxIter=20).transform(test)
    assert f1 > 0.9 > scoring.binary_metrics(plain, "label", "prediction").first()["f1"]
    # a call with all steps there trains no further; one that lacks the last goes on from the step before
    assert (sequence.train_sequence(train, "tokens", "label", store, rounds=6, workers=4).weights[1] == model.weights[1]).all()
    last = store._hadoop(f"{store.path}/step-0006.model")
    last[1].delete(last[0], False)
    resumed = sequence.train_sequence(train, "tokens", "label", store, rounds=6, workers=4)
    assert abs(resumed.weights[1] - model.weights[1]).max() < 1e-9


def _saved(spark, store, model):
    out = ModelStore(spark, f"{store.path}-final")
    out.save("1.0.0", model)
    return out


def test_features_are_the_same_in_both_worlds(spark):
    words = ["a", "é", "", "a b", "exec"]
    got = spark.createDataFrame([(words,)], "t array<string>").select(sequence.features(F.col("t"), 4096)).first()[0]
    assert got == sequence.numbers(words, 4096).tolist()
