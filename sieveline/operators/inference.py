"""Models behind a contract: versioned artefacts in a folder, loaded once a worker, and a result with a status for every text.

A model has `logits(windows)`: for each window (a list of tokens) a pair of logits, benign and malicious, or None if it has none. Texts
are cut into windows, each window is scored, and the windows of a text are rolled up in the same task: nothing is shuffled."""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from . import dataset

#: What a result can say. A text has the first of these that holds.
INVALID, NOT_LOADED, EMPTY, NO_LOGITS, NO_WINDOWS, FAILED = "Input_Error_Invalid_Text_Input_Type", "Model_Not_Loaded", "Input_Error_Empty_After_Tokenization", "No_Logits", "Windowing_Error_No_Results", "Inference_Err: "
LABELS = ("Benign", "Malicious")

PREDICTION = "status string, message string, index int, label string, p_benign double, p_malicious double, window_count int, windowed boolean, version string"
_SHAPE = pa.struct([("status", pa.string()), ("message", pa.string()), ("index", pa.int32()), ("label", pa.string()), ("p_benign", pa.float64()), ("p_malicious", pa.float64()), ("window_count", pa.int32()), ("windowed", pa.bool_()), ("version", pa.string())])


class LexiconModel:
    """Logits from weights of tokens. Windows without a known token have none; a token beyond `longest` characters is an error."""

    def __init__(self, weights: dict[str, float], bias: float = 0.0, longest: int | None = None):
        self.weights, self.bias, self.longest = weights, bias, longest

    def logits(self, windows: list[list[str]]) -> list[tuple[float, float] | None]:
        out: list[tuple[float, float] | None] = []
        for w in windows:
            if self.longest is not None and any(len(t) > self.longest for t in w):
                raise ValueError(f"a token has more than {self.longest} characters")
            known = [self.weights[t] for t in w if t in self.weights]
            out.append((0.0, self.bias + math.fsum(known)) if known else None)
        return out


class ModelStore:
    """Versions of a model below a folder of any file system that Spark knows. A version is written once, by a rename; `default` serves versions without a model of their own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, version: str, model) -> str:
        """Write a version; ValueError if it is there already. The path of the artefact."""
        if not re.fullmatch(r"[\w.+-]+", version):
            raise ValueError(f"no name of a version: {version!r}")
        target, fs = self._hadoop(f"{self.path}/{version}.model")
        temporary, _ = self._hadoop(f"{self.path}/.{version}-{uuid.uuid4().hex}")
        if fs.exists(target):
            raise ValueError(f"version {version} is there already")
        out = fs.create(temporary)
        out.write(bytearray(cloudpickle.dumps(model)))
        out.close()
        if not fs.rename(temporary, target):
            fs.delete(temporary, False)
            raise ValueError(f"version {version} is there already")
        return f"{self.path}/{version}.model"

    def versions(self) -> list[str]:
        folder, fs = self._hadoop(self.path)
        return sorted(s.getPath().getName().removesuffix(".model") for s in fs.listStatus(folder) if s.getPath().getName().endswith(".model")) if fs.exists(folder) else []

    def load(self, version: str):
        """The model of a version, on the driver."""
        p, fs = self._hadoop(f"{self.path}/{version}.model")
        source = fs.open(p)
        try:
            return pickle.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)))
        finally:
            source.close()

    def select(self, version: str) -> str | None:
        """The version that serves a release: its first three numbers, or else `default`; None without either."""
        have = self.versions()
        return next((v for v in (".".join(version.split(".")[:3]), "default") if v in have), None)


#: The worker's model: where it is from and what it is. One at a time.
_LOADED: dict[str, object] = {}


def loaded(name: str, path: str) -> tuple[object, bool]:
    """The model of an artefact, loaded once a worker process, and whether it was loaded now; another artefact's model is handed back first (close(), if it has that)."""
    fresh = name not in _LOADED
    if fresh:
        for model in _LOADED.values():
            getattr(model, "close", lambda: None)()
        _LOADED.clear()
        with open(path, "rb") as f:
            _LOADED[name] = pickle.load(f)
    return _LOADED[name], fresh


def softmax(benign: float, malicious: float) -> tuple[float, float]:
    p = 1 / (1 + math.exp(min(benign - malicious, 700)))
    return 1 - p, p


def predicted(tokens: list[str] | None, model, version: str | None, size: int = fixed.WINDOW, stride: int = fixed.STRIDE, at_once: int = 64) -> dict:
    """The result of one text. An error in any window is the text's; windows without logits don't count; of the others the one with the
    largest probability of index 1 does, the first of equals."""
    out = {"status": "error", "message": None, "index": None, "label": None, "p_benign": None, "p_malicious": None, "window_count": 0, "windowed": False, "version": version}
    if tokens is None:
        return out | {"message": INVALID}
    if model is None:
        return out | {"message": NOT_LOADED}
    if not tokens:
        return out | {"message": EMPTY}
    out["windowed"] = len(tokens) > size
    starts = range(0, len(tokens), stride) if out["windowed"] else (0,)
    best, count = None, 0
    try:
        for a in range(0, len(starts), at_once):  # a very long text is scored in blocks of windows
            for found in model.logits([tokens[s : s + size] for s in starts[a : a + at_once]]):
                if found is not None:
                    count += 1
                    p = softmax(*found)
                    best = p if best is None or p[1] > best[1] else best
    except Exception as error:
        return out | {"message": f"{FAILED}{error}"}
    if best is None:
        return out | {"message": NO_WINDOWS if out["windowed"] else NO_LOGITS}
    index = int(best[1] > best[0])
    return out | {"status": "success", "index": index, "label": LABELS[index], "p_benign": best[0], "p_malicious": best[1], "window_count": count if out["windowed"] else 0}


def predict(rows: DataFrame, text: str, store: ModelStore, version: str, size: int = fixed.WINDOW, stride: int = fixed.STRIDE, loads=None) -> DataFrame:
    """rows with `prediction` (PREDICTION) of the text column by the model that serves a version.

    Executors get the artefact by Spark's file distribution, once each, and a worker process loads it once, whatever the number of tasks
    and batches. Null texts, texts without tokens, a version without a model and failures of the model have their own messages and
    don't end the job. loads: an accumulator that counts loads."""
    spark, chosen = rows.sparkSession, store.select(version)
    source = f"{store.path}/{chosen}.model"
    # Spark keeps files by their last name, so that two stores' versions need names of their own
    if chosen is not None:
        spark.sparkContext.addFile(source)
    name = f"{chosen}.model"

    def run(batches) -> Iterator[pa.RecordBatch]:
        model, fresh = (None, False) if chosen is None else loaded(source, SparkFiles.get(name))
        if loads is not None and fresh:
            loads.add(1)
        for b in batches:
            results = [predicted(t, model, chosen, size, stride) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(results, _SHAPE)], names=[*b.schema.names[:-1], "prediction"])

    tokens = F.when(F.col(text).isNotNull(), dataset.split_tokens(F.col(text))).alias("__tokens")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.select("*", tokens).mapInArrow(run, f"{fields}, prediction struct<{', '.join(':'.join(x.split()) for x in PREDICTION.split(', '))}>")
