"""Compiled objects go to Spark column by column: the rows are those of the dictionaries."""

import pyarrow as pa

from sieveline.operators import compile as K
from sieveline.operators.objects import INSTRUCTION

SOURCES = [("python", "from os import (path, sep as s)\nx = f(1, a=2, b='ü')\n"), ("javascript", "function f(a) { return a + 1; }\nlet x = `a${f(1)}`;"), ("python", "def (:"), ("python", ""), ("cobol", "x")]


def test_a_batch_by_columns_is_the_batch_of_the_dictionaries(spark):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    shape = to_arrow_schema(_parse_datatype_string(f"language string, name string, source_code string, start int, end int, warnings array<string>, instructions array<{INSTRUCTION}>"))
    rows = [{"language": lang, **o} for lang, source in SOURCES for o in K._objects("p", source, lang)]
    plain = [{"language": lang, **o} for lang, source in SOURCES for o in K.compile_source("p", source, lang)]
    assert any(i[3] for r in rows for i in r["instructions"])
    assert K._batch(rows, shape).equals(pa.RecordBatch.from_pylist(plain, shape))


def test_files_give_the_objects_of_their_sources(spark):
    files = spark.createDataFrame([(f"p{n}", lang, source) for n, (lang, source) in enumerate(SOURCES)], "path string, language string, content string")
    got = {(r.file_path, r.name): [i.asDict(True) for i in r.instructions] for r in K.compile_files(files).collect()}
    assert got == {(f"p{n}", o["name"]): o["instructions"] for n, (lang, source) in enumerate(SOURCES) for o in K.compile_source(f"p{n}", source, lang)}
