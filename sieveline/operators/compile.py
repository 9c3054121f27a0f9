"""The compiler as a table function: a row for each file in, a row for each object out."""

from __future__ import annotations

import re
import sys
import threading
from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate, groupby
from warnings import filterwarnings

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .compile_python import PythonFrontend
from .compile_script import ScriptFrontend
from .objects import INSTRUCTION

FRONTENDS = {"python": PythonFrontend, "javascript": ScriptFrontend}
COMPILED = f"path string, name string, source_code string, start int, end int, warnings array<string>, instructions array<{INSTRUCTION}>"
#: Stack of the thread that compiles, as deep nesting needs one of its own, and calls that it may nest.
STACK_BYTES, NESTED_CALLS = 256 << 20, 15_000
#: Bytes of source whose objects go on together.
BATCH_BYTES = 4 << 20

_THREAD: ThreadPoolExecutor | None = None


def _thread() -> ThreadPoolExecutor:
    """The one thread of this process that compiles: made once, with a large stack."""
    global _THREAD
    if _THREAD is None:
        before = threading.stack_size(STACK_BYTES)
        try:
            _THREAD = ThreadPoolExecutor(1, "compile")
            _THREAD.submit(sys.setrecursionlimit, max(sys.getrecursionlimit(), NESTED_CALLS)).result()
            # what a scanned source's strings are like is no concern of this process's log
            filterwarnings("ignore", category=SyntaxWarning, module="<unknown>")
        finally:
            threading.stack_size(before)
    return _THREAD


def _compiled(path: str, source: str, language: str) -> list[dict]:
    try:
        return [{**o, "warnings": []} for o in FRONTENDS[language](path, source).compile()]
    except SyntaxError:
        return [_failed(source, "MALFORMED_SYNTAX")]
    except Exception:  # whatever a hostile source brings about is its own failure, not the job's
        return [_failed(source, "MALFORMED_FILE")]


def compile_source(path: str, source: str, language: str) -> list[dict]:
    """The objects of one source. What can't be compiled is one object without instructions and a warning: MALFORMED_SYNTAX where nothing of it is in the language, MALFORMED_FILE for another failure or language."""
    return [{**o, "instructions": [_plain(i, language) for i in o["instructions"]]} for o in _objects(path, source, language)]


def _objects(path: str, source: str, language: str) -> list[dict]:
    """The objects of one source with instructions as tuples (opcode, kind, text, items)."""
    return _thread().submit(_compiled, path, (source or "").replace("\x00", ""), language).result()


def _plain(instruction: tuple, language: str) -> dict:
    op, kind, text, items = instruction
    return {"opcode": op, "arg_kind": kind, "arg": text, "language": language, "items": [{"kind": k, "text": t} for k, t in items]}


def _failed(source: str, *warnings: str) -> dict:
    return {"name": "<module>", "source_code": source, "start": 1, "end": source.count("\n") + 1, "warnings": list(warnings), "instructions": []}


def _lists(lengths: list[int], kind: pa.DataType, columns: list[pa.Array]) -> pa.Array:
    """Lists of structs of so many members each, of the members' columns."""
    offsets = pa.array([0, *accumulate(lengths)], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(kind.value_type)), type=kind)


def _instructions(lengths: list[int], flat: list[tuple], languages: list[str], kind: pa.DataType) -> pa.Array:
    """Lists of so many instructions each, laid out column by column, without a dictionary for each."""
    members = [m for i in flat for m in i[3]]
    item = kind.value_type.field("items").type
    items = _lists([len(i[3]) for i in flat], item, [pa.array([m[k] for m in members], item.value_type[k].type) for k in range(2)])
    columns = [*(pa.array(x, kind.value_type[k].type) for k, x in enumerate(([i[0] for i in flat], [i[1] for i in flat], [i[2] for i in flat], languages))), items]
    return _lists(lengths, kind, columns)


def _batch(objects: list[dict], shape: pa.Schema) -> pa.RecordBatch:
    """Objects as a batch. Instructions are by far the most values."""
    flat = [i for o in objects for i in o["instructions"]]
    languages = [o["language"] for o in objects for _ in o["instructions"]]
    instructions = _instructions([len(o["instructions"]) for o in objects], flat, languages, shape.field("instructions").type)
    return pa.RecordBatch.from_arrays([instructions if f.name == "instructions" else pa.array([o[f.name] for o in objects], f.type) for f in shape], schema=shape)


def compile_files(files: DataFrame, path: str = "path", language: str = "language", content: str = "content", size: str | None = None, carry: list[str] | None = None, warnings: str | None = None) -> DataFrame:
    """Objects of each file: the columns of carry, file_path, file_size, language, name, source_code, start, end, warnings, instructions. Row-wise, no shuffle; null content is empty.

    A file whose column `warnings` (an array) isn't empty was refused by its source: it is one object with these warnings and without instructions."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    carried = carry or []
    whole = F.col(size) if size else F.octet_length(content).cast("long")
    rows = files.select(*carried, F.col(path).alias("file_path"), whole.alias("file_size"), F.col(language).alias("language"), F.col(content).alias("__content"), (F.col(warnings) if warnings else F.lit(None).cast("array<string>")).alias("__warnings"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("__content", "__warnings"))
    schema = f"{kinds}, name string, source_code string, start int, end int, warnings array<string>, instructions array<{INSTRUCTION}>"
    shape = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            out, held = [], 0
            for row in b.to_pylist():
                text, refused = row.pop("__content"), row.pop("__warnings")
                found = [_failed("", *refused)] if refused else _objects(row["file_path"] or "", text, row["language"])
                out += [{**row, **o} for o in found]
                held += len(text or "")
                if held > BATCH_BYTES:
                    yield _batch(out, shape)
                    out, held = [], 0
            if out:
                yield _batch(out, shape)

    return rows.mapInArrow(run, schema)


#: Opcodes whose word is mapped as a name, and short words that the cascade leaves as they are unless a table has them: no test of it takes a text without a dot, a slash, a colon or a digit in front.
_NAMING = {"LOAD_NAME", "LOAD_GLOBAL", "LOAD_PARAM", "LOAD_ATTR", "STORE_NAME", "STORE_GLOBAL", "STORE_ATTR"}
_LATIN = "A-Za-z_\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_ITSELF = re.compile(rf"[{_LATIN}][{_LATIN}0-9]{{0,{fixed.LITERAL_LENGTH - 1}}}\Z")
_GAP = re.compile("[^a-z0-9]+")
_CODECS = {_GAP.sub("_", n).strip("_") for n in fixed.ENCODINGS}
_MAPPED = {n for table in fixed.FUNCTION_MAP.values() for n in table}


def plain_tokens(instruction: tuple) -> str | None:
    """Tokens of an instruction that is its opcode alone or that and a plain word, as the cascade would find; None for any other, also for words that may be something else to it."""
    op, kind, text, _ = instruction
    if kind == "none":
        return op
    if kind != "str" or op not in _NAMING or text in _MAPPED:
        return None
    low = text.lower()
    if text.isalpha() and text.isascii():
        if len(text) > fixed.LITERAL_LENGTH or low in _CODECS:
            return None
    elif not _ITSELF.match(text) or _GAP.sub("_", low).strip("_") in _CODECS:
        return None
    if "local" in low or "loopback" in low:
        return None
    return f"{op} {text}"


class _Said(dict):
    """Tokens of each plain instruction, the number among the group's others of any other. Constants have the same tokens in all languages."""

    def __init__(self, language: str, others: list[tuple], constants: dict[tuple, int]):
        self.language, self.others, self.constants = language, others, constants

    def __missing__(self, instruction: tuple) -> str | int:
        said = plain_tokens(instruction)
        if said is None and instruction[0] == "LOAD_CONST":
            said = self.constants.get(instruction)
        if said is None:
            said = len(self.others)
            self.others.append((instruction, self.language))
            if instruction[0] == "LOAD_CONST":
                self.constants[instruction] = said
        self[instruction] = said
        return said


def _parts(said: list[str | int]) -> list[tuple[str | None, int | None]]:
    """Tokens and numbers of an object in order, those of a run of plain instructions as one text."""
    if not said:
        return []
    try:
        return [(" ".join(said), None)]
    except TypeError:  # there are numbers
        return [part for kind, run in groupby(said, type) for part in ([(" ".join(run), None)] if kind is str else [(None, n) for n in run])]


def _group(objects: list[dict], shape: pa.Schema) -> pa.RecordBatch:
    """Objects as a batch of one row: their different instructions that aren't plain, and the objects with the parts of their tokens."""
    others: list[tuple] = []
    constants: dict[tuple, int] = {}
    said = {language: _Said(language, others, constants) for language in {o["language"] for o in objects}}
    for o in objects:
        o["n"] = len(o["instructions"])
        o["parts"] = _parts(list(map(said[o["language"]].__getitem__, o["instructions"])))
    instructions = _instructions([len(others)], [i for i, _ in others], [language for _, language in others], shape.field("known").type)
    kind = shape.field("objects").type
    part = kind.value_type.field("parts").type
    flat = [p for o in objects for p in o["parts"]]
    parts = _lists([len(o["parts"]) for o in objects], part, [pa.array([p[k] for p in flat], part.value_type[k].type) for k in range(2)])
    columns = [parts if f.name == "parts" else pa.array([o[f.name] for o in objects], f.type) for f in kind.value_type]
    return pa.RecordBatch.from_arrays([instructions, _lists([len(objects)], kind, columns)], schema=shape)


def compile_groups(files: DataFrame, path: str = "path", language: str = "language", content: str = "content") -> DataFrame:
    """Objects of files in groups, for objects.tokens_of_groups(): a row for each few MB of source, with the different instructions of its objects (known), as far as they aren't plain, and the objects (file_path, file_size, language, name, warnings, n of instructions, and the parts of their tokens: text, or a place in known). Row-wise, no shuffle; null content is empty."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    rows = files.select(F.col(path).cast("string").alias("file_path"), F.octet_length(content).cast("long").alias("file_size"), F.col(language).alias("language"), F.col(content).alias("__content"))
    schema = f"known array<{INSTRUCTION}>, objects array<struct<file_path:string,file_size:bigint,language:string,name:string,warnings:array<string>,n:int,parts:array<struct<said:string,place:int>>>>"
    shape = to_arrow_schema(_parse_datatype_string(schema))

    def compiled(group: list[dict]) -> list[dict]:
        return [{**row, **o} for row in group for o in _compiled(row["file_path"] or "", (row.pop("__content") or "").replace("\x00", ""), row["language"])]

    def run(batches):
        group, held = [], 0
        for b in batches:
            for row in b.to_pylist():
                group.append(row)
                held += len(row["__content"] or "")
                if held > BATCH_BYTES:
                    yield _group(_thread().submit(compiled, group).result(), shape)
                    group, held = [], 0
        if group:
            yield _group(_thread().submit(compiled, group).result(), shape)

    return rows.mapInArrow(run, schema)
