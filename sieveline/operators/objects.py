"""Code objects: one row per module, function or class, with its instructions as an array of structs.

Everything stays on the object's row (higher-order functions over the array), so nothing is shuffled before a roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.classify import map_argument, raw_instruction

INSTRUCTION = "struct<opcode:string,arg_kind:string,arg:string,language:string,items:array<struct<kind:string,text:string>>>"
OBJECT = f"name string, language string, file_path string, file_size long, warnings array<string>, source_code string, start int, end int, instructions array<{INSTRUCTION}>"


def mapped(instructions: Column, functions=None, imports=None) -> Column:
    """Array of mapped instructions."""
    return F.transform(instructions, lambda i: map_argument(i["opcode"], i["arg_kind"], i["arg"], i["language"], i["items"], functions, imports))


def raw(instructions: Column) -> Column:
    return F.transform(instructions, lambda i: raw_instruction(i["opcode"], i["arg"]))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "[/\\\\]"), -1)


def targeted(path: Column, language: Column) -> Column:
    tests = [(language == lang) & file_name(path).isin(names) for lang, names in fixed.TARGETED.items()]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def _if(condition: Column, token: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(F.lit(token))).otherwise(F.array().cast("array<string>"))


def _pair(s: Column) -> Column:
    """Opcode and argument of a mapped instruction as tokens."""
    return F.when(F.instr(s, " ") > 0, F.filter(F.array(F.upper(F.substring_index(s, " ", 1)), F.substring(s, F.instr(s, " ") + 1, F.length(s))), lambda x: x != "")).otherwise(F.array(F.upper(s)))


def _file_tokens(warnings: Column, size: Column, is_targeted: Column) -> Column:
    return F.concat(F.coalesce(warnings, F.array().cast("array<string>")), _if(size > fixed.LARGE_FILE, "LARGE_FILE"), _if(size > fixed.PATHOLOGICAL_FILE, "PATHOLOGICAL_FILE"), _if(is_targeted, "TARGETED_FILE"))


def tokens(warnings: Column, size: Column, is_targeted: Column, mapped_instructions: Column) -> Column:
    """Warnings, file tokens, then opcode and argument of each instruction as two tokens; MALFORMED_FILE without instructions."""
    body = F.when(F.size(mapped_instructions) > 0, F.flatten(F.transform(mapped_instructions, _pair))).otherwise(F.array(F.lit("MALFORMED_FILE")))
    return F.concat(_file_tokens(warnings, size, is_targeted), body)


def with_tokens(objects: DataFrame, functions=None, imports=None) -> DataFrame:
    """objects with mapped (array), tokens (array), token_string, text (one line) and hash (SHA-256).

    Null instructions count as none. An object without instructions hashes its token string, any other its one-line text."""
    none = F.coalesce("instructions", F.expr(f"cast(array() as array<{INSTRUCTION}>)"))
    # exploding an array of one keeps later filters from computing the cascade a second time
    out = objects.withColumn("instructions", none).select("*", F.explode(F.array(mapped(F.col("instructions"), functions, imports))).alias("mapped"))
    aim = targeted(F.col("file_path"), F.col("language"))
    out = out.withColumn("tokens", tokens(F.col("warnings"), F.col("file_size"), aim, F.col("mapped")))
    text = F.array_join(F.concat(_if(aim, "TARGETED_FILE"), F.col("mapped")), " ")
    out = out.withColumn("token_string", F.array_join("tokens", " ")).withColumn("text", text)
    return out.withColumn("hash", F.sha2(F.when(F.size("mapped") > 0, F.col("text")).otherwise(F.col("token_string")), 256))


def tokens_of_groups(groups: DataFrame) -> DataFrame:
    """file_path, name, n (of instructions), token_string and hash of the objects of groups (compile.compile_groups), as with_tokens() has them.

    What comes of an instruction is found once for all objects of a group that have it; objects then only look it up."""
    one = lambda m: F.struct(m.alias("text"), F.when(m.isNotNull(), F.array_join(_pair(m), " ")).alias("said"))
    # exploding an array of one keeps the table from being made again at each place that looks it up
    words = groups.select("objects", F.explode(F.array(F.transform(mapped(F.col("known")), one))).alias("words"))

    def row(o: Column) -> Column:
        aim, some = targeted(o["file_path"], o["language"]), o["n"] > 0
        looked_up = lambda what: F.transform(o["parts"], lambda p: F.coalesce(p["said"], F.col("words")[p["place"]][what]))
        body = F.when(some, looked_up("said")).otherwise(F.array(F.lit("MALFORMED_FILE")))
        token_string = F.array_join(F.concat(_file_tokens(o["warnings"], o["file_size"], aim), body), " ")
        text = F.array_join(F.concat(_if(aim, "TARGETED_FILE"), looked_up("text")), " ")
        return F.struct(o["file_path"].alias("file_path"), o["name"].alias("name"), o["n"].alias("n"), token_string.alias("token_string"), F.when(some, text).alias("text"))

    rows = words.select(F.explode(F.transform("objects", row)).alias("o")).select("o.*")
    return rows.select("file_path", "name", "n", "token_string", F.sha2(F.coalesce("text", "token_string"), 256).alias("hash"))


def special_tokens(language: str, functions=None, imports=None) -> list[str]:
    """All tokens of a language, sorted."""
    functions = fixed.FUNCTION_MAP if functions is None else functions
    imports = fixed.IMPORT_MAP if imports is None else imports
    return sorted({*fixed.STRING_TOKENS, *fixed.SIZE_TOKENS, *fixed.FILE_TOKENS, *fixed.TYPE_TOKENS, *functions.get(language, {}).values(), *imports.get(language, {}).values()})


def gate(token_string: Column, language: Column, functions=None) -> Column:
    """Whether the text holds (as a substring) a function category of the language: only such objects are scored."""
    functions = fixed.FUNCTION_MAP if functions is None else functions
    out = F.lit(False)
    for lang, table in functions.items():
        if table:
            out = out | ((language == lang) & token_string.rlike("|".join(sorted(set(table.values())))))
    return F.coalesce(out, F.lit(False))


def first_by_name(objects: DataFrame, keys: list[str], name: str, order: list) -> DataFrame:
    """The first object of a name in each group, by an explicit order. min_by combines on the map side, so a frequent name doesn't meet in one task."""
    whole = F.struct(*[F.col(c) for c in objects.columns])
    return objects.groupBy(*keys, name).agg(F.min_by(whole, F.struct(*order)).alias("__row")).select("__row.*")


def display_code(source: Column, instructions: Column) -> Column:
    """Source, else the raw instructions, else a placeholder; line ends unified, trimmed if there are several lines."""
    text = F.coalesce(F.when(source != "", source), F.when(F.size(instructions) > 0, F.array_join(raw(instructions), "\n")), F.lit("<source not available>"))
    text = F.regexp_replace(text, "\r\n?", "\n")
    return F.when(text.contains("\n"), F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")).otherwise(text)
