"""The token cascade: what an instruction's argument becomes. First match wins, one CASE expression, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from . import text as T


def _name(c: Column) -> Column:
    """A short plain name that is its own token. Most arguments are: all other tests need a dot, a slash, a colon or a digit in front, so these three decide."""
    return c.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z") & (F.length(c) <= fixed.LITERAL_LENGTH) & ~c.isin(fixed.SENSITIVE) & ~c.rlike(rf"(?i)^(?:{'|'.join(n for n in fixed.LOCAL_NAMES if n.isalnum())})") & ~T.is_encoding(c)


def classify_string(c: Column | str) -> Column:
    """Token of a normalised string: what it is, or itself if short, with a size bucket if long."""
    c = F.col(c) if isinstance(c, str) else c

    def by_tests(low: Column, n: Column) -> Column:
        def kind(said: Column) -> Column:
            return (
                F.when(T.is_bash(c, said, n), "STRING_BASH").when(T.is_sql(c, low, said, n), "STRING_SQL").when(T.is_code(c, said, n), "STRING_CODE")
                .when(T.is_hex(c, n), "STRING_HEX").when(T.is_base64(c, n), "STRING_BASE64").otherwise("STRING")
            )

        return (
            F.when(T.is_localhost(c, low), "STRING_LOCALHOST")
            .when(T.is_ip(c), "STRING_IP")
            .when(T.is_url(c), "STRING_URL")
            .when(T.contains_url(c, low, n), "STRING_CONTAINS_URL")
            .when(T.is_version(c), "STRING_VERSION")
            .when(T.is_encoding(c, low), "STRING_ENCODING")
            .when(T.is_file_path(c, n), "STRING_FILE_PATH")
            .when(n <= fixed.LITERAL_LENGTH, c)
            # one scan for the words of all three languages
            .otherwise(F.concat_ws(" ", T.bound(T.words_said(c, n), kind), T.size_bucket(c, n)))
        )

    # the text in lower case is made once and its characters are counted once, and only where the plain tests fail
    tested = T.bound(F.lower(c), lambda low: T.bound(F.length(c), lambda n: by_tests(low, n)))
    return F.when(_name(c), c).when(c.isin(fixed.SENSITIVE), "STRING_SENSITIVE_FILE_PATH").otherwise(tested)


def classified(arg: Column | str) -> Column:
    """Token of an argument as it stands; null for null. The normalised value is bound to a name, else each test would normalise again."""
    return F.transform(F.array(T.normalised(arg)), lambda v: F.when(v.isNotNull(), classify_string(v)))[0]


def _lookup(tables: dict[str, dict[str, str]], language: Column, name: Column) -> Column:
    flat = {f"{lang}\x00{k}": v for lang, table in tables.items() for k, v in table.items()}
    # one literal, folded to a map once; the table goes to the JVM in one call
    known = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in flat.items())), F.lit("\x01"), F.lit("\x02"))
    # a map is searched from its beginning, so names that no language has are told apart by a set first
    some = name.isin(sorted({k for table in tables.values() for k in table}))
    return F.when(some, known[F.concat(language, F.lit("\x00"), name)]) if flat else F.lit(None).cast("string")


def falsy(kind: Column, arg: Column) -> Column:
    """Arguments that vanish: none, False, 0, 0.0, the empty string and the empty tuple."""
    zero = kind.isin("int", "float") & F.coalesce(arg.try_cast("double") == 0, F.lit(False))
    return F.coalesce(kind.isNull() | (kind == "none") | arg.isNull() | (arg == "") | ((kind == "bool") & (arg == "False")) | zero | ((kind == "tuple") & (arg == "()")), F.lit(True))


def map_argument(opcode: Column, kind: Column, arg: Column, language: Column, items: Column | None = None, functions: dict | None = None, imports: dict | None = None) -> Column:
    """Token of an instruction: opcode and mapped argument.

    kind is the argument's type (none, bool, int, float, tuple, str), arg its text, items the members of a tuple as structs
    (kind, text). functions and imports are dictionaries by language; those of the library by default."""
    functions = fixed.FUNCTION_MAP if functions is None else functions
    imports = fixed.IMPORT_MAP if imports is None else imports
    items = F.array().cast("array<struct<kind:string,text:string>>") if items is None else items
    # the argument is normalised once and bound to a name, else each branch would do so again
    return F.transform(F.array(T.normalised(arg)), lambda value: _branches(opcode, kind, arg, value, language, items, functions, imports))[0]


def _branches(opcode: Column, kind: Column, arg: Column, value: Column, language: Column, items: Column, functions: dict, imports: dict) -> Column:
    two = lambda x: F.concat(opcode, F.lit(" "), x)
    const = opcode == "LOAD_CONST"
    category = _lookup(imports, language, value)
    function = _lookup(functions, language, value)
    names = F.array_join(F.transform(items, lambda i: i["text"]), " ")
    return (
        F.when(falsy(kind, arg), opcode)
        .when(const & (kind == "bool"), two(F.lit("BOOLEAN")))
        .when(const & (kind == "int"), two(F.lit("INTEGER")))
        .when(const & (kind == "float"), two(F.lit("FLOAT")))
        .when(const & (kind == "tuple"), two(F.coalesce(F.nullif(tuple_token(items), F.lit("")), F.lit("LIST"))))
        .when(opcode.isin("POP_JUMP_IF_FALSE", "POP_JUMP_IF_TRUE", "JUMP_FORWARD", "MAKE_CLASS", "MAKE_FUNCTION"), opcode)
        .when(opcode.isin("IMPORT_FROM", "IMPORT_NAME") & category.isNotNull(), two(category))
        .when(opcode.isin("STORE_NAME", "LOAD_NAME", "STORE_GLOBAL", "LOAD_GLOBAL") & function.isNotNull(), two(function))
        .when(opcode == "CALL", two(value))
        .when(opcode.isin("POP_TOP", "PUSH_NULL"), opcode)
        .when(opcode == "COPY", two(value))
        .when(opcode == "KW_NAMES", two(F.when(kind == "tuple", names).otherwise(value)))
        .otherwise(two(classify_string(value)))
    )


def tuple_token(items: Column) -> Column:
    """Distinct members in order: strings as they are, ints (and bools) and floats as their types; the empty tuple is empty."""
    one = lambda i: F.when(i["kind"] == "str", i["text"]).when(i["kind"].isin("int", "bool"), "INTEGER").when(i["kind"] == "float", "FLOAT")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(items, one), lambda x: x.isNotNull()))), " ")


def raw_instruction(opcode: Column, arg: Column) -> Column:
    """An instruction as it is printed unmapped; a missing argument reads None."""
    return F.concat(opcode, F.lit(" "), F.coalesce(arg, F.lit("None")))
