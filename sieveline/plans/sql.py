"""The predicates and the cascade as SQL text for another engine, from which the oracles of the queries are made."""

from __future__ import annotations

import re

from ..functions import fixed


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def any_of(template: str, values) -> str:
    return "(" + " OR ".join(template.format(q(v)) for v in values) + ")"


def sure(s: str) -> str:
    return f"coalesce({s}, false)"


#: Word edges there know ASCII only, so they are spelled out.
_EDGE, _END = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
BASH = "(?im)(" + re.sub(r"\\b(\w+)\\b", lambda m: f"{_EDGE}{m[1]}{_END}", fixed.BASH_PATTERN).replace(r"\b(", _EDGE + "(") + ")"



def ip(c):
    return sure(f"regexp_matches({c}, {q(fixed.IP_PATTERN)})")


def version(c):
    return sure(f"contains({c}, '.') AND regexp_matches({c}, {q('(?i)' + fixed.VERSION_PATTERN)})")


def encoding(c):
    n = f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9.]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return sure(f"{n} IN {names(fixed.ENCODINGS)} OR (contains({n}, '.') AND replace({n}, '.', '_') IN {names(fixed.ENCODINGS)})")


def url(c):
    host = f"regexp_extract({c}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1)"
    return sure(f"length({c}) > 0 AND (({host} <> '' AND contains({host}, '[') = contains({host}, ']')) OR {any_of(f'starts_with({c}, {{}})', ['www.', 'http.', 'https.'])})")


def contains_url(c):
    return sure(f"length({c}) >= 8 AND {any_of(f'contains(lower({c}), {{}})', fixed.URL_MARKS)}")


def localhost(c):
    t = rf"regexp_replace(lower({c}), '^\s+|\s+$', '', 'g')"
    return sure(
        f"{t} IN {names(fixed.LOCAL_NAMES)} OR {any_of(f'starts_with({t}, {{}})', ['localhost:', '127.0.0.1:'])} OR regexp_matches({t}, {q(fixed.PRIVATE_NET)}) "
        f"OR ({any_of(f'contains({t}, {{}})', ['localhost', '127.0.0.1'])} AND {any_of(f'contains({t}, {{}})', ['http', 'ftp'])})"
    )


def file_path(c):
    suffix = f"regexp_matches(lower({c}), {q(r'\.(' + '|'.join(fixed.FILE_SUFFIXES) + r')$')})"
    separator = f"(contains({c}, '/') OR contains({c}, chr(92)))"
    domain = f"(length({c}) - length(replace({c}, '.', '')) = 1 AND split_part({c}, '.', 2) IN {names(fixed.DOMAIN_ENDS)})"
    absolute = f"({any_of(f'starts_with({c}, {{}})', ['/', '~', './', '../'])} OR starts_with({c}, chr(92) || chr(92)) OR regexp_matches({c}, '^\\p{{L}}:[\\\\/]'))"
    return sure(
        f"length({c}) >= 2 AND NOT {any_of(f'starts_with({c}, {{}})', fixed.NO_FILE_MARKS)} AND ({absolute} OR ({separator} AND {suffix}) "
        f"OR (NOT {separator} AND {suffix} AND NOT {domain}) OR {any_of(f'contains({c}, {{}})', fixed.KNOWN_FOLDERS)})"
    )


def escaped_hex(c):
    return sure(rf"regexp_matches({c}, '^(\\x[0-9a-fA-F]{{2}})+$')")


def base64(c):
    return sure(f"length({c}) > 0 AND length({c}) % 4 = 0 AND regexp_matches({c}, '^[A-Za-z0-9+/]*={{0,2}}$')")


def is_hex(c):
    d = f"regexp_replace({c}, '^0[xX]', '')"
    return sure(rf"length({d}) % 2 = 0 AND regexp_matches({d}, '^\s*[+-]?(0[xX]_?)?[0-9a-fA-F]+(_[0-9a-fA-F]+)*\s*$')")


def _marked(c, least, marks, pattern):
    return sure(f"length({c}) >= {least} AND length({c}) <= {fixed.REGEX_LENGTH} AND {marks} AND regexp_matches({c}, {q(pattern)})")


def bash(c):
    return _marked(c, 2, any_of(f"contains({c}, {{}})", fixed.BASH_MARKS), BASH)


def code(c):
    return _marked(c, 3, any_of(f"contains({c}, {{}})", fixed.CODE_MARKS), f"(?im)({fixed.CODE_PATTERN})")


def sql(c):
    return _marked(c, 6, any_of(f"contains(lower({c}), {{}})", fixed.SQL_MARKS), rf"(?i)\b{fixed.SQL_PATTERN}\b")


def large_payload(c):
    return sure(f"length({c}) > {fixed.PAYLOAD_LENGTH}")


def size_bucket(c):
    return (
        f"CASE WHEN {c} IS NULL OR length({c}) <= {fixed.LITERAL_LENGTH} THEN '' WHEN length({c}) <= {fixed.SMALL_LENGTH} THEN 'STRING_SIZE_S' "
        f"WHEN length({c}) <= {fixed.MEDIUM_LENGTH} THEN 'STRING_SIZE_M' ELSE 'STRING_SIZE_L' END"
    )


def reduce_whitespace(c):
    return rf"trim(regexp_replace({c}, '[\s\p{{Z}}]+', ' ', 'g'))"


def strip_quotes(c):
    out = ""
    for mark, left in (('f"', 2), ("f'", 2), ('"', 1), ("'", 1)):
        out += f" WHEN starts_with({c}, {q(mark)}) AND ends_with({c}, {q(mark[-1])}) THEN CASE WHEN length({c}) > {left} THEN substr({c}, {left + 1}, length({c}) - {left + 1}) ELSE '' END"
    return f"CASE{out} ELSE {c} END"


def normalised_from(table: str, c: str, keep: str) -> str:
    """A subquery with the column v of normalised values."""
    flat = f"SELECT {keep}, replace(replace({c}, chr(10), ''), chr(13), '') AS v FROM {table}"
    blank = f"SELECT * REPLACE ({reduce_whitespace('v')} AS v) FROM ({flat})"
    return f"SELECT * REPLACE ({strip_quotes('v')} AS v) FROM ({blank})"


PREDICATES = {
    "ip": ip, "version": version, "encoding": encoding, "url": url, "contains_url": contains_url, "localhost": localhost, "file_path": file_path, "escaped_hex": escaped_hex,
    "base64": base64, "hex": is_hex, "bash": bash, "code": code, "sql": sql, "large_payload": large_payload,
}


def classify(c: str) -> str:
    kind = "CASE" + "".join(f" WHEN {f(c)} THEN '{t}'" for f, t in ((bash, "STRING_BASH"), (sql, "STRING_SQL"), (code, "STRING_CODE"), (is_hex, "STRING_HEX"), (base64, "STRING_BASE64"))) + " ELSE 'STRING' END"
    tests = ((localhost, "STRING_LOCALHOST"), (ip, "STRING_IP"), (url, "STRING_URL"), (contains_url, "STRING_CONTAINS_URL"), (version, "STRING_VERSION"), (encoding, "STRING_ENCODING"), (file_path, "STRING_FILE_PATH"))
    return (
        f"CASE WHEN {c} IN {names(fixed.SENSITIVE)} THEN 'STRING_SENSITIVE_FILE_PATH'" + "".join(f" WHEN {f(c)} THEN '{t}'" for f, t in tests)
        + f" WHEN length({c}) <= {fixed.LITERAL_LENGTH} THEN {c} ELSE concat_ws(' ', {kind}, {size_bucket(c)}) END"
    )


#: Opcodes and argument types beside them.
OPCODES = ["LOAD_CONST", "LOAD_NAME", "STORE_NAME", "IMPORT_NAME", "CALL", "POP_TOP", "JUMP_FORWARD", "JUMP_BACKWARD", "MAKE_FUNCTION", "COPY", "KW_NAMES"]
