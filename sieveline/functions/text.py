"""Predicates and normalisation of text: Column in, Column out, all native. Null gives null in the predicates' parts and false overall."""

from __future__ import annotations

import re
import string
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


#: Letters that other characters are equal to where case is ignored, with these.
_FOLDED = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def _letter(x: str) -> str:
    """One character of a pattern in either case, as (?iu) takes it."""
    return f"[{x}{x.upper()}{_FOLDED.get(x, '')}]" if "a" <= x <= "z" else re.escape(x)


def tree(words: dict[str, str], one=re.escape) -> str:
    """A pattern for any of the words, each with what follows it: a place decides by its next character, where a plain alternation tries every word.

    one() gives the pattern of a character."""
    ends, by_first = [], {}
    for word, then in words.items():
        if word:
            by_first.setdefault(word[0], {})[word[1:]] = then
        else:
            ends.append(then)
    return "(?:" + "|".join([*(one(x) + tree(rest, one) for x, rest in by_first.items()), *ends]) + ")"


def _words(words: dict[str, str]) -> str:
    """Any of the words behind a word boundary, in either case. A letter before it is ruled out first, as that is cheaper than the boundary."""
    letters = sorted({w[0] for w in words})
    ahead = lambda some: f"(?=[{''.join(_letter(x)[1:-1] for x in some)}])"
    # a few letters at a time, so that a place tries only those of its part
    parts = [letters[k : k + 4] for k in range(0, len(letters), 4)]
    some = "|".join(ahead(part) + tree({w: then for w, then in words.items() if w[0] in part}, _letter) for part in parts)
    return rf"(?Ud)(?<![A-Za-z]){ahead(letters)}\b(?:{some})"


def _soon(marks: list[str], *first: str) -> list[str]:
    """The marks with those first that most texts hold."""
    return [*(m for m in first if m in marks), *(m for m in marks if m not in first)]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(conditions) -> Column:
    return reduce(or_, conditions)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _starts(c: Column, marks) -> Column:
    return _any(c.startswith(m) for m in marks)


def _holds(c: Column, marks) -> Column:
    return _any(c.contains(m) for m in marks)


def bound(value: Column, f) -> Column:
    """f of a value that is computed once: a name in the tests that f makes of it, where the expression would be evaluated again by each."""
    return F.transform(F.array(value), f)[0]


def _length(c: Column, n: Column | None) -> Column:
    """Characters of a text: each time they are counted anew, so who tests a text often counts once and hands n on."""
    return F.length(c) if n is None else n


def is_ip(c) -> Column:
    """A strict IPv4 or IPv6 address, without a zone."""
    return _sure(_c(c).rlike(fixed.IP_PATTERN.replace("$", r"\z")))


def is_version(c) -> Column:
    """A PEP 440 version with a dot."""
    c = _c(c)
    return _sure(c.contains(".") & c.rlike("(?i)" + fixed.VERSION_PATTERN.replace("$", r"\z").replace(r"\s", r"(?U:\s)")))


def _codec(some: list[str]) -> str:
    """Any of these codecs' names in lower case. What isn't a letter, a digit or a dot counts as an underscore, a dot too unless the name has one."""
    kinds = ([n for n in some if "." not in n], r"(?:[^a-z0-9.]++|\.)"), ([n for n in some if "." in n], "[^a-z0-9.]++")
    names = "|".join(tree(dict.fromkeys(names, ""), lambda x, gap=gap: gap if x == "_" else re.escape(x)) for names, gap in kinds if names)
    return rf"^[^a-z0-9.]*+(?:{names})[^a-z0-9.]*+\z"


#: Most codecs have a digit in their names and most words have none.
_DIGIT = re.compile("[0-9]")
_CODECS = [_codec([n for n in fixed.ENCODINGS if bool(_DIGIT.search(n)) == digit]) for digit in (False, True)]


def is_encoding(c, low: Column | None = None) -> Column:
    """A name under which the standard codecs are known. low is the text in lower case, if there is one already."""

    def known(low: Column) -> Column:
        return F.when(low.rlike("[0-9]"), low.rlike(_CODECS[1])).otherwise(low.rlike(_CODECS[0]))

    return _sure(bound(F.lower(_c(c)), known) if low is None else known(low))


def is_url(c) -> Column:
    """A scheme and a host, or a www., http. or https. beginning."""
    c = _c(c)
    host = F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)
    return _sure((c != "") & ((c.contains("://") & (host != "") & (host.contains("[") == host.contains("]"))) | _starts(c, ["www.", "http.", "https."])))


def contains_url(c, low: Column | None = None, n: Column | None = None) -> Column:
    c = _c(c)

    def marks(low: Column) -> Column:
        # every mark has one of these
        return _holds(low, ["://", "data:", "script:"]) & _holds(low, fixed.URL_MARKS)

    # every mark has a colon
    return _sure((_length(c, n) >= 8) & c.contains(":") & (bound(F.lower(c), marks) if low is None else marks(low)))


#: A name of this machine alone between blanks, or the beginning of an address.
_LOCAL = rf"(?U)^\s*+(?:(?:{'|'.join(map(re.escape, fixed.LOCAL_NAMES))})\s*+\z|localhost:|127\.0\.0\.1:|{fixed.PRIVATE_NET[1:]})"


def is_localhost(c, low: Column | None = None) -> Column:
    """This machine or a private network; the network's numbers are not anchored at the end."""

    def local(t: Column) -> Column:
        return (_holds(t, ["localhost", "127.0.0.1"]) & _holds(t, ["http", "ftp"])) | t.rlike(_LOCAL)

    return _sure(bound(F.lower(_c(c)), local) if low is None else local(low))


def is_file_path(c, n: Column | None = None) -> Column:
    c = _c(c)
    # suffixes are shorter than what is looked at
    suffix = F.lower(F.right(c, F.lit(32))).rlike(r"\.(" + "|".join(fixed.FILE_SUFFIXES) + r")\z")
    separator = c.contains("/") | c.contains("\\")
    one_dot = F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) == 1
    domain = one_dot & F.substring_index(c, ".", -1).isin(fixed.DOMAIN_ENDS)
    absolute = _starts(c, ["/", "~", "./", "../", "\\\\"]) | c.rlike(r"^\p{L}:[\\/]")
    # every known folder has a separator
    return _sure((_length(c, n) >= 2) & ~_starts(c, fixed.NO_FILE_MARKS) & (absolute | (suffix & (separator | ~domain)) | (separator & _holds(c, fixed.KNOWN_FOLDERS))))


def is_escaped_hex(c) -> Column:
    return _sure(_c(c).rlike(r"^(\\x[0-9a-fA-F]{2})+\n?\z"))


def is_base64(c, n: Column | None = None) -> Column:
    c = _c(c)
    return _sure((c != "") & (_length(c, n) % 4 == 0) & c.rlike(r"^[A-Za-z0-9+/]*={0,2}\n?\z"))


def is_hex(c, n: Column | None = None) -> Column:
    """An even number of characters after an optional 0x that parse as a number of base 16: outer blanks, a sign, single underscores and a second 0x are accepted."""
    c = _c(c)
    digits = F.when(_starts(c, ["0x", "0X"]), F.substring(c, F.lit(3), F.length(c))).otherwise(c)
    # the mark has two characters, so the length with it is as even
    return _sure((_length(c, n) % 2 == 0) & digits.rlike(r"(?U)^\s*[+-]?(0[xX]_?)?[0-9a-fA-F]+(_[0-9a-fA-F]+)*\s*\z"))


# The fixed patterns, taken apart: what is literal is looked for as such, what needs a mark only where the mark is, words by their letters.
_SHELL_WORDS = ["curl", "wget", "nc", "netcat", "ssh", "scp", "rsync", "cp", "mv", "rm", "find", "locate", "tar", "gzip", "zip", "unzip", "grep", "sed", "awk", "base64", "openssl", "echo", "ls", "cd", "cat", "chmod", "sudo", "export"]
_SHELL_ENDS = {**dict.fromkeys(_SHELL_WORDS, r"\s"), **dict.fromkeys(["do", "done", "fi"], r"\b")}
_CODE_ENDS = {
    **dict.fromkeys(["def", "function", "class", "const", "let", "var", "int", "float", "double", "char", "void"], r"\s+\w"), **dict.fromkeys(["if", "for", "while", "return", "import", "public", "private"], r"\s"),
    **dict.fromkeys(["break", "continue"], r"\b"), **dict.fromkeys(["require", "print"], r"\s*\("), "console": r"\.\w", "lambda": r"\s+.*:",
}
_SQL_ENDS = {
    "select": r"\s+.*\s+(?i:from)\s+\b", "insert": r"\s+(?i:into)\s+\b", "update": r"\s+\w+\s+(?i:set)\s+\b", "delete": r"\s+(?i:from)\s+\b", "drop": r"\s+(?i:table|database)\s+\b",
    "truncate": r"\s+(?i:table)\s+\b", "where": r"\s+\w+\s*=\b", "order": r"\s+(?i:by)\s+\b", "union": r"\s+(?i:select)\b",
}
_SHELL, _CODE, _SQL = _words(_SHELL_ENDS), _words(_CODE_ENDS), _words(_SQL_ENDS)

#: Words whose pattern runs over a whole line: the scan for all words finds their beginnings, the pattern decides where there are any.
_LONG = {"lambda": _words({"lambda": _CODE_ENDS["lambda"]}), "select": _words({"select": _SQL_ENDS["select"]})}
_FROM_IMPORT = r"(?Uid)(?<![A-Za-z])\bfrom\s+.*\s+import"


def _scan(words: dict[str, str]) -> str:
    """Any of the words, as a group, behind a character that isn't part of one; what follows is looked at and not taken. Letters are listed: ranges cost several times as much."""
    letters = sorted({w[0] for w in words})
    parts = [letters[k : k + 4] for k in range(0, len(letters), 4)]
    some = "|".join(f"(?=[{''.join(_letter(x)[1:-1] for x in part)}])" + tree({w: f"(?={then})" for w, then in words.items() if w[0] in part}, _letter) for part in parts)
    return rf"(?Ud)[^{string.ascii_letters}{string.digits}_]\b({some})"


_WORDS = _scan({**_SHELL_ENDS, **_CODE_ENDS, **_SQL_ENDS, **dict.fromkeys([*_LONG, "from"], r"\s")})


def words_said(c, n: Column | None = None) -> Column:
    """The distinct words of the patterns for shell, code and SQL that a text holds as these want them, in lower case: one scan of the text for all three. Texts too long for patterns have none."""
    c = _c(c)
    plain = lambda w: F.lower(F.translate(w, "".join(_FOLDED.values()), "iiks"))
    found = F.transform(F.array_distinct(F.regexp_extract_all(F.concat(F.lit(" "), c), F.lit(_WORDS))), plain)
    return F.when(_sized(c, 2, n), found).otherwise(F.array().cast("array<string>"))


def _both(marks: Column, after: bool, found: Column) -> Column:
    """Marks and what is found; the marks are looked for after that, if so said."""
    return found & marks if after else marks & found


def _says(c: Column, said: Column, words) -> Column:
    """Whether one of the words is among those said; long ones are held against their patterns."""
    out = F.arrays_overlap(said, F.array(*[F.lit(w) for w in words if w not in _LONG]))
    for w in words:
        if w in _LONG:
            out = out | (F.array_contains(said, w) & c.rlike(_LONG[w]))
    return out


def _sized(c: Column, least: int, n: Column | None = None) -> Column:
    return _length(c, n).between(least, fixed.REGEX_LENGTH)


def is_bash(c, said: Column | None = None, n: Column | None = None) -> Column:
    """Shell. said are words_said(c) and n the length, if they are there already."""
    c = _c(c)
    marks = _holds(c, _soon(fixed.BASH_MARKS, "do", "fi", "then"))
    # the first three are marks too; words that have been looked for already cost less than marks do
    found = _holds(c, ["|", "&&", "$("]) | _both(marks, said is not None, (
        (c.rlike(_SHELL) if said is None else _says(c, said, _SHELL_ENDS)) | (c.contains("$") & c.rlike(r"(?U)\$\{?\w")) | (c.contains("#!/") & c.rlike(r"(?Uimd)^#!/(usr/)?bin/(bash|sh|zsh)"))
        | (c.contains("[") & c.rlike(r"(?Ui)if\s+\[")) | (c.contains("];") & c.rlike(r"(?Ui)\];\s*then"))
    ))
    return _sure(_sized(c, 2, n) & found)


def is_code(c, said: Column | None = None, n: Column | None = None) -> Column:
    """Python, JavaScript or markup. said are words_said(c) and n the length, if they are there already."""
    c = _c(c)
    words = c.rlike(_CODE) if said is None else _says(c, said, _CODE_ENDS)
    imports = c.rlike("[mM][pP][oO][rR][tT]") & c.rlike(_FROM_IMPORT)
    found = (
        _holds(c, ["==", "!=", "&&", "||", "//"]) | words | (imports if said is None else F.array_contains(said, "from") & imports)
        | (c.contains("=>") & c.rlike(r"(?U)\w\s*=>")) | (c.contains("/*") & c.rlike(r"/\*[\s\S]*?\*/")) | (c.contains("<") & c.rlike(r"(?Ui)<(html|body|head|div|script|style|\?xml)[^>]*>"))
        | (c.contains("{") & c.rlike(r"(?Ud)\{\s*[\"\w]+\s*:|\.[\w-]+\s*\{|#[\w-]+\s*\{|\w\s*\{.*:\s*[\w#]")) | (c.contains("[") & c.rlike(r"(?U)\[\s*[\{\"\d]"))
    )
    return _sure(_sized(c, 3, n) & _both(_holds(c, _soon(fixed.CODE_MARKS, ":", "int ", "for ", "def")), said is not None, found))


def is_sql(c, low: Column | None = None, said: Column | None = None, n: Column | None = None) -> Column:
    """SQL. low is the text in lower case, said are words_said(c) and n the length, if they are there already."""
    c = _c(c)
    marks = bound(F.lower(c), lambda low: _holds(low, fixed.SQL_MARKS)) if low is None else _holds(low, fixed.SQL_MARKS)
    return _sure(_sized(c, 6, n) & _both(marks, said is not None, c.rlike(_SQL) if said is None else _says(c, said, _SQL_ENDS)))


def is_large_payload(c) -> Column:
    return _sure(F.length(_c(c)) > fixed.PAYLOAD_LENGTH)


def size_bucket(c, n: Column | None = None) -> Column:
    n = _length(_c(c), n)
    return F.when(n.isNull() | (n <= fixed.LITERAL_LENGTH), "").when(n <= fixed.SMALL_LENGTH, "STRING_SIZE_S").when(n <= fixed.MEDIUM_LENGTH, "STRING_SIZE_M").otherwise("STRING_SIZE_L")


def remove_newlines(c) -> Column:
    # a text without them is handed on as it is, which translate() would build anew
    return F.replace(F.replace(_c(c), F.lit("\n"), F.lit("")), F.lit("\r"), F.lit(""))


_NOT_LATIN = f"[^{''.join(re.escape(chr(x)) for x in (*range(0x20, 0x7F), *range(0xA1, 0x100)))}]"


def reduce_whitespace(c) -> Column:
    c = _c(c)
    # single blanks stay; most texts have no other ones and are handed on as they are: no character before the first blank beyond Latin is one
    # Latin texts are told by a list, as ranges cost several times as much
    other = c.contains("  ") | (c.rlike(_NOT_LATIN) & c.rlike(r"[^ -~\u00a1-\u167f]"))
    return F.trim(F.when(other, F.regexp_replace(c, r"(?U)\s+", " ")).otherwise(c))


def strip_quotes(c) -> Column:
    """Quotes that match go, one a side, with a leading f; a lone quote becomes empty."""
    c = _c(c)
    n = F.length(c)

    def cut(mark: str, left: int) -> tuple[Column, Column]:
        return c.startswith(mark) & c.endswith(mark[-1]), F.when(n > left, F.substring(c, F.lit(left + 1), n - left - 1)).otherwise("")

    rules = [cut('f"', 2), cut("f'", 2), cut('"', 1), cut("'", 1)]
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out.otherwise(c)


def normalised(c) -> Column:
    """An argument as the cascade sees it."""
    # each step's text is bound to a name: its tests would make the steps before it again
    return bound(bound(remove_newlines(c), reduce_whitespace), strip_quotes)


def human_size(n) -> Column:
    """Bytes in units of 1024."""
    n = _c(n).cast("double")
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.when(n < 1024, F.format_string("%.1f B", n))
    for k, unit in enumerate(units[1:-1], 1):
        out = out.when(n < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", n / 1024.0**k))
    return out.otherwise(F.format_string("%.1f TB", n / 1024.0**4))


def verdict_from_text(c) -> Column:
    """Verdict of a free reply: malicious, then benign, then suspicious, whichever word is in it; suspicious if none is."""
    t = F.lower(_c(c))
    return F.when(t.contains("malicious"), "malicious").when(t.contains("benign"), "benign").otherwise("suspicious")
