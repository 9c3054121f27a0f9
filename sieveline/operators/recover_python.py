"""Python sources that the standard library rejects: what can be saved of them, statement by statement.

Lines are repaired in place, so that places in the source stay what they are: statements of the old language are rewritten,
brackets beyond the parser's depth are taken away, and lines that can't be parsed at all are left blank."""

from __future__ import annotations

import ast
import re
from keyword import iskeyword

#: Brackets that stand open at most; the parser takes 200.
DEPTH = 150
#: Lines that are given up one by one while the whole block is tried again; a block with more faults is taken apart.
GIVEN_UP = 8

_TOKEN = re.compile(r'#[^\n]*|(?:[rRuUbBfF]{0,2})("""|\'\'\')(?:\\.|(?!\1)[\s\S])*(?:\1|\Z)|(?:[rRuUbBfF]{0,2})(?:"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?)|[()\[\]{}]|\\\n|\n|;|[^\s#"\'()\[\]{};\\]+|.')
_CLOSED_BY = {")": "(", "]": "[", "}": "{"}
_GOES_ON = re.compile(r"(else|elif|except|finally|case)\b|[)\]}]")
_LEGACY = [
    (re.compile(r"\bprint\s*>>\s*([^,;]+),\s*([^;#]*[^;#\s,])\s*,?"), r"print(\2, file=\1)"),
    (re.compile(r"\bprint\s*>>\s*([^,;]+?)\s*(?=;|#|$)"), r"print(file=\1)"),
    (re.compile(r"\bprint\s+(?![=,).:\]]|in\b|is\b|if\b|and\b|or\b|not\s+in\b)([^;#]*?[^;#\s,])\s*,?\s*(?=;|#|$)"), r"print(\1)"),
    (re.compile(r"\bprint\s*(?=;|#|$)"), "print()"),
    (re.compile(r"\bexec\s+([^(=;#][^;#]*?)\s+in\s+([^;#]+?)\s*(?=;|#|$)"), r"exec(\1, \2)"),
    (re.compile(r"\bexec\s+(?![(=.])([^;#]+?)\s*(?=;|#|$)"), r"exec(\1)"),
    (re.compile(r"\bexcept\s+([\w.]+|\([^()]*\))\s*,\s*([A-Za-z_]\w*)\s*:"), r"except \1 as \2:"),
    (re.compile(r"\braise\s+([\w.]+)\s*,\s*([^;#]+?)\s*(?=;|#|$)"), r"raise \1(\2)"),
    (re.compile(r"<>"), "!="),
    (re.compile(r"`([^`]*)`"), r"repr(\1)"),
    (re.compile(r"\b0([0-7]+)\b(?!\.)"), r"0o\1"),
    (re.compile(r"\b(\d+|0[xX][0-9a-fA-F]+)[lL]\b"), r"\1"),
    (re.compile(r"\b[uU][rR](?=[\"'])"), "r"),
]
_HIDDEN = "\x01"
#: Where code ends that is neither in a string nor in a comment nor goes on over a line's end, and words that stand side by side in it.
_PLAIN_END = re.compile(r"['\"#\\`]")
_PAIR = re.compile(r"(?<![\w.])([^\W\d]\w*)[ \t]+(?=([^\W\d]\w*))")
#: Names that a statement, of the old language too, may begin with before another name.
_BEFORE_NAME = {"match", "case", "type", "print", "exec", "_"}
_SPECIAL = re.compile(r"[()\[\]{}'\"#\\]")


def hopeless(text: str) -> bool:
    """Whether two words that are no keywords stand side by side in plain code: neither such a text nor what modern() makes of it parses, so no parser needs to be asked. Most prose is told by its first words."""
    end = m.start() if (m := _PLAIN_END.search(text)) else len(text)
    for m in _PAIR.finditer(text, 0, end):
        # the last word before a quote may be a string's prefix
        if (m.end(2) < end or end == len(text)) and not iskeyword(m[1]) and m[1] not in _BEFORE_NAME and not iskeyword(m[2]):
            return True
    return False


def parsed(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def parses(text: str) -> bool:
    return not hopeless(text) and parsed(text) is not None


def modern(line: str) -> str:
    """A line of the old language in the words of the present one; the contents of its strings are left alone."""
    strings: list[str] = []

    def hide(m):
        if m[0][0] == "#" or not re.match(r"[rRuUbBfF]{0,2}[\"']", m[0]):
            return m[0]
        text = m[0][1:] if re.match(r"[uU][rR]", m[0]) else m[0]
        strings.append(text)
        return f"{_HIDDEN}{len(strings) - 1}{_HIDDEN}"

    out = _TOKEN.sub(hide, line) if any(c in line for c in "'\"#\x01") else line
    for pattern, by in _LEGACY:
        out = pattern.sub(by, out)
    if not strings:
        return out
    return re.sub(f"{_HIDDEN}(\\d+){_HIDDEN}", lambda m: strings[int(m[1])], out)


def shallow(text: str) -> str:
    """The text without brackets that more than DEPTH others hold open."""
    open_, out = [], []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t in ("(", "[", "{"):
            open_.append(len(open_) < DEPTH)
            if not open_[-1]:
                continue
        elif t in _CLOSED_BY and open_ and not open_.pop():
            continue
        out.append(t)
    return "".join(out)


def _brackets(text: str) -> int:
    return text.count("(") + text.count("[") + text.count("{")


def blocks(lines: list[str]) -> list[tuple[int, int]]:
    """Runs of lines that hold a statement of the outermost level each, as far as brackets, strings and indents tell."""
    starts, depth, at, place = [], 0, 0, 0
    text = "\n".join(lines)
    while at < len(lines):
        line = lines[at]
        # a statement at the margin ends brackets that were never closed
        if depth and at and re.match(r"(import|from|def|class|if|for|while|try|with|return|print|exec)\b", line):
            depth = 0
        if not depth and line[:1].strip() and line[0] != "#" and not _GOES_ON.match(line):
            starts.append(at)
        if not _SPECIAL.search(line):
            place += len(line) + 1
            at += 1
            continue
        # the line's tokens; one of them may go on over the ends of lines
        while place < len(text):
            t = _TOKEN.match(text, place)[0]
            place += len(t)
            at += t.count("\n")
            if t == "\n":
                break
            if t in ("(", "[", "{"):
                depth += 1
            elif t in _CLOSED_BY:
                depth = max(depth - 1, 0)
        else:
            break
    if starts and starts[0] > 0 or not starts:
        starts.insert(0, 0)
    return list(zip(starts, [*starts[1:], len(lines)], strict=True))


def _saved(lines: list[str]) -> list[str]:
    """The lines of a block, repaired or given up one after the other until the rest parses."""
    if parses("\n".join(lines)):
        return lines
    if len(lines) == 1 and _brackets(lines[0]) <= DEPTH and ";" not in lines[0] and hopeless(lines[0]):
        return [""]
    repaired = [modern(x) for x in lines]
    if repaired != lines and parses("\n".join(repaired)):
        return repaired
    text = "\n".join(repaired)
    for flatten in (spread, shallow) if _brackets(text) > DEPTH else ():
        flat = flatten(text).split("\n")
        if flat != repaired and len(flat) == len(lines) and parses("\n".join(flat)):
            return flat
    if len(lines) == 1:
        parts = [p for p in _statements(repaired[0]) if p.strip() and parses(p.strip())] if ";" in repaired[0] else []
        return ["; ".join(p.strip() for p in parts)]
    out = repaired
    for _ in range(min(GIVEN_UP, len(lines))):
        try:
            ast.parse("\n".join(out))
            return out
        except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
            at = min(max((getattr(error, "lineno", None) or 1) - 1, 0), len(out) - 1)
            while at > 0 and not out[at].strip():
                at -= 1
            indent = out[at][: len(out[at]) - len(out[at].lstrip())]
            given = f"{indent}pass"
            if out[at] == given:
                given = ""
            out = [*out[:at], given, *out[at + 1 :]]
    return out if parses("\n".join(out)) else _apart(repaired)


def _margin(line: str) -> int:
    return len(line) - len(line.lstrip())


def _apart(lines: list[str]) -> list[str]:
    """A block taken apart: what is indented below a line at its margin is saved on its own, and so on; nothing that parses is lost.

    A head that doesn't parse with what it holds becomes a plain one of the same kind, so that its body stays."""
    heads = [i for i, x in enumerate(lines) if x.strip() and not x[:1].isspace() and not x.startswith("#")]
    out = list(lines)
    for a, b in zip(heads, [*heads[1:], len(lines)]):
        body = lines[a + 1 : b]
        inner = [i for i, x in enumerate(body) if x.strip()]
        if not inner:
            out[a : b] = [*_saved(lines[a : a + 1]), *body]
            continue
        indent = body[inner[0]][: min(_margin(body[i]) for i in inner)] or " "
        kept = _all_saved([x[len(indent) :] if x.strip() else "" for x in body])
        if not any(_real(x) for x in kept):
            kept[inner[0]] = "pass"
        # a string that goes over lines may begin at the margin: parse as it will stand
        body = [indent + x if x.strip() else x for x in kept]
        for head in (lines[a], _plain_head(lines[a])):
            if parses("\n".join([head, *body])):
                out[a:b] = [head, *body]
                break
        else:
            out[a:b] = ["", *([""] * len(body))] if not parses("\n".join(["if 1:", *body])) else ["if 1:", *body]
    return _joined(lines, out, heads)


def _joined(lines: list[str], out: list[str], heads: list[int]) -> list[str]:
    """Branches that go on (else, except) keep their words where the whole parses with them; otherwise each stands alone."""
    with_words = list(out)
    for a in heads:
        if _GOES_ON.match(lines[a]) and lines[a].rstrip().endswith(":"):
            with_words[a] = lines[a]
    return with_words if parses("\n".join(with_words)) else out


def _plain_head(line: str) -> str:
    if m := re.match(r"(?:async\s+)?def\s+(\w+)", line):
        return f"def {m[1]}(*args, **kwargs):"
    if m := re.match(r"class\s+(\w+)", line):
        return f"class {m[1]}:"
    return "if 1:"


def _real(line: str) -> bool:
    return bool(line.strip()) and not line.lstrip().startswith("#")


def _all_saved(lines: list[str]) -> list[str]:
    """All blocks of some lines, each saved; of equal length."""
    out: list[str] = []
    for a, b in blocks(lines):
        kept = _saved(lines[a:b])
        out += [*kept[: b - a], *[""] * (b - a - len(kept))]
    return out if parses("\n".join(out)) else [x if parses(x) else "" for x in out]


def spread(text: str) -> str:
    """The text with brackets beyond DEPTH moved behind its last line, as statements of their own: nothing is lost but their place.

    Arguments and subscripts follow the name `_` there, as their callee stays where it was."""
    moved = []
    while True:
        depth, cut = 0, None
        for m in _TOKEN.finditer(text):
            t = m[0]
            if t in ("(", "[", "{"):
                depth += 1
                if depth == DEPTH + 1 and cut is None:
                    cut = m.start()
                    called = bool(re.search(r"[\w)\]}]\s*$", text[max(0, cut - 80) : cut])) and t != "{"
            elif t in _CLOSED_BY:
                depth -= 1
                if cut is not None and depth == DEPTH:
                    inner = text[cut : m.end()]
                    plain = "".join(" " if x[0] == "\n" or x[0] == "\\\n" else x[0] for x in _TOKEN.finditer(inner) if x[0][0] != "#")
                    moved.append(("_" if called else "") + plain)
                    text = text[:cut] + ("" if called else "0") + "\n" * inner.count("\n") + text[m.end() :]
                    break
        else:
            break
    done = []
    for part in moved:
        done.append(spread(part) if _brackets(part) > DEPTH else part)
    return "; ".join([text, *done]) if done else text


def _statements(line: str) -> list[str]:
    parts, part = [], []
    for m in _TOKEN.finditer(line):
        if m[0] == ";":
            parts.append("".join(part))
            part = []
        else:
            part.append(m[0])
    return [*parts, "".join(part)]


def recovered(source: str) -> str:
    """The source with as much as can be saved; SyntaxError if that is nothing."""
    lines = re.split(r"\r\n|\r|\n", source.replace("\x0c", " "))
    out = _all_saved(lines)
    text = "\n".join(out)
    if not parses(text) or not any(x.strip() not in ("", "pass") and not x.lstrip().startswith("#") for x in out):
        raise SyntaxError("nothing of the source can be parsed")
    return text
