"""JavaScript sources to instructions: a tokenizer and a parser by operator precedence that emits as it goes.

It is tolerant: what it can't make sense of is passed over token by token. Types, JSX and regular expression flags have no
instructions. Function expressions are compiled in place, arrow functions, declarations and methods as objects of their own;
bodies of catch and finally, and of switch cases, are compiled."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cached_property
from itertools import accumulate

from .emit import BINARY, SCRIPT_BINARY, UNARY, Code, Frontend

_TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<num>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)|(?P<name>[A-Za-z_$#\u0080-￿][\w$\u0080-￿]*)"
    r"|(?P<str>\"(?:[^\"\\\n]++|\\.)*+\"?|'(?:[^'\\\n]++|\\.)*+'?)|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])"
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_LEVEL = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_BEFORE_VALUE = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "+", "-", "*", "%", "<", ">", "~", "^", "=>", "return", "typeof", "case", "in", "of", "&&", "||", "??", "==", "===", "!=", "!=="}


#: The tokens of a source without slashes and templates, where none depends on what stands before it.
_PLAIN_TOKEN = re.compile(rf"\s+|({re.sub(r'[?]P<[a-z]+>', '?:', _TOKEN.pattern[_TOKEN.pattern.index('(?P<num>') :])})\s*")
_OPEN, _CLOSE = {"(", "[", "{"}, {")", "]", "}"}
_QUOTES = {'"': "str", "'": "str", "`": "template"}


def kind_of(t: str) -> str:
    """Kind of a token, which its text tells; the empty one is the end."""
    c = t[:1]
    if not c:
        return "end"
    if c.isdecimal() or (c == "." and t[1:2].isdecimal()):
        return "num"
    if c == "/" and len(t) > 2:
        return "regex"
    return _QUOTES.get(c) or ("name" if c.isalpha() or c in "_$#" or c > "\x7f" else "op")


def tokenise(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, place); a template is one token."""
    out, at = [], 0
    while at < len(source):
        c = source[at]
        if c == "`":
            end, depth = at + 1, 0
            while end < len(source) and (source[end] != "`" or depth):
                if source[end] == "\\":
                    end += 1
                elif source.startswith("${", end):
                    depth += 1
                    end += 1
                elif source[end] == "}" and depth:
                    depth -= 1
                end += 1
            out.append(("template", source[at : end + 1], at))
            at = end + 1
            continue
        if c == "/" and not source.startswith(("//", "/*"), at) and (not out or out[-1][1] in _BEFORE_VALUE) and (m := _REGEX.match(source, at)):
            out.append(("regex", m[0], at))
            at = m.end()
            continue
        m = _TOKEN.match(source, at)
        if not m:
            at += 1
            continue
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    return out


def texts_of(source: str) -> list[str]:
    """The tokens' texts alone, for most sources in one call."""
    if "/" in source or "`" in source:
        return [t for _, t, _ in tokenise(source)]
    return [t for t in _PLAIN_TOKEN.findall(source) if t]


def _keep(known: dict, t: str, value):
    if len(t) <= 32:
        if len(known) >= KEPT:
            known.clear()
        known[t] = value
    return value


class _Sorts(dict):
    """What a token is to a run of plain words. Kept for short tokens, up to a number."""

    def __missing__(self, t: str) -> int:
        kind = kind_of(t)
        sort = (SILENT if t == "this" else NAME if t in _WORDS else WORD) if kind == "name" else ENDS if kind in ("num", "str", "end") else OTHER
        return _keep(self, t, sort)


class _Made(dict):
    """The instruction of an opcode with a word, one object for all its places; None for a token that is no plain word. Kept for short ones, up to a number."""

    def __init__(self, opcode: str):
        self.opcode = opcode

    def __missing__(self, word: str) -> tuple | None:
        plain = (word.isalpha() or kind_of(word) == "name") and (word not in _WORDS or self.opcode == "LOAD_ATTR")
        return _keep(self, word, (self.opcode, "str", word, ()) if plain else None)


#: Something else, what may stand behind a statement, another name, a word, and one that has no instruction.
OTHER, ENDS, NAME, WORD, SILENT = range(5)
#: Tokens and instructions that a process keeps of each sort.
KEPT = 1 << 17
_SORT = _Sorts()
_MADE = {op: _Made(op) for op in ("LOAD_NAME", "LOAD_GLOBAL", "LOAD_ATTR")}
_POP_TOP = ("POP_TOP", "none", None, ())


class ScriptFrontend(Frontend):
    def __init__(self, path: str, source: str):
        super().__init__(path, source, "javascript")
        self.texts = [*texts_of(source), ""]
        self.last = len(self.texts) - 1
        self.at, self.stored = 0, False

    @cached_property
    def places(self) -> list[int]:
        """Where the tokens begin, which few sources need to know."""
        return [*(place for _, _, place in tokenise(self.source)), len(self.source)]

    @cached_property
    def starts(self) -> list[int]:
        return [0, *accumulate(len(line) + 1 for line in self.lines)]

    @cached_property
    def closers(self) -> dict[int, int]:
        """Place of the bracket that closes each open one."""
        out, stack = {}, []
        for i, t in enumerate(self.texts):
            if t in _OPEN:
                stack.append(i)
            elif t in _CLOSE and stack:
                out[stack.pop()] = i
        return out

    def compile(self) -> list[dict]:
        self.emit("RESUME", 0)
        self.prose()
        while self.kind != "end":
            self.statement()
            self.prose()
        self.emit("RETURN_CONST")
        return self.rows()

    def prose(self) -> None:
        """Statements of plain words, their attributes and commas, as many as follow one another: what statement() makes of them, without its calls. The first that has something else is left to it."""
        texts, code, at = self.texts, self.code, self._at
        if _SORT[texts[at]] < WORD:
            return
        out, loads, attributes, begin = code.out, _MADE["LOAD_GLOBAL" if code.function else "LOAD_NAME"], _MADE["LOAD_ATTR"], at
        usual = not (code.params or code.outer or code.comprehension or self.globals)
        while True:
            if usual and (made := loads[texts[at]]):
                while follows := loads[texts[at + 1]]:
                    out += made, _POP_TOP
                    made = follows
                    at += 1
            if _SORT[texts[at]] < WORD:
                begin = at
                break
            begin, held, operator = at, len(out), None
            while (sort := _SORT[t := texts[at]]) >= WORD:
                if sort == SILENT:
                    pass
                elif usual:
                    out.append(loads[t])
                else:
                    self.load(t)
                at += 1
                t = texts[at]
                while t == "." and ((sort := _SORT[texts[at + 1]]) >= NAME or not texts[at + 1]):
                    if sort >= NAME:
                        out.append(attributes[texts[at + 1]])
                        at += 1
                    at += 1
                    t = texts[at]
                if operator:
                    self.operate(operator)
                    operator = None
                if t == "in" or t == "instanceof":
                    operator = t
                    at += 1
                elif t == ",":
                    at += 1
                else:
                    break
            else:
                t = "."  # no word behind a comma or an operator
            if t == ";":
                at += 1
            elif t != "}" and _SORT[t] == OTHER:
                del out[held:]
                break
            out.append(_POP_TOP)
        if begin != self._at:  # a statement that leaves its value on the stack was the last
            self.stored = False
        self.at = begin

    # ---- tokens ----
    @property
    def at(self) -> int:
        return self._at

    @at.setter
    def at(self, place: int) -> None:
        """A source may end within brackets: the place behind them is that of the end then. What stands there is asked for many times, so it is taken once."""
        self._at = place = min(place, self.last)
        t = self.texts[place]
        self.kind = kind = kind_of(t)
        self.text = t if kind not in ("str", "template", "regex") else "\0"

    def peek(self, n: int = 1) -> str:
        return self.texts[min(self._at + n, self.last)]

    def next(self) -> str:
        t = self.texts[self._at]
        if self.kind != "end":
            self.at = self._at + 1
        return t

    def take(self, *texts: str) -> bool:
        if self.text in texts:
            self.next()
            return True
        return False

    def line(self, at: int) -> int:
        return bisect_right(self.starts, self.places[min(at, self.last)])

    def matching(self, at: int) -> int:
        """Place of the bracket that closes the one at a place."""
        if self.texts[at] in _OPEN:
            return self.closers.get(at, self.last)
        depth = 0
        for i in range(at, len(self.texts)):
            t = self.texts[i]
            if kind_of(t) == "op":
                depth += (t in _OPEN) - (t in _CLOSE)
                if depth == 0:
                    return i
        return self.last

    # ---- statements ----
    def block(self) -> None:
        if self.take("{"):
            self.prose()
            while self.kind != "end" and self.text != "}":
                self.statement()
                self.prose()
            self.take("}")
        else:
            self.statement()

    def statement(self) -> None:
        begin = self.at
        word = self.text if self.kind in ("name", "op") else ""
        do = getattr(self, f"do_{word}", None) if self.kind == "name" else None
        if word == "{":
            self.block()
        elif word == ";":
            self.next()
        elif word == "async" and self.peek() == "function":
            self.next()
            self.function("ASYNC_FUNCTION")
        elif do and self.peek() not in (":", "=", ".", "=>"):
            do()
        elif self.kind == "name" and self.peek() == ":":
            self.next(), self.next()
        else:
            self.stored = False
            self.expression()
            if not self.stored:  # an assignment leaves nothing on the stack
                self.emit("POP_TOP")
            self.take(";")
        if self.at == begin:
            self.next()

    def do_var(self) -> None:
        self.next()
        while True:
            if self.text in "{[" and self.kind == "op":
                names = self.pattern()
                if self.take("="):
                    self.assignment()
                for n in names:
                    self.store(n)
            else:
                name = self.next()
                if self.take("="):
                    self.assignment()
                    self.store(name)
            if not self.take(","):
                break
        self.take(";")

    do_let = do_const = do_var

    def pattern(self) -> list[str]:
        """Names that a destructuring pattern binds."""
        end, names = self.matching(self.at), []
        for i in range(self.at + 1, end):
            t = self.texts[i]
            if kind_of(t) == "name" and self.texts[i + 1] in (",", "}", "]", "=") and self.texts[i - 1] in (",", "{", "[", ":", "..."):
                names.append(t)
        self.at = end + 1
        return names

    def do_function(self) -> None:
        self.function("MAKE_FUNCTION")

    def params(self) -> set[str]:
        if self.text != "(":
            return set()
        end = self.matching(self.at)
        names = {t for i, t in enumerate(self.texts[self.at : end], self.at) if kind_of(t) == "name" and self.texts[i - 1] in ("(", ",", "...", "{", "[", ":")}
        self.at = end + 1
        return names

    def reference(self, name: str, first: int, last: int) -> None:
        self.emit("LOAD_CONST", f"CodeObject(name={name}, path={self.path}, location=({self.line(first)}, {self.line(last)}))")

    def source_of(self, first: int, last: int) -> str:
        last = min(last, self.last)
        return self.source[self.places[first] : self.places[last] + len(self.texts[last])]

    def function(self, opcode: str) -> None:
        first = self.at
        self.take("function")
        if self.take("*"):
            opcode = "GENERATOR_FUNCTION"
        label = self.next() if self.kind == "name" else "anonymous"
        params = self.params()
        name, body = self.name_of(label), self.at
        last = self.matching(body)
        self.reference(name, body, last)
        self.emit(opcode, 0)
        self.store(label)
        self.inside(Code(name, self.line(first), self.line(last), self.source_of(first, last), params), self.block)

    def do_class(self) -> None:
        first = self.at
        self.next()
        label = self.next() if self.kind == "name" and self.text != "extends" else "anonymous"
        if self.take("extends"):
            base = len(self.code.out)
            self.unary()
            del self.code.out[base:]
        if self.text != "{":
            return
        name, last = self.name_of(label), self.matching(self.at)
        for op, arg in (("PUSH_NULL", None), ("LOAD_BUILD_CLASS", None)):
            self.emit(op, arg)
        self.reference(name, self.at, last)
        self.emit("MAKE_FUNCTION", 0)
        self.emit("LOAD_CONST", label)
        self.emit("CALL", 2)
        self.store(label)

        def members():
            self.next()
            while self.kind != "end" and self.at < last:
                begin = self.at
                while self.text in ("static", "async", "get", "set", "*") and self.peek() not in ("(", "="):
                    self.next()
                member = self.next() if self.kind in ("name", "str", "num") else ""
                if self.text == "[":
                    self.at = self.matching(self.at) + 1
                if self.text == "(":
                    params = self.params()
                    if self.text == "{":
                        end, body = self.matching(self.at), self.at
                        own = self.name_of(member or "computed")
                        self.reference(own, body, end)
                        self.emit("MAKE_FUNCTION", 0)
                        self.store(member or "computed")
                        self.inside(Code(own, self.line(begin), self.line(end), self.source_of(begin, end), params), self.block)
                elif self.take("="):
                    self.assignment()
                    self.store(member)
                self.take(";")
                if self.at == begin:
                    self.next()
            self.at = last + 1

        self.inside(Code(name, self.line(first), self.line(last), self.source_of(first, last), function=self.code.function), members)

    def do_if(self) -> None:
        self.next()
        base = len(self.code.out)
        self.bracketed()
        jump = self.emit("POP_JUMP_IF_FALSE", 0)
        self.block()
        if self.take("else"):
            over = self.emit("JUMP_FORWARD", 0)
            self.code.patch(jump, len(self.code.out) - base)
            self.block()
            self.code.patch(over, len(self.code.out) - base)
        else:
            self.code.patch(jump, len(self.code.out) - base)

    def bracketed(self) -> None:
        if self.take("("):
            self.expression()
            self.take(")")

    def do_while(self) -> None:
        self.next()
        head = len(self.code.out)
        self.bracketed()
        self.loop(head)

    def loop(self, head: int) -> None:
        jump = self.emit("POP_JUMP_IF_FALSE", 0)
        self.block()
        self.emit("JUMP_BACKWARD", len(self.code.out) - head + 1)
        self.code.patch(jump, len(self.code.out) - jump - 1)

    def do_do(self) -> None:
        self.next()
        self.block()
        if self.take("while"):
            self.bracketed()
            self.emit("POP_JUMP_IF_TRUE", -2)
        self.take(";")

    def do_for(self) -> None:
        self.next()
        self.take("await")
        end = self.matching(self.at)
        inner = self.texts[self.at + 1 : end]
        depth, each = 0, None
        for i, t in enumerate(inner):
            depth += (t in _OPEN) - (t in _CLOSE)
            if depth == 0 and t in ("of", "in") and i:
                each = self.at + 1 + i
                break
        if each is not None:
            first = self.at + 1
            names = [t for t in self.texts[first:each] if kind_of(t) == "name" and t not in ("const", "let", "var")]
            self.at = each + 1
            self.expression()
            self.emit("GET_ITER")
            head = self.emit("FOR_ITER", 0)
            self.at = end + 1
            for n in names:
                self.store(n)
            self.block()
            n = len(self.code.out) - head
            self.emit("JUMP_BACKWARD", n + 1)
            self.code.patch(head, n)
            self.emit("END_FOR")
            return
        self.take("(")
        if self.text in ("var", "let", "const"):
            self.do_var()
        elif not self.take(";"):
            self.expression()
            self.take(";")
        head = len(self.code.out)
        if self.text != ";":
            self.expression()
        self.take(";")
        step = self.at
        self.at = end + 1
        jump = self.emit("POP_JUMP_IF_FALSE", 0)
        self.block()
        after, self.at = self.at, step
        if self.text != ")":
            self.expression()
        self.at = after
        self.emit("JUMP_BACKWARD", len(self.code.out) - head + 1)
        self.code.patch(jump, len(self.code.out) - jump - 1)

    def do_switch(self) -> None:
        self.next()
        self.bracketed()
        end = self.matching(self.at)
        self.take("{")
        while self.at < end and self.kind != "end":
            if self.take("case"):
                self.expression()
                self.emit("COMPARE_EQUAL")
                self.take(":")
            elif self.text == "default" and self.peek() == ":":
                self.next(), self.next()
            else:
                self.statement()
        self.at = end + 1

    def do_try(self) -> None:
        self.next()
        self.emit("NOP")
        self.block()
        self.emit("RETURN_CONST")
        self.emit("PUSH_EXC_INFO")
        if self.take("catch"):
            if self.text == "(":
                self.at = self.matching(self.at) + 1
            self.block()
        for op, arg in (("RERAISE", 0), ("COPY", 3), ("POP_EXCEPT", None), ("RERAISE", 1)):
            self.emit(op, arg)
        if self.take("finally"):
            self.block()

    def do_return(self) -> None:
        line = self.line(self.at)
        self.next()
        if self.text in (";", "}") or self.kind == "end" or self.line(self.at) != line:
            self.emit("RETURN_CONST")
        else:
            self.expression()
            self.emit("RETURN_VALUE")
        self.take(";")

    def do_throw(self) -> None:
        self.next()
        self.expression()
        self.emit("BINARY_OPERATION")
        self.take(";")

    def do_break(self) -> None:
        line = self.line(self.at)
        self.next()
        if self.kind == "name" and self.line(self.at) == line:
            self.next()
        self.take(";")

    do_continue = do_break

    def do_import(self) -> None:
        if self.peek() in ("(", "."):
            self.expression()
            return
        while self.kind != "end" and self.kind != "str" and self.text != ";":
            self.next()
        self.next()
        self.take(";")

    def do_export(self) -> None:
        self.next()
        if self.take("default"):
            self.statement() if self.text in ("function", "class", "async") else self.expression()
            self.emit("EXPORT_DEFAULT")
        elif self.text in ("{", "*"):
            while self.kind != "end" and self.text != ";" and self.text != "}":
                self.next()
            self.take("}")
            if self.take("from"):
                self.next()
            self.emit("EXPORT_NAMED")
        else:
            self.statement()
            self.emit("EXPORT_NAMED")
        self.take(";")

    # ---- expressions ----
    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def arrow(self) -> bool:
        at = self.at + (self.text == "async" and self.peek() not in ("=>",))
        t = self.texts[at]
        if self.texts[min(at + 1, self.last)] == "=>" and kind_of(t) == "name":
            return True
        return t == "(" and self.texts[min(self.matching(at) + 1, self.last)] == "=>"

    def assignment(self) -> None:
        if self.arrow():
            first = self.at
            if self.text == "async" and self.peek() != "=>":
                self.next()
            params = self.params() if self.text == "(" else {self.next()}
            self.take("=>")
            name = self.name_of("lambda")
            self.emit("MAKE_FUNCTION", name)
            code = Code(name, self.line(first), 0, None, params)

            def body():
                if self.text == "{":
                    self.block()
                else:
                    self.assignment()
                    self.emit("RETURN_VALUE")

            self.inside(code, body)
            code.end, code.source = self.line(self.at - 1), self.source_of(first, self.at - 1)
            return
        if self.text in ("yield", "await") and self.text == "yield":
            self.next()
            self.take("*")
            if self.text not in (")", "]", "}", ",", ";"):
                self.assignment()
            self.emit("YIELD_VALUE")
            return
        base = len(self.code.out)
        self.binary(0)
        if self.take("?"):
            self.assignment()
            self.take(":")
            self.assignment()
        elif self.text in _ASSIGN:
            op = self.next()
            target = self.code.out[base:]
            if op == "=":
                del self.code.out[base:]
            self.assignment()
            if op != "=":
                self.operate(op[:-1])
            self.assign(target)
            self.stored = True

    def assign(self, target: list[tuple]) -> None:
        if not target:
            return
        op, _, text, _ = target[-1]
        self.code.out.extend(target[:-1])
        if op == "LOAD_ATTR":
            self.emit("STORE_ATTR", text)
        elif op == "BINARY_SUBSCR":
            self.emit("STORE_SUBSCR")
        elif op.startswith("LOAD_") and text:
            self.store(text)

    def operate(self, op: str) -> None:
        if op in BINARY:
            self.emit("BINARY_OP", BINARY[op])
        else:
            self.emit(SCRIPT_BINARY.get(op, "BINARY_OPERATION"))

    def binary(self, least: int) -> None:
        self.unary()
        while (level := _LEVEL.get(self.text, 0)) > least and self.kind in ("op", "name"):
            op = self.next()
            self.binary(level - (op == "**"))
            self.operate(op)

    def unary(self) -> None:
        if self.text in UNARY and self.kind in ("op", "name"):
            op = self.next()
            self.unary()
            self.emit(UNARY[op])
        elif self.take("await"):
            self.unary()
            self.emit("AWAIT_EXPRESSION")
        elif self.text in ("++", "--"):
            op = self.next()
            base = len(self.code.out)
            self.unary()
            self.bump(base, op)
        else:
            base = len(self.code.out)
            self.postfix()
            if self.text in ("++", "--"):
                self.bump(base, self.next())

    def bump(self, base: int, op: str) -> None:
        target = self.code.out[base:]
        self.emit("LOAD_CONST", 1.0)
        self.emit("BINARY_ADD" if op == "++" else "BINARY_SUBTRACT")
        self.assign(target)

    def arguments(self) -> int:
        n = 0
        self.take("(")
        while self.kind != "end" and self.text != ")":
            begin = self.at
            self.take("...")
            self.assignment()
            n += 1
            self.take(",")
            if self.at == begin:
                self.next()
        self.take(")")
        return n

    def postfix(self) -> None:
        base = len(self.code.out)
        if self.take("new"):
            self.member(base, calls=False)
            self.emit("CALL", self.arguments() if self.text == "(" else 0)
        self.member(base, primary=len(self.code.out) == base)

    def member(self, base: int, calls: bool = True, primary: bool = True) -> None:
        if primary:
            self.primary()
        while True:
            if self.text in (".", "?."):
                self.next()
                if self.kind == "name":
                    self.emit("LOAD_ATTR", self.next())
            elif self.text == "[":
                self.next()
                self.expression()
                self.take("]")
                self.emit("BINARY_SUBSCR")
            elif calls and self.text == "(":
                self.code.out.insert(base, ("PUSH_NULL", "none", None, ()))
                self.emit("CALL", self.arguments())
            elif self.kind == "template":
                self.template(self.next())
            else:
                return

    def template(self, text: str) -> None:
        for inner in re.findall(r"\$\{([^{}]*)\}", text):
            part = ScriptFrontend(self.path, inner)
            part.code, part.globals, part.objects = self.code, self.globals, self.objects
            part.numbered = self.numbered
            while part.kind != "end":
                begin = part.at
                part.expression()
                if part.at == begin:
                    part.next()
            self.numbered = part.numbered
        self.emit("BINARY_OPERATION")

    def primary(self) -> None:
        kind, text = self.kind, self.texts[self.at]
        if kind == "num":
            self.next()
            plain = text.rstrip("n").replace("_", "")
            try:
                self.emit("LOAD_CONST", float(plain))
            except ValueError:
                self.emit("LOAD_CONST", text)
        elif kind in ("str", "regex"):
            self.emit("LOAD_CONST", self.next())
        elif kind == "template":
            self.template(self.next())
        elif text in ("true", "false"):
            self.emit("LOAD_CONST", self.next() == "true")
        elif text in ("null", "undefined"):
            self.next()
            self.emit("LOAD_CONST")
        elif text == "function" or (text == "async" and self.peek() == "function"):
            self.take("async")
            self.next()
            self.take("*")
            if self.kind == "name":
                self.next()
            self.params()
            self.block()
        elif text == "class":
            self.do_class()
        elif text == "this":
            self.next()
        elif kind == "name":
            self.load(self.next())
        elif text == "(":
            self.next()
            self.expression()
            self.take(")")
        elif text == "[":
            n = 0
            self.next()
            while self.kind != "end" and self.text != "]":
                begin = self.at
                self.take("...")
                if self.text != ",":
                    self.assignment()
                    n += 1
                self.take(",")
                if self.at == begin:
                    self.next()
            self.take("]")
            self.emit("BUILD_LIST", n)
        elif text == "{":
            self.record()

    def record(self) -> None:
        n = 0
        self.next()
        while self.kind != "end" and self.text != "}":
            begin = self.at
            if self.take("..."):
                self.assignment()
            else:
                while self.text in ("async", "get", "set", "*") and self.peek() not in (",", ":", "(", "}"):
                    self.next()
                key = self.texts[self.at]
                if self.text == "[":
                    self.at = self.matching(self.at) + 1
                else:
                    self.next()
                if self.take(":"):
                    self.assignment()
                    n += 1
                elif self.text == "(":
                    self.params()
                    self.block()
                    n += 1
                elif kind_of(key) == "name":
                    self.load(key)
                    n += 1
                    if self.take("="):
                        self.assignment()
            self.take(",")
            if self.at == begin:
                self.next()
        self.take("}")
        self.emit("BUILD_MAP", n)


#: Names that are more than a word where a statement or an operand begins.
_WORDS = {*UNARY, *(n[3:] for n in dir(ScriptFrontend) if n.startswith("do_")), *"async await class false function in instanceof new null this true undefined yield".split()}
