"""What both frontends share: instructions, scopes and objects."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Numbers of the generic binary operation, and names of unary and comparing operations: fixed values.
BINARY = {"+": 0, "&": 1, "-": 2, "@": 3, "|": 4, "*": 5, "%": 6, "^": 7, "**": 8, "<<": 9, ">>": 10, "/": 11, "//": 12}
SCRIPT_BINARY = {">>>": "BINARY_UNSIGNED_RSHIFT", "??": "BINARY_NULLISH_COALESCING", "<": "COMPARE_LESS", ">": "COMPARE_GREATER", "==": "COMPARE_EQUAL", "===": "COMPARE_EQUAL", "!=": "COMPARE_NOT_EQUAL", "!==": "COMPARE_NOT_EQUAL", "<=": "COMPARE_LESS_EQUAL", ">=": "COMPARE_GREATER_EQUAL", "in": "COMPARE_IN", "instanceof": "COMPARE_INSTANCEOF", "&&": "LOGICAL_AND", "||": "LOGICAL_OR"}
UNARY = {"-": "UNARY_NEGATIVE", "+": "UNARY_POSITIVE", "~": "UNARY_INVERT", "not": "LOGICAL_NOT", "!": "LOGICAL_NOT", "typeof": "TYPEOF_OPERATOR", "void": "VOID_OPERATOR", "delete": "DELETE_OPERATOR"}


@dataclass
class Code:
    """An object under compilation: (opcode, kind, text, items)."""

    name: str
    start: int
    end: int
    source: str | None
    params: set[str] = field(default_factory=set)
    outer: set[str] = field(default_factory=set)  # nonlocal
    function: bool = True
    comprehension: list[set[str]] = field(default_factory=list)
    out: list[tuple] = field(default_factory=list)

    def emit(self, opcode: str, value=None, kind: str | None = None) -> int:
        if isinstance(value, tuple):
            items = tuple(("str", v) for v in value)
            self.out.append((opcode, "tuple", repr(value), items))
        elif kind:
            self.out.append((opcode, kind, value, ()))
        elif value is None:
            self.out.append((opcode, "none", None, ()))
        elif isinstance(value, bool):
            self.out.append((opcode, "bool", str(value), ()))
        elif isinstance(value, int):
            self.out.append((opcode, "int", str(value), ()))
        elif isinstance(value, float):
            self.out.append((opcode, "float", repr(value), ()))
        else:
            self.out.append((opcode, "str", value, ()))
        return len(self.out) - 1

    def patch(self, at: int, target: int | None = None) -> None:
        """Point the jump at a place, by default the next one."""
        op, _, _, _ = self.out[at]
        self.out[at] = (op, "int", str(len(self.out) if target is None else target), ())


class Frontend:
    """Collects the objects of a file: the module first, then the others in order of their beginning."""

    def __init__(self, path: str, source: str, language: str):
        self.path, self.source, self.language = path, source, language
        self.lines = source.split("\n")
        self.globals: set[str] = set()
        self.objects: list[Code] = []
        self.code = Code("<module>", 1, len(self.lines), None, function=False)
        self.numbered = 0

    def emit(self, *args, **kw) -> int:
        return self.code.emit(*args, **kw)

    def load(self, name: str) -> None:
        c = self.code
        if any(name in s for s in c.comprehension):
            op = "LOAD_FAST"
        elif name in c.outer:
            op = "LOAD_DEREF"
        elif name in c.params:
            op = "LOAD_PARAM"
        elif name in self.globals or c.function:
            op = "LOAD_GLOBAL"
        else:
            op = "LOAD_NAME"
        self.emit(op, name)

    def store(self, name: str) -> None:
        c = self.code
        op = "STORE_DEREF" if name in c.outer else "STORE_GLOBAL" if name in self.globals or c.function else "STORE_NAME"
        self.emit(op, name)

    def name_of(self, base: str) -> str:
        self.numbered += 1
        return f"{base}_ref_{self.numbered - 1}"

    def inside(self, code: Code, body) -> None:
        """Compile body into an object of its own."""
        self.objects.append(code)
        before, self.code = self.code, code
        try:
            body()
        finally:
            self.code = before

    def rows(self) -> list[dict]:
        """The objects; their instructions as tuples (opcode, kind, text, items)."""
        covered = {n for o in self.objects for n in range(o.start, o.end + 1)}
        self.code.source = "\n".join(line for n, line in enumerate(self.lines, 1) if n not in covered and line.strip()).strip()
        out = []
        for c in [self.code, *self.objects]:
            out.append({"name": c.name, "source_code": c.source, "start": c.start, "end": c.end, "instructions": c.out})
        return out
