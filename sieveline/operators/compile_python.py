"""Python sources to instructions, on the standard library's syntax tree.

Of a source that Python can't parse, statements of the old language are rewritten and what still can't be parsed is left out;
only if nothing is left is it an object without instructions and with the warning MALFORMED_SYNTAX. Against a tree of a
tolerant parser there are differences by design: decorated definitions, elif chains, finally and bare except bodies are
compiled in full."""

from __future__ import annotations

import ast
import re

from .emit import BINARY, UNARY, Code, Frontend
from .recover_python import hopeless, parsed, recovered

_OPS = {
    ast.Add: "+", ast.BitAnd: "&", ast.Sub: "-", ast.MatMult: "@", ast.BitOr: "|", ast.Mult: "*", ast.Mod: "%", ast.BitXor: "^", ast.Pow: "**", ast.LShift: "<<",
    ast.RShift: ">>", ast.Div: "/", ast.FloorDiv: "//", ast.USub: "-", ast.UAdd: "+", ast.Invert: "~", ast.Not: "not",
}


class PythonFrontend(Frontend):
    def __init__(self, path: str, source: str):
        tree = None if hopeless(source) else parsed(source)
        if tree is None:
            source = recovered(source)
            tree = ast.parse(source)
        self.tree = tree
        super().__init__(path, source, "python")
        #: Lines as the parser counts them, to cut segments out.
        self.parsed_lines = re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", source)
        self.globals = {n for node in (ast.walk(self.tree) if "global" in source else ()) if isinstance(node, ast.Global) for n in node.names}
        #: Whether functions of outer variables and generators are looked for.
        self.outer, self.yields = "nonlocal" in source, "yield" in source

    def compile(self) -> list[dict]:
        self.emit("RESUME", 0)
        self.body(self.tree.body)
        self.emit("RETURN_CONST")
        return self.rows()

    def body(self, statements) -> None:
        for s in statements:
            getattr(self, f"do_{type(s).__name__}", self.do_other)(s)

    def do_other(self, node) -> None:
        for child in ast.iter_child_nodes(node):
            self.body([child]) if isinstance(child, ast.stmt) else self.value(child) if isinstance(child, ast.expr) else self.do_other(child)

    def value(self, node) -> None:
        if node is not None:
            getattr(self, f"of_{type(node).__name__}", self.do_other)(node)

    def segment(self, node) -> str:
        if getattr(node, "end_lineno", None) is None:
            return ""
        lines = self.parsed_lines[node.lineno - 1 : node.end_lineno]
        if not lines:
            return ""
        lines[-1] = lines[-1].encode()[: node.end_col_offset].decode()
        lines[0] = lines[0].encode()[node.col_offset :].decode()
        return "".join(lines)

    # ---- statements ----
    def do_Pass(self, node):
        pass

    do_Global = do_Nonlocal = do_Pass

    def do_Break(self, node):
        self.emit("BINARY_OPERATION")

    do_Continue = do_Break

    def do_Expr(self, node):
        self.value(node.value)
        self.emit("POP_TOP")

    def do_Return(self, node):
        if node.value is None:
            self.emit("RETURN_CONST")
        else:
            self.value(node.value)
            self.emit("RETURN_VALUE")

    def do_Raise(self, node):
        self.value(node.exc)
        self.value(node.cause)
        self.emit("BINARY_OPERATION")

    def do_Assert(self, node):
        self.value(node.test)
        self.value(node.msg)
        self.emit("BINARY_OPERATION")

    def do_Delete(self, node):
        for t in node.targets:
            if isinstance(t, ast.Subscript):
                self.value(t.value)
                self.index(t.slice)
                self.emit("DELETE_SUBSCR")
            elif isinstance(t, ast.Name):
                self.emit("DELETE_NAME", t.id)
            else:
                self.value(t)

    def do_Assign(self, node):
        if isinstance(node.value, ast.Tuple) and isinstance(node.targets[0], ast.Tuple) and not self.segment(node.value).startswith("("):
            for v in node.value.elts:
                self.value(v)
        else:
            self.value(node.value)
        for t in node.targets:
            self.target(t)
            if isinstance(t, (ast.Tuple, ast.List)):
                self.store(self.segment(t))

    def do_AnnAssign(self, node):
        if node.value is not None:
            self.value(node.value)
            self.target(node.target)

    def do_AugAssign(self, node):
        self.value(node.target)
        self.value(node.value)
        self.emit("BINARY_OP")
        self.target(node.target)

    def target(self, t) -> None:
        if isinstance(t, ast.Name):
            self.store(t.id)
        elif isinstance(t, ast.Attribute):
            self.value(t.value)
            self.emit("STORE_ATTR", t.attr)
        elif isinstance(t, ast.Subscript):
            self.value(t.value)
            self.index(t.slice)
            self.emit("STORE_SUBSCR")
        elif isinstance(t, (ast.Tuple, ast.List)):
            self.emit("UNPACK_SEQUENCE", len(t.elts))
            for e in t.elts:
                self.target(e.value if isinstance(e, ast.Starred) else e)
        elif isinstance(t, ast.Starred):
            self.target(t.value)

    def do_If(self, node):
        base = len(self.code.out)
        self.value(node.test)
        jump = self.emit("POP_JUMP_IF_FALSE", 0)
        self.body(node.body)
        if node.orelse:
            over = self.emit("JUMP_FORWARD", 0)
            self.code.patch(jump, len(self.code.out) - base)
            self.body(node.orelse)
            self.code.patch(over, len(self.code.out) - base)
        else:
            self.code.patch(jump, len(self.code.out) - base)

    def do_For(self, node):
        self.value(node.iter)
        self.emit("GET_ITER")
        head = self.emit("FOR_ITER", 0)
        self.target(node.target)
        self.body(node.body)
        n = len(self.code.out) - head
        self.emit("JUMP_BACKWARD", n + 1)
        self.code.patch(head, n)
        self.emit("END_FOR")
        self.body(node.orelse)

    do_AsyncFor = do_For

    def do_While(self, node):
        head = len(self.code.out)
        self.value(node.test)
        jump = self.emit("POP_JUMP_IF_FALSE", 0)
        self.body(node.body)
        self.emit("JUMP_BACKWARD", len(self.code.out) - head + 1)
        self.code.patch(jump, len(self.code.out) - jump - 1)
        self.body(node.orelse)

    def do_Try(self, node):
        self.emit("NOP")
        self.body(node.body)
        self.emit("RETURN_CONST")
        self.emit("PUSH_EXC_INFO")
        for h in node.handlers:
            jump = None
            if h.type is not None:
                if h.name:
                    self.emit("LOAD_GLOBAL" if self.code.function else "LOAD_NAME", f"{self.segment(h.type)} as {h.name}")
                else:
                    self.value(h.type)
                self.emit("CHECK_EXC_MATCH")
                jump = self.emit("POP_JUMP_IF_FALSE", 0)
            self.emit("POP_TOP")
            self.body(h.body)
            self.emit("POP_EXCEPT")
            self.emit("RETURN_CONST")
            if jump is not None:
                self.code.patch(jump)
        self.emit("RERAISE", 0)
        self.emit("COPY", 3)
        self.emit("POP_EXCEPT")
        self.emit("RERAISE", 1)
        self.body(node.orelse)
        self.body(node.finalbody)

    do_TryStar = do_Try

    def do_With(self, node):
        for item in node.items:
            self.value(item.context_expr)
            self.emit("BEFORE_WITH")
            if item.optional_vars is not None:
                self.target(item.optional_vars)
            else:
                self.emit("POP_TOP")
        self.body(node.body)
        for _ in range(3):
            self.emit("LOAD_CONST")
        self.emit("CALL", 2)
        for op, arg in (("POP_TOP", None), ("PUSH_EXC_INFO", None), ("WITH_EXCEPT_START", None), ("POP_JUMP_IF_TRUE", 14), ("RERAISE", 2), ("POP_TOP", None), ("POP_EXCEPT", None), ("POP_TOP", None), ("POP_TOP", None), ("JUMP_BACKWARD", 5), ("COPY", 3), ("POP_EXCEPT", None), ("RERAISE", 1)):
            self.emit(op, arg)

    do_AsyncWith = do_With

    def do_Import(self, node):
        for a in node.names:
            self.emit("LOAD_CONST", 0)
            self.emit("LOAD_CONST")
            self.emit("IMPORT_NAME", a.name)
            self.store(a.asname or a.name)

    def do_ImportFrom(self, node):
        names = tuple(f"{a.name} as {a.asname}" if a.asname else a.name for a in node.names)
        self.emit("LOAD_CONST", node.level or 0)
        self.emit("LOAD_CONST", names)
        self.emit("IMPORT_NAME", "." * (node.level or 0) + (node.module or ""))
        for a, n in zip(node.names, names, strict=True):
            self.emit("IMPORT_FROM", n)
            self.store(a.asname or a.name)
        self.emit("POP_TOP")

    def reference(self, name: str, node) -> None:
        self.emit("LOAD_CONST", f"CodeObject(name={name}, path={self.path}, location=({node.body[0].lineno}, {node.end_lineno}))")

    def do_FunctionDef(self, node):
        for d in node.decorator_list:
            self.value(d)
        for default in [*node.args.defaults, *node.args.kw_defaults]:
            self.value(default)
        a = node.args
        params = {x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, [a.vararg, a.kwarg])]}
        outer = {n for x in (ast.walk(node) if self.outer else ()) if isinstance(x, ast.Nonlocal) for n in x.names}
        name = self.name_of(node.name)
        code = Code(name, node.lineno, node.end_lineno, self.segment(node), params, outer)
        self.reference(name, node)
        generator = self.yields and any(isinstance(x, (ast.Yield, ast.YieldFrom)) for x in self.own_nodes(node))
        self.emit("ASYNC_FUNCTION" if isinstance(node, ast.AsyncFunctionDef) else "GENERATOR_FUNCTION" if generator else "MAKE_FUNCTION", 0)
        for _ in node.decorator_list:
            self.emit("CALL", 1)
        self.store(node.name)

        self.inside(code, lambda: self.body(node.body))

    do_AsyncFunctionDef = do_FunctionDef

    @staticmethod
    def own_nodes(node):
        stack = list(node.body)
        while stack:
            x = stack.pop()
            yield x
            if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)):
                stack.extend(ast.iter_child_nodes(x))

    def do_ClassDef(self, node):
        for d in node.decorator_list:
            self.value(d)
        self.emit("PUSH_NULL")
        self.emit("LOAD_BUILD_CLASS")
        name = self.name_of(node.name)
        self.reference(name, node)
        self.emit("MAKE_FUNCTION", 0)
        self.emit("LOAD_CONST", node.name)
        for base in node.bases:
            self.value(base)
        self.emit("CALL", 2 + len(node.bases))
        for _ in node.decorator_list:
            self.emit("CALL", 1)
        self.store(node.name)
        code = Code(name, node.lineno, node.end_lineno, self.segment(node), function=self.code.function)
        self.inside(code, lambda: self.body(node.body))

    # ---- expressions ----
    def of_Constant(self, node):
        v = node.value
        if isinstance(v, bool) or v is None:
            self.emit("LOAD_CONST", v)
        elif v is ...:
            self.emit("LOAD_CONST", "...")
        elif isinstance(v, (int, float, complex)):
            text = self.segment(node).replace("_", "")
            try:
                self.emit("LOAD_CONST", float(text.rstrip("jJ")))
            except (ValueError, OverflowError):
                self.emit("LOAD_CONST", text)
        else:
            self.emit("LOAD_CONST", self.segment(node) or repr(v))

    def of_Name(self, node):
        self.load(node.id)

    def of_JoinedStr(self, node):
        n = 0
        for part in node.values:
            if isinstance(part, ast.Constant):
                self.emit("LOAD_CONST", str(part.value))
            else:
                self.value(part.value)
                self.emit("FORMAT_VALUE")
            n += 1
        self.emit("BUILD_STRING", n)

    def of_Attribute(self, node):
        self.value(node.value)
        self.emit("LOAD_ATTR", node.attr)

    def index(self, s) -> None:
        if isinstance(s, ast.Slice):
            for _ in range(3):
                self.emit("LOAD_CONST")
            self.emit("BINARY_OPERATION")
        else:
            self.value(s)

    def of_Subscript(self, node):
        self.value(node.value)
        self.index(node.slice)
        self.emit("BINARY_SUBSCR")

    def of_Call(self, node):
        self.emit("PUSH_NULL")
        self.value(node.func)
        for a in node.args:
            self.value(a.value if isinstance(a, ast.Starred) else a)
        for k in node.keywords:
            self.value(k.value)
        names = tuple(k.arg for k in node.keywords if k.arg)
        if names:
            self.emit("KW_NAMES", names)
        self.emit("CALL", len(node.args) + len(node.keywords))

    def of_BinOp(self, node):
        self.value(node.left)
        self.value(node.right)
        self.emit("BINARY_OP", BINARY[_OPS[type(node.op)]])

    def of_UnaryOp(self, node):
        self.value(node.operand)
        self.emit(UNARY[_OPS[type(node.op)]])

    def of_BoolOp(self, node):
        op = "LOGICAL_AND" if isinstance(node.op, ast.And) else "LOGICAL_OR"
        self.value(node.values[0])
        for v in node.values[1:]:
            self.value(v)
            self.emit(op)

    def of_Compare(self, node):
        self.value(node.left)
        for i, c in enumerate(node.comparators):
            self.value(c)
            if i < len(node.comparators) - 1:
                self.emit("COPY", 1)
        self.emit("COMPARE_OP")

    def of_IfExp(self, node):
        self.value(node.test)
        jump = self.emit("POP_JUMP_IF_FALSE", 0)
        self.value(node.body)
        over = self.emit("JUMP_FORWARD", 0)
        self.code.patch(jump)
        self.value(node.orelse)
        self.code.patch(over)

    def of_NamedExpr(self, node):
        self.value(node.value)
        self.emit("COPY", 1)
        self.target(node.target)

    def _build(self, node, op):
        for e in node.elts:
            self.value(e.value if isinstance(e, ast.Starred) else e)
        self.emit(op, len(node.elts))

    def of_List(self, node):
        self._build(node, "BUILD_LIST")

    def of_Tuple(self, node):
        self._build(node, "BUILD_TUPLE")

    def of_Set(self, node):
        self._build(node, "BUILD_SET")

    def of_Dict(self, node):
        n = 0
        for k, v in zip(node.keys, node.values, strict=True):
            if k is not None:
                self.value(k)
                self.value(v)
                n += 1
        self.emit("BUILD_MAP", n)

    def _comprehension(self, node, build, add, *values):
        if build:
            self.emit(build, 0)
        depth = 0
        heads = []
        for g in node.generators:
            self.value(g.iter)
            self.emit("GET_ITER")
            heads.append(self.emit("FOR_ITER", 0))
            names = {x.id for x in ast.walk(g.target) if isinstance(x, ast.Name)}
            self.code.comprehension.append(names)
            depth += 1
            self.emit("STORE_FAST", self.segment(g.target))
            for test in g.ifs:
                self.value(test)
                self.emit("POP_JUMP_IF_FALSE", heads[-1])
        for v in values:
            self.value(v)
        if add:
            self.emit(add, 1)
        for head in reversed(heads):
            self.emit("JUMP_FORWARD", head)
            self.code.patch(head)
        for _ in range(depth):
            self.code.comprehension.pop()

    def of_ListComp(self, node):
        self._comprehension(node, "BUILD_LIST", "LIST_APPEND", node.elt)

    def of_SetComp(self, node):
        self._comprehension(node, "BUILD_SET", "SET_ADD", node.elt)

    def of_DictComp(self, node):
        self._comprehension(node, "BUILD_MAP", "MAP_ADD", node.key, node.value)

    def of_GeneratorExp(self, node):
        self._comprehension(node, None, None, node.elt)

    def of_Lambda(self, node):
        a = node.args
        params = {x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, [a.vararg, a.kwarg])]}
        name = self.name_of("lambda")
        self.emit("MAKE_FUNCTION", name)

        def inner():
            self.value(node.body)
            self.emit("RETURN_VALUE")

        self.inside(Code(name, node.lineno, node.end_lineno, self.segment(node), params), inner)

    def of_Await(self, node):
        self.value(node.value)
        self.emit("AWAIT_EXPRESSION")

    def of_Yield(self, node):
        self.value(node.value)
        self.emit("YIELD_VALUE")

    of_YieldFrom = of_Yield

    def of_Starred(self, node):
        self.value(node.value)
