"""Facts of a Python file, from its syntax tree."""

from __future__ import annotations

import ast
import warnings
from dataclasses import dataclass, replace

#: Words in a call's name and the action they stand for, in this order. Fixed values.
ACTIONS = (
    ("listen", "Listen to microphone"), ("recognize", "Recognize speech"), ("speak", "Speak"), ("print", "Print output"), ("read", "Read data"), ("write", "Write data"),
    ("open", "Open file"), ("close", "Close resource"), (".get", "Get data"), (".set", "Set value"), (".send", "Send data"), (".receive", "Receive data"),
)
_OPERATORS = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Is: "is", ast.IsNot: "is not", ast.In: "in", ast.NotIn: "not in"}
_LITERALS = {ast.List: "list", ast.Dict: "dict", ast.Tuple: "tuple", ast.Set: "set"}


@dataclass(frozen=True)
class Scope:
    """Where a node stands: its class, function, depth of functions, inside a method, under the main guard."""

    cls: str | None = None
    function: str | None = None
    depth: int = 0
    method: bool = False
    main: bool = False


def dotted(node: ast.AST, other: str = "unknown") -> str:
    """``a.b.c`` of names and attributes; only the last attribute where something else is in front; else ``other``."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    elif not parts:
        return other
    return ".".join(reversed(parts))


def action(call: str) -> str:
    low = call.lower()
    return next((label for word, label in ACTIONS if word in low), call)


def _condition(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Constant):
        return str(node.value)
    if isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
        return f"{dotted(node.func)}()"
    if isinstance(node, ast.Compare):
        more = " ..." if len(node.ops) > 1 else ""
        return f"{_condition(node.left)} {_OPERATORS.get(type(node.ops[0]), '?')} {_condition(node.comparators[0])}{more}"
    return "condition"


def _target(node: ast.AST) -> str:
    if isinstance(node, ast.Tuple):
        return f"({', '.join(_target(e) for e in node.elts)})"
    return node.id if isinstance(node, ast.Name) else "target"


def _iterable(node: ast.AST) -> str:
    if isinstance(node, ast.Call):
        return f"{node.func.id}()" if isinstance(node.func, ast.Name) else "iterable"
    return dotted(node, "iterable")


def _context(node: ast.AST) -> str:
    if isinstance(node, ast.Call):
        if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name):
            return node.func.value.id
        return dotted(node.func, "context")
    return dotted(node, "context")


def _type(node: ast.AST | None) -> str:
    if isinstance(node, ast.Constant):
        return type(node.value).__name__
    return _LITERALS.get(type(node), "unknown")


def _annotation(node: ast.AST | None) -> str | None:
    if node is None:
        return None
    return dotted(node.value if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) else node)


def _docstring(body: list[ast.stmt]) -> str | None:
    """The first line of a docstring, at most 80 characters."""
    if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
        first = body[0].value.value.strip().split("\n")[0].strip()
        return first[:77] + "..." if len(first) > 80 else first
    return None


class _Collector:
    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.once: set[tuple] = set()
        self.classes: set[str] = set()
        self.imports: list[dict] = []

    def add(self, fact: str, key: tuple | None = None, **values: object) -> None:
        """A fact; with a key only the first of that key."""
        if key is not None:
            if (fact, *key) in self.once:
                return
            self.once.add((fact, *key))
        self.rows.append({"fact": fact, **values})

    def body(self, nodes: object, scope: Scope) -> None:
        for node in nodes:
            self.visit(node, scope)

    def children(self, node: ast.AST, scope: Scope) -> None:
        for child in ast.iter_child_nodes(node):
            self.visit(child, scope)

    def visit(self, node: ast.AST, scope: Scope) -> None:
        handler = getattr(self, f"on_{type(node).__name__}", None)
        if handler is None:
            self.children(node, scope)
        else:
            handler(node, scope)

    def _decorators(self, node: ast.AST) -> list[str]:
        names = [dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
        for name, d in zip(names, node.decorator_list, strict=True):
            self.add("decorator", (name,), name=name, line=d.lineno)
        return names

    def on_FunctionDef(self, node: ast.FunctionDef, scope: Scope) -> None:
        method = scope.cls is not None
        name = f"{scope.cls}.{node.name}" if method else node.name
        self.add(
            "method" if method else "function", name=node.name, qualified=name, class_name=scope.cls, line=node.lineno, is_async=isinstance(node, ast.AsyncFunctionDef), is_nested=scope.depth > 0 or method,
            decorators=self._decorators(node), parameters=[a.arg for a in node.args.args], returns=_annotation(node.returns), docstring=_docstring(node.body),
        )
        self.children(node, replace(scope, function=name, depth=scope.depth + 1, method=scope.method or method))

    on_AsyncFunctionDef = on_FunctionDef

    def on_ClassDef(self, node: ast.ClassDef, scope: Scope) -> None:
        decorators = self._decorators(node)
        self.children(node, replace(scope, cls=node.name))
        self.add("class", name=node.name, qualified=node.name, line=node.lineno, bases=[dotted(b) for b in node.bases], decorators=decorators, docstring=_docstring(node.body))
        self.classes.add(node.name)

    def _variable(self, name: str, line: int, kind: str, scope: Scope) -> None:
        if scope.cls and not scope.method:
            self.add("class_variable", (scope.cls, name), name=name, class_name=scope.cls, line=line, type=kind, source="class_variable")
        elif scope.function is not None:
            self.add("local_variable", (scope.function, name), name=name, caller=scope.function, line=line, type=kind, source="local", is_method=scope.method)
        elif not scope.cls and scope.depth == 0:
            if scope.main:
                self.add("execution_variable", (name,), name=name, line=line, type=kind, source="execution_scope")
            else:
                self.add("global_variable", (name,), name=name, line=line, type=kind, source="global")

    def _assigned(self, target: ast.AST, line: int, kind: str, scope: Scope) -> None:
        if isinstance(target, ast.Name):
            self._variable(target.id, line, kind, scope)
        elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self" and scope.cls:
            self.add("instance_variable", (scope.cls, target.attr), name=target.attr, class_name=scope.cls, caller=scope.function, line=line, type=kind, source="instance_variable")

    def on_Assign(self, node: ast.Assign, scope: Scope) -> None:
        for target in node.targets:
            self._assigned(target, node.lineno, _type(node.value), scope)
        self.children(node, scope)

    def on_AnnAssign(self, node: ast.AnnAssign, scope: Scope) -> None:
        self._assigned(node.target, node.lineno, _annotation(node.annotation) or "unknown", scope)
        self.children(node, scope)

    def on_Import(self, node: ast.Import, scope: Scope) -> None:
        for a in node.names:
            self.imports.append({"kind": "import", "module": a.name, "name": None})
            self.add("import", kind="import", module=a.name, alias=a.asname, line=node.lineno)

    def on_ImportFrom(self, node: ast.ImportFrom, scope: Scope) -> None:
        for a in node.names:
            self.imports.append({"kind": "from_import", "module": node.module or "", "name": a.name})
            self.add("import", kind="from_import", module=node.module or "", name=a.name, alias=a.asname, line=node.lineno)

    def on_Global(self, node: ast.Global, scope: Scope) -> None:
        for name in node.names if scope.function else ():
            self.add("declared_global", (scope.function, name), name=name, caller=scope.function, line=node.lineno)

    def _used(self, name: str, scope: Scope, line: int) -> None:
        for i in self.imports:
            module = i["module"]
            if i["kind"] == "import" and (name == module or name.startswith(module + ".")) or i["kind"] == "from_import" and (i["name"] == name or module and name.startswith(module + ".")):
                self.add("import_usage", caller=scope.function, module=module, name=name, line=line)

    def on_Call(self, node: ast.Call, scope: Scope) -> None:
        if scope.function:
            self._call(node, scope)
        self.children(node, scope)

    def _call(self, node: ast.Call, scope: Scope) -> None:
        func, line, caller = node.func, node.lineno, scope.function
        if isinstance(func, ast.Name):
            name = func.id
            if name in self.classes:
                self.add("class_instantiation", caller=caller, class_name=name, name=name, line=line)
            else:
                self.add("function_call", caller=caller, name=name, line=line)
                self._used(name, scope, line)
        elif isinstance(func, ast.Attribute):
            name = dotted(func)
            if isinstance(func.value, ast.Name) and func.value.id == "self" and scope.cls:
                self.add("method_call", caller=caller, class_name=scope.cls, name=func.attr, line=line)
            else:
                self.add("function_call", caller=caller, name=name, line=line)
                root = func.value
                while isinstance(root, ast.Attribute):
                    root = root.value
                if isinstance(root, ast.Name):
                    self._used(root.id, scope, line)
        else:
            return
        self.add("control_flow", kind="call", caller=caller, line=line, call_name=name, call_label=f"{name}()", action_label=action(name))

    def _flow(self, kind: str, node: ast.AST, scope: Scope, **values: object) -> None:
        if scope.function:
            self.add("control_flow", kind=kind, caller=scope.function, line=node.lineno, **values)

    def on_If(self, node: ast.If, scope: Scope) -> None:
        t = node.test
        guard = isinstance(t, ast.Compare) and isinstance(t.left, ast.Name) and t.left.id == "__name__" and any(isinstance(c, ast.Constant) and c.value == "__main__" for c in t.comparators)
        if guard and not scope.function:
            scope = replace(scope, main=True)
        else:
            self._flow("if", node, scope, condition=_condition(t), has_else=bool(node.orelse))
        self.children(node, scope)

    def on_For(self, node: ast.For, scope: Scope) -> None:
        self._flow("for", node, scope, target=_target(node.target), iter=_iterable(node.iter))
        self.children(node, scope)

    def on_While(self, node: ast.While, scope: Scope) -> None:
        self._flow("while", node, scope, condition=_condition(node.test))
        self.children(node, scope)

    def on_Try(self, node: ast.Try, scope: Scope) -> None:
        caught: list[str] = []
        for h in node.handlers:
            kinds = h.type.elts if isinstance(h.type, ast.Tuple) else [h.type]
            caught += [dotted(k, "Exception") if k is not None else "Exception" for k in kinds]
        self._flow("try", node, scope, has_except=bool(node.handlers), has_finally=bool(node.finalbody), exceptions=caught or ["Exception"])
        self.children(node, scope)

    def on_With(self, node: ast.With, scope: Scope) -> None:
        items = [{"var": _target(i.optional_vars) if i.optional_vars else None, "context": (c := _context(i.context_expr)), "label": f"Enter {c or 'context'}"} for i in node.items]
        self._flow("with", node, scope, items=items)
        self.children(node, scope)

    def on_Return(self, node: ast.Return, scope: Scope) -> None:
        self._flow("return", node, scope, has_value=node.value is not None)
        self.children(node, scope)

    def on_Break(self, node: ast.Break, scope: Scope) -> None:
        self._flow("break", node, scope)

    def on_Continue(self, node: ast.Continue, scope: Scope) -> None:
        self._flow("continue", node, scope)

    def warn(self) -> None:
        """Shadowed globals and repeated definitions, from what was found."""
        rows = list(self.rows)
        globals_ = {r["name"]: r for r in rows if r["fact"] == "global_variable"}
        declared = {(r["caller"], r["name"]) for r in rows if r["fact"] == "declared_global"}
        for r in rows:
            if r["fact"] == "local_variable" and r["name"] in globals_ and (r["caller"], r["name"]) not in declared:
                text = f'Variable "{r["name"]}" in {r["caller"]} shadows global variable (consider using "global {r["name"]}")'
                self.add("warning", (r["caller"], r["name"]), kind="global_override", severity="warning", message=text, name=r["name"], caller=r["caller"], line=r["line"], global_line=globals_[r["name"]]["line"])
        for fact in ("function", "class"):
            first: dict[str, int] = {}
            for r in rows:
                if r["fact"] == fact:
                    if r["name"] in first:
                        self.add("warning", kind=f"duplicate_{fact}", severity="warning", message=f'Duplicate {fact} name "{r["name"]}"', name=r["name"], line=r["line"], previous_line=first[r["name"]])
                    else:
                        first[r["name"]] = r["line"]


def facts(content: str) -> list[dict]:
    """The facts of a module in the order in which its tree is walked; raises ``SyntaxError`` for one that is none."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(content)
    collector = _Collector()
    collector.body(tree.body, Scope())
    collector.warn()
    return collector.rows
