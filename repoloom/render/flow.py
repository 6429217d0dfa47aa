"""What a flowchart shows, apart from how it is drawn: nodes on a grid and arrows between them."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

Fact = dict

#: How many calls in a row, exceptions, hooks, handlers, parameters and entries of a list are shown. Fixed values.
CALLS, EXCEPTIONS, HOOKS, HANDLERS, PARAMETERS, ENTRIES = 4, 4, 5, 3, 3, 5
#: Hooks of components. Fixed values.
HOOK_NAMES = ("usestate", "useeffect", "usecontext", "usereducer", "usememo", "usecallback", "useref")
#: Parts of names that mark event handlers. Fixed values.
HANDLER_WORDS = ("handle", "on", "click", "submit", "change")


def short(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 3] + "..."


@dataclass(frozen=True)
class Node:
    """``shape`` is round, box or diamond; ``row`` and ``column`` place it, column 0 being the main line."""

    id: str
    shape: str
    label: str
    row: int
    column: int = 0


@dataclass(frozen=True)
class Arrow:
    source: str
    target: str
    label: str = ""
    back: bool = False


@dataclass
class Flow:
    nodes: list[Node] = field(default_factory=list)
    arrows: list[Arrow] = field(default_factory=list)
    row: int = -1
    #: Ends of the flow so far, with the label of the arrow that leaves each.
    tails: list[tuple[str, str]] = field(default_factory=list)

    def beside(self, node: str, shape: str, label: str, column: int = 0) -> str:
        """A node in the present row without arrows."""
        self.nodes.append(Node(node, shape, label, self.row, column))
        return node

    def arrow(self, source: str, target: str, label: str = "", back: bool = False) -> None:
        self.arrows.append(Arrow(source, target, label, back))

    def then(self, node: str, shape: str, label: str) -> str:
        """A node of the main line in the next row, reached from all ends of the flow."""
        self.row += 1
        self.beside(node, shape, label)
        for source, name in self.tails:
            self.arrow(source, node, name)
        self.tails = [(node, "")]
        return node

    def arms(self, source: str, arms: list[tuple[str, str, str]]) -> None:
        """Boxes of one row that ``source`` branches into: (node, label of the arrow, label)."""
        self.row += 1
        for k, (node, name, label) in enumerate(arms):
            column = 0 if len(arms) == 1 else (k + 1) // 2 * (1 if k % 2 else -1) if len(arms) % 2 else (k // 2 + 1) * (1 if k % 2 else -1)
            self.beside(node, "box", label, column)
            self.arrow(source, node, name)


def chosen(facts: list[Fact], function: str | None = None) -> Fact | None:
    """The function that is drawn: the one named, else the top-level one with most events, the first of equals."""
    functions = [f for f in facts if f["fact"] == "function" and (f["name"] == function if function else not f.get("is_nested"))]
    events = Counter(f["caller"] for f in facts if f["fact"] == "control_flow")
    return max(functions, key=lambda f: events[f["name"]], default=None)


def _calls(flow: Flow, group: list[Fact], n: int) -> None:
    for k, call in enumerate(group[:CALLS]):
        flow.then(f"CALL{n}_{k}", "box", short(call.get("action_label") or call.get("call_label") or "Call function", 25))
    if len(group) > CALLS:
        flow.then(f"CALL{n}_MORE", "box", f"... {len(group) - CALLS} more calls")


def _if(flow: Flow, event: Fact, n: int) -> None:
    test = flow.then(f"IF{n}", "diamond", short(event.get("condition") or "condition", 30))
    arms = [(f"TRUE{n}", "True", "If Body"), *([(f"FALSE{n}", "False", "Else Body")] if event.get("has_else") else [])]
    flow.arms(test, arms)
    flow.tails = [(node, "") for node, _, _ in arms] + ([] if event.get("has_else") else [(test, "False")])
    flow.then(f"ENDIF{n}", "box", "Continue")


def _loop(flow: Flow, event: Fact, n: int) -> None:
    each = event["kind"] == "for"
    label = f"for {event.get('target') or 'item'} in {short(event.get('iter') or 'iterable', 25)}" if each else short(event.get("condition") or "condition", 30)
    test = flow.then(f"LOOP{n}", "diamond", label)
    body = f"BODY{n}"
    flow.arms(test, [(body, "Has items" if each else "True", "Loop Body" if each else "While Body")])
    flow.arrow(body, test, "Loop back", back=True)
    flow.tails = [(test, "No items" if each else "False")]
    flow.then(f"ENDLOOP{n}", "box", "Continue")


def _try(flow: Flow, event: Fact, n: int) -> None:
    names = event.get("exceptions") or ["Exception"]
    start = flow.then(f"TRY{n}", "box", "Try")
    arms = [(f"EXCEPT{n}_{k}", name, f"Except {short(name, 13)}") for k, name in enumerate(names if len(names) <= EXCEPTIONS else names[: EXCEPTIONS - 1])]
    if len(names) > EXCEPTIONS:
        arms.append((f"EXCEPT{n}_MORE", "...", "More exceptions"))
    flow.arms(start, arms)
    flow.tails = [(start, "Success"), *((node, "") for node, _, _ in arms)]
    if event.get("has_finally"):
        flow.then(f"FINALLY{n}", "box", "Finally")
    flow.then(f"ENDTRY{n}", "box", "Continue")


def _with(flow: Flow, event: Fact, n: int) -> None:
    label = next((i["label"] for i in event.get("items") or []), "Enter context")
    flow.then(f"WITH{n}", "box", label)
    flow.then(f"EXIT{n}", "box", f"Exit {short(label.removeprefix('Enter '), 20)}")


def of_function(facts: list[Fact], function: Fact) -> Flow:
    """The flow of one function: its events in the order of lines up to the first return or break."""
    name, flow = function["name"], Flow()
    flow.then("START", "round", f"Start: {name}")
    events = sorted((f for f in facts if f["fact"] == "control_flow" and f["caller"] == name), key=lambda f: f.get("line") or 0)
    group: list[Fact] = []
    ended = False
    for n, event in enumerate([*events, {"kind": "end"}]):
        kind = event["kind"]
        if kind == "call":
            group.append(event)
            continue
        _calls(flow, group, n)
        group = []
        if kind in ("if", "for", "while", "try", "with"):
            {"if": _if, "for": _loop, "while": _loop, "try": _try, "with": _with}[kind](flow, event, n)
        elif kind == "continue":
            flow.then(f"CONTINUE{n}", "round", "Continue")
        elif kind in ("return", "break"):
            flow.then(f"LEAVE{n}", "round", "Break" if kind == "break" else "Return with value" if event.get("has_value") else "Return")
            ended = True
        if ended or kind == "end":
            break
    flow.then("END", "round", "End")
    return flow


def of_script(facts: list[Fact]) -> Flow | None:
    """The flow of a JavaScript file: its first component, or else its first function, with hooks and handlers."""
    functions = [f for f in facts if f["fact"] == "function"]
    if not functions:
        return None
    main = next((f for f in functions if f.get("is_react_component")), functions[0])
    component, parameters = bool(main.get("is_react_component")), main.get("parameters") or []
    label = f"Start: {main['name']}" + (" (async)" if main.get("is_async") else "") + (" (React Component)" if component else "")
    if parameters:
        label += f" ({', '.join(parameters[:PARAMETERS])}{f', +{len(parameters) - PARAMETERS}' if len(parameters) > PARAMETERS else ''})"
    flow = Flow()
    flow.then("START", "round", label)
    hooks = [f["name"].lower() for f in facts if f["fact"] == "function_call" and f["name"].lower() in HOOK_NAMES]
    if hooks:
        names = list(dict.fromkeys(hooks))[:HOOKS]
        flow.then("HOOKS", "box", "Initialize Hooks: " + ", ".join(names) + (f", ... {len(hooks) - HOOKS} more" if len(hooks) > HOOKS else ""))
    if component:
        flow.then("RENDER", "box", "Render JSX: Component UI")
        handlers = [f["name"] for f in functions if any(w in f["name"].lower() for w in HANDLER_WORDS)]
        if handlers:
            flow.then("HANDLERS", "box", "Event Handlers: " + ", ".join(f"{h}()" for h in handlers[:HANDLERS]) + (f", ... {len(handlers) - HANDLERS} more" if len(handlers) > HANDLERS else ""))
    else:
        flow.then("PROCESS", "box", "Function Body: Execute Logic")
    flow.then("END", "round", f"End: {main['name']}" + (" (Component Rendered)" if component else ""))
    return flow


def of_tables(facts: list[Fact]) -> Flow:
    """Tables with the number of their columns, and an arrow for each foreign key between two of them."""
    columns = Counter(f["class_name"] for f in facts if f["fact"] == "sql_column")
    flow, names = Flow(), {}
    for n, table in enumerate(f for f in facts if f["fact"] == "sql_table"):
        flow.row += 1
        names[table["name"]] = flow.beside(f"T{n}", "box", f"{table['name']} ({columns[table['name']]} columns)")
    for f in facts:
        if f["fact"] == "sql_relationship" and f["from_table"] in names and f["to_table"] in names:
            flow.arrow(names[f["from_table"]], names[f["to_table"]], f"{f['from_column']} → {f.get('to_column') or ''}".strip())
    return flow


def of_structure(facts: list[Fact]) -> Flow:
    """A file without functions: its classes, variables, imports and tables below one start."""
    flow = Flow()
    flow.then("START", "round", "Code Structure")
    of = lambda *kinds: [f for f in facts if f["fact"] in kinds]

    def branch(node: str, label: str, entries: list[tuple[str, str]]) -> None:
        flow.row += 1
        flow.arrow("START", flow.beside(node, "box", label))
        for k, (name, more) in enumerate(entries[:ENTRIES]):
            flow.row += 1
            flow.arrow(node, flow.beside(f"{node}{k}", "box", name, 1))
            if more:
                flow.arrow(f"{node}{k}", flow.beside(f"{node}{k}_MORE", "box", more, 2))

    methods, columns = Counter(f["class_name"] for f in of("method")), Counter(f["class_name"] for f in of("sql_column"))
    if classes := of("class"):
        branch("CLASSES", f"Classes ({len(classes)})", [(c["name"], f"Methods: {methods[c['name']]}" if methods[c["name"]] else "") for c in classes])
    globals_, locals_ = of("global_variable"), of("local_variable")
    if globals_ or locals_:
        branch("VARIABLES", f"Variables ({len(globals_) + len(locals_)})", [(f"{name}: {len(items)}", "") for name, items in (("Global", globals_), ("Local", locals_)) if items])
    if imports := of("import"):
        branch("IMPORTS", f"Imports ({len(imports)})", [(i.get("module") or i.get("name") or "Unknown", "") for i in imports])
    if tables := of("sql_table"):
        branch("TABLES", f"Tables ({len(tables)})", [(t["name"], f"Columns: {columns[t['name']]}") for t in tables])
    if len(flow.nodes) == 1:
        flow.then("EMPTY", "box", "Empty or Unsupported Code")
    return flow


def of_file(facts: list[Fact], language: str | None = None, function: str | None = None) -> Flow:
    """The flow of a file in the way of its language."""
    if any(f["fact"] == "sql_table" for f in facts):
        return of_tables(facts)
    if language == "javascript" and not function:
        return of_script(facts) or of_structure(facts)
    main = chosen(facts, function)
    return of_function(facts, main) if main else of_structure(facts)
