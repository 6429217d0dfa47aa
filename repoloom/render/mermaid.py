"""Mermaid diagrams of a file or project, from its facts (rows of :mod:`repoloom.parsers.facts` as dictionaries)."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from repoloom.render import categories as words
from repoloom.render import flow

Fact = dict
_SECTIONS = (("components", "Components", "#e3f2fd", "#2196f3"), ("services", "Services", "#ede7f6", "#673ab7"), ("models", "Models", "#e8eaf6", "#3f51b5"), ("helpers", "Helpers", "#fff8e1", "#ffa000"), ("entry_points", "Entry Points", "#fce4ec", "#c2185b"))
#: Items of a section, imports, participants and calls that a diagram shows before it says how many more there are.
SHOWN = {"section": 8, "imports": 6, "globals": 5, "participants": 10, "calls": 30, "loop_calls": 25, "packages": 15, "columns": 10, "flow": 40}


def of(facts: list[Fact], *kinds: str) -> list[Fact]:
    return [f for f in facts if f["fact"] in kinds]


def identifier(text: str, prefix: str = "") -> str:
    clean = re.sub(r"[^A-Za-z0-9_]", "_", text).strip("_") or "x"
    return f"{prefix}{clean}"


def quoted(text: str) -> str:
    return text.replace('"', "'").replace("\n", " ")


def short(text: str, size: int) -> str:
    return text if len(text) <= size else text[: size - 3] + "..."


def fence(lines: list[str]) -> str:
    return "\n".join(["```mermaid", *lines, "```"])


def top_module(module: str) -> str:
    return module.split(".")[0]


def _hit(text: str, keys: tuple[str, ...]) -> bool:
    return any(k in text for k in keys)


def class_category(cls: Fact, facts: list[Fact]) -> str:
    name, doc = cls["name"].lower(), (cls.get("docstring") or "").lower()
    for category, keys in words.CLASS_KEYWORDS.items():
        if _hit(name, keys) or _hit(doc, words.CLASS_DOC_KEYWORDS.get(category, ())):
            return category
    own = {f["fact"] for f in facts if f.get("class_name") == cls["name"]}
    return "models" if "method" not in own and own & {"class_variable", "instance_variable"} else "components"


def function_category(function: Fact) -> str:
    name, doc = function["name"].lower(), (function.get("docstring") or "").lower()
    for category, keys in words.FUNCTION_KEYWORDS.items():
        if _hit(name, keys) or _hit(doc, words.FUNCTION_DOC_KEYWORDS.get(category, ())):
            return category
    return "helpers"


def class_role(cls: Fact, facts: list[Fact]) -> str:
    doc = re.split(r"[.\n]", (cls.get("docstring") or "").strip())[0].strip()
    if doc:
        return short(doc, 60)
    for keys, role in words.CLASS_ROLES:
        if _hit(cls["name"].lower(), keys):
            return role
    n = sum(f["fact"] == "method" and f.get("class_name") == cls["name"] for f in facts)
    return f"Class with {n} method{'s' if n > 1 else ''}" if n else "Class definition"


def _more(lines: list[str], parent: str, left: int) -> None:
    if left > 0:
        lines.append(f'    {parent} --> MORE_{parent}["... {left} more"]')


def architecture(facts: list[Fact]) -> str:
    """The module with its imports, categorised classes and functions, execution scope and globals."""
    if of(facts, "sql_table"):
        return sql_architecture(facts)
    lines = ["graph TD", '    MODULE["📄 Module"]', "    style MODULE fill:#e8f5e9,stroke:#4caf50,stroke-width:3px"]
    modules = sorted({top_module(f["module"]) for f in of(facts, "import") if f.get("module")})
    if modules:
        lines.append(f'    MODULE --> IMPORTS["📚 Imports ({len(modules)})"]')
        lines += [f'    IMPORTS --> {identifier(m, "IMP_")}["📦 {quoted(m)}"]' for m in modules[: SHOWN["imports"]]]
        _more(lines, "IMPORTS", len(modules) - SHOWN["imports"])
    classes, functions = of(facts, "class"), [f for f in of(facts, "function") if not f.get("is_nested")]
    grouped: dict[str, list[tuple[str, Fact]]] = defaultdict(list)
    for c in classes:
        grouped[class_category(c, facts)].append(("CLASS", c))
    for f in functions:
        grouped[function_category(f)].append(("FUNC", f))
    ids: dict[str, str] = {}
    for key, title, fill, stroke in _SECTIONS:
        items = grouped.get(key, [])
        if not items:
            continue
        section = f"SEC_{key.upper()}"
        lines += [f'    MODULE --> {section}["{title} ({len(items)})"]', f"    style {section} fill:{fill},stroke:{stroke},stroke-width:2px"]
        for kind, item in items[: SHOWN["section"]]:
            node = identifier(item["name"], f"{kind}_")
            label = quoted(item["name"])
            if kind == "CLASS":
                ids[item["name"]] = node
                bases = item.get("bases") or []
                if bases:
                    label += f"({quoted(', '.join(bases[:2]))}{f', +{len(bases) - 2}' if len(bases) > 2 else ''})"
                label += f"\\n<i>{quoted(class_role(item, facts))}</i>"
            else:
                label = ("🔁 " if item.get("is_async") else "") + label + "()"
                if item.get("docstring"):
                    label += f"\\n<i>{quoted(short(item['docstring'], 40))}</i>"
            lines.append(f'    {section} --> {node}["{label}"]')
        _more(lines, section, len(items) - SHOWN["section"])
    for c in classes:
        for base in c.get("bases") or []:
            if base.split(".")[-1] in ids and c["name"] in ids:
                lines.append(f"    {ids[base.split('.')[-1]]} -.->|inherits| {ids[c['name']]}")
    execution, globals_ = of(facts, "execution_variable"), of(facts, "global_variable")
    if execution:
        lines += ['    MODULE --> EXEC["▶️ Execution Scope"]', f'    EXEC --> EXEC_VARS["Variables: {len(execution)}"]']
    if globals_:
        lines.append(f'    MODULE --> GLOBALS["🌍 Global Variables ({len(globals_)})"]')
        lines += [f'    GLOBALS --> {identifier(g["name"], "GLOBAL_")}["{quoted(g["name"])}"]' for g in globals_[: SHOWN["globals"]]]
        _more(lines, "GLOBALS", len(globals_) - SHOWN["globals"])
    return fence(lines)


def code_architecture(facts: list[Fact]) -> str:
    """Classes and functions with inheritance, instantiation and call edges, each once."""
    classes = {c["name"]: identifier(c["name"], "CLASS_") for c in of(facts, "class")}
    functions = {f["name"]: identifier(f["name"], "FUNC_") for f in of(facts, "function") if not f.get("is_nested")}
    lines = ["graph TD", '    MODULE["📄 Module"]']
    lines += [f'    MODULE --> {i}["🏛️ {quoted(n)}"]' for n, i in classes.items()] + [f'    MODULE --> {i}["⚙️ {quoted(n)}()"]' for n, i in functions.items()]
    edges: dict[str, None] = {}
    for c in of(facts, "class"):
        for base in c.get("bases") or []:
            if (b := base.split(".")[-1]) in classes:
                edges[f"    {classes[c['name']]} -.->|inherits| {classes[b]}"] = None
    for call in of(facts, "class_instantiation", "function_call"):
        head = (call.get("caller") or "").split(".")[0]
        source = functions.get(call.get("caller")) or classes.get(head)
        target = classes.get(call["name"]) or functions.get(call["name"])
        if source and target and source != target:
            edges[f"    {source} --> {target}"] = None
    return fence([*lines, *edges])


def valid_calls(facts: list[Fact]) -> list[Fact]:
    """Calls whose ends are functions or classes of the file: a dotted callee needs a class head, a plain one a function."""
    functions, classes = {f["name"] for f in of(facts, "function")}, {c["name"] for c in of(facts, "class")}
    out = []
    for call in of(facts, "function_call", "method_call", "class_instantiation"):
        caller, name = call.get("caller") or "", call["name"]
        if caller.split(".")[0] not in functions | classes and caller not in functions:
            continue
        if call["fact"] == "method_call":
            ok = call.get("class_name") in classes
        elif call["fact"] == "class_instantiation":
            ok = name in classes
        else:
            ok = name.split(".")[0] in classes if "." in name else name in functions
        if ok:
            out.append(call)
    return sorted(out, key=lambda c: c.get("line") or 0)


#: Words in the names of entry points. Fixed values.
ENTRY_WORDS = ("main", "run", "start", "entry", "app", "init")


def participants(calls: list[Fact]) -> list[str]:
    """Heads of callers and callees by name; of more than are shown the entry points come first, the last of them first."""
    heads: set[str] = set()
    for c in calls:
        heads |= {c["caller"].split(".")[0], (c.get("class_name") or c["name"]).split(".")[0]}
    order = sorted(heads)
    if len(order) > SHOWN["participants"]:
        first = [h for h in order if any(k in h.lower() for k in ENTRY_WORDS)]
        order = [*reversed(first), *(h for h in order if h not in first)][: SHOWN["participants"]]
    return order


def sequence(facts: list[Fact]) -> str:
    """Who calls whom in the order of lines; a pattern of three calls or more under one loop becomes a loop block."""
    if of(facts, "sql_table"):
        return sql_sequence(facts)
    calls = valid_calls(facts)
    if not calls:
        return _structure_sequence(facts)
    names = participants(calls)
    taken: dict[str, str] = {}
    for n in names:
        base = alias = identifier(n)[:12]
        k = 1
        while alias in taken.values():
            alias, k = f"{base}{k}", k + 1
        taken[n] = alias
    lines = ["sequenceDiagram", "    autonumber", *[f'    participant {a} as "{quoted(n)}"' for n, a in taken.items()]]
    loops = defaultdict(list)
    for f in of(facts, "control_flow"):
        if f.get("kind") in ("for", "while"):
            loops[f["caller"]].append(f)
    repeated = Counter((c["caller"], c["name"]) for c in calls)
    shown, looped = 0, set()
    for c in calls:
        source, target = taken.get(c["caller"].split(".")[0]), taken.get((c.get("class_name") or c["name"]).split(".")[0])
        if source is None or target is None or shown >= SHOWN["calls"]:
            continue
        message = f"new {c['name']}()" if c["fact"] == "class_instantiation" else f"{c['name'].split('.')[-1]}()"
        key = (c["caller"], c["name"])
        if repeated[key] >= 3:
            if key in looped:
                continue
            looped.add(key)
            over = next((f"Each {(x.get('target') or 'round').lower()}" for x in loops[c["caller"]]), f"{repeated[key]} times")
            lines += [f'    loop "{quoted(over)}"', f'        {source}->>{target}: "{quoted(message)}"', f'        {target}-->>{source}: "result"', "    end"]
        else:
            lines += [f'    {source}->>{target}: "{quoted(message)}"', f'    {target}-->>{source}: "{"instance" if message.startswith("new ") else "return value"}"']
        shown += 1
    return fence(lines)


def _structure_sequence(facts: list[Fact]) -> str:
    functions, classes = of(facts, "function"), of(facts, "class")
    lines = ["sequenceDiagram", "    participant Main"]
    if not functions and not classes:
        return fence([*lines, "    Note over Main: No code structure detected"])
    for item in [*classes, *functions][: SHOWN["participants"]]:
        alias = identifier(item["name"])
        lines += [f'    participant {alias} as "{quoted(item["name"])}"', f'    Main->>{alias}: "{"use" if item["fact"] == "class" else quoted(item["name"]) + "()"}"']
    return fence(lines)


def package(module: str) -> str:
    """The package of a module: scoped names keep two segments."""
    if module.startswith("@"):
        return "/".join(module.split("/")[:2])
    return module if module.startswith(".") else module.split("/")[0].split(".")[0]


def dependency(facts: list[Fact]) -> str:
    """The module and the packages it imports, with how many of their modules."""
    imports = [f["module"] for f in of(facts, "import") if f.get("module")]
    if not imports:
        return fence(["graph LR", '    CurrentModule["📄 Your Code"]', '    CurrentModule --> NONE["No Imports Found"]'])
    grouped: dict[str, list[str]] = defaultdict(list)
    for m in imports:
        grouped[package(m)].append(m)
    lines = ["graph LR", '    CurrentModule["📄 Your Code"]']
    for n, (name, modules) in enumerate(sorted(grouped.items())):
        if n >= SHOWN["packages"]:
            _more(lines, "CurrentModule", len(grouped) - n)
            break
        count = f" ({len(set(modules))} modules, {len(modules)} imports)" if len(modules) > 1 else ""
        lines.append(f'    CurrentModule -->|imports| {identifier(name, "PKG_")}["📦 {quoted(name)}{count}"]')
    return fence(lines)


_SHAPES = {"box": ('["', '"]'), "diamond": ('{"', '"}'), "round": ('(["', '"])')}


def flowchart(facts: list[Fact], language: str | None = None, function: str | None = None) -> str:
    """The flow of a file, or of one function, with all its arms; see :mod:`repoloom.render.flow`."""
    chart = flow.of_file(facts, language, function)
    nodes = [f"    {n.id}{_SHAPES[n.shape][0]}{quoted(n.label)}{_SHAPES[n.shape][1]}" for n in chart.nodes]
    arrows = [f"    {a.source} -->" + (f'|"{quoted(a.label)}"|' if a.label else "") + f" {a.target}" for a in chart.arrows]
    return fence(["flowchart TD", *nodes, *arrows])


def structure(facts: list[Fact]) -> str:
    """Classes with their members, functions with parameters, as one tree."""
    if of(facts, "sql_table"):
        return sql_structure(facts)
    lines = ["graph TD", '    MODULE["📄 MODULE"]']
    for c in of(facts, "class"):
        node = identifier(c["name"], "C_")
        lines.append(f'    MODULE --> {node}["class {quoted(c["name"])}"]')
        members = [f for f in facts if f.get("class_name") == c["name"] and f["fact"] in ("method", "class_variable", "instance_variable")]
        for f in members[: SHOWN["section"]]:
            label = f"method {f['name']}()" if f["fact"] == "method" else f"{f['fact'].replace('_', ' ')} {f['name']}"
            lines.append(f'    {node} --> {identifier(c["name"] + "_" + f["fact"] + "_" + f["name"], "M_")}["{quoted(label)}"]')
        _more(lines, node, len(members) - SHOWN["section"])
    functions = [f for f in of(facts, "function") if not f.get("is_nested")]
    for f in functions[: 2 * SHOWN["section"]]:
        lines.append(f'    MODULE --> {identifier(f["name"], "F_")}["function {quoted(f["name"])}({quoted(", ".join(f.get("parameters") or []))})"]')
    _more(lines, "MODULE", len(functions) - 2 * SHOWN["section"])
    return fence(lines)


def _columns(facts: list[Fact]) -> dict[str, list[Fact]]:
    out: dict[str, list[Fact]] = {t["name"]: [] for t in of(facts, "sql_table")}
    for c in of(facts, "sql_column"):
        out.setdefault(c["class_name"], []).append(c)
    return out


def sql_architecture(facts: list[Fact]) -> str:
    """Tables and their foreign keys."""
    lines = ["graph TD", '    MODULE["🗄️ Schema"]']
    lines += [f'    MODULE --> {identifier(t, "T_")}["{quoted(t)} ({len(cs)} columns)"]' for t, cs in _columns(facts).items()]
    lines += [f'    {identifier(r["from_table"], "T_")} -->|{quoted(r["from_column"])}| {identifier(r["to_table"], "T_")}' for r in of(facts, "sql_relationship")]
    return fence(lines)


def sql_sequence(facts: list[Fact]) -> str:
    """For each table the three first tables it refers to."""
    grouped: dict[str, list[Fact]] = defaultdict(list)
    for r in of(facts, "sql_relationship"):
        grouped[r["from_table"]].append(r)
    lines = ["sequenceDiagram", *[f"    participant {identifier(t)}" for t in _columns(facts)]]
    lines += [f'    {identifier(t)}->>{identifier(r["to_table"])}: "{quoted(r["from_column"])}"' for t, rs in grouped.items() for r in rs[:3]]
    return fence(lines)


def sql_structure(facts: list[Fact]) -> str:
    """An entity diagram: columns with keys, relationships."""
    lines = ["erDiagram"]
    for t, cs in _columns(facts).items():
        lines.append(f"    {identifier(t)} {{")
        for c in cs[: SHOWN["columns"]]:
            marks = ", ".join(m for m, on in (("PK", c["is_primary_key"]), ("FK", c["is_foreign_key"]), ("UK", c["is_unique"])) if on)
            lines.append(f"        {identifier(c['type'])} {identifier(c['name'])} {marks}".rstrip())
        lines.append("    }")
    lines += [f'    {identifier(r["to_table"])} ||--o{{ {identifier(r["from_table"])} : "{quoted(r["from_column"])}"' for r in of(facts, "sql_relationship")]
    return fence(lines)


DIAGRAMS = {"architecture": architecture, "code_architecture": code_architecture, "sequence": sequence, "dependency": dependency, "flowchart": flowchart, "structure": structure}
