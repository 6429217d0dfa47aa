"""Template documentation from facts: docstrings, README and architecture texts."""

from __future__ import annotations

import ast
import re
import warnings

from repoloom.render.mermaid import Fact, class_role, of, top_module

#: What a parameter is, by words in its name. Fixed values.
PARAMETERS = ((("path", "file", "filename"), "Path of the file to use."), (("url", "uri"), "Address to use."), (("name", "title", "label"), "Name to use."), (("id", "key"), "Identifier to look up."), (("data", "payload", "content", "text"), "Data to process."), (("count", "size", "limit", "num", "n"), "Number of items."), (("flag", "enable", "is_", "has_"), "Whether the behaviour is on."), (("items", "list", "values", "rows"), "Items to process."), (("config", "options", "settings"), "Settings to use."), (("callback", "func", "handler"), "Function to call."))
#: What a function does, by the first word of its name. Fixed values.
VERBS = {"get": "Return", "set": "Set", "load": "Load", "save": "Save", "read": "Read", "write": "Write", "create": "Create", "build": "Build", "make": "Make", "delete": "Delete", "remove": "Remove", "update": "Update", "add": "Add", "is": "Check whether", "has": "Check whether", "check": "Check", "validate": "Validate", "parse": "Parse", "process": "Process", "handle": "Handle", "run": "Run", "compute": "Compute", "calculate": "Calculate", "render": "Render", "find": "Find", "send": "Send", "init": "Initialise"}


#: What a function returns, by a word in its name. Fixed values.
RETURNS = ((("get", "fetch", "load", "read", "find"), "The retrieved value."), (("is", "has", "check", "validate", "can"), "bool: True if the condition is met, False otherwise."), (("calculate", "compute", "count", "sum", "add"), "The calculated result."), (("create", "make", "build"), "The created object or value."), (("process", "handle", "run"), "The processed result."))
#: What an annotated type stands for. Fixed values.
TYPES = {"str": "str: The result as a string.", "int": "int: The result as an integer.", "bool": "bool: The boolean result.", "list": "list: A list of results.", "dict": "dict: A dictionary of results."}


def words_of(name: str) -> list[str]:
    return [p.lower() for p in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])", name)] or [name.lower()]


def returned(function: Fact, returns: list[Fact]) -> str | None:
    """What a function gives back, by its name, its annotation and its return statements; None if it gives nothing."""
    values = [bool(f.get("has_value")) for f in returns]
    kind = function.get("returns")
    if not any(values) and (not kind or kind == "None"):
        return None
    parts = set(words_of(function["name"]))
    named = next((text for keys, text in RETURNS if parts & set(keys)), None)
    if kind and kind != "None":
        return TYPES.get(kind) or named or f"{kind}: The result value."
    return named or ("The result, or None where there is none." if not all(values) else "The result.")


def sentence(name: str) -> str:
    """A sentence from a function's name."""
    if name == "__init__":
        return "Initialise the instance."
    parts = words_of(name)
    verb = VERBS.get(parts[0])
    rest = " ".join(parts[1:])
    if verb:
        return f"{verb} {rest}.".replace(" .", ".") if rest else f"{verb} the object."
    return f"{' '.join(parts).capitalize()}."


def parameter(name: str) -> str:
    low = name.lower()
    return next((text for keys, text in PARAMETERS if any(low == k or k in low and len(k) > 2 for k in keys)), f"Value of {name}.")


def docstring(function: Fact, facts: list[Fact]) -> str:
    """A docstring with arguments, behaviour from the control flow, return value and exceptions."""
    name = function.get("qualified") or function["name"]
    flow = [f for f in of(facts, "control_flow") if f["caller"] in (name, function["name"])]
    kinds = {f["kind"] for f in flow}
    lines = [f'"""{sentence(function["name"])}']
    notes = [text for kind, text in (("if", "Decides between cases."), ("for", "Goes through its items one by one."), ("while", "Repeats while a condition holds."), ("try", "Handles errors on the way."), ("with", "Holds a resource while it works.")) if kind in kinds]
    if notes:
        lines += ["", " ".join(notes)]
    parameters = [p for p in function.get("parameters") or [] if p not in ("self", "cls")]
    if parameters:
        lines += ["", "Args:", *[f"    {p}: {parameter(p)}" for p in parameters]]
    result = returned(function, [f for f in flow if f["kind"] == "return"])
    if result:
        lines += ["", "Returns:", f"    {result}"]
    caught = sorted({e for f in flow if f["kind"] == "try" for e in f.get("exceptions") or []})
    if caught:
        lines += ["", "Raises:", *[f"    {e}: Handled inside." for e in caught]]
    return "\n".join([*lines, '"""'])


def class_docstring(cls: Fact, facts: list[Fact]) -> str:
    """A docstring with the role of a class, its bases and its attributes."""
    lines = [f'"""{class_role(cls, facts)}.']
    if cls.get("bases"):
        lines += ["", f"Inherits from {', '.join(cls['bases'])}."]
    attributes = list({f["name"]: f for f in facts if f.get("class_name") == cls["name"] and f["fact"] in ("class_variable", "instance_variable")}.values())
    if attributes:
        lines += ["", "Attributes:", *[f"    {a['name']}: {a['type'] if a.get('type') not in (None, 'unknown') else 'Value'} of the {'class' if a['fact'] == 'class_variable' else 'instance'}." for a in attributes]]
    return "\n".join([*lines, '"""'])


def documented(code: str, facts: list[Fact]) -> str:
    """Python source with docstrings put in where functions, methods and classes have none; other code as it is.

    Definitions whose body stands on the line of their head are left alone, and so is code that does not parse.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return code
    by_line = {f["line"]: f for f in of(facts, "function", "method", "class")}
    lines, added = code.splitlines(keepends=True), []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and ast.get_docstring(node) is None and node.lineno in by_line:
            first = node.body[0]
            at = min([first.lineno, *(d.lineno for d in getattr(first, "decorator_list", []))])
            head = lines[at - 1][: first.col_offset]
            if at > node.lineno and not head.strip():
                fact = by_line[node.lineno]
                text = class_docstring(fact, facts) if fact["fact"] == "class" else docstring(fact, facts)
                added.append((at - 1, "".join(f"{head if x else ''}{x}\n" for x in text.split("\n"))))
    for at, text in sorted(added, reverse=True):
        lines.insert(at, text)
    return "".join(lines)


def docstrings(facts: list[Fact]) -> str:
    """Docstrings for what has none; '' if everything has one or there is nothing."""
    out = []
    for f in of(facts, "function", "method"):
        if not f.get("docstring"):
            out.append(f"def {f.get('qualified') or f['name']}({', '.join(f.get('parameters') or [])}):\n    " + docstring(f, facts).replace("\n", "\n    "))
    for c in of(facts, "class"):
        if not c.get("docstring"):
            out.append(f"class {c['name']}:\n    " + class_docstring(c, facts).replace("\n", "\n    "))
    return "\n\n".join(out)


def _own(facts: list[Fact], cls: str, kind: str) -> list[Fact]:
    return [f for f in of(facts, kind) if f.get("class_name") == cls]


def _plain(facts: list[Fact]) -> list[Fact]:
    return [f for f in of(facts, "function") if not f.get("is_nested")]


def readme(facts: list[Fact], language: str = "python") -> str:
    functions, classes = _plain(facts), of(facts, "class")
    lines = ["# Project Documentation", "", f"This {language} module has {len(functions)} functions and {len(classes)} classes.", ""]
    modules = sorted({top_module(f["module"]) for f in of(facts, "import") if f.get("module")})
    if modules:
        lines += ["## Dependencies", "", *[f"- `{m}`" for m in modules], ""]
    if classes:
        lines += ["## Classes", ""]
        for c in classes:
            lines += [f"### `{c['name']}`", "", class_role(c, facts), "", f"- **Methods**: {len(_own(facts, c['name'], 'method'))}", *([f"- **Inherits**: {', '.join(c['bases'])}"] if c.get("bases") else []), ""]
    if functions:
        lines += ["## Functions", ""]
        for f in functions:
            lines += [f"### `{f['name']}`", "", f.get("docstring") or sentence(f["name"]), "", f"- **Parameters**: {', '.join(f.get('parameters') or []) or 'none'}", ""]
    tables = of(facts, "sql_table")
    if tables:
        lines += ["## Tables", "", *[f"- `{t['name']}`: {len(_own(facts, t['name'], 'sql_column'))} columns" for t in tables], ""]
    return "\n".join(lines)


def architecture(facts: list[Fact]) -> str:
    functions, classes = _plain(facts), of(facts, "class")
    flow = of(facts, "control_flow")
    lines = ["# Architecture Documentation", "", "## Overview", "", f"{len(classes)} classes, {len(functions)} functions, {len(of(facts, 'import'))} imports.", "", "### Classes", ""]
    for c in classes:
        methods = ", ".join(f"`{m['name']}`" for m in _own(facts, c["name"], "method")) or "none"
        lines += [f"- **{c['name']}**: {class_role(c, facts)}. Methods: {methods}"]
    if not classes:
        lines.append("No classes were detected.")
    lines += ["", "### Functions", "", f"Total top-level functions: {len(functions)}", ""]
    lines += [f"- `{f['name']}`: {f.get('docstring') or sentence(f['name'])}" for f in functions] or ["No top-level functions were detected."]
    lines += ["", "## Functional Overview", ""]
    for f in functions:
        own = [e for e in flow if e["caller"] == f["name"]]
        kinds = {e["kind"] for e in own}
        does = [text for kind, text in (("if", "decides between cases"), ("for", "goes through items"), ("while", "repeats"), ("try", "handles errors"), ("with", "holds a resource")) if kind in kinds]
        calls = list(dict.fromkeys(e["call_name"] for e in own if e["kind"] == "call"))
        result = returned(f, [e for e in own if e["kind"] == "return"])
        lines += [f"### {f['name']}", "", f"- **Purpose**: {f.get('docstring') or sentence(f['name'])}", f"- **Inputs**: {', '.join(f.get('parameters') or []) or 'none'}", f"- **Output**: {result or 'none'}", f"- **Behaviour**: {', '.join(does) or 'runs straight through'}", *([f"- **Calls**: {', '.join(calls)}"] if calls else []), ""]
    lines += ["### Control flow", "", f"Branches: {any(f['kind'] == 'if' for f in flow)}, loops: {any(f['kind'] in ('for', 'while') for f in flow)}, error handling: {any(f['kind'] == 'try' for f in flow)}"]
    edges = sorted({(f["caller"], f["name"]) for f in of(facts, "function_call") if f["name"] in {x["name"] for x in functions}})
    if edges:
        lines += ["", "### Calls", "", *[f"- `{a}` calls `{b}`" for a, b in edges]]
    return "\n".join(lines)


def document(facts: list[Fact], language: str = "python") -> dict[str, str]:
    return {"docstrings": docstrings(facts), "readme": readme(facts, language), "architecture": architecture(facts)}


def project_readme(files: list[dict], top: int = 10) -> str:
    """README of a project from its file rows (path, language, lines_of_code, functions, classes)."""
    lines = ["# Project Documentation", "", f"{len(files)} files, {sum(f.get('lines_of_code') or 0 for f in files):,} lines.", "", "## Files by language", ""]
    by: dict[str, list[dict]] = {}
    for f in files:
        by.setdefault(f.get("language") or "unknown", []).append(f)
    for language, own in sorted(by.items()):
        lines += [f"### {language} ({len(own)})", "", *[f"- `{f['path']}`: {f.get('functions') or 0} functions, {f.get('classes') or 0} classes" for f in own[:top]]]
        if len(own) > top:
            lines.append(f"- ... {len(own) - top} more")
        lines.append("")
    return "\n".join(lines)
