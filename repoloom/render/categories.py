"""Category of classes and functions by the words in their names and docstrings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in a class name, categories in the order in which they are tried. Fixed values.
CLASS_KEYWORDS = {
    "entry_points": ("main", "app", "application", "server", "runner", "entry", "start", "launch"),
    "services": ("service", "manager", "handler", "controller", "api", "client", "processor", "executor"),
    "components": ("component", "widget", "view", "ui", "panel", "frame", "window", "dialog"),
    "models": ("model", "entity", "schema", "record", "dto", "dataclass", "table"),
}
#: Words in a class docstring. Fixed values.
CLASS_DOC_KEYWORDS = {"services": CLASS_KEYWORDS["services"], "components": CLASS_KEYWORDS["components"], "models": ("model", "entity", "schema", "record")}
#: Words in a function name, and in its docstring. Fixed values.
FUNCTION_KEYWORDS = {
    "entry_points": ("main", "run", "start", "launch", "execute", "entry"),
    "components": ("render", "display", "show", "draw", "paint"),
    "services": ("process", "handle", "manage", "serve", "api", "request", "response"),
    "models": ("to_dict", "from_dict", "serialize", "deserialize"),
    "helpers": ("format", "validate", "convert", "transform", "utility", "helper", "parse"),
}
FUNCTION_DOC_KEYWORDS = {"components": ("render", "display", "ui", "view"), "services": FUNCTION_KEYWORDS["services"], "models": ("model", "entity", "serialize"), "helpers": ("helper", "utility", "format", "validate")}
#: Description of a class by words in its name, in this order. Fixed values.
CLASS_ROLES = (
    (("model", "entity"), "Data model representing structured information"),
    (("service", "manager"), "Service layer for business logic"),
    (("controller", "handler"), "Controller handling requests and responses"),
    (("component", "widget"), "UI component for user interaction"),
    (("client", "api"), "API client for external communication"),
    (("view",), "View component for displaying data"),
    (("factory",), "Factory for creating instances"),
    (("base", "abstract"), "Base class providing common functionality"),
)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def _by_words(name: Column, docstring: Column | None, names: dict, docs: dict, default: Column | str) -> Column:
    lower = F.lower(name)
    doc = F.lower(F.coalesce(docstring, F.lit(""))) if docstring is not None else None
    out = None
    for category, words in names.items():
        hit = _any(lower, words)
        if doc is not None and category in docs:
            hit = hit | _any(doc, docs[category])
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise(default)


def class_category(name: Column, docstring: Column | None = None, has_methods: Column | None = None, has_variables: Column | None = None) -> Column:
    """Category of a class: by name before docstring in each category; else by what it has; ``other`` if unknown."""
    default: Column | str = "other"
    if has_methods is not None:
        default = F.when(has_methods, "components").when(has_variables if has_variables is not None else F.lit(False), "models").otherwise("components")
    return _by_words(name, docstring, CLASS_KEYWORDS, CLASS_DOC_KEYWORDS if docstring is not None else {}, default)


def function_category(name: Column, docstring: Column | None = None) -> Column:
    return _by_words(name, docstring, FUNCTION_KEYWORDS, FUNCTION_DOC_KEYWORDS, "helpers")


def class_role(name: Column, docstring: Column, n_methods: Column) -> Column:
    """The first sentence of the docstring up to 60 characters, else what the name suggests, else the method count."""
    first = F.btrim(F.regexp_extract(F.btrim(docstring), r"(?s)^([^.\n]*)", 1))
    first = F.when(F.length(first) > 60, F.concat(F.left(first, F.lit(57)), F.lit("..."))).otherwise(first)
    inferred = None
    for words, role in CLASS_ROLES:
        hit = _any(F.lower(name), words)
        inferred = F.when(hit, role) if inferred is None else inferred.when(hit, role)
    counted = F.when(n_methods > 0, F.concat(F.lit("Class with "), n_methods.cast("string"), F.lit(" method"), F.when(n_methods > 1, "s").otherwise(""))).otherwise("Class definition")
    return F.coalesce(F.when(first != "", first), inferred.otherwise(counted))
