"""The code graph as two tables, and queries over it.

Nodes ``node_id, kind, name, file_path, line``; edges ``src, dst, relation, line, file_path``. There is one edge per
ordered pair, the last written one wins across relations; of a node the first written attributes stay. A callee that
nothing defines is a node without attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.session import cut, materialise

NODE_COLUMNS = ("kind", "name", "file_path", "line")
EDGE_COLUMNS = ("relation", "line", "file_path")
_FACT_COLUMNS = ("path", "seq", "fact", "name", "qualified", "class_name", "module", "alias", "kind", "caller", "line", "is_nested", "bases")


def node_id(kind: str, path: Column, name: Column | None = None) -> Column:
    parts = [F.lit(kind), path] + ([name] if name is not None else [])
    return F.concat_ws(":", *parts)


def edges_last_write(candidates: DataFrame, seq: str = "seq") -> DataFrame:
    """One edge per (src, dst) with the attributes written last; loops and edges with a null end go."""
    kept = candidates.where((F.col("src") != F.col("dst")))
    best = kept.groupBy("src", "dst").agg(F.max_by(F.struct(*EDGE_COLUMNS), seq).alias("e"))
    return best.select("src", "dst", "e.*")


def nodes_first_write(candidates: DataFrame, edges: DataFrame, seq: str = "seq") -> DataFrame:
    """One node per id with the attributes written first, and a bare node for each end of an edge that has none."""
    own = candidates.groupBy("node_id").agg(F.min_by(F.struct(*NODE_COLUMNS), seq).alias("n")).select("node_id", "n.*")
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    bare = ends.join(own, "node_id", "left_anti")
    return own.unionByName(bare, allowMissingColumns=True)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    both = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(edges.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_nodes"), F.coalesce(F.sum("e"), F.lit(0)).cast("bigint").alias("n_edges"))


def relation(edges: DataFrame, name: str | None = None) -> DataFrame:
    return edges.where(F.col("relation") == name) if name else edges


def resolve_symbol(nodes: DataFrame, symbol: str) -> DataFrame:
    """``node_id`` of the nodes that a symbol means, by the best tier that has any.

    1: the name itself; 2: an id that ends with ``:symbol``; 3: ``module.name`` of a Python file of that stem; 4: a
    name that ends with ``.symbol`` or an id that ends with ``:`` and its last part.
    """
    last = symbol.rsplit(".", 1)[-1]
    module = symbol.rsplit(".", 1)[0].rsplit(".", 1)[-1] if "." in symbol else None
    name, node = F.coalesce(F.col("name"), F.lit("")), F.col("node_id")
    tier = F.when(name == symbol, 1).when(F.endswith(node, F.lit(f":{symbol}")), 2)
    if module:
        tier = tier.when(F.endswith(F.concat(F.lit("/"), F.coalesce(F.col("file_path"), F.lit(""))), F.lit(f"/{module}.py")) & (name == last), 3)
    tier = tier.when(F.endswith(name, F.lit(f".{symbol}")) | F.endswith(node, F.lit(f":{last}")), 4)
    tiered = nodes.select("node_id", tier.alias("tier")).where("tier is not null")
    best = tiered.agg(F.min("tier").alias("tier"))
    return tiered.join(F.broadcast(best), "tier").select("node_id")


def resolve_file(nodes: DataFrame, path: str) -> DataFrame:
    """The file node of a path: the exact one, else the shortest that ends with ``/path``, ties by id."""
    wanted = path.replace("\\", "/").lstrip("/") if path else path
    files = nodes.where((F.col("kind") == "file") & ((F.col("file_path") == path) | (F.col("file_path") == wanted) | F.endswith(F.col("file_path"), F.lit(f"/{wanted}"))))
    exact = (F.col("file_path") != path).cast("int")
    return files.select("node_id", exact.alias("x"), F.length("file_path").alias("n")).orderBy("x", "n", "node_id").limit(1).select("node_id")


def _with_attributes(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    return ids.join(nodes, "node_id", "left").select("node_id", *NODE_COLUMNS)


def who_calls(nodes: DataFrame, edges: DataFrame, symbol: str) -> DataFrame:
    """Direct callers: ``node_id, kind, name, file_path, line, callee_id, call_line``; none for an unknown symbol."""
    targets = resolve_symbol(nodes, symbol)
    calls = relation(edges, "calls").join(targets.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return calls.select(F.col("src").alias("node_id"), F.col("dst").alias("callee_id"), F.col("line").alias("call_line")).join(nodes, "node_id", "left")


def what_calls(nodes: DataFrame, edges: DataFrame, symbol: str) -> DataFrame:
    """Direct callees: ``node_id, ..., caller_id, call_line``."""
    targets = resolve_symbol(nodes, symbol)
    calls = relation(edges, "calls").join(targets.withColumnRenamed("node_id", "src"), "src", "left_semi")
    return calls.select(F.col("dst").alias("node_id"), F.col("src").alias("caller_id"), F.col("line").alias("call_line")).join(nodes, "node_id", "left")


def reach_backwards(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct ``node_id`` from which a seed can be reached.

    Each seed is left out of what it reaches itself, but stays in the result if another seed's callers include it. To
    know that, two different seeds per node are enough: a node is passed again only while it has been reached from one
    seed alone, so that there are no more than three rows per node whatever the number of seeds. Each round is one join
    and one look at the earlier rounds, on keys; it is checkpointed, and no earlier round is written again.
    """
    arrows = cut(edges.select("src", "dst").distinct())
    frontier = seeds.select(F.col("node_id").alias("dst"), F.col("node_id").alias("low"), F.col("node_id").alias("high"))
    rounds: list[DataFrame] = []

    def reached() -> DataFrame:
        out = rounds[0]
        for one in rounds[1:]:
            out = out.unionByName(one)
        return out.groupBy("dst").agg(F.min("low").alias("low"), F.max("high").alias("high"))

    while True:
        found = frontier.join(arrows, "dst").select(F.col("src").alias("dst"), "low", "high").groupBy("dst").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        if rounds:
            before = reached().select("dst", F.col("low").alias("b_low"), F.col("high").alias("b_high"))
            news = F.col("b_low").isNull() | ((F.col("b_low") == F.col("b_high")) & ((F.col("low") != F.col("b_low")) | (F.col("high") != F.col("b_high"))))
            found = found.join(before, "dst", "left").where(news).select("dst", "low", "high")
        frontier = cut(found)
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    if not rounds:
        return seeds.limit(0).select("node_id")
    return reached().where("low != dst or high != dst").select(F.col("dst").alias("node_id"))


def impact_of(nodes: DataFrame, edges: DataFrame, symbol: str) -> DataFrame:
    """Everything that would be touched by a change: direct and transitive callers with their attributes."""
    return _with_attributes(reach_backwards(relation(edges, "calls"), resolve_symbol(nodes, symbol)), nodes)


def dependencies_of(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """What a file imports: the module nodes with the line of the import."""
    file = resolve_file(nodes, path).withColumnRenamed("node_id", "src")
    imports = relation(edges, "imports").join(file, "src", "left_semi")
    return imports.select(F.col("dst").alias("node_id"), F.col("line").alias("import_line")).join(nodes, "node_id", "left")


# --- building the graph from facts ---------------------------------------------------------------------------------


def build(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a project from the fact table of :mod:`repoloom.parsers`.

    Structure is written before calls, files in the order of their paths, facts in the order in which they were found;
    that order decides which of several writes stays. A callee is looked for in this order: a definition of the file,
    a nested function, a method of that bare name, an import from a module of the project (found by its stem; of
    several files the last), and is a bare node of the caller's file otherwise. Method calls are never resolved
    through imports. One equi-join per step; nothing is collected.
    """
    own = materialise(facts.where("fact != 'error'").select(*_FACT_COLUMNS), "graph-facts")  # one parse for every branch below
    path, order = F.col("path"), F.struct("path", "seq")
    none_text, none_int = F.lit(None).cast("string"), F.lit(None).cast("int")

    def identity(kind: str, *parts: Column | str) -> Column:
        return F.concat_ws(":", F.lit(kind), *[F.col(p) if isinstance(p, str) else p for p in parts])

    def node(df: DataFrame, node: Column, kind: str, name: Column, file: Column, line: Column, seq: Column = order) -> DataFrame:
        return df.select(node.alias("node_id"), F.lit(kind).alias("kind"), name.alias("name"), file.alias("file_path"), line.alias("line"), seq.alias("seq"))

    files = own.select("path").distinct()
    imports = own.where("fact = 'import'").withColumn("target", F.when((F.col("kind") == "from_import") & (F.coalesce("module", F.lit("")) != "") & F.col("name").isNotNull(), F.concat_ws(".", "module", "name")).otherwise(F.coalesce(F.nullif("module", F.lit("")), "name"))).where("target is not null and target != ''")
    functions = own.where("fact = 'function' and not coalesce(is_nested, false)")
    classes, methods = own.where("fact = 'class'"), own.where("fact = 'method'")
    bases = classes.select("path", "seq", "line", "name", F.explode("bases").alias("base")).where("base != ''")
    calls = own.where("fact in ('function_call', 'method_call') and caller is not null and name is not null")
    late = F.struct(F.concat(F.lit("\uffff"), path).alias("path"), F.col("seq"))

    nodes = node(files, identity("file", path), "file", path, path, none_int, F.struct(path.alias("path"), F.lit(-1).alias("seq")))
    for part in (
        node(imports, identity("module", "target"), "module", F.col("target"), none_text, none_int),
        node(functions, identity("function", path, "name"), "function", F.col("name"), path, F.col("line")),
        node(classes, identity("class", path, "name"), "class", F.col("name"), path, F.col("line")),
        node(methods, identity("function", path, "qualified"), "function", F.col("qualified"), path, F.col("line")),
        node(bases, identity("class", path, "base"), "class", F.col("base"), path, none_int),
        node(calls, identity("function", path, "caller"), "function", F.col("caller"), path, none_int, late),
    ):
        nodes = nodes.unionByName(part)

    def edge(df: DataFrame, src: Column, dst: Column, name: str, step: int = 0) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(name).alias("relation"), "line", path.alias("file_path"), F.struct(F.lit(step).alias("step"), "path", "seq").alias("seq"))

    # of what a name means in a file the last one registered stays: classes come behind functions
    definitions = functions.select("path", "name", identity("function", path, "name").alias("id"), F.lit(0).alias("rank")).unionByName(classes.select("path", "name", identity("class", path, "name").alias("id"), F.lit(1).alias("rank"))).unionByName(methods.select("path", F.col("qualified").alias("name"), identity("function", path, "qualified").alias("id"), F.lit(2).alias("rank")))
    known = definitions.groupBy("path", "name").agg(F.max_by("id", "rank").alias("id"))
    nested = own.where("fact = 'function' and is_nested").select("path", "name").distinct().select("path", F.col("name").alias("callee"), identity("function", path, "name").alias("nested_id"))
    bare = methods.groupBy("path", "name").agg(F.min_by("qualified", "seq").alias("q")).select("path", F.col("name").alias("callee"), identity("function", path, "q").alias("method_id"))
    modules = files.groupBy(F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "").alias("module")).agg(F.max("path").alias("module_path"))
    member = F.when(F.col("kind") == "from_import", F.col("name"))
    last_part = F.element_at(F.split("module", r"\."), -1)
    alias = imports.where("module is not null and module != ''").select("path", "seq", F.coalesce("alias", member, last_part).alias("head"), "module", member.alias("member"))
    alias = alias.groupBy("path", "head").agg(F.max_by(F.struct("module", "member"), "seq").alias("m")).select("path", "head", "m.*").join(modules, "module").select("path", "head", "member", "module_path")

    local = known.select("path", F.col("name").alias("callee"), F.col("id").alias("local_id"))
    first = known.select(F.col("path").alias("module_path"), F.col("name").alias("wanted"), F.col("id").alias("remote_id"))
    second = known.select(F.col("path").alias("module_path"), F.col("name").alias("rest"), F.col("id").alias("member_id"))
    direct = calls.where("fact = 'function_call'").withColumn("callee", F.col("name")).withColumn("head", F.substring_index("name", ".", 1)).withColumn("rest", F.when(F.contains("name", F.lit(".")), F.expr("substring(name, instr(name, '.') + 1)")))
    direct = direct.join(local, ["path", "callee"], "left").join(nested, ["path", "callee"], "left").join(bare, ["path", "callee"], "left").join(alias, ["path", "head"], "left")
    direct = direct.withColumn("wanted", F.when(F.col("rest").isNull(), F.coalesce("member", "callee")).otherwise(F.concat_ws(".", F.coalesce("member", "head"), "rest")))
    direct = direct.join(first, ["module_path", "wanted"], "left").join(second, ["module_path", "rest"], "left")
    target = F.coalesce("local_id", "nested_id", "method_id", "remote_id", "member_id", identity("function", path, "callee"))
    within = calls.where("fact = 'method_call'").withColumn("callee", F.concat_ws(".", "class_name", "name"))
    caller = identity("function", path, "caller")

    edges = edge(imports, identity("file", path), identity("module", "target"), "imports")
    for part in (
        edge(functions, identity("file", path), identity("function", path, "name"), "defines"),
        edge(classes, identity("file", path), identity("class", path, "name"), "defines"),
        edge(bases, identity("class", path, "name"), identity("class", path, "base"), "inherits"),
        edge(methods, identity("class", path, "class_name"), identity("function", path, "qualified"), "defines"),
        edge(direct, caller, target, "calls", 1),
        edge(within, caller, identity("function", path, "callee"), "calls", 1),
    ):
        edges = edges.unionByName(part)
    final = edges_last_write(edges)
    return nodes_first_write(nodes, final), final
