"""Aggregates over files, facts and runs: roll-ups, means, thresholds, patterns, groups, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repoloom.session import numbered


def file_counts(facts: DataFrame) -> DataFrame:
    """The counters of each file from its facts: one row per ``path``."""
    is_ = lambda name: F.count_if(F.col("fact") == name)
    functions = F.col("fact") == "function"
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return facts.groupBy("path").agg(
        is_("function").alias("total_functions"),
        F.count_if(functions & ~yes("is_async") & ~yes("is_nested")).alias("sync_functions"),
        F.count_if(functions & yes("is_async")).alias("async_functions"),
        F.count_if(functions & yes("is_nested")).alias("nested_functions"),
        is_("class").alias("total_classes"), is_("method").alias("total_methods"),
        is_("import").alias("total_imports"), is_("global_variable").alias("total_global_variables"),
        is_("local_variable").alias("total_local_variables"), is_("class_variable").alias("total_class_variables"),
        is_("instance_variable").alias("total_instance_variables"), is_("function_call").alias("total_function_calls"),
        is_("method_call").alias("total_method_calls"), is_("class_instantiation").alias("total_class_instantiations"),
        is_("control_flow").alias("total_control_flow"), is_("warning").alias("total_warnings"), is_("sql_table").alias("total_tables"),
    )


def project_summary(files: DataFrame) -> DataFrame:
    """One row for all files: files, lines, and sums of the four counters; null counts are 0."""
    return files.agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum("lines_of_code"), F.lit(0)).alias("total_lines"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c.removesuffix('_count')}") for c in ("functions_count", "classes_count", "tables_count", "imports_count")],
        F.count_if(F.col("error").isNotNull()).alias("failed_files"),
    )


def mean_or_nan(column: str) -> Column:
    """The mean of what is not null; NaN if there is nothing."""
    return F.coalesce(F.avg(column), F.lit(float("nan")))


def operational_summary(runs: DataFrame, mode: Column) -> DataFrame:
    """Per mode: runs, mean latency over all of them (null counts 0), mean tokens over those that have them; 0 if none."""
    return runs.groupBy(mode.alias("mode")).agg(
        F.count("*").alias("n_runs"),
        F.round(F.coalesce(F.avg(F.coalesce("latency_ms", F.lit(0.0))), F.lit(0.0)), 6).alias("mean_latency_ms"),
        F.round(F.coalesce(F.avg("tokens.total"), F.lit(0.0)), 6).alias("mean_tokens"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
    )


def threshold_failures(means: DataFrame, minimum: dict[str, float], modes: tuple[str, ...]) -> DataFrame:
    """``mode, metric, value``: every mode of ``modes`` whose metric is missing, NaN or below its minimum."""
    spark = means.sparkSession
    wanted = spark.createDataFrame([(m, k, float(v)) for m in modes for k, v in minimum.items()], "mode string, metric string, minimum double")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in minimum]))
    long = means.select("mode", pairs.alias("p")).select("mode", "p.metric", "p.value")
    both = F.broadcast(wanted).join(long, ["mode", "metric"], "left")
    return both.where(F.col("value").isNull() | F.isnan("value") | (F.col("value") < F.col("minimum"))).select("mode", "metric", "value")


def pending(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Items without a finished run."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def last_per_group(rows: DataFrame, group: str, order: list[Column], n: int = 6) -> DataFrame:
    """The last ``n`` rows of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top_module(module: Column) -> Column:
    return F.substring_index(module, ".", 1)


def dependency_groups(imports: DataFrame, module_col: str = "module", *keys: str) -> DataFrame:
    """Imports by package: the first dotted part, two segments for scoped packages, the first path segment else."""
    m = F.col(module_col)
    group = F.when(F.startswith(m, F.lit("@")), F.substring_index(m, "/", 2)).when(F.contains(m, F.lit("/")) & ~F.startswith(m, F.lit(".")), F.substring_index(m, "/", 1)).when(F.startswith(m, F.lit(".")), m).otherwise(top_module(m))
    return imports.where(m.isNotNull() & (m != "")).groupBy(*keys, group.alias("package")).agg(F.count("*").alias("n_imports"), F.countDistinct(module_col).alias("n_modules"))


def duplicates(defs: DataFrame, keys: list[str], name: str = "name", order: str = "seq", line: str = "line") -> DataFrame:
    """Definitions that repeat an earlier one of the same name: with the line of the first."""
    w = Window.partitionBy(*keys, name).orderBy(order)
    ranked = defs.withColumn("_rn", F.row_number().over(w)).withColumn("previous_line", F.first(line).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ranked.where("_rn > 1").drop("_rn")


def shadowed(locals_: DataFrame, globals_: DataFrame, declared: DataFrame, key: str = "path") -> DataFrame:
    """Local names that hide a global one and are not declared global in their function."""
    g = globals_.groupBy(key, "name").agg(F.min("line").alias("global_line"))
    return locals_.join(g, [key, "name"]).join(declared.select(key, "function", "name").distinct(), [key, "function", "name"], "left_anti")


def repeated(rows: DataFrame, keys: list[str], at_least: int = 3) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def busiest(rows: DataFrame, group: str, member: str, order: str) -> DataFrame:
    """Per group the member with most rows; the one that comes first wins a tie."""
    counted = rows.groupBy(group, member).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(group).agg(F.max_by(F.struct(member, "n"), F.struct("n", -F.col("first"))).alias("b")).select(group, f"b.{member}", "b.n")


def islands(rows: DataFrame, group: str, order: list[str], breaks: Column) -> DataFrame:
    """Rows with the number of the run of consecutive rows they are in; a row that breaks belongs to no run."""
    w = Window.partitionBy(group).orderBy(*order)
    numbered = rows.withColumn("_b", breaks.cast("int")).withColumn("island", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("_b = 0").drop("_b")


def until_first(rows: DataFrame, group: str, order: list[str], stops: Column) -> DataFrame:
    """Rows of each group up to and with the first that stops."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_s", F.coalesce(F.max(stops.cast("int")).over(w), F.lit(0))).where("_s = 0").drop("_s")


def flow_flags(events: DataFrame, by: list[str], kind: Column, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per group whether any event is of one of the kinds named, and whether all are: ``any_<name>``, ``all_<name>``."""
    checks = [f(F.coalesce(kind.isin(*values), F.lit(False))).alias(f"{word}_{name}") for name, values in kinds.items() for word, f in (("any", F.bool_or), ("all", F.bool_and))]
    return events.groupBy(*by).agg(*checks)


def progress(items: DataFrame, group: str, *order: str) -> DataFrame:
    """Rows with ``index`` (from 1, in the order given) and ``total`` of their group, without a window over a group."""
    placed = numbered(items, group, *order)
    totals = placed.groupBy(group).agg(F.count("*").alias("total"))
    return placed.join(totals, group).withColumn("index", F.col("position") + 1).drop("position")
