"""Training rows: labels and stable files joined with code and process metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codehist.functions.names import (
    clean_dollar,
    clean_method_name,
    is_inner_class,
    is_test_file,
    method_name_or_empty,
    scale_cohesion,
    simplify_method_name,
    trimmed,
)
from codehist.operators.labels import LABEL
from codehist.schemas import CLASS_METRICS, COHESION, METHOD_METRICS

CLASS, METHOD, VARIABLE, ATTRIBUTE = 1, 2, 3, 4


def class_metrics(ck: DataFrame) -> DataFrame:
    """Metric rows with the output names: inner-class flag, scaled cohesion."""
    values = [
        scale_cohesion(F.col(m)).alias(m) if m in COHESION else F.col(m) for m in CLASS_METRICS
    ]
    return ck.select(
        "project",
        "commit_id",
        "file",
        clean_dollar(F.col("class")).alias("class"),
        F.struct(F.col("class"), "type").alias("rawClass"),
        F.struct(is_inner_class(F.col("type")).alias("isInnerClass"), *values).alias("classMetrics"),
        "methods",
    )


def method_metric(m: Column) -> Column:
    name = method_name_or_empty(m["name"])
    return F.struct(
        simplify_method_name(name).alias("fullMethodName"),
        clean_method_name(name).alias("shortMethodName"),
        m["start_line"].alias("startLine"),
        *[m[n].alias(n) for n in METHOD_METRICS],
    )


def metrics_asked_for(ck: DataFrame, files: DataFrame) -> DataFrame:
    """Metric rows of the given files (project, commit_id, file), found by their keys, before the wide columns are looked at."""
    return ck.join(files.distinct(), ["project", "commit_id", "file"], "left_semi")


def label_class_join(targets: DataFrame, ck: DataFrame) -> DataFrame:
    """Class metrics at the parent commit, by class name or by its alias.

    Several metric rows may match a label; see ``first_matches``.
    """
    names = F.array_compact(F.array_distinct(F.array("class", "alias")))
    asked = targets.select("*", F.explode(names).alias("_name"))
    files = targets.select("project", F.col("parent_id").alias("commit_id"), F.col("path").alias("file"))
    metrics = class_metrics(metrics_asked_for(ck, files)).select(
        F.col("project"),
        F.col("commit_id").alias("parent_id"),
        F.col("file").alias("path"),
        F.col("class").alias("_name"),
        "rawClass",
        "classMetrics",
        "methods",
    )
    return asked.join(metrics, ["project", "parent_id", "path", "_name"]).withColumnRenamed("_name", "className")


def first_matches(found: DataFrame) -> DataFrame:
    """Number the metric rows that are left of a label by ``match_pos``.

    The name itself comes before its alias. Rows that agree in all metrics are
    told apart by the class name and type as they stand in the metric table.
    """
    order = [F.col("className") != F.col("class"), "classMetrics", "rawClass"]
    nth = F.row_number().over(Window.partitionBy(*LABEL, "class_pos").orderBy(*order))
    return found.withColumn("match_pos", nth)


def matching_method(methods: Column, full_name: Column) -> Column:
    """First method (by line) whose simplified name is ``full_name``, any case."""
    wanted = F.lower(simplify_method_name(full_name))
    hits = F.filter(
        F.transform(
            methods,
            lambda m, i: F.struct(
                m["start_line"].alias("line"),
                i.alias("i"),
                (F.lower(simplify_method_name(m["name"])) == wanted).alias("hit"),
            ),
        ),
        lambda h: h["hit"],
    )
    return F.get(methods, F.array_min(hits)["i"])


def label_method_join(found: DataFrame) -> DataFrame:
    """Add ``method``; method and variable labels without one are dropped."""
    needs = F.col("level").isin(METHOD, VARIABLE)
    method = F.when(needs, matching_method(F.col("methods"), F.col("method_full_name")))
    return found.withColumn("method", method).filter(~needs | F.col("method").isNotNull())


def variable_appearances(method: Column, name: Column) -> Column:
    """Uses of a variable in a method, -1 when it is not found there."""
    return F.coalesce(F.try_element_at(method["variables"], name), F.lit(-1))


def field_appearances(methods: Column, name: Column) -> Column:
    """Uses of a field summed over all methods, 0 when there are none."""
    uses = F.transform(methods, lambda m: F.coalesce(F.try_element_at(m["fields"], name), F.lit(0)))
    return F.reduce(uses, F.lit(0), lambda a, b: a + b)


def instance_id(*key: str) -> Column:
    """Stable id of a row, the same in every run."""
    return F.sha2(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in key]), 256)


def refactoring_instances(targets: DataFrame, ck: DataFrame) -> DataFrame:
    """One row per (label, class) with code metrics; process metrics come later."""
    rows = first_matches(label_method_join(label_class_join(targets, ck)))
    of_level = lambda level, value: F.when(F.col("level") == level, value)
    element = F.col("element_name")
    return rows.select(
        instance_id(*LABEL, "class_pos", "match_pos").alias("id"),
        *LABEL,
        "class_pos",
        "match_pos",
        F.col("path").alias("filePath"),
        "className",
        is_test_file(F.col("path")).alias("isTest"),
        "level",
        F.col("display_name").alias("refactoring"),
        trimmed(F.col("summary")).alias("refactoringSummary"),
        F.lit(True).alias("isValid"),
        "classMetrics",
        F.when(F.col("method").isNotNull(), method_metric(F.col("method"))).alias("methodMetrics"),
        of_level(
            VARIABLE,
            F.struct(
                element.alias("variableName"),
                variable_appearances(F.col("method"), element).alias("variableAppearances"),
            ),
        ).alias("variableMetrics"),
        of_level(
            ATTRIBUTE,
            F.struct(
                element.alias("fieldName"),
                field_appearances(F.col("methods"), element).alias("fieldAppearances"),
            ),
        ).alias("fieldMetrics"),
    )


def stable_rows(stable: DataFrame, ck: DataFrame) -> DataFrame:
    """Rows of every class of a stable file, as it was at the base commit.

    Per class: one row per (method, variable), per method, per field, and one
    for the class. Files missing at the base commit have no rows.
    """
    files = stable.select("project", F.col("base_commit").alias("commit_id"), F.col("path").alias("file"))
    metrics = class_metrics(metrics_asked_for(ck, files)).drop("rawClass").withColumnsRenamed({"commit_id": "base_commit", "file": "path"})
    found = stable.join(metrics, ["project", "base_commit", "path"])
    null_of = lambda t: F.lit(None).cast(t)
    var_t = "struct<variableName:string,variableAppearances:int>"
    field_t = "struct<fieldName:string,fieldAppearances:int>"
    method_t = "struct<fullMethodName:string,shortMethodName:string,startLine:int,{}>".format(
        ",".join(f"{m}:int" for m in METHOD_METRICS)
    )

    def unit(level: int, method: Column, variable: Column, field: Column) -> Column:
        return F.struct(
            F.lit(level).alias("level"),
            method.cast(method_t).alias("methodMetrics"),
            variable.cast(var_t).alias("variableMetrics"),
            field.cast(field_t).alias("fieldMetrics"),
        )

    # the metrics of a method are worked out once, for itself and for its variables
    found = found.withColumn("_methods", F.transform("methods", lambda m: F.struct(method_metric(m).cast(method_t).alias("m"), m["variables"].alias("vars"))))
    methods = F.col("methods")
    of_methods = F.transform(
        "_methods", lambda m: unit(METHOD, m["m"], null_of(var_t), null_of(field_t))
    )
    of_variables = F.flatten(
        F.transform(
            "_methods",
            lambda m: F.transform(
                F.map_entries(m["vars"]),
                lambda v: unit(
                    VARIABLE, m["m"], F.struct(v["key"], v["value"]), null_of(field_t)
                ),
            ),
        )
    )
    fields = F.array_distinct(F.flatten(F.transform(methods, lambda m: F.map_keys(m["fields"]))))
    of_fields = F.transform(
        fields,
        lambda f: unit(
            ATTRIBUTE, null_of(method_t), null_of(var_t), F.struct(f, field_appearances(methods, f))
        ),
    )
    of_class = F.array(unit(CLASS, null_of(method_t), null_of(var_t), null_of(field_t)))
    units = F.concat(of_class, of_methods, of_variables, of_fields)
    keep = [c for c in stable.columns if c not in ("project", "base_commit", "path", "fired")]
    return found.select(
        "project",
        F.col("base_commit").alias("commit_id"),
        F.col("path").alias("filePath"),
        F.col("class").alias("className"),
        is_test_file(F.col("path")).alias("isTest"),
        F.col("fired").alias("commitThreshold"),
        "classMetrics",
        *keep,
        F.explode(units).alias("_unit"),
    ).select("*", "_unit.*").drop("_unit")


def training_set(instances: DataFrame, stable: DataFrame) -> DataFrame:
    """Positive and negative rows in one table, told apart by ``kind``."""
    return instances.withColumn("kind", F.lit("refactoring")).unionByName(
        stable.withColumn("kind", F.lit("stable")), allowMissingColumns=True
    )


def labels_without_metrics(targets: DataFrame, instances: DataFrame) -> DataFrame:
    """Labels that found no class (or method) in the metrics."""
    return targets.join(instances, [*LABEL, "class_pos"], "left_anti")


def commit_instances(instances: DataFrame, commit_id: str) -> DataFrame:
    return instances.filter(F.col("commit_id") == commit_id)
