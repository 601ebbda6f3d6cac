"""Cohesion of classes from the members that their methods touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.graph import min_label_components


def method_components(methods: DataFrame, touches: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(cls, method, label): methods are connected if they share a member or one calls the other.

    methods(cls, method), touches(cls, method, member), calls(cls, method, callee). A member connects
    its methods by a star around the smallest, so one that all methods touch makes no pairs.
    """
    node = F.struct("cls", "method")
    first = touches.groupBy("cls", "member").agg(F.min("method").alias("least"))
    links = touches.join(first, ["cls", "member"]).where("method <> least").select(node.alias("x"), F.struct("cls", F.col("least").alias("method")).alias("y"))
    if calls is not None:
        links = links.unionAll(calls.select(node.alias("x"), F.struct("cls", F.col("callee").alias("method")).alias("y")))
    labels = min_label_components(methods.select(node.alias("node")).distinct(), links)
    return labels.select("node.cls", "node.method", F.col("label.method").alias("label"))


def class_cohesion(methods: DataFrame, touches: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(cls, methods, lcom4, tcc, lcc): components, and the shares of pairs of methods that share a member or a component."""
    labels = method_components(methods, touches, calls)
    sizes = labels.groupBy("cls", "label").agg(F.count("*").alias("k"))
    per = sizes.groupBy("cls").agg(F.sum("k").alias("methods"), F.count("*").alias("lcom4"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("same"))
    t = touches.distinct()
    pairs = t.toDF("cls", "m1", "member").join(t.toDF("c2", "m2", "mem2"), (F.col("cls") == F.col("c2")) & (F.col("member") == F.col("mem2"))).where("m1 < m2").select("cls", "m1", "m2").distinct()
    direct = pairs.groupBy("cls").agg(F.count("*").alias("direct"))
    all_ = F.col("methods") * (F.col("methods") - 1) / 2
    share = lambda c: F.when(F.col("methods") < 2, 1.0).otherwise(F.coalesce(c, F.lit(0)) / all_)
    return per.join(direct, "cls", "left").select("cls", "methods", "lcom4", share(F.col("direct")).alias("tcc"), share(F.col("same")).alias("lcc"))


def suggested_groups(labels: DataFrame, touches: DataFrame, fields: int = 4) -> DataFrame:
    """(cls, label, methods, fields): each component's methods and its first few members, sorted."""
    own = labels.groupBy("cls", "label").agg(F.array_sort(F.collect_set("method")).alias("methods"))
    t = touches.join(labels, ["cls", "method"]).groupBy("cls", "label").agg(F.slice(F.array_sort(F.collect_set("member")), 1, fields).alias("fields"))
    return own.join(t, ["cls", "label"], "left")
