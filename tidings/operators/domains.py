"""Registered domains by a table of public suffix rules: ordinary, wildcard and exception rules, the longest fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.plans.shape import unpack
from tidings.plans.skew import HOT_ROWS, salted_join
from tidings.plans.storage import materialize


def suffix_table(rules: DataFrame, rule: str) -> DataFrame:
    """(suffix, labels, exception): ``com.pl`` is itself, ``*.ck`` stands for one label more than ``ck``, ``!www.ck`` for an exception.

    ``suffix`` is what a host must end with, ``labels`` how many labels its public suffix has. Rules are compared in lower case; blank
    ones and comments drop out.
    """
    text = F.lower(F.trim(F.col(rule)))
    body = F.regexp_replace(text, r"^!|^\*\.", "")
    n = F.size(F.split(body, r"\."))
    labels = F.when(text.startswith("!"), n - 1).when(text.startswith("*."), n + 1).otherwise(n)
    listed = rules.where((text != "") & ~text.startswith("//"))
    return listed.select(body.alias("suffix"), labels.alias("labels"), text.startswith("!").alias("exception")).distinct()


def registered_domains(
    df: DataFrame, host: str, rules: DataFrame, rule: str = "rule", name: str = "domain", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``df`` with the registered domain of ``host``: its public suffix and one label more.

    Every distinct host is taken apart into its endings, and the endings meet the rules by an equi-join. An exception wins over all
    other rules, else the one with most labels; a host that fits no rule has its last label as suffix. Null, a blank
    host, a bare suffix and an address of digits have none.
    """
    clean = F.regexp_replace(F.lower(F.trim(F.col(host))), r"\.+$", "")
    hosts = materialize(df.select(clean.alias("_host")).where((F.col("_host") != "") & ~F.col("_host").rlike(r"^[0-9.]+$|^\[")).distinct(), "hosts")
    parts = hosts.select("_host", F.split("_host", r"\.").alias("_labels"))
    every = F.transform(F.sequence(F.lit(1), F.size("_labels")), lambda i: F.array_join(F.slice("_labels", i, F.size("_labels")), "."))
    endings = unpack(parts, ["_host"], every, "suffix")
    # the ending com has as many rows as there are such hosts
    fits = salted_join(endings, suffix_table(rules, rule), ["suffix"], hot_rows=hot_rows)
    best = fits.groupBy("_host").agg(F.max(F.struct("exception", "labels")).alias("_fit"))
    n = F.coalesce(F.col("_fit.labels"), F.lit(1))
    found = parts.join(best, "_host", "left").where(F.size("_labels") > n).select("_host", F.array_join(F.slice("_labels", -(n + 1), n + 1), ".").alias(name))
    return salted_join(df.drop(name).withColumn("_host", clean), found, ["_host"], "left", hot_rows=hot_rows).drop("_host")
