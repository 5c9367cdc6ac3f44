"""Robots policies as data: rules of a file, and whether a path may be fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rules(policies: DataFrame, agent: str) -> DataFrame:
    """(site, allow, pattern) of the groups that address the agent: their lines are taken in order, a user-agent line after rules opens a new group."""
    lines = policies.select("site", F.posexplode(F.split("body", r"\r?\n")).alias("n", "raw"))
    clean = F.trim(F.regexp_replace("raw", "#.*$", ""))
    parsed = lines.select("site", "n", F.lower(F.trim(F.substring_index(clean, ":", 1))).alias("key"), F.trim(F.regexp_extract(clean, r"^[^:]*:(.*)$", 1)).alias("value")).where(F.col("key").isin("user-agent", "allow", "disallow"))
    w = W.partitionBy("site").orderBy("n")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")
    grouped = parsed.withColumn("_open", opens.cast("int")).withColumn("group", F.sum("_open").over(w.rowsBetween(W.unboundedPreceding, 0)))
    token = F.lit(agent.lower())
    ours = grouped.where((F.col("key") == "user-agent") & ((F.col("value") == "*") | ((F.col("value") != "") & F.startswith(token, F.lower("value"))))).select("site", "group").distinct()
    return grouped.where((F.col("key") != "user-agent") & (F.col("value") != "")).join(ours, ["site", "group"], "left_semi").select("site", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))


def may_fetch(paths: DataFrame, policies: DataFrame, agent: str) -> DataFrame:
    """(site, path, allowed): no policy allows, an unreadable one refuses, else the most specific rule decides and a tie refuses.

    policies: site, status, content_type, body.
    """
    html = F.coalesce(F.lower("content_type").contains("text/html"), F.lit(False)) | F.coalesce(F.col("body").rlike(r"(?i)^\s*(<!doctype html|<html)"), F.lit(False))
    state = policies.select("site", F.when(F.col("status").isin(404, 410), "none").when((F.col("status") != 200) | html, "unreadable").otherwise("rules").alias("_kind"))
    found = rules(policies, agent)
    body = F.regexp_replace("pattern", r"\$$", "")
    quoted = F.regexp_replace(F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    regex = F.concat(F.lit("^"), quoted, F.when(F.endswith("pattern", F.lit("$")), "$").otherwise(""))
    ranked = found.select("site", "allow", regex.alias("_regex"), F.length(F.regexp_replace("pattern", r"[*$]", "")).alias("_size"), (~F.col("allow") & F.col("pattern").isin("/", "/*")).alias("_all"))
    closed = ranked.where("_all").select("site").distinct().withColumn("_closed", F.lit(True))
    hits = paths.join(ranked, "site").where(F.expr("path rlike _regex")).groupBy("site", "path").agg(F.max(F.struct("_size", (~F.col("allow")).alias("_no"))).alias("_best"))
    j = paths.join(state, "site", "left").join(closed, "site", "left").join(hits, ["site", "path"], "left")
    allowed = F.when(F.coalesce("_kind", F.lit("none")) == "none", True).when((F.col("_kind") == "unreadable") | F.col("_closed"), False).otherwise(~F.coalesce(F.col("_best")["_no"], F.lit(False)))
    return j.select("site", "path", allowed.alias("allowed"))
