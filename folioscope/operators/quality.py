"""Fact checks against sources, selection of pages to check, patches and the life of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.constants import CONTRADICTION_MARKERS, INJECTION_PATTERNS, RECHECK_DAYS, TRUNCATION_MARKERS, TRUNCATION_WORDS

def fingerprints(issues: DataFrame) -> DataFrame:
    """(page, fingerprint): 16 digits of the hash of the sorted distinct claims; pages without issues have none."""
    claims = issues.groupBy("page").agg(F.array_sort(F.collect_set("claim")).alias("claims"))
    return claims.select("page", F.when(F.size("claims") == 0, "").otherwise(F.substring(F.sha2(F.array_join("claims", "\n"), 256), 1, 16)).alias("fingerprint"))


def contradicts_itself(evidence: str | Column, hint: str | Column) -> Column:
    return T.any_contains(F.concat_ws(" ", evidence, hint), CONTRADICTION_MARKERS)


def truncation_artefact(origin: str, severity: str, evidence: str) -> Column:
    """A contradiction of the model whose evidence rests on a shortened source; "Abkürzung" is another word."""
    named = T.any_contains(evidence, TRUNCATION_MARKERS) | F.lower(F.col(evidence)).rlike("(?U)" + TRUNCATION_WORDS)
    return (F.col(origin) == "llm") & (F.col(severity) == "contradiction") & named


def selected(pages: DataFrame, today: str, n: int) -> DataFrame:
    """Pages to check next: not checked clean within 30 days, not in grace, oldest update first, unknown dates last.

    A roll-up page waits while a leaf of its scope is not younger than it; one minimum per scope decides.
    """
    day = F.to_date(F.lit(today))
    p = pages.withColumn("u", T.iso_date("updated")).withColumn("c", T.iso_date("created")).withColumn("l", T.iso_date("last_check")).withColumn("g", T.iso_date("issue_until"))
    fresh = (F.col("check_status") == "clean") & (F.datediff(day, F.col("l")) <= RECHECK_DAYS)
    grace = F.col("g") >= day
    first = p.where("rollup_hash IS NULL AND u IS NOT NULL").groupBy("scope").agg(F.min("u").alias("first"))
    held = F.col("rollup_hash").isNotNull() & (F.col("first") <= F.col("u"))
    kept = p.join(first, "scope", "left").where(~F.coalesce(fresh, F.lit(False)) & ~F.coalesce(grace, F.lit(False)) & ~F.coalesce(held, F.lit(False)))
    return kept.orderBy(F.asc_nulls_last("u"), F.asc_nulls_last("c"), "path").limit(n).select("path", "scope", "updated", "created")


def backoff(state: DataFrame, today: str, rounds_needed: int = 2) -> DataFrame:
    """The next (rounds, issue_fingerprint, issue_until) of each page from its last state and this check.

    The same fingerprint again counts up; at the second time the page rests for 30 days. A clean page, a
    changed fingerprint or an applied patch starts anew.
    """
    same = (F.col("status") == "issues") & (F.col("fingerprint") == F.col("old_fingerprint")) & (F.col("fingerprint") != "") & ~F.col("patched")
    rounds = F.when(F.col("status") != "issues", 0).when(same, F.coalesce("old_rounds", F.lit(0)) + 1).otherwise(1)
    until = F.when((rounds >= rounds_needed) & same, F.date_format(F.date_add(F.to_date(F.lit(today)), RECHECK_DAYS), "yyyy-MM-dd"))
    return state.select("page", rounds.cast("int").alias("rounds"), F.when(F.col("status") == "issues", F.col("fingerprint")).otherwise("").alias("issue_fingerprint"), until.alias("issue_until"))


def rule_verdict(direction: str) -> Column:
    """Why a rule text is refused, or null."""
    d = F.regexp_replace(F.col(direction), r"[\x00-\x08\x0B-\x1F\x7F]", "")
    out = F.when(F.trim(d) == "", "empty").when(F.length(d) > 500, "too long").when(d.rlike(r"(?m)^\s*#"), "header").when(F.contains(d, F.lit("```")), "fence")
    for pattern in INJECTION_PATTERNS:
        out = out.when(d.rlike("(?i)" + pattern), "injection")
    return out


def admitted(rules: DataFrame, per_week: int = 3) -> DataFrame:
    """(rule_id, admitted): at most ``per_week`` queued rules within any seven days before a rule, as rules arrive."""
    w = Window.partitionBy("origin").orderBy(F.unix_timestamp("created"), "rule_id")
    week = Window.partitionBy("origin").orderBy(F.unix_timestamp("created")).rangeBetween(-7 * 86400, 0)
    return rules.withColumn("n", F.count(F.lit(1)).over(week)).withColumn("position", F.row_number().over(w)).select("rule_id", (F.col("n") <= per_week).alias("admitted"))
