"""Manifests, gates, probes and the state machines that keep them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a provider's root and the ways between them.
TRANSITIONS = {
    "missing": ("starting",), "starting": ("importing", "partial"), "importing": ("ready", "partial"), "ready": ("resolving", "stale"), "resolving": ("ready", "partial"),
    "stale": ("resolving",), "partial": ("retrying",), "retrying": ("ready", "partial"),
}
BLOCKING = ("stale", "updating", "missing")


def can_move(old: Column, new: Column) -> Column:
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, own in TRANSITIONS.items() for b in own))
    return F.array_contains(pairs, F.concat(old, F.lit(">"), new))


def refresh(state: Column, event: Column) -> Column:
    """A manifest's state after an event: changes of source, config or environment make it stale, a reconcile moves stale to updating, the rest stays."""
    return F.when(event.isin("source", "config", "environment"), "stale").when((event == "reconcile") & (state == "stale"), "updating").when((event == "built") & (state == "updating"), "fresh").otherwise(state)


def gate(manifests: DataFrame) -> DataFrame:
    """One row `allows_precise`: no manifest blocks."""
    return manifests.agg((~F.coalesce(F.bool_or(F.col("state").isin(*BLOCKING)), F.lit(False))).alias("allows_precise"))


def query_manifests(manifests: DataFrame, root: str | None = None, language: str | None = None, provider: str | None = None) -> DataFrame:
    out = manifests
    for c, v in (("root_id", root), ("language", language), ("provider", provider)):
        out = out if v is None else out.where(F.col(c) == v)
    return out


def manifests_for(roots: DataFrame, providers: DataFrame) -> DataFrame:
    return roots.select("root_id", "language").join(providers, "language").withColumn("state", F.lit("missing"))


def capability(manifests: DataFrame, languages: DataFrame) -> DataFrame:
    """language, state, provider for each language: missing without a manifest, partial while any blocks, else ready."""
    per = manifests.groupBy("language").agg(F.bool_or(F.col("state").isin(*BLOCKING)).alias("blocked"), F.min("provider").alias("provider"))
    state = F.when(F.col("blocked").isNull(), "missing").when(F.col("blocked"), "partial").otherwise("ready")
    return languages.select("language").distinct().join(per, "language", "left").select("language", state.alias("state"), "provider")


def dedup_probes(probes: DataFrame, key: list[str]) -> DataFrame:
    """Of probes with the same key that of the least priority number, ties by probe_id."""
    return probes.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("priority", "probe_id"))).where("n = 1").drop("n")


def schedule(probes: DataFrame, most_roots: int, most_probes: int) -> DataFrame:
    """probes with decision: run, or deferred for the provider's roots or the root's probes. Only distinct roots are ranked within a provider, and of those the first ones are found
    by a top-k for each task, so a provider with very many probes is no single task."""
    roots = probes.select("provider", "root_id").distinct()
    first = _first_roots(roots, most_roots)
    own = F.row_number().over(Window.partitionBy("provider", "root_id").orderBy("priority", "probe_id"))
    kept = probes.join(first.withColumn("among", F.lit(True)), ["provider", "root_id"], "left")
    why = F.when(F.col("among").isNull(), "deferred_roots").when(F.col("p") > most_probes, "deferred_probes").otherwise("run")
    return kept.withColumn("p", own).withColumn("decision", why).select(*probes.columns, "decision")


def _first_roots(roots: DataFrame, most: int) -> DataFrame:
    """The first `most` roots of each provider. A filter on row_number keeps only so many of a provider in each task before the exchange."""
    return roots.withColumn("r", F.row_number().over(Window.partitionBy("provider").orderBy("root_id"))).where(F.col("r") <= most).drop("r")


def provider_for(probes: DataFrame, providers: DataFrame) -> DataFrame:
    """probes with the preferred provider if it serves the language, else the language's least."""
    first = providers.groupBy("language").agg(F.min("provider").alias("first_provider"), F.collect_set("provider").alias("all_providers"))
    return probes.join(first, "language", "left").withColumn("provider", F.when(F.array_contains("all_providers", F.col("preferred")), F.col("preferred")).otherwise(F.col("first_provider"))).drop("first_provider", "all_providers")


def semantic_budget_ms(java_roots: int, java_files: int) -> int:
    return min(3_600_000, max(60_000, 180_000 + 60_000 * java_roots + 1000 * java_files)) if java_roots else 60_000
