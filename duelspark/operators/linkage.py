"""Record linkage between contests and external statistics: a cascade of equi-joins, first unique hit wins.

Tiers: date + tournament + round + names, date + names, date + explicit ids. A tier counts only if
exactly one external row qualifies; otherwise the next tier decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIERS = ("strict", "unique_date_player", "explicit_alias")


def _name_pairs(project: DataFrame, external: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """(match_id, external_row) with both names matching on one date: exploded name keys joined, never whole days."""
    p = project.select("match_id", "match_date", *[F.explode(F.array_distinct(F.col(f"{s}_keys"))).alias("key") if s == "winner" else F.col(f"{s}_keys").alias("loser_keys") for s in ("winner", "loser")], "winner_alias", "loser_alias")
    e = external.select("external_row", "match_date", F.explode(F.array_distinct("winner_keys")).alias("key"), F.col("loser_keys").alias("e_loser_keys"), F.col("loser_id").alias("e_loser_id"))
    by_name = p.join(e, ["match_date", "key"])
    loser_ok = F.arrays_overlap("loser_keys", "e_loser_keys") | F.coalesce(F.col("loser_alias") == F.col("e_loser_id"), F.lit(False))
    found = by_name.filter(loser_ok).select("match_id", "external_row")
    if aliases is not None:
        q = project.filter("winner_alias is not null").select("match_id", "match_date", F.col("winner_alias").alias("winner_id"), "loser_keys", "loser_alias")
        x = external.select("external_row", "match_date", "winner_id", F.col("loser_keys").alias("e_loser_keys"), F.col("loser_id").alias("e_loser_id"))
        by_id = q.join(x, ["match_date", "winner_id"]).filter(loser_ok).select("match_id", "external_row")
        found = found.unionByName(by_id)
    return found.distinct()


def _with_aliases(project: DataFrame, aliases: DataFrame | None) -> DataFrame:
    for side in ("winner", "loser"):
        if aliases is None:
            project = project.withColumn(f"{side}_alias", F.lit(None).cast("long"))
        else:
            ids = aliases.groupBy("name").agg(F.max_by("player_id", "line").alias(f"{side}_alias")).withColumnRenamed("name", f"{side}_normalized")
            project = project.join(ids, f"{side}_normalized", "left")
    return project


def link(project: DataFrame, external: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """One row per project match: tier and external_row of the first unique hit, or failure_reason.

    ``project``: match_id, match_date, tournament_normalized, round, winner_normalized, loser_normalized and
    the name keys; ``external``: external_row, the same, winner_id, loser_id; ``aliases``: name, player_id, line."""
    project = _with_aliases(project, aliases)
    pairs = _name_pairs(project, external, aliases)
    place = ["match_id", "tournament_normalized", "round"]
    named = pairs.join(project.select(*place), "match_id")
    at = external.select("external_row", F.col("tournament_normalized").alias("e_tournament"), F.col("round").alias("e_round"))
    same = F.coalesce((F.col("tournament_normalized") == F.col("e_tournament")) & (F.col("round") == F.col("e_round")), F.lit(False))
    judged = named.join(at, "external_row").withColumn("same_place", same)
    tiers = judged.groupBy("match_id").agg(
        F.count_if("same_place").alias("n1"), F.max(F.when(F.col("same_place"), F.col("external_row"))).alias("r1"), F.count(F.lit(1)).alias("n2"), F.max("external_row").alias("r2")
    )
    if aliases is not None:
        ids = project.filter("winner_alias is not null and loser_alias is not null").select("match_id", "match_date", F.col("winner_alias").alias("winner_id"), F.col("loser_alias").alias("loser_id"))
        third = ids.join(external, ["match_date", "winner_id", "loser_id"]).groupBy("match_id").agg(F.count(F.lit(1)).alias("n3"), F.max("external_row").alias("r3"))
        tiers = tiers.join(third, "match_id", "full")
    else:
        tiers = tiers.withColumn("n3", F.lit(0)).withColumn("r3", F.lit(None).cast("long"))
    hit = F.when(F.lit(False), F.struct(F.lit("").alias("tier"), F.lit(0).cast("long").alias("row")))
    for k, tier in enumerate(TIERS, 1):
        hit = hit.when(F.col(f"n{k}") == 1, F.struct(F.lit(tier).alias("tier"), F.col(f"r{k}").alias("row")))
    out = project.select("match_id").join(tiers.withColumn("hit", hit), "match_id", "left")
    reason = F.when(F.col("hit").isNull(), F.when(F.coalesce("n2", F.lit(0)) > 1, "ambiguous").otherwise("unmatched"))
    return out.select("match_id", F.col("hit.tier").alias("tier"), F.col("hit.row").alias("external_row"), reason.alias("failure_reason"))


def manual_suggestions(links: DataFrame, project: DataFrame, external: DataFrame, most: int = 5) -> DataFrame:
    """For each failure the first few external rows of its date (a report, not a link)."""
    first = external.withColumn("rank", F.row_number().over(Window.partitionBy("match_date").orderBy("external_row"))).filter(F.col("rank") <= most)
    failed = links.filter("failure_reason is not null").select("match_id").join(project.select("match_id", "match_date"), "match_id")
    return failed.join(first.select("match_date", "external_row", "rank"), "match_date").select("match_id", "rank", "external_row")


def link_rates(links: DataFrame, project: DataFrame, column: str) -> DataFrame:
    return links.join(project.select("match_id", column), "match_id").groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("external_row").isNotNull().cast("double")).alias("rate"))
