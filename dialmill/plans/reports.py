"""Reports assembled from small aggregates (K7 to K11, K13); every section is one query's table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dialmill.operators import arena, metrics
from dialmill.sources import sinks


def score_report(scored: DataFrame) -> str:
    """Scores by category, defects, the most frequent ones, and advice (K7)."""
    return sinks.markdown("Scores", {
        "By category": metrics.scores_by_category(scored).orderBy("category_id"), "Defects": metrics.defect_counts(scored),
        "Top defects": metrics.top_defects(scored), "Advice": metrics.suggestions(scored).orderBy("rank"),
    })


def pair_report(pairs: DataFrame, by: str = "defect", cap: int = 110, drops: DataFrame | None = None) -> str:
    """Statistics and capped shares per class, the mix by category and source, and what was dropped (K8, K9)."""
    sections = {"Statistics": metrics.pair_stats(pairs, by).orderBy(by), "Shares": metrics.capped_shares(pairs, by, cap).orderBy(by), "By category": metrics.pairs_by_category(pairs).orderBy("category_id")}
    if "source" in pairs.columns:
        sections["By source"] = metrics.pair_stats(pairs, "source").orderBy("source")
    if drops is not None:
        sections["Dropped"] = drops
    return sinks.markdown("Preference pairs", sections)


def final_report(both: DataFrame, matches: DataFrame, scored: DataFrame) -> str:
    """The ten sections of the final evaluation (K10); both has c_ and b_ scores with verdict, gap and category_id, scored the candidate's rows."""
    return sinks.markdown("Final evaluation", {
        "Totals": arena.final_verdict(both), "By category": arena.compare_categories(both).orderBy("category_id"), "Dimensions": arena.compare_dimensions(both),
        "Arena": arena.overview(matches, "category_id").orderBy("category_id"), "Defects": metrics.defect_counts(scored), "Good cases": metrics.good_cases(matches.withColumnRenamed("candidate", "len"), key="doc_id").select("doc_id", "gap", "place").orderBy("place"),
        "Bad cases": metrics.worst_per_category(scored, key="doc_id").select("category_id", "place", "doc_id", "total", "more").orderBy("category_id", "place"),
        "Improved and degraded": arena.compare_categories(both).select("category_id", "delta", "change").orderBy("change", "category_id"), "Movements": metrics.moves(both),
        "Advice": metrics.suggestions(scored).orderBy("rank"), "Conclusion": arena.conclusion(both),
    })


def arena_report(matches: DataFrame, most: int = 200) -> str:
    """Overall, by category, and match by match."""
    each = matches.select("category_id", "doc_id", "verdict", "method", "gap").orderBy("category_id", "doc_id")
    return sinks.markdown("Arena", {"Overall": arena.rates(matches), "By category": arena.rates(matches, "category_id").orderBy("category_id"), "Matches": each}, most)


def arena_page(matches: DataFrame) -> str:
    """The dashboard over win rates and matches, without answers (F18's degraded mode)."""
    return sinks.dashboard("Arena", arena.overview(matches, "category_id").orderBy("category_id"), matches.select("doc_id", "category_id", "verdict", "method", "gap"))
