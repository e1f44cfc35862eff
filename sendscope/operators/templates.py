"""Template existence and similarity."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prepare import conversations_with_campaigns


def distinct_templates(camp: DataFrame) -> DataFrame:
    return camp.where(F.col("template").isNotNull()).select("template").distinct()


def missing_templates(expected: DataFrame, camp: DataFrame) -> DataFrame:
    """Reported campaigns whose template never appears in the campaign base."""
    exp = expected.select("campaign", "template")
    return exp.join(distinct_templates(camp), "template", "left_anti").select("campaign", "template")


def template_candidates(expected: DataFrame, camp: DataFrame, max_distance: int = 4) -> DataFrame:
    """All (expected, base template) pairs within ``max_distance`` edits, self
    excluded, for lists of any length (:func:`_segment_candidates`).
    ``levenshtein(a, b, k)`` stops early once k is exceeded."""
    k = int(max_distance)
    exp = expected.select("campaign", F.col("template").alias("expected_template")) \
        .where(F.col("expected_template").isNotNull()).distinct()
    pairs = _segment_candidates(exp.select("expected_template").distinct(), distinct_templates(camp), k)
    d = F.levenshtein(F.col("template"), F.col("expected_template"), k)
    return (pairs.withColumn("distance", d)
                 .where((F.col("distance") >= 1) & (F.col("distance") <= k))
                 .join(exp, "expected_template")
                 .select("campaign", "expected_template", F.col("template").alias("similar_template"),
                         "distance"))


def _deletions(names: DataFrame, col: str, k: int) -> DataFrame:
    """``names`` with ``_v``: every string left when at most ``k`` characters of
    ``col`` are deleted. Each round deletes one character at or behind the last
    place, or stops."""
    stop = 1 << 30
    rows = names.withColumn("_v", F.col(col)).withColumn("_at", F.lit(0))
    for _ in range(k):
        places = F.when(F.col("_at") < F.length("_v"),
                        F.concat(F.array(F.lit(-1)), F.sequence(F.col("_at"), F.length("_v") - 1))).otherwise(F.array(F.lit(-1)))
        rows = (rows.withColumn("_p", F.explode(places))
                .withColumn("_v", F.when(F.col("_p") < 0, F.col("_v"))
                            .otherwise(F.concat(F.substring("_v", 1, F.col("_p")), F.substring("_v", F.col("_p") + 2, F.length("_v")))))
                .withColumn("_at", F.when(F.col("_p") < 0, F.lit(stop)).otherwise(F.col("_p"))).drop("_p"))
    return rows.select(*names.columns, "_v").distinct()


#: Characters of a segment, at most.
SEGMENT_CHARS = 8


def _grams(names: DataFrame, col: str, most: int) -> DataFrame:
    """``names`` with ``_w``, ``_p`` and ``_s``: every substring of 2 to ``most``
    characters, its length and where it begins (from 0)."""
    return (names.withColumn("_w", F.explode(F.sequence(F.lit(2), F.lit(most))))
            .where(F.col("_w") <= F.length(col))
            .withColumn("_p", F.explode(F.sequence(F.lit(0), F.length(col) - F.col("_w"))))
            .withColumn("_s", F.substring(F.col(col), F.col("_p") + 1, F.col("_w"))))


def _cut_points(exp: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """``expected_template``, ``_w`` and ``_p``: for each name of 2(k+1) characters
    or more its k+1 segments, side by side and of ``_w`` characters each, where
    templates hold them least often.

    Every length from 2 on and every place of the first segment is weighed by
    how many templates hold its segments, so a beginning or end that all names
    share is left out of the segments as far as the rest has room for them.
    Ties: the longer segments, then the first place.
    """
    grams = _grams(exp.where(F.length("expected_template") >= 2 * (k + 1)), "expected_template", SEGMENT_CHARS)
    grams = grams.where(F.col("_w") * (k + 1) <= F.length("expected_template"))
    held = (_grams(base, "template", SEGMENT_CHARS).select("_s", "template").distinct()
            .join(grams.select("_s").distinct(), "_s", "left_semi")
            .groupBy("_s").agg(F.count(F.lit(1)).alias("_n")))
    weighed = (grams.join(held, "_s", "left").groupBy("expected_template", "_w")
               .agg(F.sort_array(F.collect_list(F.struct("_p", F.coalesce("_n", F.lit(0)).alias("n")))).alias("_f")))
    # the array holds a place for each of the name's grams of this length, in order
    firsts = F.sequence(F.lit(0), F.size("_f") - 1 - F.col("_w") * k)
    costs = F.transform(firsts, lambda o: F.struct(
        sum((F.get(F.col("_f"), o + F.col("_w") * i)["n"] for i in range(1, k + 1)), F.get(F.col("_f"), o)["n"]).alias("cost"),
        (-F.col("_w")).alias("w"), o.alias("o")))
    best = (weighed.select("expected_template", F.array_min(costs).alias("_b"))
            .groupBy("expected_template").agg(F.min("_b").alias("_b")))
    return best.select("expected_template", (-F.col("_b.w")).alias("_w"),
                       F.explode(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.col("_b.o") - F.col("_b.w") * i)).alias("_p"))


def _segment_candidates(exp: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """Exact candidate pairs by partition-based blocking (pigeonhole).

    k edits change at most k of k+1 disjoint segments of a name, so a template
    within k edits holds one of them unchanged, beginning within k places of
    where it begins in the name. Names meet templates by (segment, place); the
    caller verifies the distance. :func:`_cut_points` chooses the segments.
    Shorter names meet the templates with which they share a string after at
    most k deletions on either side (:func:`_deletions`), which holds for every
    pair within k edits.
    """
    cuts = _cut_points(exp, base, k)
    e_keys = (cuts.withColumn("_s", F.substring(F.col("expected_template"), F.col("_p") + 1, F.col("_w")))
              .withColumn("_p", F.explode(F.sequence(F.greatest(F.col("_p") - k, F.lit(0)), F.col("_p") + k))))
    t_keys = _grams(base, "template", SEGMENT_CHARS)
    near = F.abs(F.length("template") - F.length("expected_template")) <= k
    blocked = e_keys.join(t_keys, ["_w", "_p", "_s"]).where(near).select("expected_template", "template").distinct()

    # names too short for segments of two characters
    e_short = _deletions(exp.where(F.length("expected_template") < 2 * (k + 1)), "expected_template", k)
    t_short = _deletions(base.where(F.length("template") < 2 * (k + 1) + k), "template", k)
    short_pairs = e_short.join(t_short, "_v").select("expected_template", "template").distinct()
    return blocked.unionByName(short_pairs)


def similar_templates(expected: DataFrame, camp: DataFrame, max_distance: int = 4,
                      top_k: int = 3, conv: DataFrame | None = None) -> DataFrame:
    """For each reported template of a campaign, the ``top_k`` nearest base templates
    by (edit distance, name); with ``conv``, also ``n_linked_rows`` — how many
    rows each neighbour contributes to campaigns ⋈ conversations (0 = the
    name never reaches a conversation).

    ``row_number() <= k`` lets Spark insert a partial per-group limit before
    the shuffle, so no task receives more than k rows per group per map task.
    """
    cand = template_candidates(expected, camp, max_distance)
    w = Window.partitionBy("campaign", "expected_template").orderBy("distance", "similar_template")
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    if conv is None:
        return top
    names = top.select(F.col("similar_template").alias("template"))
    linked = template_join_counts(camp, conv, names).withColumnRenamed("template", "similar_template")
    return (top.join(linked, "similar_template", "left")
               .select("campaign", "expected_template", "similar_template", "distance", "rank",
                       F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_linked_rows")))


def _with_templates(camp: DataFrame, templates: Iterable[str] | DataFrame) -> DataFrame:
    """Campaign rows whose template is listed: a literal hash set for a list,
    a semi join against the distinct listed names for a table (AQE broadcasts
    it when its measured size is small)."""
    if not isinstance(templates, DataFrame):
        return camp.where(F.col("template").isin([str(t) for t in templates]))
    return camp.join(templates.select("template").distinct(), "template", "left_semi")


def template_join_counts(camp: DataFrame, conv: DataFrame, templates: Iterable[str] | DataFrame) -> DataFrame:
    """A4: rows per template in campaigns ⋈ conversations, without the join.

    Σ over sessions of (campaign rows with that template) × (conversation
    rows of the session): both sides are pre-aggregated per session, so a
    hot session contributes one row per side. Templates without joined rows
    are absent, as with a GROUP BY over the join.
    """
    c = _with_templates(camp, templates).groupBy("session_id", "template").agg(F.count(F.lit(1)).alias("n_c"))
    # only sessions holding a listed template matter: reduce conversations first
    v = (conv.join(c.select("session_id").distinct(), "session_id", "left_semi")
             .groupBy("session_id").agg(F.count(F.lit(1)).alias("n_v")))
    return (c.join(v, "session_id", "inner")
             .groupBy("template").agg(F.sum(F.col("n_c") * F.col("n_v")).cast("long").alias("n_rows")))


def similar_template_detail(camp: DataFrame, conv: DataFrame, templates: Iterable[str] | DataFrame) -> DataFrame:
    """Joined campaign/conversation rows for the listed templates (filter first)."""
    return conversations_with_campaigns(_with_templates(camp, templates), conv)
