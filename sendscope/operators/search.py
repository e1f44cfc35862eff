"""Keyword evidence search.

Several patterns are evaluated in one scan, never one scan per pattern: a short
list as one test at the scan, a long one through a shared prefilter of the
literals that its patterns require.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.literals import choose_keys, folded, further_literals, with_grams
from ..functions.params import DEFAULT_BLOCK, DEFAULT_MAX_PARAM_ROWS, blocks
from ..functions.regex import FLAG_YES, flag, java_pattern, matches
from ..session import ensure_checkpoint_dir

Keywords = Iterable[tuple[str, str]] | DataFrame


def keyword_table(spark: SparkSession, keywords: Keywords) -> DataFrame:
    """Distinct (name, pattern) rows of a list or a keyword table; rows
    without a name or a pattern are none."""
    if not isinstance(keywords, DataFrame):
        keywords = spark.createDataFrame(_listed(keywords), schemas.KEYWORDS)
    return keywords.select("name", "pattern").dropna().distinct()


def _listed(keywords: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """The distinct (name, pattern) pairs of a list, in order."""
    return sorted({(str(n), str(p)) for n, p in keywords if n is not None and p is not None})


def keyword_blocks(spark: SparkSession, keywords: Keywords, block: int) -> Iterator[list[Row]]:
    """The keywords, however many, in blocks. A list is on the driver already
    and needs no job; a table is read in its order."""
    if isinstance(keywords, DataFrame):
        yield from blocks(keyword_table(spark, keywords).orderBy("name", "pattern"), block)
        return
    rows = [Row(name=n, pattern=p) for n, p in _listed(keywords)]
    for k in range(0, len(rows), block):
        yield rows[k: k + block]


def campaign_sessions_among(camp: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distinct campaign sessions that occur among ``candidates.session_id``.

    Only sessions with a hit can link, so the campaign side is semi-joined
    with the candidate sessions before its distinct: when the hits are few
    AQE broadcasts them and the campaign scan is filtered map-side, so only
    matching session ids are shuffled; otherwise it is an ordinary shuffle
    join. Same result either way.
    """
    hit_sessions = candidates.select("session_id").where(F.col("session_id").isNotNull()).distinct()
    return (camp.select("session_id").join(hit_sessions, "session_id", "left_semi")
                .distinct().select(F.col("session_id").alias("session_campanha")))


def keyword_flag(df: DataFrame, pattern: str, flag_col: str, text_col: str = "text") -> DataFrame:
    """Every row plus a ``'sim'/'não'`` column for the pattern (null text → 'não')."""
    return df.withColumn(flag_col, flag(text_col, pattern))


def keyword_conversations(conv: DataFrame, camp: DataFrame, pattern: str, flag_col: str) -> DataFrame:
    """Conversations whose text matches, left-joined to the DISTINCT campaign
    sessions; ``session_campanha`` is NULL when no campaign explains the session.

    The match filter runs at the conversations scan, once: the hit rows carry
    their text, so reducing the campaign side by the hit sessions first would
    mean a second regex pass over every text. The campaign side is instead
    aggregated to distinct ids (map-side partial distinct), so the join cannot
    multiply rows and a hot session is one id.
    """
    hits = conv.where(matches("text", pattern)).withColumn(flag_col, F.lit(FLAG_YES))
    cam = camp.select(F.col("session_id").alias("session_campanha")).distinct()
    return hits.join(cam, hits["session_id"] == cam["session_campanha"], "left")


def keyword_logs(logs: DataFrame, pattern: str, flag_col: str, message_col: str = "message") -> DataFrame:
    """Log rows whose message matches, with the flag column."""
    return logs.where(matches(message_col, pattern)).withColumn(flag_col, F.lit(FLAG_YES))


#: Patterns from which on the shared prefilter by literals pays.
MANY_PATTERNS = 64


def keyword_hits(df: DataFrame, keywords: Keywords, text_col: str = "text",
                 keep_cols: list[str] | None = None, block: int = DEFAULT_BLOCK) -> DataFrame:
    """one output row per (row, matching keyword), in one scan of the texts.

    A short list is one test of all patterns at the scan (only rows that hold
    one go on) and a flag for each. Of a long one (``MANY_PATTERNS`` or more),
    each pattern with a required literal of three characters or more is tried only on
    the rows that hold it (:mod:`~sendscope.functions.literals`): the rows'
    grams meet the patterns' keys in a join with the table of keys. That table
    is as long as the list; beyond ``block`` of the patterns that have no such
    literal, these take another scan a block.
    """
    keep = keep_cols if keep_cols is not None else [c for c in df.columns if c != text_col]
    listed = [k for some in keyword_blocks(df.sparkSession, keywords, block) for k in some]
    keys = choose_keys([k.pattern for k in listed]) if len(listed) >= MANY_PATTERNS else [None] * len(listed)
    keyed = [(k.name, k.pattern, g) for k, g in zip(listed, keys) if g is not None]
    plain = [k for k, g in zip(listed, keys) if g is None]
    parts = [_flagged(df, plain[i: i + block], text_col, keep) for i in range(0, len(plain), block)]
    if keyed:
        parts.append(_prefiltered(df, keyed, text_col, keep))
    if not parts:
        return df.select(*keep, F.lit("").alias("keyword")).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts)


def _flagged(df: DataFrame, some: list[Row], text_col: str, keep: list[str]) -> DataFrame:
    tests = [matches(text_col, k.pattern) for k in some]
    names = F.array(*[F.when(t, F.lit(k.name)) for k, t in zip(some, tests)])
    # explode + not-null filter stays in whole-stage codegen (array_compact
    # is a lambda function evaluated outside it).
    return (df.where(reduce(Column.__or__, tests)).select(*keep, F.explode(names).alias("keyword"))
              .where(F.col("keyword").isNotNull()))


def _prefiltered(df: DataFrame, keyed: list[tuple[str, str, str]], text_col: str, keep: list[str]) -> DataFrame:
    table = df.sparkSession.createDataFrame([(n, java_pattern(p), g, further_literals(p, g)) for n, p, g in keyed],
                                            "_name string, _pattern string, _gram string, _needs array<string>")
    # patterns of one key travel together: a row meets a key at most once
    by_key = table.groupBy("_gram").agg(F.sort_array(F.collect_list(F.struct("_pattern", "_name", "_needs"))).alias("_some"))
    rows = df.select(*[F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"),
                     folded(F.col(text_col)).alias("_fold"))
    held = F.filter("_some", lambda k: F.forall(k["_needs"], lambda need: F.contains(F.col("_fold"), need)))
    met = (with_grams(rows, "_fold", sorted({len(g) for _, _, g in keyed}), "_gram")
           .join(F.broadcast(by_key) if len(keyed) <= DEFAULT_MAX_PARAM_ROWS else by_key, "_gram")
           .select("*", F.explode(held).alias("_one")).where("_text RLIKE _one._pattern"))
    return met.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], F.col("_one._name").alias("keyword"))


def keyword_linkage(conv: DataFrame, camp: DataFrame, keywords: Keywords) -> DataFrame:
    """Per keyword, hits in conversations split into linked / unlinked to a campaign.

    The "coupon hits, none linked to a campaign" finding as a table. Keywords
    without hits are reported with zeros.
    """
    keywords = keywords if isinstance(keywords, DataFrame) else _listed(keywords)  # read twice
    kws = keyword_table(conv.sparkSession, keywords)
    # Pre-aggregated per (keyword, session) — a hot session is one row per
    # keyword — and checkpointed (reliable, in spark.checkpoint.dir): both uses
    # below read this small table, so the regex runs once over the texts.
    ensure_checkpoint_dir(conv.sparkSession)
    per = (keyword_hits(conv, keywords, keep_cols=["session_id"])
           .groupBy("keyword", "session_id").agg(F.count(F.lit(1)).alias("_n"))
           .checkpoint(eager=True))
    cam = campaign_sessions_among(camp, per)
    linked = per.join(cam, per["session_id"] == cam["session_campanha"], "left")
    is_linked = F.col("session_campanha").isNotNull()
    agg = linked.groupBy("keyword").agg(
        F.sum("_n").alias("n_hits"),
        F.sum(F.when(is_linked, F.col("_n"))).alias("n_linked"),
        F.sum(F.when(~is_linked, F.col("_n"))).alias("n_unlinked"),
        F.count("session_id").alias("n_sessions"))
    names = kws.select(F.col("name").alias("keyword")).distinct()
    return (names.join(agg, "keyword", "left")
              .select("keyword", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                                   for c in ["n_hits", "n_linked", "n_unlinked", "n_sessions"]]))
