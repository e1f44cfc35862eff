"""Payload triage of infrastructure logs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import with_grams
from ..functions.params import DEFAULT_BLOCK, is_bounded
from ..functions.payload import error_payload, is_deserialization_error, looks_like_json
from ..session import ensure_checkpoint_dir


def non_json_payloads(logs: DataFrame, message_col: str = "message", method: str = "prefix") -> DataFrame:
    """messages a JSON consumer would reject.

    ``prefix`` (the deserialiser's rule): the text does not start with ``{``
    or ``[``. ``parser``: the text does not parse as JSON at all
    (``try_parse_json``) — it accepts JSON scalars such as ``12``, which the
    prefix rule rejects.
    """
    if method == "parser":
        bad = F.try_parse_json(F.col(message_col)).isNull() & F.col(message_col).isNotNull()
    else:
        bad = ~looks_like_json(message_col)
    return logs.where(bad).select("timestamp", "insertId", message_col)


def payload_schema_violations(logs: DataFrame, required: dict[str, str],
                              message_col: str = "message") -> DataFrame:
    """messages that lack a required field (or are not JSON at all).

    ``from_json`` in PERMISSIVE mode turns unparseable text into a struct of
    nulls, so one null test per field covers both cases. ``missing_fields``
    lists the absent fields in the declared order.
    """
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in required.items()])
    parsed = F.from_json(F.col(message_col), schema)
    missing = F.concat_ws(",", *[F.when(parsed.getField(n).isNull(), F.lit(n)) for n in required])
    return (logs.select("timestamp", "insertId", message_col, missing.alias("missing_fields"))
                .where(F.col("missing_fields") != ""))


def error_payloads(logs: DataFrame, message_col: str = "message") -> DataFrame:
    """R9+C9: deserialisation errors grouped by the offending payload."""
    err = logs.where(is_deserialization_error(message_col))
    return (err.groupBy(error_payload(message_col).alias("payload"))
               .agg(F.count(F.lit(1)).alias("n_errors"),
                    F.min("timestamp").alias("first_seen"),
                    F.max("timestamp").alias("last_seen")))


def cta_table(spark: SparkSession, ctas: Iterable[str] | DataFrame) -> DataFrame:
    """Distinct CTAs of a list or a table with a column ``cta``. Null and empty CTAs are none."""
    if not isinstance(ctas, DataFrame):
        ctas = spark.createDataFrame([(c,) for c in ctas], "cta string")
    return ctas.select("cta").where(F.col("cta") != "").distinct()


def cta_contained(df: DataFrame, text: str, ctas: DataFrame, *keep: Column | str,
                  block: int = DEFAULT_BLOCK) -> DataFrame:
    """The columns ``keep`` and ``cta`` for every (row, CTA contained in its
    text), case-sensitive, in one scan of the texts: literal ``contains`` tests
    for up to ``block`` CTAs, a join by each CTA's rarest gram
    (:func:`contains_join`) for more."""
    some = ctas.orderBy("cta").limit(block + 1).collect()
    if not some:
        return df.select(*keep, F.lit("").alias("cta")).where(F.lit(False))
    if len(some) <= block:
        hit = F.array(*[F.when(F.col(text).contains(F.lit(r.cta)), F.lit(r.cta)) for r in some])
        return df.select(*keep, F.explode(hit).alias("cta")).where(F.col("cta").isNotNull())
    kept = df.select(F.col(text).alias("_searched"), F.struct(*keep).alias("_row"))
    return contains_join(kept, ctas, "_searched", "cta").select("_row.*", "cta")


#: Characters of a pattern's key, at most, and the share of texts (one in ...)
#: whose grams are counted to choose the keys.
KEY_CHARS, COUNTED = 6, 16


def pattern_keys(texts: DataFrame, patterns: DataFrame, text_col: str, pattern_col: str) -> DataFrame:
    """``_pat`` and ``_gram``: each distinct pattern with the gram of its own
    that is the rarest in the texts, so that a gram in every text keys nothing.

    Frequencies come from a hashed share of the texts, joined with the
    patterns' grams only; they decide how fast the patterns are found, not
    which. Ties: the gram that fewer patterns hold, then the first in order.
    """
    pats = patterns.select(F.col(pattern_col).alias("_pat")).where(F.col("_pat") != "").distinct()
    sizes = _key_sizes(pats)
    held = with_grams(pats, "_pat", sizes, "_gram").where(
        F.length("_gram") == F.least(F.length("_pat"), F.lit(KEY_CHARS)))
    shared = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_shared"))
    counted = with_grams(texts.select(F.col(text_col).alias("_text")).where(F.pmod(F.xxhash64("_text"), F.lit(COUNTED)) == 0),
                         "_text", sizes, "_gram")
    seen = counted.join(shared, "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_seen"))
    ranked = held.join(shared.join(seen, "_gram", "left"), "_gram")
    return (ranked.groupBy("_pat").agg(F.min_by("_gram", F.struct(F.coalesce("_seen", F.lit(0)), "_shared", "_gram")).alias("_gram")))


def _key_sizes(pats: DataFrame) -> list[int]:
    sizes = pats.select(F.least(F.length("_pat"), F.lit(KEY_CHARS)).alias("n")).distinct().collect()  # at most KEY_CHARS numbers
    return sorted(r.n for r in sizes)


def contains_join(texts: DataFrame, patterns: DataFrame, text_col: str, pattern_col: str) -> DataFrame:
    """Exact ``contains(text, pattern)`` pairs for a pattern table of any size.

    Every pattern has one key, its rarest gram (:func:`pattern_keys`). A text's
    distinct grams meet the keys in an equi-join and each pair that meets is
    verified, so a (text row, pattern) pair comes up once, without row ids or a
    distinct. Null and empty patterns are none. Output: the text rows plus
    ``pattern_col``.
    """
    pats = patterns.select(F.col(pattern_col).alias("_pat")).where(F.col("_pat") != "")
    sizes = _key_sizes(pats)
    if not sizes:
        return texts.withColumn(pattern_col, F.lit(None).cast("string")).where(F.lit(False))
    ensure_checkpoint_dir(texts.sparkSession)
    keys = pattern_keys(texts, patterns, text_col, pattern_col).checkpoint(eager=True)
    rows = texts.select(F.struct(*[F.col(f"`{c}`") for c in texts.columns]).alias("_all"), F.col(text_col).alias("_text"))
    # texts only meet patterns through the keys; those are as many as the patterns
    met = with_grams(rows, "_text", sizes, "_gram").join(
        F.broadcast(keys) if is_bounded(keys, KEYS_BROADCAST) else keys, "_gram")
    return met.where(F.contains("_text", "_pat")).select("_all.*", F.col("_pat").alias(pattern_col))


#: Patterns whose keys are broadcast; more of them are joined by an exchange.
KEYS_BROADCAST = 200_000


def cta_log_evidence(ctas: Iterable[str] | DataFrame, logs: DataFrame,
                     message_col: str = "message", block: int = DEFAULT_BLOCK) -> DataFrame:
    """Per CTA, log lines containing it (exact, case-sensitive substring),
    how many of them are deserialisation errors, and when it was first seen.

    One scan of the logs, whatever the number of CTAs (:func:`cta_contained`).
    CTAs without evidence get zeros.
    """
    table = cta_table(logs.sparkSession, ctas)
    hits = cta_contained(logs, message_col, table, "timestamp",
                         is_deserialization_error(message_col).alias("_err"), block=block)
    agg = hits.groupBy("cta").agg(F.count(F.lit(1)).alias("n_log_hits"),
                                 F.count_if("_err").alias("n_error_hits"),
                                 F.min("timestamp").alias("first_seen"))
    return (table.join(agg, "cta", "left")
                 .select("cta", F.coalesce("n_log_hits", F.lit(0)).alias("n_log_hits"),
                         F.coalesce("n_error_hits", F.lit(0)).alias("n_error_hits"), "first_seen"))
