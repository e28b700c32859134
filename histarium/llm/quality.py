"""Quality rules with thresholds that adapt to language and source.

Each document gets a few whole-number measures. Their distribution in every
(language, source) group is kept as a mergeable quantile sketch: counts by
value, the value cut to its seven leading bits, so an estimated quantile is
less than 1/64 below the true one. Sketches are sums of counts: partial ones
merge in any order with the same result, and those of small groups merge into
their language's, then into that of all documents. A document is rejected when
a measure lies beyond its group's fence,

    median + FENCE * max(median - 10th percentile, least spread),

which looks only at the lower half: up to half of a group may be junk without
moving it. Built from DataFrame functions alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, saved

#: Limits of the base rules; fixed values of the data contract.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
#: Measures in thousandths, with the least spread counted for each.
LEAST_SPREAD = {"symbol_pm": 4, "shout_pm": 8, "upper_pm": 30, "dup_line_pm": 60, "repeat_pm": 20, "long_word_pm": 400}
FENCE = 10
#: A group with fewer documents takes the thresholds of its language, then those of all.
MIN_GROUP = 100
#: The table of thresholds is broadcast up to so many groups; beyond, Spark joins it by key.
BROADCAST_GROUPS = 100_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count_of(text: F.Column, chars: str) -> F.Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the struct ``_q`` with ``COUNTS`` and the counts that the measures need.

    Null and empty texts have zero everywhere. ``docs`` must have no column
    called ``_q``; all others are carried along.
    """
    if "_q" in (c.lower() for c in docs.columns):
        raise ValueError("the column _q is taken")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    spaced = F.translate(text, SPACES, " " * len(SPACES))
    own = {k: free_name(docs, f"_{k}") for k in ("words", "hashes", "windows", "twice", "sorted", "places", "lines")}
    w, h, g, twice, s, p, lines = own.values()
    df = docs.withColumn(w, F.filter(F.split(spaced, " "), lambda x: x != ""))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    n = F.size(h)
    at = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(g, F.transform(at, lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(WINDOW)])))
    # Windows are counted by sorting: only texts with a window that recurs look for its places.
    df = df.withColumn(twice, F.size(g) > F.size(F.array_distinct(g)))
    df = df.withColumn(s, F.when(F.col(twice), F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    pairs = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn(p, F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))))
    covered = F.aggregate(
        F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    df = df.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != ""))
    letters = F.length(text)
    counts = {
        "n_words": n,
        "word_chars": letters - _count_of(text, SPACES),
        "n_symbols": _count_of(text, SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(F.col(twice), covered).otherwise(0),
        "n_lines": F.size(lines),
        "n_shouts": _count_of(text, "!?"),
        "n_upper": letters - F.length(F.regexp_replace(text, r"\p{Lu}", "")),
    }
    return df.withColumn("_q", F.struct(*[c.cast("long").alias(k) for k, c in counts.items()])).drop(*own.values())


def measures() -> dict[str, F.Column]:
    """The measures, whole thousandths, of the struct ``_q``."""

    def share(part: str, whole: str) -> F.Column:
        return F.when(F.col(f"_q.{whole}") > 0, F.floor(F.col(f"_q.{part}") * 1000 / F.col(f"_q.{whole}"))).otherwise(0).cast("long")

    return {
        "symbol_pm": share("n_symbols", "word_chars"),
        "shout_pm": share("n_shouts", "word_chars"),
        "upper_pm": share("n_upper", "word_chars"),
        "dup_line_pm": share("n_dup_lines", "n_lines"),
        "repeat_pm": share("n_repeat_words", "n_words"),
        "long_word_pm": share("word_chars", "n_words"),
    }


def base_failed() -> F.Column:
    return (F.col("_q.n_words") < MIN_WORDS) | (F.col("_q.n_repeat_words") * 100 > F.col("_q.n_words") * MAX_REPEAT_PERCENT)


def leading_bits(value: F.Column, bits: int = 7) -> F.Column:
    """A whole number >= 0 with all but its leading bits set to 0."""
    unit = F.pow(F.lit(2), F.greatest(F.length(F.bin(value)) - bits, F.lit(0)))
    return (unit * F.floor(value / unit)).cast("long")


def sketches(counted: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """``lang, source, name, value, n``: the sketch of each measure in each group.

    A row of the input makes one row; those of a group with the same measures
    meet before the shuffle.
    """
    names = list(LEAST_SPREAD)
    m = measures()
    cut = counted.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), *[leading_bits(m[k]).alias(k) for k in names])
    by = cut.groupBy("lang", "source", *names).agg(F.count("*").alias("n"))
    each = by.select("lang", "source", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in names])).alias("m"))
    return each.groupBy("lang", "source", "m.name", "m.value").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, fence: int = FENCE, min_group: int = MIN_GROUP) -> DataFrame:
    """``lang, source, limits``: the fence of each measure, by the group's sketch
    or, in a group of under ``min_group`` documents, by the merged one above it."""

    def quantiles(df: DataFrame, by: list[str], level: int) -> DataFrame:
        # Values of one sketch: at most 64 to an octave, whatever the number of documents.
        merged = df.groupBy(*by, "name", "value").agg(F.sum("n").alias("n"))
        held = merged.groupBy(*by, "name").agg(F.sum("n").alias("all"), F.sort_array(F.collect_list(F.struct("value", "n"))).alias("bins"))

        def at(q: float) -> F.Column:
            start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("found"))
            step = lambda a, b: F.struct((a["sum"] + b["n"]).alias("sum"), F.coalesce(a["found"], F.when(a["sum"] + b["n"] >= F.col("all") * q, b["value"])).alias("found"))
            return F.aggregate("bins", start, step)["found"]

        spread = F.greatest(at(0.5) - at(0.1), reduce(lambda c, k: F.when(F.col("name") == k, LEAST_SPREAD[k]).otherwise(c), LEAST_SPREAD, F.lit(0)).cast("long"))
        limit = held.select(*by, "name", "all", (at(0.5) + fence * spread).alias("limit"))
        return limit.groupBy(*by).agg(F.max("all").alias(f"n{level}"), F.map_from_entries(F.collect_list(F.struct("name", "limit"))).alias(f"limits{level}"))

    own, lang, every = quantiles(sketch, ["lang", "source"], 0), quantiles(sketch, ["lang"], 1), quantiles(sketch, [], 2)
    lang = lang.withColumnRenamed("lang", "lang_")
    both = own.join(F.broadcast(lang), F.col("lang").eqNullSafe(F.col("lang_")), "left").crossJoin(F.broadcast(every))
    limits = F.when(F.col("n0") >= min_group, F.col("limits0")).when(F.col("n1") >= min_group, F.col("limits1")).otherwise(F.col("limits2"))
    return both.select("lang", "source", limits.alias("limits"))


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", counted: DataFrame | None = None) -> DataFrame:
    """Adds the structs ``_q`` (counts) and ``_v`` (``base_failed, kept, reason``).

    ``counted``: the same rows with ``_q``, if they have been computed already.
    ``reason`` is ``base``, the first measure beyond its fence, or null. Null
    languages and sources are groups of their own; equal rows count each; an
    empty table stays empty; other columns are carried along, and must not be
    called ``_q`` or ``_v``.
    """
    counted = with_counts(docs, text_col) if counted is None else counted
    if "_v" in (c.lower() for c in counted.columns):
        raise ValueError("the column _v is taken")
    limits, lang, source = (free_name(counted, c) for c in ("_limits", "_lang", "_source"))
    fenced = saved(fences(sketches(counted, lang_col, source_col)).toDF(lang, source, limits))
    if fenced.count() <= BROADCAST_GROUPS:
        fenced = F.broadcast(fenced)
    held = counted.join(fenced, F.col(f"`{lang_col}`").eqNullSafe(F.col(lang)) & F.col(f"`{source_col}`").eqNullSafe(F.col(source)), "left")
    m = measures()
    beyond = F.coalesce(*[F.when(m[k] > F.element_at(limits, k), k) for k in LEAST_SPREAD])
    reason = F.when(base_failed(), "base").otherwise(beyond)
    verdict = F.struct(base_failed().alias("base_failed"), reason.isNull().alias("kept"), reason.alias("reason"))
    return held.withColumn("_v", verdict).drop(limits, lang, source)


def quality_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``id_col``, ``COUNTS``, ``base_failed, kept, reason``: a row for each document."""
    narrow = with_counts(docs.select(*dict.fromkeys([id_col, text_col, lang_col, source_col])), text_col).select(*dict.fromkeys([id_col, lang_col, source_col]), "_q")
    out = judged(docs, text_col, lang_col, source_col, saved(narrow))
    return out.select(id_col, *[F.col(f"_q.{c}").alias(c) for c in COUNTS], "_v.base_failed", "_v.kept", "_v.reason")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that pass, columns as they were, whatever they are called.

    The documents are saved once with their counts: counting takes ten times
    as long as writing and reading them.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"))
    counted = saved(with_counts(packed).drop("text"))
    return judged(packed, "text", "lang", "source", counted).filter("_v.kept").select("row.*")
