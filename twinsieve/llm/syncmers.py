"""Document fingerprints by closed syncmers, in DataFrame expressions only.

A text is a sequence of symbols: runs of up to eight letters or digits in lower case, and every other character
that is not white space. A k-mer of symbols is an anchor if the smallest hash among its s-mers is the first
or the last one. That depends on the k-mer alone, so an edit changes only the anchors that it touches,
and equal passages have equal anchors wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import texts

K = 5  # symbols in a k-mer
S = 2  # symbols in an s-mer
SYMBOL = r"[\p{L}\p{N}]{1,8}|[^\s\p{L}\p{N}]"
# Rows of neighbouring ids that one window holds, about; a table has at most this many windows.
WINDOW_ROWS, WINDOWS = 512, 1 << 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and wherever ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def anchors(text: Column) -> Column:
    """Array of (position, anchor) structs; the anchor is 32 bits of the k-mer's hash.

    A text without any chosen k-mer, short ones above all, has one anchor over all its symbols. A text
    without symbols has none.
    """
    inner = K - S  # place of the last s-mer in a k-mer

    def chosen(small: Column) -> Column:
        def is_closed(i: Column) -> Column:
            middle = F.least(*[small[i + j] for j in range(1, inner)])
            return F.least(small[i], small[i + inner]) <= middle

        def anchor(i: Column) -> Column:
            # s-mers that together cover the k-mer
            covering = [small[i + j] for j in sorted({*range(0, inner, S), inner})]
            return F.struct(i.alias("position"), F.xxhash64(*covering).bitwiseAND(0xFFFFFFFF).alias("anchor"))

        starts = F.sequence(F.lit(0), F.size(small) - (inner + 1))
        return F.transform(F.filter(starts, is_closed), anchor)

    def small_of(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(*[h[i + j] for j in range(S)]))

    def found(h: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(h).bitwiseAND(0xFFFFFFFF).alias("anchor")))
        none = F.slice(whole, 1, 0)
        some = F.when(F.size(h) >= K, let(small_of(h), chosen)).otherwise(none)
        return F.when(F.size(h) == 0, none).otherwise(let(some, lambda a: F.when(F.size(a) > 0, a).otherwise(whole)))

    symbols = F.regexp_extract_all(F.lower(text), F.lit(SYMBOL), 0)
    return let(F.transform(symbols, lambda s: F.xxhash64(s)), found)


def distinct_anchors(text: Column) -> Column:
    """The different anchors in order of their first place."""
    return F.array_distinct(F.transform(anchors(text), lambda a: a["anchor"]))


def spelt(found: Column) -> Column:
    """Anchors as one string, eight hexadecimal digits each."""
    return F.array_join(F.transform(found, lambda a: F.lpad(F.lower(F.hex(a)), 8, "0")), "")


def likeness(one: Column, other: Column) -> Column:
    """Shared anchors by all anchors of the two; 1 if neither has any."""
    shared = F.size(F.array_intersect(one, other))
    either = F.size(one) + F.size(other) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, anchors): every document's anchors with their positions.

    A null text counts as empty and has none; repeated rows and null doc_ids give a row each; an empty table
    gives an empty one; columns other than doc_id and text are not looked at.
    """
    return texts(docs).select("doc_id", anchors(F.col("text")).alias("anchors"))


def with_next(rows: DataFrame) -> DataFrame:
    """Each row of (doc_id, text) with the next row by descending doc_id, the first one behind the last.

    Adds next_text and next_found; needs ``found``, computed here where the text lies after its only shuffle.
    Null ids come last, equal ids by text. Ids are cut into even ranges; a range's top row also goes to
    the range above it, whose last row it follows.
    """
    spark = rows.sparkSession
    total, ids = rows.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    ranges = max(1, min(WINDOWS, -(-total // WINDOW_ROWS)))
    cuts: list[int] = []
    if ids and ranges > 1:
        at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
        cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", at, F.lit(10 * ranges))).first()[0]))
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    if cuts:
        edges = F.array(*[F.lit(c).cast("bigint") for c in cuts])
        # Bisection: how many cuts lie below the id.
        below = let(edges, lambda e: F.aggregate(
            F.array(*[F.lit(s) for s in steps]), F.lit(0),
            lambda low, s: F.when((low + s <= len(cuts)) & (e[F.least(low + s, F.lit(len(cuts))) - 1] < F.col("doc_id")), low + s).otherwise(low),
        ))
    else:
        below = F.lit(0)
    placed = rows.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(below))
    # One row per range, WINDOWS at most.
    tops = placed.groupBy("range").agg(F.max("doc_id").alias("top_id")).collect()
    order = sorted(tops, key=lambda r: r["range"])
    goes = [(top["range"], top["top_id"], order[(i + 1) % len(order)]["range"]) for i, top in enumerate(order)]
    targets = spark.createDataFrame(goes, "top_range int, top_id bigint, target int")
    copies = placed.join(F.broadcast(targets), (F.col("range") == F.col("top_range")) & F.col("doc_id").eqNullSafe(F.col("top_id")))
    both = placed.withColumn("is_copy", F.lit(False)).unionByName(
        copies.select("doc_id", "text", F.col("target").alias("range"), F.lit(True).alias("is_copy"))
    )
    here = both.repartition("range").withColumn("found", distinct_anchors(F.col("text")))
    window = Window.partitionBy("range").orderBy("is_copy", F.desc_nulls_last("doc_id"), "text")
    led = here.select("*", F.lead("text").over(window).alias("next_text"), F.lead("found").over(window).alias("next_found"))
    return led.filter(~F.col("is_copy")).drop("range", "is_copy")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document, with their likenesses.

    The edited text has the last third of the code points replaced by the first as many (or all) of the
    next document. A null text counts as empty; equal texts have equal fingerprints; a single document follows
    itself. Rows as in ``fingerprints``.
    """
    led = with_next(texts(docs)).withColumn("n_chars", F.char_length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    with_edit = led.withColumn("edited", edited).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "found", "next_found",
        distinct_anchors(F.col("edited")).alias("edited_found"),
    )
    return with_edit.select(
        "doc_id", "n_chars", "edited_sha256", spelt(F.col("found")).alias("fingerprint"), spelt(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edited_found")).alias("near_edited"), likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )
