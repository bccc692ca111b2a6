"""Licence scans by canonical digests, in DataFrame expressions only.

A text is made canonical (case, copyright lines, punctuation, white space and equivalent spellings) and its
SHA-256 is looked up among the digests of known texts by a hash join. The unit is an entire text: the whole
document, and each of its lines, which finds one-line notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import texts
from .licence_texts import KNOWN
from .rewriting import literal, rewritten, rewritten_sql

# Spellings that count as equal. Endings are rewritten in every word, which is right for a digest
# because known texts go through the same steps.
SPELLINGS = [
    ("licence", "license"), ("programme", "program"), ("offence", "offense"), ("defence", "defense"), ("dgement", "dgment"),
    ("fulfill", "fulfil"), ("practise", "practice"), ("artefact", "artifact"), ("whilst ", "while "), ("our ", "or "),
    ("tre ", "ter "), ("ogue ", "og "), ("isation ", "ization "), ("ise ", "ize "), ("ised ", "ized "), ("ising ", "izing "),
    ("lled ", "led "), ("lling ", "ling "), (" per cent ", " percent "), (" non ", " non"), (" sub license", " sublicense"),
    (" copyright owner", " copyright holder"), (" http ", " https "), (" and or ", " or "),
]
STEPS = [
    ("lower",),
    ("replace", "\r\n", "\n"),
    ("replace", "\r", "\n"),
    ("wrap", "\n", ""),
    # A line that names a holder or a year, and the usual line behind it; wording about copyright stays.
    ("regex", r"\n[ \t#*/;-]*(?:copyright(?:[ \t]+notice)?[ \t:]*(?:\(c\)|©|[0-9]|\[|<|by[ \t])|\(c\)[ \t]|©)[^\n]*", "\n"),
    ("regex", r"\n[ \t#*/;-]*all rights reserved[ \t.!]*(?:\n|\z)", "\n"),
    ("regex", r"[^\p{L}\p{N}]+", " "),
    ("trim",),
    ("wrap", " ", " "),
    *[("replace", a, b) for a, b in SPELLINGS],
    ("trim",),
]


def canonical(text: Column) -> Column:
    return rewritten(text, STEPS)


def digest(text: Column) -> Column:
    # Never null where the text is not, which is said here: a join on it would else test it for null, and compute it a second time.
    return F.coalesce(F.sha2(canonical(text).cast("binary"), 256), F.lit(""))


def known_digests(known: DataFrame) -> DataFrame:
    """(licence, digest), one row per digest, of (licence, text); the alphabetically first licence names a text."""
    return known.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, licence, notices, n_notice_lines) for every row of ``docs``.

    ``licence`` is that of the whole text or null; ``notices`` are the licences of single lines, sorted
    and joined by commas (null: none). A null text counts as empty and, like every text without letters and
    digits, is no licence. Rows that repeat
    both doc_id and text count their lines together. An empty
    table gives an empty one; columns other than doc_id and text are not looked at.
    """
    digests = known_digests(known)
    rows = texts(docs)
    # The raw text's hash tells rows of one doc_id apart; making the text canonical for that would cost as much again.
    lines = rows.select("doc_id", F.xxhash64("text").alias("own"), F.explode(F.split("text", "\r\n?|\n")).alias("line"))
    hits = lines.filter(F.length("line") > 0).select("doc_id", "own", digest(F.col("line")).alias("digest")).join(digests, "digest")
    distinct = hits.groupBy("doc_id", "own", "licence").agg(F.count(F.lit(1)).alias("n"))
    notices = distinct.groupBy("doc_id", "own").agg(
        F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("notices"), F.sum("n").alias("n_notice_lines")
    )
    whole = rows.select("doc_id", F.xxhash64("text").alias("own"), digest(F.col("text")).alias("text_sha256")).join(digests.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left")
    n = notices.withColumnsRenamed({"doc_id": "notice_id", "own": "notice_own"})
    found = whole.join(n, F.col("doc_id").eqNullSafe(F.col("notice_id")) & (F.col("own") == F.col("notice_own")), "left")
    return found.select("doc_id", "text_sha256", "licence", "notices", F.coalesce("n_notice_lines", F.lit(0)).alias("n_notice_lines"))


def scan_known(docs: DataFrame) -> DataFrame:
    """``scan`` with the texts that come along."""
    return scan(docs, docs.sparkSession.createDataFrame(KNOWN, "licence string, text string"))


def scan_sql() -> str:
    known = ", ".join(f"({literal(a)}, {literal(b)})" for a, b in KNOWN)
    made = lambda x: f"sha256({rewritten_sql(x, STEPS)})"
    return f"""
        WITH known AS (SELECT {made('t')} AS digest, min(l) AS licence FROM (VALUES {known}) AS v(l, t) GROUP BY 1),
        d AS (SELECT doc_id, coalesce(text, '') AS text, {made("coalesce(text, '')")} AS text_sha256 FROM documents),
        lines AS (SELECT doc_id, text, unnest(regexp_split_to_array(text, '\r\n?|\n')) AS line FROM d),
        n AS (
            SELECT doc_id, text, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n_notice_lines
            FROM (SELECT doc_id, text, {made('line')} AS digest FROM lines WHERE line <> '') JOIN known USING (digest) GROUP BY 1, 2
        )
        SELECT doc_id, text_sha256, licence, notices, coalesce(n_notice_lines, 0) AS n_notice_lines
        FROM d LEFT JOIN known ON d.text_sha256 = known.digest LEFT JOIN n USING (doc_id, text)"""
