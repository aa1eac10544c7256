"""Line dedup: a line that several documents share stays in the first of them.

Lines become hashes of their keys. Hashes are dealt out by range and sorted inside a range by
document and position, so a window sees every first occurrence before its repeats. What comes
out is no text: per document the number of lines and a run-length bitmap of those dropped.

A hash of very many documents would be one long group, so heavy hashes are told apart first
from a sample of documents, which steers the way taken and never the result: for those the
first document is a minimum with partial aggregates, joined back to their lines.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import Scratch, fresh, let

BLANKS = " \t\n\x0b\f\r"
MIN_CHARS = 10
# one document in SAMPLE tells heavy hashes; a hash in HEAVY of them or more is heavy
SAMPLE, HEAVY = 16, 256


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _lines(docs: DataFrame, doc: str, text: str, min_chars: int) -> DataFrame:
    """(doc, row, key, pos) of every line whose key is long enough."""
    whole = F.coalesce(F.col(text), F.lit(""))
    keys = F.transform(F.split(whole, "\n", -1), lambda line, i: F.struct(i.alias("pos"), line_key(line).alias("line")))
    long_enough = F.filter(keys, lambda k: F.char_length(k["line"]) >= min_chars)
    # the digest of the text stands below the generator, so it is taken once per document
    per_doc = docs.select(F.col(doc).alias("doc"), _digest(whole).alias("row"), long_enough.alias("lines"))
    exploded = per_doc.select("doc", "row", F.explode("lines").alias("k"))
    return exploded.select("doc", "row", _digest(F.col("k.line")).alias("key"), F.col("k.pos").alias("pos"))


def _after(first: Column) -> Column:
    return first.isNotNull() & (F.col("doc").isNull() | (F.col("doc") > first))


def _repeats(lines: DataFrame, scratch: Scratch, sample: int, heavy: int) -> DataFrame:
    """(doc, row, pos) of lines whose key stands in an earlier document."""
    seen = lines.filter(F.pmod(F.xxhash64("doc", "row"), F.lit(sample)) == 0)
    often = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= heavy).select("key")
    often = scratch.keep(often, "heavy")
    firsts = scratch.keep(lines.join(often, "key", "left_semi").groupBy("key").agg(F.min("doc").alias("first")), "firsts")
    heavy_ones = lines.join(firsts, "key").filter(_after(F.col("first")))
    order = Window.partitionBy("key").orderBy(F.asc_nulls_last("doc"), "pos")
    streamed = lines.join(often, "key", "left_anti").repartitionByRange("key").withColumn(
        "first", F.first("doc").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return heavy_ones.select("doc", "row", "pos").unionByName(
        streamed.filter(_after(F.col("first"))).select("doc", "row", "pos"))


def _runs(positions: Column) -> Column:
    """Ascending positions as (first, last) of their maximal runs."""
    def edges(p: Column) -> Column:
        first = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
        last = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last")))

    return let(positions, edges)


def keep_bitmaps(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                 sample: int = SAMPLE, heavy: int = HEAVY) -> DataFrame:
    """(doc, row, n_dropped, dropped) of every document that loses lines.

    ``dropped`` is the keep bitmap's zeros as ascending (first, last) runs of line numbers from
    0; ``row`` is the digest of the text, which tells rows of one id apart. Lines are what
    stands between newlines; a null or empty text is one empty line. Keys of fewer than
    ``min_chars`` code points are never dropped.

    Rows that share an id are one document to the rule: a key found only in them is kept in
    all of them. A null id counts as one document after all others. Equal rows share one
    bitmap. No documents, no rows; other columns do not matter.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.keep(_lines(docs, doc, text, min_chars), "lines")
    gone = _repeats(lines, scratch, sample, heavy)
    per_doc = gone.groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("positions"))
    return per_doc.select("doc", "row", F.size("positions").cast("long").alias("n_dropped"),
                          _runs(F.col("positions")).alias("dropped"))


def _kept(lines: Column, runs: Column) -> Column:
    """Lines outside ascending runs, by slices between the runs."""
    def joined(part: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["last"] + 1))
        ends = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(part)))
        spans = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: s["a"] < s["b"])
        return F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(part, s["a"] + 1, s["b"] - s["a"]))), "\n")

    return let(lines, joined)


def drop_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                 sample: int = SAMPLE, heavy: int = HEAVY) -> tuple[DataFrame, str, str]:
    """``docs`` with the text of its kept lines, and the names of two added columns: lines
    before dropping and lines dropped. Rows, order of lines and other columns stay as they are."""
    n_lines, n_dropped, row, runs = fresh(docs, "n_lines", "n_dropped", "row", "runs")
    bitmaps = keep_bitmaps(docs, doc, text, min_chars, sample, heavy)
    whole = F.coalesce(F.col(text), F.lit(""))
    left = docs.withColumn(row, _digest(whole))
    right = bitmaps.select(F.col("doc").alias("_bitmap_doc"), F.col("row").alias("_bitmap_row"),
                           F.col("n_dropped").alias(n_dropped), F.col("dropped").alias(runs))
    both = left.join(right, left[doc].eqNullSafe(right["_bitmap_doc"]) & (left[row] == right["_bitmap_row"]), "left")
    kept = F.when(F.col(runs).isNull(), F.col(text)).otherwise(_kept(F.split(whole, "\n", -1), F.col(runs)))
    newlines = F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit("")))
    out = [kept.alias(c) if c == text else F.col(c) for c in docs.columns]
    return both.select(*out, (newlines + 1).cast("long").alias(n_lines),
                       F.coalesce(F.col(n_dropped), F.lit(0).cast("long")).alias(n_dropped)), n_lines, n_dropped


def report(docs: DataFrame) -> DataFrame:
    """One row per document: lines, dropped lines, digest of what is kept."""
    out, n_lines, n_dropped = drop_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"),
                      F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))
