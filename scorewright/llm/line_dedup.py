"""Operator 8 [native]: repeated runs of lines by winnowing.

Lines are hashed; every window of ``w = min_run - k + 1`` neighbouring k-line
pieces puts forward its smallest piece, so each run of ``min_run`` lines contains
a fingerprint and equal runs contain the same one.  Positions are joined on the
fingerprint; only shared fingerprints go on.  From each the match is extended
over the lines on both sides: every run of ``min_run`` lines that owes its minimum
to this fingerprint is compared (by a 128-bit hash of its lines) with the first
place, in order of doc_id and line, that holds the same lines.  A later place is
a repeat; overlapping repeats join to longer runs, and their lines go.

Only DataFrame functions are used.  Null text is one empty line, like empty text;
texts with fewer than ``min_run`` lines lose none; rows repeated under one id with
equal text keep the same lines; a null id sorts last; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import attach, keyed, public_id, stage


def _pieces(lines: Column, k: int, w: int) -> Column:
    """Distinct (hash, position) minima of all windows of w pieces of k line hashes."""
    n = F.size(lines)
    piece = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(
        F.xxhash64(F.slice(lines, i + 1, F.lit(k))).alias("fp"), i.alias("at")))
    minima = F.transform(F.sequence(F.lit(0), n - (k + w - 1)),
                         lambda i: F.array_min(F.slice(piece, i + 1, F.lit(w))))
    return F.when(n >= k + w - 1, F.array_distinct(minima))


def repeated_runs(rows: DataFrame, min_run: int, k: int) -> DataFrame:
    """(doc_id, key, starts): first lines of the later places of repeated ``min_run``-line windows.

    ``rows``: doc_id, key, h (line hashes), h2 (the same with another function)."""
    w = min_run - k + 1
    low = F.greatest(F.col("p.at") - (w - 1), F.lit(0))
    around = F.slice("h", low + 1, F.least(F.col("p.at") + k + w - 1, F.size("h")) - low)
    around2 = F.slice("h2", low + 1, F.least(F.col("p.at") + k + w - 1, F.size("h")) - low)
    prints = (rows.select("doc_id", "key", "h", "h2", F.explode(_pieces(F.col("h"), k, w)).alias("p"))
              .select("doc_id", "key", F.col("p.fp").alias("fp"), F.col("p.at").cast("int").alias("at"),
                      low.cast("int").alias("low"), around.alias("lines"), around2.alias("lines2")))
    prints, _ = stage(prints, "line-fingerprints")
    total = prints.count()
    shared = prints.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1")
    joined = attach(prints, shared, "fp", "n", total).filter("n is not null")
    # the windows around a fingerprint: from w - 1 pieces before it to its own start
    start = F.explode(F.sequence(F.lit(0), F.size("lines") - min_run))
    windows = joined.filter(F.size("lines") >= min_run).select("doc_id", "key", "low", start.alias("o"), "lines", "lines2")
    windows = windows.select("doc_id", "key", (F.col("low") + F.col("o")).alias("start"), F.struct(
        F.xxhash64(F.slice("lines", F.col("o") + 1, F.lit(min_run))).alias("a"),
        F.xxhash64(F.slice("lines2", F.col("o") + 1, F.lit(min_run))).alias("b")).alias("run")).distinct()
    windows, _ = stage(windows, "line-windows")
    first = windows.groupBy("run").agg(F.count("*").alias("n"),
                                       F.min(F.struct("doc_id", "start")).alias("first")).filter("n > 1")
    later = attach(windows, first, "run", "n", total * w).filter(F.struct("doc_id", "start") > F.col("first"))
    return later.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("start")).alias("starts"))


def repeated_lines(docs: DataFrame, min_run: int = 3, k: int = 2, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per document: its lines, how many go, and the kept text."""
    rows = keyed(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    lines = F.split("text", "\n", -1)
    hashed = rows.select("doc_id", "key", F.transform(lines, lambda x: F.xxhash64(x)).alias("h"),
                         F.transform(lines, lambda x: F.xxhash64(F.reverse(x), F.lit(1))).alias("h2"))
    starts, _ = stage(repeated_runs(hashed, min_run, k), "line-repeats")
    # one plan at every size: the repeats grow with the input, so they are never broadcast
    found = rows.join(starts.hint("merge"), ["doc_id", "key"], "left").select("doc_id", lines.alias("lines"), "starts")
    s, n = F.col("starts"), F.size("lines")
    # kept: the lines between the end of one repeat and the start of the next
    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size(s)), lambda j: F.slice(
        "lines", F.when(j == 0, F.lit(1)).otherwise(F.get(s, j - 1) + min_run + 1),
        F.greatest(F.lit(0), F.when(j == F.size(s), n).otherwise(F.get(s, j))
                   - F.when(j == 0, F.lit(0)).otherwise(F.get(s, j - 1) + min_run)))))
    kept = F.when(s.isNull(), F.col("lines")).otherwise(left)
    out = found.select("doc_id", n.cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select(public_id(), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed"),
                      F.array_join("kept", "\n").alias("kept"))
