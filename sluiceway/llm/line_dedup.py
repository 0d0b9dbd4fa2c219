"""Line dedup in DataFrame operations only: explode normalised lines, hash, count distinct documents by hash, drop the
lines over the threshold and put the rest together again by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, materialize, small

#: Broadcast the list of frequent lines up to this many rows (a digest and a long: about 50 MB), else shuffle.
BROADCAST_ROWS = 500_000


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row of docs (doc_id, text; other columns are ignored).

    A text is split at newlines; null or empty is one empty line.  A line's key is the line without ASCII white space
    at its ends, A-Z lower-cased.  A key of at least min_chars code points found in at least min_docs different
    documents loses its lines in all documents but the one with the largest doc_id among those that hold it.  Rows that
    repeat a doc_id are one document for the count; a null doc_id counts as no document and never is the largest.
    Only digests and positions are shuffled for the count; the texts move once, to meet their dropped positions.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = ["doc_id", "print", "size"]
    lines = d.select(
        "doc_id",
        F.xxhash64("text").alias("print"),
        F.char_length("text").alias("size"),
        F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("pos", "line"),
    )
    lines = lines.withColumn("line", F.btrim("line", F.lit(SPACES))).filter(F.char_length("line") >= min_chars)
    lines = lines.select(*key, "pos", F.unhex(F.sha2("line", 256)).alias("digest"))
    frequent = materialize(
        lines.groupBy("digest").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("holder")).filter(F.col("n") >= min_docs).select("digest", "holder"),
        "frequent-lines",
    )
    dropped = (
        lines.join(small(frequent, BROADCAST_ROWS), "digest")
        .filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
        .groupBy(*key)
        .agg(F.collect_set("pos").alias("dropped"))
        .select(F.col("doc_id").alias("d_id"), F.col("print").alias("d_print"), F.col("size").alias("d_size"), "dropped")
    )
    full = d.withColumns({"print": F.xxhash64("text"), "size": F.char_length("text")})
    met = full.join(
        dropped.hint("shuffle_hash"),
        F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("print") == F.col("d_print")) & (F.col("size") == F.col("d_size")),
        "left",
    ).select("doc_id", F.col("text"), F.split("text", "\n").alias("lines"), "dropped")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    return met.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")).alias("kept_text"),
    )
