"""Document fingerprints in DataFrame operations only: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a text's shingles, ascending.  Sketches of parts merge into the
sketch of the whole; two sketches estimate resemblance and containment, one estimates the number of distinct shingles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .common import SPACES, ascii_lower, let

WORDS, K = 5, 128
#: Rows by id range.  Beyond so many ranges, whose borders are a literal of the plan, ranges grow with the rows: at 50 billion
#: rows they have some 800 000 each, which a task sorts on its disk.
RANGE_ROWS, MAX_RANGES = 1024, 1 << 16
LOWEST = -(2**63)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The hashes of a text's shingles, in order: runs of so many words between ASCII white space, A-Z lower-cased; a
    text with fewer words is one shingle; a null text, or one without words, has none."""
    split = F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"[{SPACES}]+")
    hashed = F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))

    def rolled(h: Column) -> Column:
        whole = F.when(F.size(h) > 0, F.array(F.xxhash64(F.size(h), h))).otherwise(F.expr("cast(array() as array<bigint>)"))
        runs = F.transform(F.slice(h, 1, F.size(h) - (words - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, words)]))
        return F.when(F.size(h) >= words, runs).otherwise(whole)

    return let(hashed, rolled)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two shingle sets, from their sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1; exact if both sets together have at most k shingles.  Two empty: 1."""
    common = lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u).cast("double")
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(common(u)))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(s, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too, 0 to 1.  An empty a: 1."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def to_text(s: Column) -> Column:
    """A sketch as one string: 16 hexadecimal digits by hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def in_ranges(docs: DataFrame, range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES) -> tuple[DataFrame, WindowSpec]:
    """doc_id, text, copy, and the window in which lead() of a row is the row after it by ascending doc_id; after the
    last comes the first.  Null texts are empty, a null doc_id comes first, rows with equal doc_id follow each other by
    a hash of their text, then by text.  Rows with copy set are there only to follow others: drop them after the last lead().

    Each row is dealt once to the range of its doc_id; a range also gets copies of the first rows of the range after
    it, so that a window inside the range finds every successor and no row passes through a single task.  A doc_id that
    fills several ranges is split over them by the hash of its texts.
    """
    k = F.coalesce(F.col("doc_id"), F.lit(LOWEST))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), k.alias("k"), F.xxhash64(text).alias("h"))
    parts = max(1, min(max_ranges, math.ceil(rows.count() / range_rows)))
    at = [i / parts for i in range(1, parts)]
    borders = sorted(rows.agg(F.percentile_approx("k", F.lit(at), F.lit(20 * parts)).alias("b")).first()["b"]) if at else []
    side = max(1, math.ceil(math.sqrt(len(borders) + 1)))
    blocks = [borders[i : i + side] for i in range(0, len(borders), side)]

    def below(x: Column, same: bool) -> Column:
        """How many borders are less than x (same: or equal): first by block, then inside the block."""
        heads, inner = F.lit([b[0] for b in blocks]), F.array(*[F.lit(b) for b in blocks])
        count = lambda values: F.aggregate(values, F.lit(0), lambda s, b: s + F.when(b <= x if same else b < x, 1).otherwise(0))
        return let(count(heads), lambda j: F.when(j == 0, 0).otherwise((j - 1) * side + count(F.get(inner, j - 1))))

    def place(x: Column, h: Column) -> Column:
        """The range: after all borders up to x, or where several borders are x one of those that it fills."""
        if not borders:
            return F.lit(0)
        if len(set(borders)) == len(borders):
            return below(x, True)
        part = lambda n: F.least(F.floor((h / 2.0**64 + 0.5) * n).cast("int"), n - 1)
        return let(F.struct(below(x, False).alias("a"), below(x, True).alias("b")), lambda p: F.when(p["b"] - p["a"] < 2, p["b"]).otherwise(p["a"] + 1 + part(p["b"] - p["a"])))

    rows = rows.withColumn("range", place(F.col("k"), F.col("h")))
    # one row by range: the lowest id in it, so at most max_ranges rows come to the driver
    firsts = sorted((r["range"], (r["m"]["k"], r["m"]["h"])) for r in rows.groupBy("range").agg(F.min(F.struct("k", "h")).alias("m")).collect()) or [(0, (LOWEST, LOWEST))]
    order = [r for r, _ in firsts]
    first = dict(firsts)
    size = order[-1] + 1
    low_k, low_h = (F.lit([first.get(r, (LOWEST, LOWEST))[i] for r in range(size)]) for i in range(2))
    before = dict(zip(order, [order[-1], *order[:-1]], strict=True))
    prev = F.lit([before.get(r, 0) for r in range(size)])
    here, r = F.struct(F.col("range").alias("range"), F.lit(0).alias("lap"), F.lit(False).alias("copy")), F.col("range")
    copy = F.struct(F.get(prev, r).alias("range"), F.when(r == order[0], 1).otherwise(0).alias("lap"), F.lit(True).alias("copy"))
    lowest = (F.col("k") == F.get(low_k, r)) & (F.col("h") == F.get(low_h, r))
    dealt = rows.withColumn("to", F.explode(F.when(lowest, F.array(here, copy)).otherwise(F.array(here))))
    dealt = dealt.select("doc_id", "text", "k", "h", F.col("to.range").alias("range"), F.col("to.lap").alias("lap"), F.col("to.copy").alias("copy"))
    return dealt, Window.partitionBy("range").orderBy("lap", "k", "h", "text", "copy")


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS, **ranges) -> DataFrame:
    """doc_id, text, edited_text, sketch, edited_sketch, near_edited, near_next for every row of docs (doc_id, text; other
    columns are ignored).  edited_text is the text with its last floor(n / 2) code points replaced by the first as many
    (or all) of the next document; see in_ranges for order, nulls and repeated rows."""
    got, window = in_ranges(docs, **ranges)
    got = got.withColumn("next_text", F.lead("text").over(window))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    got = got.withColumn("edited_text", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
    got = got.withColumn("sketch", sketch(F.col("text"), k, words))
    got = got.withColumn("next_sketch", F.lead("sketch").over(window))
    got = got.filter(~F.col("copy")).withColumn("edited_sketch", sketch(F.col("edited_text"), k, words))
    return got.select(
        "doc_id", "text", "edited_text", "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
