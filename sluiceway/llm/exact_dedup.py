"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

A text is cut at places that its own content decides, each chunk becomes an identifier, and two texts are equal when
their ordered identifier lists are equal.  A text is read once; after that only digests and identifiers move, however
long the documents are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, keep_rows, materialize

#: A chunk ends after MIN bytes or more where a hash of the last WINDOW bytes says so (once in 90 to 1000 bytes, measured in
#: twelve scripts), so that cuts follow the content and meet again after an insertion; or it has MAX bytes, or what is left.
MIN_CHUNK, MAX_CHUNK, WINDOW = 256, 4096, 8
#: Broadcast the list of dropped rows up to this many rows (a long and a digest of 32 bytes: under 100 MB), else shuffle.
BROADCAST_ROWS = 1_000_000


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    """A chunk, of letters that stand for bytes.  The hash has a part for each place of the window, a product of the byte, and
    the window is a cut where all parts are low: so it is looked up, and moves on, letter by letter.  First bytes of letters
    count as low, as a script has few of them."""
    low = lambda k: "".join(f"\\x{b:02x}" for b in range(256) if b >= 0xC0 or (b * 187 + k * 101) * (2 * k + 187) % 257 < (140 if b < 0x80 else 77))
    return f"(?s).{{{least},{most - 1}}}?(?<={''.join(f'[{low(k)}]' for k in range(WINDOW))})|.{{1,{most}}}"


def as_bytes(text: Column) -> Column:
    """The bytes of a text in UTF-8, a letter each."""
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of a text, in order; joined they are as_bytes(text)."""
    return F.regexp_extract_all(as_bytes(text), F.lit(chunk_pattern(least, most)), F.lit(0))


def recipes(docs: DataFrame, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """A row per document row: row (unique), doc_id, text_sha256, recipe (digest, second hash and length by chunk)."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return (
        docs.select(F.col("doc_id"), text.alias("t"))
        .select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("t", 256).alias("text_sha256"),
            F.transform(
                chunks(F.col("t"), least, most),
                lambda c: F.struct(F.unhex(F.sha2(c, 256)).alias("digest"), F.xxhash64(c).alias("check"), F.char_length(c).alias("size")),
            ).alias("recipe"),
        )
    )


def exact_dedup(docs: DataFrame, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text; other columns are ignored).

    Equal: the same text after lower-casing A-Z; null counts as empty, and all empty texts are equal.  The row with the
    largest doc_id stays; a null doc_id is smaller than any other.  If rows repeat that doc_id too, one of them stays.

    A chunk's identifier is the place (row, position) of its first copy among chunks that agree in SHA-256, a second
    independent hash and length; chunks that agree in one and not in the others stay apart.
    """
    rows = materialize(recipes(docs, least, most), "recipes")  # also fixes the row numbers
    each = rows.select("row", F.posexplode("recipe").alias("pos", "c")).select("row", "pos", "c.*")
    agree = ["digest", "check", "size"]
    # written, so that both sides of the join are dealt anew and a chunk that very many rows share can be split
    known = materialize(each.groupBy(*agree).agg(F.min(F.struct("row", "pos")).alias("chunk")), "chunks")
    listed = (
        each.join(known, agree)
        .groupBy("row")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "chunk"))), lambda x: x["chunk"]).alias("chunks"))
    )
    empty = rows.filter(F.size("recipe") == 0).select("row", F.expr("cast(array() as array<struct<row:bigint,pos:int>>)").alias("chunks"))
    lists = materialize(rows.select("row", "doc_id", "text_sha256").join(listed.unionByName(empty), "row"), "lists")
    groups = materialize(
        lists.groupBy("chunks").agg(F.max(F.struct("doc_id", (-F.col("row")).alias("row"))).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups"
    )
    return lists.join(groups, "chunks").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == -F.col("keep.row")).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns: of equal texts the row with the largest doc_id, of
    rows equal in both any one."""
    found = exact_dedup(docs).select("doc_id", F.unhex("text_sha256").alias("print"), "kept", F.lit(True).alias("once"))
    return keep_rows(docs, found, F.unhex(F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)), BROADCAST_ROWS)
