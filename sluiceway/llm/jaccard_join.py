"""N-gram Jaccard join with skipping by set relations: its links, and their components.

Every text becomes a set of word-shingle hashes; equal sets are one class.  Classes are joined by prefixes: shingles are
ordered with rare ones first, and similar sets must share one of their first few.  The prefixes make index lists.

* In a list, entries are in blocks of equal size, by position inside a block; a set skips all blocks whose size, and the
  rest of a block whose positions, leave too little room for the needed overlap.
* In a long list the set with the fewest shingles of its own, in a stretch of sizes, is the pivot.  Each class near one is
  verified against it and described by its difference from it.  What two classes under one pivot have in common follows
  from their differences, so their answers are derived from the pivot's, without their sets, and they are skipped in all
  other lists.
* Where only components are asked for, as by keep_one, sets already in one component need no further look.

The result is exact: a bound only ever drops pairs that can't reach the threshold, or takes pairs that must.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, materialize, release, small, tidy
from .components import components
from .shingles import least_size, needed_overlap, set_key, shingle_sets

#: Counters of shingles by hash, for the order only: a fixed number, whatever the input.
COUNTERS, BLOCKS = 1 << 22, 64
#: A list has at most so many entries, or else parts, which meet in pairs; a stretch of this many sets gets a pivot.
LONG_LIST, PIVOT_FROM = 4096, 8
#: A class in more pairs than this has its set dealt to several tasks.
HOT_CLASS = 64
#: Broadcast a list of document ids up to so many (16 MB or so), else shuffle.
BROADCAST_IDS = 1_000_000


def _columns(names: list[str], *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(values), names=names)


def _binary(a: np.ndarray) -> pa.Array:
    """An array of fixed-size items as an Arrow binary column."""
    size = a.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(0, size * (len(a) + 1), size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(a))])


def _codes(c: pa.Array) -> np.ndarray:
    """A number for each different value of a binary column; -1 for null."""
    return c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def describe(docs: DataFrame, words: int, prints: bool = False) -> DataFrame:
    """Per document doc_id, n, key (and a digest of its text, if prints); and, with a null key, partial counts of shingles
    by block of counters.  Counts stop at 65535 in a task; they only decide on the order of shingles."""

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, count, seen = ["doc_id", "n", "key", "print", "block", "counts"], np.zeros(COUNTERS, np.uint32), set()
        for batch in batches:
            keys, sizes = [], []
            for s in shingle_sets(batch.column(1), words):
                keys.append(k := set_key(s))
                sizes.append(len(s))
                if k not in seen:
                    seen.add(k)
                    np.add.at(count, s >> np.uint64(42), 1)
            none = pa.nulls(len(keys))
            yield _columns(names, batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), batch.column(2), none.cast(pa.int32()), none.cast(pa.binary()))
        if seen:
            parts = np.minimum(count, 65535).astype("<u2").reshape(BLOCKS, -1)
            none = pa.nulls(BLOCKS)
            yield _columns(names, none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.binary()), pa.array(range(BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()))

    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)) if prints else F.lit(None).cast("binary")
    rows = docs.select("doc_id", "text", digest.alias("print"))
    return materialize(rows.mapInArrow(tidy(told), "doc_id long, n long, key binary, print binary, block int, counts binary"), "shingles")


def counted(described: DataFrame) -> np.ndarray:
    """The counters of all shingles: first summed by block and group of tasks, then by block."""

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, "<u2" if len(data) == 2 * COUNTERS // BLOCKS else "<u4")
                total[block] = np.minimum(total.get(block, 0) + part.astype(np.uint64), 2**32 - 1)
        yield _columns(["block", "counts"], pa.array(list(total), pa.int32()), pa.array([t.astype("<u4").tobytes() for t in total.values()], pa.binary()))

    rows = described.filter("block is not null").select("block", "counts", F.floor(F.spark_partition_id() / 16).alias("group"))
    rows = rows.repartition("block", "group").select("block", "counts").mapInArrow(summed, "block int, counts binary")
    rows = rows.repartition("block").mapInArrow(summed, "block int, counts binary")
    out = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.uint32)
    for r in rows.collect():  # BLOCKS rows, 16 MB in all
        out[r["block"]] = np.frombuffer(r["counts"], "<u4")
    return out.ravel()


def entries(docs: DataFrame, counts: np.ndarray, words: int, num: int, den: int, long_list: int) -> DataFrame:
    """token, salt, salts, key, n, pos: the prefix of each class, once for each task that meets the class."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    noise = float(counts.mean())
    noise += 6 * noise**0.5

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = shared.value, set()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                token, salt, salts, key, size, pos = [], [], [], [], [], []
                for s in shingle_sets(batch.column(0).slice(i, 512), words):
                    n = len(s)
                    if not n or (k := set_key(s)) in seen:
                        continue
                    seen.add(k)
                    c = count[s >> np.uint64(42)]
                    first = np.lexsort((s, c))[: n - least_size(n, num, den) + 1]
                    parts = np.maximum(1, np.ceil((c[first] - noise) / long_list)).astype(np.int64)
                    token.append(s[first].view(np.int64))
                    salts.append(parts)
                    salt.append(int.from_bytes(k[4:11], "big") % parts)
                    key.append(np.full(len(first), np.void(k)))
                    size.append(np.full(len(first), n))
                    pos.append(np.arange(len(first)))
                if token:
                    t, a, b, n, p = (pa.array(np.concatenate(x).astype(np.int64)) for x in (token, salt, salts, size, pos))
                    yield _columns(["token", "salt", "salts", "key", "n", "pos"], t, a.cast(pa.int32()), b.cast(pa.int32()), _binary(np.concatenate(key)), n.cast(pa.int32()), p.cast(pa.int32()))

    return docs.select("text").mapInArrow(tidy(prefixes), "token long, salt int, salts int, key binary, n int, pos int")


def _lists(batches: Iterable[pa.RecordBatch], by: list[str], most: int | None = None) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Whole lists, from rows sorted so that those of a list follow each other: batches of whole lists only, and 0.  A list of
    more rows than `most` comes alone, in parts with numbers from 0 on, so that no more of it is held."""
    held: list[pa.RecordBatch] = []
    rows = part = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for c in by:
            v = batch.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in by):
            yield _joined(held), part
            held, rows, part = [], 0, 0
        at = np.flatnonzero(new)
        if len(at):
            if held and part:  # the end of a list in parts comes alone
                yield _joined([*held, batch.slice(0, int(at[0]))]), part
                held, part, first = [], 0, int(at[0])
            else:
                first = 0
            if int(at[-1]) > first:
                held.append(batch.slice(first, int(at[-1]) - first))
            if held:
                yield _joined(held), 0
            held = [batch.slice(int(at[-1]))]
            rows = held[0].num_rows
        else:
            held.append(batch)
            rows += batch.num_rows
        while most and rows > most:
            whole = _joined(held)
            yield whole.slice(0, most), part
            held, rows, part = [whole.slice(most)], rows - most, part + 1
    if held:
        yield _joined(held), part


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def lists(found: DataFrame, num: int, den: int, pivot_from: int, long_list: int = LONG_LIST) -> DataFrame:
    """The entries of all lists with at least two classes or of several parts, and the pivot of each (null in a short
    stretch).  A list that has more entries than its counter said is cut into parts where it is built."""

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in _lists(batches, ["token", "salt"], 2 * long_list):
            token, salt, key = batch.column("token").to_numpy(), batch.column("salt").to_numpy(), _codes(batch.column("key"))
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            once = new.copy()
            once[1:] |= key[1:] != key[:-1]  # a class comes once from each task
            at = np.flatnonzero(once)
            group = np.cumsum(new[at]) - 1
            many = (np.bincount(group)[group] > 1) | (batch.column("salts").to_numpy()[at] > 1) | (part > 0)  # parts of a long list meet later
            if not many.any():
                continue
            at, group = at[many], group[many]
            n, pos = batch.column("n").to_numpy()[at], batch.column("pos").to_numpy()[at]
            pivot = np.full(len(at), -1)
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            ends = np.append(starts[1:], len(at))
            for a, b in zip(starts[ends - starts >= pivot_from].tolist(), ends[ends - starts >= pivot_from].tolist(), strict=True):
                while b - a >= pivot_from:  # the sets that may be similar to the least one left
                    c = a + int(np.searchsorted(n[a:b], n[a] * den // num, "right"))
                    if c - a >= pivot_from:
                        pivot[a:c] = at[a + int(np.argmin(pos[a:c]))]  # rare shingles come first: it has the fewest of its own
                    a = c
            keep = batch.take(pa.array(at))
            chosen = batch.column("key").take(pa.array(pivot, mask=pivot < 0))
            yield pa.RecordBatch.from_arrays([*keep.columns, chosen, pa.array(np.full(len(at), part), pa.int32())], names=[*keep.schema.names, "pivot", "part"])

    dealt = found.repartition("token", "salt").sortWithinPartitions("token", "salt", "key")
    out = materialize(dealt.mapInArrow(tidy(told), "token long, salt int, salts int, key binary, n int, pos int, pivot binary, part int"), "lists")
    cut = out.filter("part > 0").select("token").distinct()
    if cut.isEmpty():
        return out.drop("part")
    # a row for each part of such a list: entries by long_list at most
    parts = out.join(cut, "token", "left_semi").select("token", "salt", "part").distinct().groupBy("token").agg(F.sort_array(F.collect_list(F.struct("salt", "part"))).alias("p"))
    parts = materialize(parts.select("token", F.size("p").alias("now"), F.posexplode("p").alias("at", "p")).select("token", "now", "at", "p.salt", "p.part"), "list-parts")
    told_anew = out.join(small(parts, BROADCAST_IDS), ["token", "salt", "part"], "left")
    return told_anew.select("token", F.coalesce("at", "salt").alias("salt"), F.coalesce("now", "salts").alias("salts"), "key", "n", "pos", "pivot")


def candidates(n, pos, comp, salt, pivot, common, pivot_n, num: int, den: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """In one list sorted by (n, pos): i, the later entries that may be similar to i, and which of them must be.

    All arguments but the last two are arrays by entry.  comp: component so far, pairs inside one are skipped.  salt: only
    pairs of different ones count, or all where it is negative.  pivot, pivot_n, common: a number for the pivot, its size
    and the overlap with it (negative: unknown).
    """
    blocks = np.append(np.flatnonzero(np.diff(n, prepend=-1)), len(n))  # of equal size
    sizes = n[blocks[:-1]]
    block = np.repeat(np.arange(len(sizes)), np.diff(blocks))
    for i in range(len(n) - 1):
        size = int(n[i])
        last = int(np.searchsorted(sizes, size * den // num, "right"))  # blocks of larger sets are skipped
        picked = []
        for b in range(int(block[i]), last):
            need = int(needed_overlap(size, int(sizes[b]), num, den))
            if pos[i] > size - need:
                break  # larger sets need more
            lo, hi = max(i + 1, int(blocks[b])), int(blocks[b + 1])
            hi = lo + int(np.searchsorted(pos[lo:hi], int(sizes[b]) - need, "right"))  # the rest of the block is skipped
            picked.append(np.arange(lo, hi))
        if not picked:
            continue
        j = np.concatenate(picked)
        j = j[(comp[j] != comp[i]) & ((salt[j] != salt[i]) | (salt[j] < 0))]
        sure = np.zeros(len(j), bool)
        if len(j) and common[i] >= 0:
            known = (pivot[j] == pivot[i]) & (common[j] >= 0)
            need = needed_overlap(size, n[j], num, den)
            most = np.minimum(common[i], common[j]) + np.minimum(size - common[i], n[j] - common[j])
            sure = known & (common[i] + common[j] - pivot_n[i] >= need)
            stay = ~known | (most >= need)
            j, sure = j[stay], sure[stay]
        if len(j):
            yield i, j, sure


def _parts(rows: DataFrame) -> DataFrame:
    """The rows of each part of a list, once for each part that it meets: low and high are the two."""
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return rows.withColumns({"low": F.least("salt", "part"), "high": F.greatest("salt", "part")})


def under_pivots(against: DataFrame, num: int, den: int, long_list: int = LONG_LIST, as_pairs: bool = False) -> DataFrame:
    """a, b, n: the links between classes under one pivot.  Those of a class are counted, n in rows whose b is null; rows
    with n = 0 are as many links (a, b) as join the components.  as_pairs: all links as rows (a, b) instead.

    against: a, b (the pivot), linked, missing and extra (the difference of a from b).  With |b| known, two classes have
    |b| - |missing| - |other missing| shingles in common, and one more for each shingle that both differences have."""
    rows = against.select(F.xxhash64("b").alias("token"), F.col("b").alias("pivot"), F.col("a").alias("key"), "linked", F.size("missing").alias("missing"), F.concat("missing", "extra").alias("diff"))
    sizes = materialize(rows.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / long_list).cast("int").alias("salts")), "pivot-lists")
    rows = rows.join(small(sizes, BROADCAST_IDS), "pivot").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in _lists(batches, ["token", "low", "high"]):
            pivot, low = _codes(batch.column("pivot")), batch.column("low").to_numpy()
            new = np.ones(len(pivot), bool)  # two pivots of one token differ here
            new[1:] = (pivot[1:] != pivot[:-1]) | (low[1:] != low[:-1]) | np.diff(batch.column("high").to_numpy()).astype(bool) | (np.diff(batch.column("token").to_numpy()) != 0)
            starts = np.flatnonzero(new)
            got, held = [], 0

            def told_of(got, key=batch.column("key")):
                a, b, n = (np.concatenate(x) for x in zip(*got, strict=True))
                return _columns(["a", "b", "n"], key.take(pa.array(a)), key.take(pa.array(b, mask=b < 0)), pa.array(n, pa.int64()))

            for i, j in zip(starts.tolist(), np.append(starts[1:], len(pivot)).tolist(), strict=True):
                for a, b, n in _answers(batch.slice(i, j - i), num, den, as_pairs):
                    got.append((i + a, np.where(b < 0, -1, i + b), n))
                    held += len(a)
                    if held > 50_000:
                        yield told_of(got)
                        got, held = [], 0
            if got:
                yield told_of(got)

    dealt = _parts(rows).select("token", "low", "high", "pivot", "salt", "key", "linked", "missing", "diff").repartition("token", "low", "high")
    return materialize(dealt.sortWithinPartitions("token", "low", "high", "pivot", "key").mapInArrow(tidy(met), "a binary, b binary, n long"), "under-pivots")


def _answers(part: pa.RecordBatch, num: int, den: int, as_pairs: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The links inside one pivot's list, as places (a, b or -1, n): see under_pivots."""
    m = part.num_rows
    if m < 2:
        return
    key, pivot = part.column("key").to_pylist(), part.column("pivot")[0].as_py()
    n, size = np.array([int.from_bytes(k[:4], "big") for k in key]), int.from_bytes(pivot[:4], "big")
    missing, salt = part.column("missing").to_numpy().astype(np.int64), part.column("salt").to_numpy()
    apart = part.column("low")[0].as_py() != part.column("high")[0].as_py()
    flat = part.column("diff")
    bounds, values = flat.offsets.to_numpy(), np.unique(flat.flatten().to_numpy(), return_inverse=True)[1]
    bounds = bounds - bounds[0]
    owner = np.repeat(np.arange(m), np.diff(bounds))
    by_value = np.argsort(values, kind="stable")
    holders, heads = owner[by_value], np.searchsorted(values[by_value], np.arange(len(values) + 1))
    count, label = np.zeros(m, np.int64), np.where(part.column("linked").to_numpy(zero_copy_only=False), -1, np.arange(m))
    for i in range(m - 1):
        mine = values[bounds[i] : bounds[i + 1]]
        starts, lengths = heads[mine], heads[mine + 1] - heads[mine]
        shared = np.bincount(holders[_ranges(starts, lengths)], minlength=m)[i + 1 :]
        overlap = size - missing[i] - missing[i + 1 :] + shared
        good = overlap >= needed_overlap(n[i], n[i + 1 :], num, den)
        if apart:
            good &= salt[i + 1 :] != salt[i]
        js = i + 1 + np.flatnonzero(good)
        if not len(js):
            continue
        if as_pairs:
            yield np.full(len(js), i), js, np.zeros(len(js), np.int64)
            continue
        count[i] += len(js)
        count[js] += 1
        other = js[label[js] != label[i]]
        if len(other):
            names, one = np.unique(label[other], return_index=True)
            yield np.full(len(one), i), other[one], np.zeros(len(one), np.int64)
            label[np.isin(label, names)] = label[i]
    some = np.flatnonzero(count)
    if len(some):
        yield some, np.full(len(some), -1), count[some]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def pairs(found: DataFrame, against: DataFrame, roots: DataFrame | None, num: int, den: int) -> DataFrame:
    """a, b, sure: the pairs of classes that may be similar, each once; sure: that must be.  With roots only those of
    different components; without it all but those of against, and of two classes under one pivot, which under_pivots has.

    found: the lists; against: overlaps with pivots (a, b, overlap); roots: components so far, or None.  The parts of a long list
    meet in pairs of parts, so that all pairs of entries are looked at and no task holds more than two parts."""
    told = against.select(F.col("a").alias("key"), F.col("b").alias("pivot"), F.col("overlap").alias("common"))
    rows = found.join(told, ["key", "pivot"], "left")
    under = against.filter("missing is not null").select(F.col("a").alias("key"), F.col("b").alias("root"))
    rows = rows.join(roots.select(F.col("node").alias("key"), "root") if roots else under, "key", "left")
    rows = rows.withColumn("common", F.when(F.col("key") == F.col("pivot"), F.col("n")).otherwise(F.coalesce("common", F.lit(-1))))
    rows = rows.withColumn("comp", F.coalesce("root", "key"))
    # a long list that is one component by now, or all under one pivot, as that of a large group of near copies is, needs no pairs of parts
    whole, long = rows.filter("salts = 1"), rows.filter("salts > 1")
    open_ = materialize(long.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").select("token"), "open-lists")
    rows = whole.unionByName(long.join(small(open_, BROADCAST_IDS), "token", "left_semi"))
    rows = _parts(rows).select("token", "low", "high", "salt", "n", "pos", "key", "comp", "pivot", "common")
    names = ["a", "b", "na", "nb", "pa", "pb", "sure"]

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in _lists(batches, ["token", "low", "high"]):
            token, low, high = (batch.column(c).to_numpy() for c in ("token", "low", "high"))
            salt, n, pos = (batch.column(c).to_numpy().astype(np.int64) for c in ("salt", "n", "pos"))
            comp, pivot = _codes(batch.column("comp")), _codes(batch.column("pivot"))
            common = batch.column("common").to_numpy().astype(np.int64)
            pivot_n = np.array([-1 if k is None else int.from_bytes(k[:4], "big") for k in batch.column("pivot").to_pylist()])
            salt = np.where(low == high, -1, salt)
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(token))
            mixed = np.minimum.reduceat(comp, starts) < np.maximum.reduceat(comp, starts) if len(starts) else starts
            got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            held = 0

            def told_of(got):
                i, j, sure = (np.concatenate(x) for x in zip(*got, strict=True))
                key = batch.column("key")
                return _columns(names, key.take(pa.array(i)), key.take(pa.array(j)), *(pa.array(x.astype(np.int32)) for x in (n[i], n[j], pos[i], pos[j])), pa.array(sure))

            for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
                part = slice(a, b)
                for i, j, sure in candidates(n[part], pos[part], comp[part], salt[part], pivot[part], common[part], pivot_n[part], num, den):
                    got.append((np.full(len(j), a + i), a + j, sure))
                    held += len(j)
                    if held > 50_000:
                        yield told_of(got)
                        got, held = [], 0
            if got:
                yield told_of(got)

    out = rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "n", "pos")
    out = out.mapInArrow(tidy(met), "a binary, b binary, na int, nb int, pa int, pb int, sure boolean")
    swap = F.col("a") > F.col("b")  # only among sets of one size
    first = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    out = out.select(first("a", "b").alias("a"), first("b", "a").alias("b"), first("na", "nb").alias("na"), first("nb", "na").alias("nb"), first("pa", "pb").alias("pa"), first("pb", "pa").alias("pb"), "sure")
    # all common shingles up to the last one seen are counted; after it at most the rest of either set is common
    out = out.filter("a <> b").groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.count(F.lit(1)).alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("sure").alias("sure"))
    most = F.col("c") + F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb"))
    out = out.filter(F.col("sure") | (most * (num + den) >= (F.col("na") + F.col("nb")) * num)).select("a", "b", "sure")
    if not roots:
        out = out.join(against.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    return materialize(out, "pairs")


def _with_sets(rows: DataFrame, asked: DataFrame, sets: DataFrame, by: str, other: str, name: str) -> DataFrame:
    """rows, one for each pair asked, with the set of the class `by` in a column.  A class in very many pairs has its set in
    several tasks."""
    hot = materialize(asked.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_CLASS).select(by, F.ceil(F.col("n") / HOT_CLASS).cast("int").alias("salts")), "hot-classes")
    sets = sets.select(F.col("key").alias(by), F.col("set").alias(name))
    if hot.isEmpty():
        return rows.join(sets, by)
    hot, salts = small(hot, BROADCAST_IDS), F.coalesce("salts", F.lit(1))
    dealt = rows.join(hot, by, "left").withColumn("salt", F.pmod(F.xxhash64(other), salts).cast("int")).drop("salts")
    copies = sets.join(hot, by, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(copies, [by, "salt"]).drop("salt")


def verified(asked: DataFrame, docs: DataFrame, classes: DataFrame, words: int, num: int, den: int, differences: bool = False) -> DataFrame:
    """a, b, overlap, linked for the written pairs (a, b): only the texts of documents that stand for a class in a pair are
    read into sets, and each pair meets its two sets.  differences: also missing and extra, the shingles that b has and a
    doesn't and the other way round, where they are fewer than those in common; else null."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                got = [s for s in shingle_sets(batch.column(0).slice(i, 512), words) if len(s)]
                if got:
                    values = pa.array(np.concatenate(got).view(np.int64))
                    ends = pa.array(np.cumsum([0, *map(len, got)]), pa.int32())
                    yield _columns(["key", "set"], pa.array([set_key(s) for s in got], pa.binary()), pa.ListArray.from_arrays(ends, values))

    keys = asked.select(F.col("a").alias("key")).union(asked.select("b")).distinct()
    ids = materialize(keys.join(classes, "key").select("doc_id").distinct(), "needed")
    texts = docs.select("doc_id", "text")
    texts = texts.join(small(ids, BROADCAST_IDS), "doc_id", "left_semi").union(texts.filter("doc_id is null"))
    known = materialize(texts.select("text").mapInArrow(tidy(sets), "key binary, set array<bigint>"), "sets")
    both = _with_sets(_with_sets(asked.select("a", "b"), asked, known, "a", "b", "s"), asked, known, "b", "a", "t")
    common = both.withColumn("overlap", F.size(F.array_intersect("s", "t")))
    linked = F.col("overlap") * (num + den) >= (F.size("s") + F.size("t")) * num
    told = ["a", "b", "overlap", linked.alias("linked")]
    if differences:
        near = F.size("s") + F.size("t") <= 3 * F.col("overlap")
        told += [F.when(near, F.array_except(x, y)).alias(name) for x, y, name in (("t", "s", "missing"), ("s", "t", "extra"))]
    out = materialize(common.select(*told).dropDuplicates(["a", "b"]), "verified")  # rows that repeat a doc_id
    release(ids, known)
    return out


def to_pivots(found: DataFrame) -> DataFrame:
    """For each class near a pivot the pair (a, b) of it and one pivot, the one that it meets most often; for the pivots of
    the parts of a long list the least of them.  Which pairs these are decides on speed only."""
    shared = found.filter("pivot is not null and key <> pivot").groupBy(F.col("key").alias("a"), F.col("pivot").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    heads = found.filter("salts > 1 and key = pivot").select("token", F.col("key").alias("a")).distinct()
    least = heads.groupBy("token").agg(F.min("a").alias("b"))
    linked = heads.join(least, "token").filter("a <> b").select("a", "b", F.lit(2**62).alias("c"))
    return materialize(shared.unionByName(linked).groupBy("a").agg(F.max(F.struct("c", "b")).alias("m")).select("a", "m.b"), "to-pivots")


def _classes(docs: DataFrame, words: int, prints: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows described; doc_id, n, key, print of each document; key and least doc_id of each class."""
    described = describe(docs, words, prints)
    each = described.filter("key is not null").select("doc_id", "n", "key", "print")
    return described, each, materialize(each.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id")), "classes")


def _ends(links: DataFrame) -> DataFrame:
    """key, n: how many of the links (a, b) each class is in."""
    return links.select(F.col("a").alias("key")).union(links.select("b")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _linked(docs: DataFrame, described: DataFrame, classes: DataFrame, words: int, num: int, den: int, long_list: int, pivot_from: int, every: bool, as_pairs: bool = False) -> tuple[DataFrame, DataFrame]:
    """For every the number of links of each class (key, n), or with as_pairs the links (a, b), a the lesser key, each once;
    without it only as many links as make the components.  And the roots of the components."""
    found = lists(entries(docs, counted(described), words, num, den, long_list), num, den, pivot_from, long_list)
    first = verified(to_pivots(found), docs, classes, words, num, den, True)
    links = materialize(first.filter("linked").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pivot-links")
    near = under_pivots(first.filter("missing is not null"), num, den, long_list, as_pairs) if every else None
    joins = near.filter("b is not null").select("a", "b") if every else None
    roots = components(links.union(joins) if every else links)
    more = pairs(found, first, None if every else roots, num, den)
    second = verified(more.filter("not sure"), docs, classes, words, num, den)
    again = materialize(more.filter("sure").select("a", "b").union(second.filter("linked").select("a", "b")), "links")
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    across = again
    if every:  # what lies inside components joins no more of them
        across = again.join(root("a"), "a", "left").join(root("b"), "b", "left")
        across = across.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a <> b").distinct()
    found_roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(across))
    both = links.union(again)
    if as_pairs:
        return both.union(joins).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), found_roots
    if every:
        counts = _ends(both).union(near.filter("b is null").select(F.col("a").alias("key"), "n")).groupBy("key").agg(F.sum("n").alias("n"))
        return materialize(counts, "link-counts"), found_roots
    return both, found_roots


def _components(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """key, class_id, component_id, root of each class; a root is the key that stands for its component."""
    placed = materialize(classes.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("key", "doc_id", F.coalesce("root", "key").alias("root")), "placed")
    least = materialize(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least-ids")
    return materialize(placed.join(least, "root").select("key", F.col("doc_id").alias("class_id"), "component_id", "root"), "class-components")


def jaccard_join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, long_list: int = LONG_LIST, pivot_from: int = PIVOT_FROM) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, n_links for every row of docs (doc_id, text; other columns are ignored):
    the size of its set of shingles, the least doc_id with that set, the least doc_id of its component, and how many other
    sets its set is linked to.  Two documents are linked when the Jaccard similarity of their sets is at least num / den.
    Texts without words have an empty set and no link, and a class and component of their own; a null text is empty.  Rows
    that repeat a doc_id are taken each for itself; a null doc_id is never the least, where its component has another."""
    described, each, classes = _classes(docs, words)
    counts, roots = _linked(docs, described, classes, words, num, den, long_list, pivot_from, True)
    out = each.join(_components(classes, roots), "key", "left").join(counts.withColumnRenamed("n", "n_links"), "key", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def jaccard_links(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, long_list: int = LONG_LIST, pivot_from: int = PIVOT_FROM) -> DataFrame:
    """a, b: the class_ids of each two different sets that are linked, each pair once.  With the class_id of jaccard_join as
    membership these are all links.  The class_id of a set that only null doc_ids have is null."""
    described, _, classes = _classes(docs, words)
    links, _ = _linked(docs, described, classes, words, num, den, long_list, pivot_from, True, True)
    name = lambda c: classes.select(F.col("key").alias(c), F.col("doc_id").alias(f"{c}_id"))
    return links.join(name("a"), "a").join(name("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, long_list: int = LONG_LIST, pivot_from: int = PIVOT_FROM) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component: of each one row stays, whatever doc_ids
    repeat.  It is that with the least doc_id (a null one only where there is no other), among those with that doc_id the
    one whose text has the least digest, and of rows equal in both any one.  Rows without words all stay."""
    described, each, classes = _classes(docs, words, True)
    _, roots = _linked(docs, described, classes, words, num, den, long_list, pivot_from, False)
    rooted = _components(classes, roots).select("key", "root")
    rows = each.filter("n > 0").select("doc_id", "print", "key").join(rooted, "key")
    rows = materialize(rows.select("doc_id", "print", "root"), "rooted")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("best"))
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("print") == F.col("best.print"))
    found = rows.join(materialize(best, "best"), "root").select("doc_id", "print", kept.alias("kept"), F.lit(True).alias("once"))
    blank = each.filter("n = 0").select("doc_id", "print", F.lit(True).alias("kept"), F.lit(False).alias("once"))
    return keep_rows(docs, found.unionByName(blank), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)), BROADCAST_IDS)
