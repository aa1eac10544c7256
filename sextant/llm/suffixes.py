"""Removal of byte strings that repeat an earlier one, by induced suffix sorting of samples.

Sampled suffixes come first: in every string of ``LENGTH`` bytes the grams with the smallest
hash are anchors, so equal strings have equal anchors at equal places. Anchors that occur
once are dropped, and of occurrences whose whole surroundings are equal only the earliest is
looked at further; all others are repeats from end to end. What is left is sorted by what
follows the anchor. That order, with the common-prefix lengths between neighbours, is then
induced to the suffixes that begin one byte earlier, again and again: a stable distribution by
the preceding byte gives the next order, one plus a range minimum the next prefix lengths.
Runs of suffixes that share ``LENGTH`` bytes are equal strings; all but the earliest go.

Spark's external sort is the disk-backed queue: it holds the suffix tuples of shards that
are far larger than memory and hands them to a task in order, group by group. A task holds
a group of at most ``GROUP_ROWS`` tuples for the induction. Of a larger one it holds nothing:
its strings leave as hashes, one per offset, and are compared by an aggregation and a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm import textscan as S
from sextant.llm.common import Scratch

LENGTH = 100
GRAM = 24
REACH = LENGTH - GRAM  # bytes a string may reach to the left of its anchor
# a group is cut into parts by longer strings around the anchor, each for its own offsets
PARTS = 3
# tuples of one group that a task may hold, at about a kilobyte each
GROUP_ROWS = 1 << 16
_NONE = np.uint64(2 ** 64 - 1)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` over every window of ``width`` entries, in log(width) passes."""
    n = 1
    while 2 * n <= width:
        x = f(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return f(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, gram hash, hash of the surroundings) of the anchors of a block."""
    n = len(data)
    if n < LENGTH:
        nothing = np.zeros(0, dtype=np.int64)
        return nothing, nothing.view(np.uint64), nothing.view(np.uint64)
    prefix = S.prefix_hashes(data)
    starts = np.arange(n - GRAM + 1)
    grams = np.full(n, _NONE)
    grams[:len(starts)] = np.minimum(S.range_hashes(prefix, starts, starts + GRAM), _NONE - np.uint64(1))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    grams[np.arange(n) + GRAM > ends] = _NONE
    least = _slide(grams, REACH + 1, np.minimum)
    whole = np.arange(len(least)) + LENGTH <= ends[:len(least)]
    least = np.where(whole, least, np.uint64(0))
    # a gram is an anchor if it is the least of some string that holds it
    spread = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)])
    most = _slide(spread, REACH + 1, np.maximum)
    at = np.flatnonzero((most == grams) & (grams != _NONE))
    owner = np.searchsorted(offsets, at, side="right") - 1
    left = np.maximum(at - REACH, offsets[owner])
    right = np.minimum(at + LENGTH, offsets[owner + 1])
    around = S.range_hashes(prefix, left, right) + (at - left).astype(np.uint64)
    return at, grams[at], around


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of every text. Of equal surroundings inside one block all but the earliest are
    settled: they are repeats, and a scattered gram keeps them away from the group they leave."""
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        for row, data, offsets in S.blocks(batch.column("text")):
            at, gram, around = anchors(data, offsets)
            owner = np.searchsorted(offsets, at, side="right") - 1
            key, pos = keys[row + owner], at - offsets[owner]
            order = np.lexsort((pos, key, around, gram))
            later = np.zeros(len(at), dtype=bool)
            a, b = order[:-1], order[1:]
            later[b] = (gram[a] == gram[b]) & (around[a] == around[b])
            spread = S.mix(key.astype(np.int64).view(np.uint64) + pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            gram, around = np.where(later, spread, gram), np.where(later, np.uint64(0), around)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)), pa.array(key), pa.array(pos.astype(np.int32)),
                 pa.array(later)], ["gram", "around", "key", "pos", "settled"])


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gram, around, key, pos): repeats of a surrounding (open is false), and the
    first of each where a gram has several (open is true). One row is carried over."""
    held = None  # (key, pos) of the only surrounding of the last gram so far
    last = None  # (gram, around) of the last row

    for batch in batches:
        settled = batch.column("settled")
        done = batch.filter(settled)
        if done.num_rows:
            yield pa.RecordBatch.from_arrays([done.column("key"), done.column("pos"), pa.array(np.zeros(done.num_rows, dtype=bool))],
                                             ["key", "pos", "open"])
        batch = batch.filter(pc.invert(settled))
        gram, around, key, pos = (batch.column(c).to_numpy() for c in ("gram", "around", "key", "pos"))
        n = len(gram)
        if not n:
            continue
        new_gram, new_around = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        new_gram[1:] = gram[1:] != gram[:-1]
        new_around[1:] = new_gram[1:] | (around[1:] != around[:-1])
        goes_on = last is not None and last[0] == gram[0]
        if goes_on:
            new_gram[0] = False
            new_around[0] = last[1] != around[0]
        out = [(key[~new_around], pos[~new_around], np.zeros(int((~new_around).sum()), dtype=bool))]
        # a first surrounding counts when its gram has another one
        group = np.cumsum(new_gram)
        several = np.bincount(group, weights=new_around & ~new_gram, minlength=int(group[-1]) + 1) > 0
        if goes_on and several[0] and held is not None:
            out.append(tuple(np.array([x]) for x in (*held, True)))
            held = None
        known_several = goes_on and held is None
        is_open = new_around & (several[group] | ((group == 0) & known_several))
        out.append((key[is_open], pos[is_open], np.ones(int(is_open.sum()), dtype=bool)))
        end = int(group[-1])
        if not (end == 0 and goes_on):
            first = np.flatnonzero(group == end)[0]
            held = None if several[end] else (key[first], pos[first])
        last = (gram[-1], around[-1])
        cols = [np.concatenate([o[i] for o in out]) for i in range(3)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(bool))],
            ["key", "pos", "open"])


def _parts() -> list[tuple[int, int]]:
    """Offsets (bytes before the anchor) that each part answers for, first and last."""
    cuts = [(REACH + 1) * i // PARTS for i in range(PARTS + 1)]
    return [(cuts[i], cuts[i + 1] - 1) for i in range(PARTS)]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix tuples of the open anchors of a text: shard, part, what follows, what precedes."""
    for batch in batches:
        rows: list[tuple] = []
        for key, text, places in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "places")), strict=True):
            raw = (text or "").encode()
            for q in places:
                for part, (low, high) in enumerate(_parts()):
                    # the bytes every string of this part holds, the gram among them: they make the shard
                    if q < low or q + LENGTH - high > len(raw):
                        continue
                    core = raw[q - low:q + LENGTH - high]
                    rows.append((hash_bytes(core), part, raw[q:q + LENGTH - low], raw[max(0, q - high):q][::-1], key, q))
            if len(rows) >= 20_000:
                yield _tuple_batch(rows)
                rows = []
        yield _tuple_batch(rows)


def hash_bytes(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _tuple_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32())
    names = ("shard", "part", "follows", "precedes", "key", "pos")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, and their lengths."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(1, dtype=np.uint8)
    length = np.diff(offsets)
    at = np.minimum(offsets[:-1, None] + np.arange(width), max(len(data) - 1, 0))
    return np.where(np.arange(width) < length[:, None], data[at], 0), length


class _RangeMinimum:
    """Minima of any range of an array, from minima over powers of two."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while 2 << (len(self.levels) - 1) <= len(x):
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum over first..last, both included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), dtype=self.levels[0].dtype)
        for k in np.unique(level).tolist():
            pick = np.flatnonzero(level == k)
            row = self.levels[k]
            out[pick] = np.minimum(row[first[pick]], row[last[pick] - (1 << k) + 1])
        return out


def repeated_offsets(group: np.ndarray, follows: np.ndarray, follow_length: np.ndarray, precedes: np.ndarray,
                     precede_length: np.ndarray, age: np.ndarray, low: int, high: int) -> np.ndarray:
    """Which strings that begin ``low``..``high`` bytes before the anchor repeat an earlier one.

    Rows come sorted by (group, follows); ``age`` orders occurrences. Returns rows x offsets.
    """
    n = len(group)
    found = np.zeros((n, high - low + 1), dtype=bool)
    if n < 2:
        return found
    differs = follows[1:] != follows[:-1]
    both = np.minimum(follow_length[1:], follow_length[:-1])
    lcp = np.zeros(n, dtype=np.int16)
    lcp[1:] = np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), both), both)
    lcp[1:][group[1:] != group[:-1]] = 0
    order = np.arange(n)
    for x in range(high + 1):
        if x >= low and len(order):
            start = np.flatnonzero(lcp < LENGTH)
            earliest = np.minimum.reduceat(age[order], start)
            run = np.cumsum(lcp < LENGTH) - 1
            found[order[age[order] > earliest[run]], x - low] = True
        if x == high:
            break
        ranks = np.flatnonzero(precede_length[order] > x)
        if len(ranks) < 2:
            break
        before = order[ranks]
        symbol = group[before].astype(np.int64) << 8 | precedes[before, x]
        sorting = np.argsort(symbol, kind="stable")
        minimum = _RangeMinimum(lcp)
        ranks, order = ranks[sorting], before[sorting]
        symbol = symbol[sorting]
        same = symbol[1:] == symbol[:-1]
        lcp = np.zeros(len(order), dtype=np.int16)
        lcp[1:][same] = 1 + minimum(ranks[:-1][same] + 1, ranks[1:][same])
    return found


_SPANS = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("shard", pa.int64()),
                    ("strings", pa.list_(pa.int64()))])


def _strings(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Per tuple the hashes of its strings: the i-th begins i bytes before ``start``; null if the
    text does not hold it."""
    parts = rows.column("part").to_numpy()
    for part in np.unique(parts).tolist():
        low, high = _parts()[part]
        mine = rows.filter(pa.array(parts == part))
        follows, follow_length = _matrix(mine.column("follows"), LENGTH - low)
        precedes, precede_length = _matrix(mine.column("precedes"), max(high, 1))
        data = np.hstack([precedes[:, :high][:, ::-1], follows]).astype(np.uint8)
        x = np.arange(low, high + 1)
        start = np.arange(mine.num_rows)[:, None] * data.shape[1] + high - x
        hashes = S.range_hashes(S.prefix_hashes(data.ravel()), start.ravel(), start.ravel() + LENGTH).view(np.int64)
        absent = (x > precede_length[:, None]) | (LENGTH - x > follow_length[:, None])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(mine.num_rows + 1, dtype=np.int32) * len(x)),
                                         pa.array(hashes, mask=absent.ravel()))
        first = (mine.column("pos").to_numpy() - low).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [mine.column("key"), pa.array(first), pa.nulls(mine.num_rows, pa.int32()), mine.column("shard"), lists], schema=_SPANS)


def _repeats(rows: pa.Table) -> pa.RecordBatch:
    """Spans of repeated bytes of whole groups."""
    out = []
    parts = rows.column("part").to_numpy()
    for part in np.unique(parts).tolist():
        low, high = _parts()[part]
        mine = rows.filter(pa.array(parts == part)).combine_chunks()
        column = {c: mine.column(c).combine_chunks() if mine.num_rows else mine.column(c) for c in mine.column_names}
        shard, key = (column[c].to_numpy() for c in ("shard", "key"))
        pos = column["pos"].to_numpy().astype(np.int64)
        new = np.ones(len(shard), dtype=bool)
        new[1:] = shard[1:] != shard[:-1]
        age = np.empty(len(shard), dtype=np.int64)
        age[np.lexsort((pos, key))] = np.arange(len(shard))
        follows, follow_length = _matrix(column["follows"], LENGTH - low)
        precedes, precede_length = _matrix(column["precedes"], max(high, 1))
        found = repeated_offsets(np.cumsum(new), follows, follow_length, precedes, precede_length, age, low, high)
        row, offset = np.nonzero(found)
        start = pos[row] - low - offset
        out.append((key[row], start))
    keys, starts = (np.concatenate([o[i] for o in out]) for i in (0, 1))
    order = np.lexsort((starts, keys))
    keys, starts = keys[order], starts[order]
    # strings that overlap become one span
    opens = np.ones(len(keys), dtype=bool)
    opens[1:] = (keys[1:] != keys[:-1]) | (starts[1:] > starts[:-1] + LENGTH)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(keys))[:len(first)] - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[first]), pa.array(starts[first].astype(np.int32)), pa.array((starts[last] + LENGTH).astype(np.int32)),
         pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.list_(pa.int64()))], schema=_SPANS)


def _inducer(limit: int):
    """Batch function on suffix tuples sorted by (part, shard, follows): spans of repeated bytes,
    and for tuples of groups over ``limit`` the hashes of their strings."""

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # the last group so far, while it is within the limit
        held, current = 0, None

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            shard = batch.column("shard").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [n]))
            low = 0
            if current == shard[0]:  # the last group goes on
                low = int(cuts[1])
                kept.append(batch.slice(0, low))
                held += low
                if held > limit:
                    for piece in kept:
                        yield from _strings(piece)
                    kept = []
                if low == n:
                    continue
            last = int(cuts[-2])
            whole = kept
            if last > low:
                middle, sizes = batch.slice(low, last - low), np.diff(cuts[(cuts >= low) & (cuts <= last)])
                large = np.repeat(sizes > limit, sizes)
                if large.any():
                    yield from _strings(middle.filter(pa.array(large)))
                    middle = middle.filter(pa.array(~large))
                whole = [*kept, middle]
            if sum(b.num_rows for b in whole):
                yield _repeats(pa.Table.from_batches(whole))
            kept, held, current = [batch.slice(last)], n - last, shard[last]
            if held > limit:
                yield from _strings(kept[0])
                kept = []
        if kept:
            yield _repeats(pa.Table.from_batches(kept))

    return induce


def _later_strings(large: DataFrame) -> DataFrame:
    """(key, start, end) of bytes under strings of large groups that also start earlier."""
    strings = large.select("key", "shard", F.col("start").alias("at"), F.posexplode("strings").alias("i", "string")).filter(
        F.col("string").isNotNull()).select("key", "shard", "string", "at", (F.col("at") - F.col("i")).alias("start"))
    place = F.struct("key", "start")
    earliest = strings.groupBy("shard", "string").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(
        F.col("first") < F.col("last")).drop("last")
    # the strings of one tuple overlap in the bytes that make its shard
    return strings.join(earliest, ["shard", "string"]).filter(place > F.col("first")).groupBy("key", "shard", "at").agg(
        F.min("start").alias("start"), (F.max("start") + LENGTH).alias("end")).select("key", "start", "end")


def _keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """(key, doc_id, text) with a key that orders documents and tells them apart, and whether
    any key stands on several rows.

    The key is the doc_id, unless ids are null or stand for several texts; then documents
    are numbered by (doc_id, text hash), nulls first.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"))
    ids = hashed.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count(F.lit(1)).alias("n"))
    seen = ids.agg(F.max(F.col("doc_id").isNull() | (F.col("a") != F.col("b"))).alias("odd"), F.max("n").alias("n")).first()
    if not seen["odd"]:
        return docs.select(F.col("doc_id").cast("long").alias("key"), "doc_id", "text"), (seen["n"] or 0) > 1
    block = Window.partitionBy("block").orderBy("doc_id", "h")
    rows = hashed.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("rows")).repartitionByRange("doc_id", "h")
    rows = scratch.keep(rows.withColumn("block", F.spark_partition_id()), "ids")
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("block", F.coalesce(F.sum("n").over(  # one row per partition
        Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = rows.withColumn("i", F.row_number().over(block)).join(before, "block").select(
        F.col("doc_id").alias("id"), "h", (F.col("i") + F.col("before")).cast("long").alias("key"))
    return docs.join(numbered, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("h"))).select(
        "key", "doc_id", "text"), not rows.filter("rows > 1").isEmpty()


def repeated_spans(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, start, end) of bytes under strings that also start earlier; spans may overlap."""
    rows = keyed.select("key", "text").mapInArrow(_scan, "gram bigint, around bigint, key bigint, pos int, settled boolean")
    parts = keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = rows.repartition(int(parts), "gram").sortWithinPartitions("gram", "around", "key", "pos")
    classed = scratch.keep(rows.mapInArrow(_classify, "key bigint, pos int, open boolean"), "classed")
    whole = classed.filter(~F.col("open")).select(
        "key", F.greatest(F.lit(0), F.col("pos") - REACH).alias("start"), (F.col("pos") + LENGTH).alias("end"))
    places = classed.filter("open").groupBy("key").agg(F.collect_list("pos").alias("places"))
    tuples = keyed.select("key", "text").join(places, "key").mapInArrow(
        _contexts, "shard bigint, part int, follows binary, precedes binary, key bigint, pos int")
    tuples = tuples.repartition(int(parts), "shard").sortWithinPartitions("part", "shard", "follows")
    partial = tuples.mapInArrow(_inducer(GROUP_ROWS), "key bigint, start int, end int, shard bigint, strings array<bigint>")
    found = scratch.keep(whole.unionByName(partial, allowMissingColumns=True), "spans")
    scratch.drop("classed")
    spans = found.filter(F.col("end").isNotNull()).select("key", "start", "end")
    large = found.filter(F.col("end").isNull())
    return spans if large.isEmpty() else spans.unionByName(_later_strings(large))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        sizes, removed, spans, shas, texts = [], [], [], [], []
        for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends")), strict=True):
            raw = text.encode()
            runs: list[list[int]] = []
            for a, b in sorted(zip(starts or [], ends or [], strict=True)):
                b = min(b, len(raw))
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            kept, at = [], 0
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rest = b"".join(kept)
            sizes.append(len(raw))
            removed.append(len(raw) - len(rest))
            spans.append(len(runs))
            shas.append(hashlib.sha256(rest).hexdigest())
            texts.append(rest)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
             pa.array(shas, pa.string()), pa.array(texts, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def cut_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept holds the bytes.

    Strings of ``LENGTH`` bytes are compared inside and across documents, not over their
    borders; earlier is the smaller doc_id, then the earlier start. Null is the empty text,
    which like any shorter than ``LENGTH`` bytes keeps everything. Rows that repeat both id
    and text are one document and get the same result.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    keyed, repeated = _keyed(docs, scratch)
    # a row that repeats id and text is not an earlier document
    once = keyed.select("key", "text").dropDuplicates(["key"]) if repeated else keyed
    spans = repeated_spans(once, scratch).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("s")).select(
        "key", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
    kind = dict(docs.dtypes)["doc_id"]
    return keyed.join(spans, "key", "left").select("doc_id", "text", "starts", "ends").mapInArrow(
        _cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def report(docs: DataFrame) -> DataFrame:
    return cut_repeats(docs).drop("kept")
