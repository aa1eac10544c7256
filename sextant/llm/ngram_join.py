"""Exact n-gram Jaccard join: fixed-size subsets for small sets, inverted lists for large ones.

A first filter reads every text once. Each document keeps its smallest hashes, more than a
prefix filter needs, and counts over all documents say which of them are shared; a document
that shares too few to reach any link is done. So a passage that many documents share leaves
no trace as long as it makes up less than a third of a document.

The rest is joined by size. Equal sets are one class. Shingles are counted again over the
whole sets of these classes, and each class keeps its rarest ones: as many as leave, with any
class it links to, at least one in common (inverted lists) or two (subsets). Small sets
enumerate pairs of them, large sets read the list of each one; the size at which this changes
is where the summed costs of all sets are least. Within a list, members are compared with one
hub after the other, and only with members that are not yet connected to it. What still falls
apart after a few hubs is compared block by block inside tasks, which yield only pairs that may
connect components. Parity sketches, whose distance never exceeds that of the sets, tell most
pairs apart before whole sets are moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sextant.llm import textscan as S
from sextant.llm.common import Scratch, fresh
from sextant.llm.graph import components

WORDS = 5
# similarity threshold as a fraction: intersection * 5 >= union * 4
NUMERATOR, DENOMINATOR = 4, 5
EXTRA_SHARE = 10  # a prefix is longer than necessary by n / EXTRA_SHARE hashes
HUB_ROUNDS = 3
LONG_WORD = 64  # bytes from which a word is hashed by itself
SKETCH_BITS = 512
LIST_BLOCK = 512  # members of a list that are compared in one group with another block


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles of a block, ordered by both."""
    low = S.LOWER[data]
    start, end, owner = S.word_spans(low, offsets, S.NOT_SPACE)
    hashes = S.word_hashes(low, start, end)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():  # sums over a ring of powers of two repeat for crafted words
        hashes[i] = xxhash.xxh3_64_intdigest(low[start[i]:end[i]].tobytes())
    first, grams = S.windows(hashes, owner, WORDS)
    owners = owner[first]
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    for length in range(1, WORDS):  # short texts: the whole sequence is one shingle
        if np.any(counts == length):
            f, g = S.windows(hashes, owner, length)
            whole = counts[owner[f]] == length
            owners, grams = np.concatenate([owners, owner[f[whole]]]), np.concatenate([grams, g[whole]])
    order = np.lexsort((grams, owners))
    owners, grams = owners[order], grams[order]
    if len(grams):
        fresh_one = np.ones(len(grams), dtype=bool)
        fresh_one[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
        owners, grams = owners[fresh_one], grams[fresh_one]
    return owners, grams


def _least_overlap(n: np.ndarray) -> np.ndarray:
    """Smallest intersection of a set of ``n`` with any set it links to."""
    return -(-NUMERATOR * n // DENOMINATOR)


def _prefix_length(n: np.ndarray) -> np.ndarray:
    least = _least_overlap(n)
    return n - least + np.minimum(np.maximum(2, -(-n // EXTRA_SHARE)), least)


def _set_columns(data: np.ndarray, offsets: np.ndarray):
    """Per text: size, two fingerprints of the set, and the bounds of its hashes."""
    owners, grams = shingle_sets(data, offsets)
    texts = len(offsets) - 1
    n = np.bincount(owners, minlength=texts)
    bounds = np.concatenate(([0], np.cumsum(n)))
    prints = []
    for salt in (0x51ED270B, 0x2545F491):
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(S.mix(grams ^ np.uint64(salt)))))
        prints.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return n, prints, bounds, grams


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for _, data, offsets in S.blocks(batch.column("text")):
            texts = len(offsets) - 1
            n, prints, bounds, grams = _set_columns(data, offsets)
            length = np.where(n > 1, _prefix_length(n), 0)
            ends = np.concatenate(([0], np.cumsum(length)))
            pick = np.repeat(bounds[:-1] - ends[:-1], length) + np.arange(ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(grams[pick].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, texts), batch.column("text_hash").slice(at, texts), pa.array(n.astype(np.int64)),
                 pa.array(prints[0]), pa.array(prints[1]), lists],
                ["doc_id", "text_hash", "n", "f1", "f2", "prefix"])
            at += texts


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, f1, f2, prefix) of every row of (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash")).mapInArrow(
        _signatures, f"doc_id {kind}, text_hash bigint, n bigint, f1 bigint, f2 bigint, prefix array<bigint>")


def _sketches(n: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Parity of the hashes in each of ``SKETCH_BITS`` places, as signed words per text."""
    owner = np.repeat(np.arange(len(n)), n)
    place = (grams >> np.uint64(20)).astype(np.int64) % SKETCH_BITS
    odd = np.bincount(owner * SKETCH_BITS + place, minlength=len(n) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(n), SKETCH_BITS), axis=1).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for _, data, offsets in S.blocks(batch.column("text")):
            texts = len(offsets) - 1
            n, prints, bounds, grams = _set_columns(data, offsets)
            same = (prints[0] == batch.column("f1").slice(at, texts).to_numpy()) & (
                prints[1] == batch.column("f2").slice(at, texts).to_numpy())
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(grams.view(np.int64)))
            sketches = pa.FixedSizeListArray.from_arrays(pa.array(_sketches(n, grams).reshape(-1)), SKETCH_BITS // 64)
            found = pa.RecordBatch.from_arrays([batch.column("node").slice(at, texts), lists,
                                                sketches.cast(pa.list_(pa.int64()))], ["node", "hashes", "sketch"])
            yield found.filter(pa.array(same))
            at += texts


def _candidates(signed: DataFrame) -> DataFrame:
    """(row) of the documents whose shared prefix hashes suffice for a link."""
    postings = signed.select("row", F.explode("prefix").alias("token"))
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1).select("token")
    held = postings.join(shared, "token").groupBy("row").agg(F.count(F.lit(1)).alias("held"))
    sizes = signed.select("row", "n", F.size("prefix").alias("length"))
    return held.join(sizes, "row").filter(_needed(F.col("length") - F.col("held")) > 0).select("row")


def _needed(alone: Column) -> Column:
    """Shared hashes to look at so that every linked class is met, given those shared with none."""
    least = F.floor((F.col("n") * NUMERATOR + DENOMINATOR - 1) / DENOMINATOR)
    return F.col("n") - least + 1 - alone


def _probes(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, n, token, df, place, need, purity): the rarest shared hashes of each class.

    ``need`` of them reach every linked class by one common hash; one more, by two. A class
    whose unshared hashes already exceed what a link may miss has no row.
    """
    postings = sets.select("node", F.explode("hashes").alias("token"))
    counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    held = postings.join(counts, "token")
    by_class = Window.partitionBy("node")
    held = held.select("node", "token", "df", F.count(F.lit(1)).over(by_class).alias("held"),
                       F.row_number().over(by_class.orderBy("df", "token")).alias("place"))
    held = held.join(sets.select("node", F.size("hashes").alias("n")), "node")
    alone = F.col("n") - F.col("held")
    held = held.select("node", "n", "token", "df", "place", _needed(alone).cast("int").alias("need"),
                       F.floor(alone * 1000 / F.col("n")).cast("int").alias("purity"))
    return scratch.keep(held.filter((F.col("need") > 0) & (F.col("place") <= F.col("need") + 1)), "probes")


def _boundary(probes: DataFrame) -> int:
    """Largest size that enumerates subsets: where the rows written for both forms are fewest.

    A class writes a row per subset, or a row per list; either is read once more by the hub of
    its key, but a subset only if another class shares it. Lists therefore cost two rows an
    entry, subsets one and the measured share of probes that stand in a list of three or more,
    whose subsets others are likely to hold. Sizes are summed in classes a quarter apart, so a
    few dozen rows come to the driver.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    rows = probes.groupBy(size_class.alias("c")).agg(
        F.max("n").alias("n"), F.sum(F.when(F.col("place") <= F.col("need"), 2).otherwise(0)).alias("lists"),
        F.sum(F.col("place") - 1).alias("subsets"), F.avg(F.when(F.col("df") > 2, 1.0).otherwise(0.0)).alias("shared")).orderBy("c").collect()
    best, at, total = None, 1, sum(r["lists"] for r in rows)
    for r in rows:
        total += r["subsets"] * (1 + r["shared"]) - r["lists"]
        if best is None or total < best:
            best, at = total, r["n"]
    return at if best is not None and best < sum(r["lists"] for r in rows) else 1


def _members(probes: DataFrame, boundary: int) -> DataFrame:
    """(key, node, n, purity): members of the lists of small sets (a key per pair of hashes)
    and of large sets (a key per hash, read also by sets just below the boundary)."""
    small = probes.filter(F.col("n") <= boundary).groupBy("node").agg(
        F.first("n").alias("n"), F.first("purity").alias("purity"), F.sort_array(F.collect_list("token")).alias("t"))
    t = F.col("t")
    subsets = F.flatten(F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.transform(
        F.slice(t, i + 1, F.size(t)), lambda y: F.xxhash64(F.element_at(t, i), y))))
    light = small.filter(F.size(t) > 1).select(F.explode(subsets).alias("key"), "node", "n", "purity")
    lowest = -(-NUMERATOR * (boundary + 1) // DENOMINATOR)
    heavy = probes.filter((F.col("n") >= lowest) & (F.col("place") <= F.col("need"))).select(
        F.col("token").alias("key"), "node", "n", "purity")
    return light.unionByName(heavy)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for left, right in zip(batch.column("h1"), batch.column("h2"), strict=True):
            a, b = (x.values.to_numpy().view(np.uint64) for x in (left, right))
            short, long = (a, b) if len(a) <= len(b) else (b, a)
            at = np.minimum(np.searchsorted(long, short), len(long) - 1)
            both = int(np.count_nonzero(long[at] == short))
            linked.append(both * DENOMINATOR >= (len(a) + len(b) - both) * NUMERATOR)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_())], ["u", "v", "linked"])


def _farthest(sizes):
    """Most elements in which two linked sets can differ, given the sum of their sizes."""
    return sizes * (DENOMINATOR - NUMERATOR) / (DENOMINATOR + NUMERATOR)


def _sizes_fit(n: Column, m: Column) -> Column:
    return F.least(n, m) * DENOMINATOR >= F.greatest(n, m) * NUMERATOR


def hash_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, hashes) of the given classes, from the text of one document each."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash")).alias("d")
    w = classes.select("node", "doc_id", "text_hash", "f1", "f2").alias("w")
    texts = w.join(d, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash")))
    found = texts.select("node", "f1", "f2", "d.text").mapInArrow(
        _sets, "node bigint, hashes array<bigint>, sketch array<bigint>")
    return found.groupBy("node").agg(F.any_value("hashes").alias("hashes"), F.any_value("sketch").alias("sketch"))  # repeated rows


class _Linker:
    """Verified links between classes."""

    def __init__(self, sets: DataFrame, scratch: Scratch):
        self.sets, self.scratch, self.round = sets, scratch, 0

    def links(self, pairs: DataFrame) -> DataFrame:
        """(u, v) of the given pairs whose sets link."""
        self.round += 1
        one = self.sets.select(F.col("node").alias("u"), F.col("sketch").alias("s1"), F.size("hashes").alias("n1"))
        two = self.sets.select(F.col("node").alias("v"), F.col("sketch").alias("s2"), F.size("hashes").alias("n2"))
        apart = F.aggregate(F.zip_with("s1", "s2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
        pairs = pairs.join(one, "u").join(two, "v").filter(apart <= _farthest(F.col("n1") + F.col("n2"))).select("u", "v")
        pairs = self.scratch.keep(pairs, f"pairs{self.round}")
        one = self.sets.select(F.col("node").alias("u"), F.col("hashes").alias("h1"))
        two = self.sets.select(F.col("node").alias("v"), F.col("hashes").alias("h2"))
        found = pairs.join(one, "u").join(two, "v").select("u", "v", "h1", "h2").mapInArrow(
            _overlaps, "u bigint, v bigint, linked boolean")
        return self.scratch.keep(found.filter("linked").select("u", "v"), f"links{self.round}")


def _with_labels(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _split_lists(members: DataFrame) -> DataFrame:
    """Members of the lists that still hold more than one component."""
    mixed = members.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter(
        F.col("a") != F.col("b")).select("key")
    return members.join(mixed, "key")


def _bridges(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs inside a list that may link two components, found block by block.

    A list is cut into blocks by hash; a member goes to one group per block of its list, and
    a group compares two blocks by their sketches. Groups are bounded, pairs of one component
    and pairs too far apart never leave them.
    """
    blocks = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("blocks"))
    placed = rows.join(blocks, "key").join(sets.select("node", "sketch"), "node").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block",
                           "node", "n", "label", "sketch")
    group = ("key", "b1", "b2")
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(width, *group).sortWithinPartitions(*group).mapInArrow(
        _compare_blocks, "u bigint, v bigint").distinct()


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group; the last group of a batch may go on in the next one."""
    kept: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        ends = _group_starts(rows)
        if len(ends) == 1:
            kept = rows
            continue
        cut = int(ends[-1])
        yield _close_pairs(rows.slice(0, cut), ends[:-1])
        kept = rows.slice(cut)
    if kept is not None and kept.num_rows:
        yield _close_pairs(kept, np.array([0]))


def _group_starts(rows: pa.Table) -> np.ndarray:
    changed = np.ones(rows.num_rows, dtype=bool)
    if rows.num_rows > 1:
        changed[1:] = False
        for name in ("key", "b1", "b2"):
            x = rows.column(name).to_numpy()
            changed[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(changed)


def _close_pairs(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    b1, b2, block, node, n, label = (rows.column(c).to_numpy() for c in ("b1", "b2", "block", "node", "n", "label"))
    sketch = rows.column("sketch").combine_chunks()
    sketch = sketch.flatten().to_numpy().reshape(rows.num_rows, -1).view(np.uint64) if rows.num_rows else None
    us, vs = [], []
    for a, b in zip(starts, [*starts[1:], rows.num_rows], strict=True):
        left = np.flatnonzero(block[a:b] == b1[a]) + a
        right = np.flatnonzero(block[a:b] == b2[a]) + a
        for i in left.tolist():
            far = np.bitwise_count(sketch[right] ^ sketch[i]).sum(axis=1)
            low, high = np.minimum(n[right], n[i]), np.maximum(n[right], n[i])
            near = (label[right] != label[i]) & (low * DENOMINATOR >= high * NUMERATOR) & (far <= _farthest(n[right] + n[i]))
            near &= node[right] != node[i] if b1[a] != b2[a] else right > i
            hits = node[right[near]]
            us.append(np.minimum(hits, node[i]))
            vs.append(np.maximum(hits, node[i]))
    empty = [np.zeros(0, dtype=np.int64)]
    pairs = np.unique(np.stack([np.concatenate(us or empty), np.concatenate(vs or empty)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])


def link_classes(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every class that links to another one.

    Lists are worked off hub by hub: the hub, the member with the fewest hashes of its own,
    is compared with all members of other components and leaves the list. After a few rounds
    the lists that still hold several components are compared block by block.
    """
    probes = _probes(sets, scratch)
    members = scratch.keep(_members(probes, _boundary(probes)), "members0")
    members = scratch.keep(_split_lists(members.withColumn("label", F.col("node"))).drop("label"), "members1")
    linker = _Linker(sets, scratch)
    labels, edges = None, None
    for turn in range(HUB_ROUNDS + 1):
        rows = scratch.keep(_split_lists(_with_labels(members, labels)), f"lists{turn}")
        if rows.isEmpty():
            break
        if turn < HUB_ROUNDS:
            rank = F.struct("purity", "node", "n", "label")
            hubs = rows.groupBy("key").agg(F.min(rank).alias("hub"))
            met = rows.join(hubs, "key")
            pairs = met.filter((F.col("label") != F.col("hub.label")) & _sizes_fit(F.col("n"), F.col("hub.n"))).select(
                F.col("hub.node").alias("u"), F.col("node").alias("v")).distinct()
            members = met.filter(F.col("node") != F.col("hub.node")).select("key", "node", "n", "purity")
        else:
            pairs = _bridges(rows, sets)
        found = linker.links(pairs)
        edges = found if edges is None else edges.unionByName(found)
        labels = components(edges, scratch, f"labels{turn}_")
    if labels is None:
        return sets.select("node", F.col("node").alias("label")).limit(0)
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) of every row of (doc_id, text).

    The set of a text is its distinct 5-word shingles, or its whole word sequence if that is
    shorter; texts without words, null or empty, have no set and no links. Two texts link
    when the intersection is at least four fifths of the union. ``component_id`` is the
    smallest doc_id reachable, nulls left aside; rows that repeat an id or a text count as
    documents of their own. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "ngram")
    docs = docs.select("doc_id", "text")
    signed = scratch.keep(signatures(docs).withColumn("row", F.monotonically_increasing_id()), "signed")
    narrow = signed.drop("prefix")
    candidates = scratch.keep(_candidates(signed.filter(F.col("n") > 1)), "candidates")
    narrow = scratch.keep(narrow, "narrow")
    scratch.drop("signed")
    classes = narrow.filter(F.col("n") > 0).groupBy("f1", "f2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")).alias("m"))
    classes = scratch.keep(classes.select(F.monotonically_increasing_id().alias("node"), "f1", "f2",
                                          F.col("m.doc_id").alias("doc_id"), F.col("m.text_hash").alias("text_hash")), "classes")
    compared = narrow.join(candidates, "row").select("f1", "f2").distinct()
    sets = scratch.keep(hash_sets(docs, classes.join(compared, ["f1", "f2"])), "sets")
    labels = link_classes(sets, scratch)
    named = classes.select("node", "f1", "f2", "doc_id").join(labels, "node")
    lowest = named.groupBy("label").agg(F.min("doc_id").alias("lowest"))
    linked = named.join(lowest, "label").select("f1", "f2", "lowest")
    own = classes.select("f1", "f2", F.col("doc_id").alias("own"))
    final = own.join(linked, ["f1", "f2"], "left").select("f1", "f2", F.coalesce("lowest", "own").alias("lowest"), F.lit(1).alias("known"))
    return narrow.drop("row").join(final, ["f1", "f2"], "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).drop("text_hash")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each component: that of its smallest doc_id; columns as they are.

    Rows that repeat both id and text are one document. A component of rows without ids
    keeps all of its different texts.
    """
    found = near_duplicates(docs.select("doc_id", F.col(text).alias("text"))).select(
        "doc_id", "text_hash", "component_id")
    scratch = Scratch(docs.sparkSession, "keepers")
    found = scratch.keep(found, "found")
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash").distinct()
    repeated = scratch.keep(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "text_hash").count()
                            .filter(F.col("count") > 1).drop("count"), "repeated")
    key = fresh(docs, "text_hash")[0]
    rows = docs.withColumn(key, F.xxhash64(F.col(text).cast("string"))).alias("d")

    def same(side: str) -> Column:
        return F.col("d.doc_id").eqNullSafe(F.col(f"{side}.doc_id")) & (F.col(f"d.{key}") == F.col(f"{side}.text_hash"))

    kept = rows.join(gone.alias("g"), same("g"), "left_anti")
    if not repeated.isEmpty():
        kept = kept.alias("d")
        once = kept.join(repeated.alias("r"), same("r"), "left_semi").dropDuplicates(["doc_id", key])
        kept = kept.join(repeated.alias("r"), same("r"), "left_anti").unionByName(once)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
