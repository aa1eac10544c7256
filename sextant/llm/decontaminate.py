"""Benchmark decontamination: a broadcast hash set of the test n-grams and a scan of the corpus.

The normalised n-grams of a bounded block of items are broadcast as a sorted array of
hashes; every text is scanned once per block, hits are verified on the words themselves,
and the hit words, or the documents, are removed. Item tables beyond the bound are scanned
for block after block: one block at a time is in the driver and the workers, its hits are
written as narrow rows, and the hits of all blocks are joined back by a digest of the text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.llm import textscan as S
from sextant.llm.common import Scratch, fresh

WINDOW = 10
# item text per broadcast; the hash set takes some twenty times as much in a worker
BROADCAST_BYTES = 4 << 20


class GramSet:
    """Windows of some items: sorted hashes, and per hash the items and their words."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = WINDOW):
        grams: dict[int, list[tuple[tuple[bytes, ...], set[str]]]] = defaultdict(list)
        by_size: dict[int, set[int]] = defaultdict(set)
        texts = pa.array([t for _, t in items], pa.string())
        for row, data, offsets in S.blocks(texts):
            low = S.LOWER[data]
            start, end, owner = S.word_spans(low, offsets, S.WORD_BYTES)
            hashes, raw = S.word_hashes(low, start, end), low.tobytes()
            counts = np.bincount(owner, minlength=len(offsets) - 1)
            for length in {min(size, int(c)) for c in counts if c}:
                first, gram = S.windows(hashes, owner, length)
                whole = (counts[owner[first]] >= size) if length == size else (counts[owner[first]] == length)
                for f, g in zip(first[whole].tolist(), gram[whole].tolist(), strict=True):
                    item = items[row + int(owner[f])][0]
                    text = tuple(raw[start[k]:end[k]] for k in range(f, f + length))
                    name = "" if item is None else str(item)
                    for known, ids in grams[g]:
                        if known == text:
                            ids.add(name)
                            break
                    else:
                        grams[g].append((text, {name}))
                    by_size[length].add(g)
        self.grams = dict(grams)
        self.hashes = {n: np.array(sorted(g), dtype=np.uint64) for n, g in by_size.items()}

    def hits(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray,
             hashes: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, words, items) of every verified window of a block."""
        raw = None
        for length, known in self.hashes.items():
            first, gram = S.windows(hashes, owner, length)
            at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
            found = np.flatnonzero(known[at] == gram)
            if len(found) and raw is None:
                raw = data.tobytes()
            for f, g in zip(first[found].tolist(), gram[found].tolist(), strict=True):
                text = tuple(raw[start[k]:end[k]] for k in range(f, f + length))
                for words, ids in self.grams[g]:
                    if words == text:
                        yield f, length, ids


def _scanner(shared, text: str, names: list[str]):
    """Batch function: adds the number of words, the hit runs and the items of every row."""
    n_name, run_name, item_name = names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: GramSet = shared.value
        for batch in batches:
            rows = batch.num_rows
            n_words = np.zeros(rows, dtype=np.int64)
            runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
            items: dict[int, set[str]] = defaultdict(set)
            for row, data, offsets in S.blocks(batch.column(text)):
                low = S.LOWER[data]
                start, end, owner = S.word_spans(low, offsets, S.WORD_BYTES)
                counts = np.bincount(owner, minlength=len(offsets) - 1)
                n_words[row:row + len(counts)] = counts
                before = np.concatenate(([0], np.cumsum(counts)))
                for f, length, ids in grams.hits(low, start, end, owner, S.word_hashes(low, start, end)):
                    k = int(owner[f])
                    runs[row + k].append((f - int(before[k]), length))
                    items[row + k] |= ids
            run_lists = [[x for pair in sorted(runs[i]) for x in pair] if i in runs else [] for i in range(rows)]
            item_lists = [sorted(items[i]) if i in items else [] for i in range(rows)]
            kept = {c: batch.column(c) for c in batch.schema.names if c not in names}
            yield pa.RecordBatch.from_pydict(kept | {
                n_name: pa.array(n_words), run_name: pa.array(run_lists, pa.list_(pa.int32())),
                item_name: pa.array(item_lists, pa.list_(pa.string()))})

    return scan


def _item_blocks(items: DataFrame) -> list[DataFrame]:
    """Items in blocks of a bounded number of bytes; nothing is collected yet."""
    narrow = items.select(F.col("item_id").alias("id"), F.col("text").alias("text")).filter(F.col("text").isNotNull())
    size = narrow.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    # hashed blocks are near their mean; half the bound leaves room
    count = max(1, -(-2 * size // BROADCAST_BYTES)) if size > BROADCAST_BYTES else 1
    place = F.pmod(F.xxhash64("id", "text"), F.lit(count))
    return [narrow.filter(place == k) for k in range(count)]


def scan(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW) -> tuple[DataFrame, list[str]]:
    """``docs`` plus (number of words, hit runs, items); returns the frame and the three names.

    Hit runs are ``[first word, words, first word, words, ...]``. Null and empty texts have
    no words and no hits; items without words, and an empty item table, hit nothing.
    Repeated rows and repeated items change nothing for each other.
    """
    names = fresh(docs, "n_words", "runs", "items")
    context = docs.sparkSession.sparkContext
    kinds = (T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType()))
    added = [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]

    def scanned(df: DataFrame, shared) -> DataFrame:
        return df.mapInArrow(_scanner(shared, text, names), T.StructType([*df.schema.fields, *added]))

    def gram_set(block: DataFrame) -> GramSet:
        return GramSet([(r["id"], r["text"]) for r in block.collect()], window)

    blocks = _item_blocks(items)
    if len(blocks) == 1:
        return scanned(docs, context.broadcast(gram_set(blocks[0]))), names
    digest, pairs, ids = fresh(docs, "digest", "pairs", "ids")
    n_name, run_name, item_name = names
    scratch = Scratch(docs.sparkSession, "hits")
    narrow = docs.select(F.md5(text).alias(digest), text)
    found = None
    for k, block in enumerate(blocks):
        shared = context.broadcast(gram_set(block))
        hits = scratch.keep(scanned(narrow, shared).filter(F.size(run_name) > 0).select(digest, run_name, item_name), f"block{k}")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    run = F.transform(F.sequence(F.lit(0), F.size(run_name) - 2, F.lit(2)), lambda i: F.struct(
        F.get(run_name, i).alias("f"), F.get(run_name, i + 1).alias("n")))
    # rows equal in text have equal hits, which count once
    found = found.groupBy(digest).agg(F.collect_set(run).alias(pairs), F.collect_set(item_name).alias(ids)).select(
        digest, F.array_sort(F.array_distinct(F.flatten(pairs))).alias(pairs), F.array_sort(F.array_distinct(F.flatten(ids))).alias(ids))
    counted = scanned(docs, context.broadcast(GramSet([], window))).withColumn(digest, F.md5(text))
    runs = F.flatten(F.transform(pairs, lambda p: F.array(p["f"], p["n"])))
    return counted.join(found, digest, "left").select(
        *[F.col(f"`{c}`") for c in docs.columns], n_name, F.coalesce(runs, run_name).alias(run_name),
        F.coalesce(ids, item_name).alias(item_name)), names


def _union_length():
    """Words under the union of the hit runs, which are sorted by their first word."""

    @F.pandas_udf("long")
    def length(runs):
        return runs.map(lambda r: S.merged_length(np.asarray(r[::2]), np.asarray(r[1::2])))

    return length


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    out, (n, runs, ids) = scan(docs.select("doc_id", "text"), items)
    hit = F.when(F.size(runs) == 0, F.lit(0)).otherwise(_union_length()(F.col(runs)))
    out = out.select("doc_id", F.col(n).alias("n_words"), hit.cast("long").alias("n_hit"),
                     F.size(ids).cast("long").alias("n_items"),
                     F.sha2(F.array_join(F.col(ids), ","), 256).alias("items_sha256"),
                     (F.size(runs) > 0).alias("contaminated"))
    return out


def digest_of(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit; columns as they are."""
    out, (_, runs, _) = scan(docs, items, text)
    return out.filter(F.size(runs) == 0).select(*docs.columns)


def cut_spans(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the hit words, and what stands between words of one run, cut from the text."""
    out, names = scan(docs, items, text)
    runs = names[1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for i, pairs in enumerate(batch.column(runs).to_pylist()):
                if not pairs:
                    continue
                raw = texts[i].encode()
                data = np.frombuffer(raw, dtype=np.uint8)
                start, end, _ = S.word_spans(S.LOWER[data], np.array([0, len(raw)]), S.WORD_BYTES)
                keep = np.ones(len(raw), dtype=bool)
                for f, length in zip(pairs[::2], pairs[1::2], strict=True):
                    keep[start[f]:end[f + length - 1]] = False
                texts[i] = data[keep].tobytes().decode()
            column = batch.schema.get_field_index(text)
            batch = batch.set_column(column, text, pa.array(texts, pa.string()))
            yield batch.select([c for c in batch.schema.names if c not in names])

    return out.mapInArrow(cut, docs.schema)
