"""Token counts with a byte-level BPE vocabulary compiled to a counting transducer.

The vocabulary and its merges become a deterministic automaton over bytes whose transitions
carry the change of the token count. A state holds the boundaries from which a token can
still end later: the trie node reached since, the token before, and the count there, relative
to now. Exactly one of them admits the next token under the merge rules, so the count of a
piece is the sum along its path and no merge is run on the text. States and transitions are
built when they are first needed and shared by all pieces.

A very long text is read in chunks. A chunk becomes a map (bytes before its first sure
border, count between the borders, bytes after the last one); maps are composed in pairs,
level by level, which gives the count whatever state a chunk was entered in.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import textscan as S

LETTER, NUMBER, SPACE, OTHER_SPACE, OTHER = range(5)
# entries kept per worker before its tables are begun anew
MAX_PIECES = 400_000
MAX_STATES = 300_000
LIMIT = 512


def _byte_symbols() -> dict[str, int]:
    """Characters that stand for bytes in the file: printable Latin-1 for itself, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _character_classes(path: str) -> np.ndarray:
    """Class of every code point as the library's own splitter sees it.

    Unicode data differ between libraries, so letters and numbers are the candidates that
    the splitter joins to a letter or a digit.
    """
    import regex
    from tokenizers import Tokenizer

    splitter = Tokenizer.from_file(path).pre_tokenizer
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern, mate in ((LETTER, r"\p{L}", "a"), (NUMBER, r"\p{N}", "1")):
        probes = "".join(f"\n{mate}{c}" for c in regex.findall(pattern, every))
        for _, (first, last) in splitter.pre_tokenize_str(probes):
            if last - first == 2 and probes[first] == mate:
                classes[ord(probes[first + 1])] = kind
    for c in regex.findall(r"\s", every):
        classes[ord(c)] = OTHER_SPACE
    classes[32] = SPACE
    return classes


@dataclass(frozen=True)
class Compiled:
    """What the workers need of a tokenizer file; its size is that of the vocabulary."""

    tokens: tuple[bytes, ...]
    ids: tuple[int, ...]
    merges: tuple[tuple[int, int], ...]
    classes: bytes
    specials: tuple[bytes, ...]


def compile_tokenizer(path: str) -> Compiled:
    """Read a byte-level BPE file without normaliser; other kinds are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, splitter = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or splitter["type"] != "ByteLevel" or spec["normalizer"] or splitter["add_prefix_space"]:
        raise ValueError(f"{path} is not a plain byte-level BPE")
    symbols = _byte_symbols()
    added = {t["content"] for t in spec["added_tokens"]}
    vocabulary = {bytes(symbols[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = tuple((vocabulary[bytes(symbols[c] for c in a)], vocabulary[bytes(symbols[c] for c in b)]) for a, b in pairs)
    import zlib

    return Compiled(tuple(vocabulary), tuple(vocabulary.values()), merges,
                    zlib.compress(_character_classes(path).tobytes()),
                    tuple(t["content"].encode() for t in spec["added_tokens"]))


class CountTransducer:
    """Automaton over bytes; transitions give the change of the number of tokens."""

    def __init__(self, compiled: Compiled):
        self.bytes_of = dict(zip(compiled.ids, compiled.tokens, strict=True))
        self.id_of = dict(zip(compiled.tokens, compiled.ids, strict=True))
        self.merged = {}
        for rank, (a, b) in enumerate(compiled.merges):
            self.merged.setdefault((a, b), (rank, self.id_of[self.bytes_of[a] + self.bytes_of[b]]))
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.inner = [True]
        for text, i in self.id_of.items():
            node = 0
            for b in text:
                self.inner[node] = True
                key = node << 8 | b
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.states = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]
        self.counts: dict[bytes, int] = {}

    def merge(self, text: bytes) -> list[int]:
        """The merge rules themselves, used on pairs of tokens only."""
        ids = [self.id_of[bytes((b,))] for b in text]
        while len(ids) > 1:
            best = min((self.merged[p] for p in zip(ids, ids[1:], strict=False) if p in self.merged), default=None)
            if best is None:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.merged.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _fit(self, left: int, right: int) -> bool:
        """Whether two tokens can stand side by side (left is -1 at the start)."""
        known = self.fits.get((left, right))
        if known is None:
            head = b"" if left < 0 else self.bytes_of[left]
            known = self.merge(head + self.bytes_of[right]) == ([right] if left < 0 else [left, right])
            self.fits[left, right] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        reached, last = [], None
        for node, before, count in self.states[state]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            token = self.token[to]
            if last is None and token >= 0 and self._fit(before, token):
                last = (token, count + 1)
            if self.inner[to]:
                reached.append((to, before, count))
        token, change = last
        following = (*((n, t, c - change) for n, t, c in reached), (0, token, 0))
        number = self.number.get(following)
        if number is None:
            number = self.number[following] = len(self.states)
            self.states.append(following)
            self.moves.append({})
        self.moves[state][byte] = (number, change)
        return number, change

    def count(self, piece: bytes) -> int:
        known = self.counts.get(piece)
        if known is not None:
            return known
        if len(self.states) >= MAX_STATES:
            self._restart()
        if len(self.counts) >= MAX_PIECES:
            self.counts.clear()
        state = total = 0
        for byte in piece:
            state, change = self.moves[state].get(byte) or self._move(state, byte)
            total += change
        self.counts[piece] = total
        return total


class Counter:
    """Token counts of blocks of texts."""

    def __init__(self, compiled: Compiled):
        import zlib

        self.transducer = CountTransducer(compiled)
        self.classes = np.frombuffer(zlib.decompress(compiled.classes), dtype=np.uint8)
        self.specials = compiled.specials

    def _chars(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, class) of every character."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at]
        kinds = self.classes[lead]
        wide = np.flatnonzero(lead >= 0x80)
        if len(wide):
            follow = [data[np.minimum(at[wide] + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
            b = lead[wide].astype(np.int64)
            code = np.where(b < 0xE0, (b & 0x1F) << 6 | follow[0], np.where(
                b < 0xF0, (b & 0x0F) << 12 | follow[0] << 6 | follow[1],
                (b & 0x07) << 18 | follow[0] << 12 | follow[1] << 6 | follow[2]))
            kinds = kinds.copy()
            kinds[wide] = self.classes[np.minimum(code, 0x10FFFF)]
        return at, kinds

    def _special_spans(self, raw: bytes, offsets: np.ndarray) -> list[tuple[int, int]]:
        spans = []
        for special in self.specials:
            at = raw.find(special)
            while at >= 0:
                end = at + len(special)
                if np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, end - 1, side="right"):
                    spans.append((at, end))
                    at = raw.find(special, end)
                else:
                    at = raw.find(special, at + 1)
        return sorted(spans)

    def count_block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of every text of a block."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(texts, dtype=np.int64)
        raw = data.tobytes()
        at, kinds = self._chars(data)
        n = len(at)
        spans = self._special_spans(raw, offsets)
        cuts = np.unique(np.concatenate([offsets[:-1], np.array(spans, dtype=np.int64).reshape(-1)]))
        cuts = np.searchsorted(at, cuts[cuts < len(data)])
        opens = np.zeros(n + 1, dtype=bool)
        opens[cuts] = True
        opens[n] = True
        blank = (kinds == SPACE) | (kinds == OTHER_SPACE)
        group = np.where(blank, SPACE, kinds)
        begins = opens[:n].copy()
        begins[1:] |= group[1:] != group[:-1]
        joined = np.zeros(n, dtype=bool)  # a single space goes to the run behind it
        joined[1:] = ~opens[1:n] & ~blank[1:] & (kinds[:-1] == SPACE)
        start = begins & ~joined
        start[:-1] |= blank[:-1] & ~blank[1:] & ~opens[1:n]
        # 's 't 'm 'd 're 've 'll behind a border
        quotes = np.flatnonzero(start & (data[at] == 39))
        quotes = quotes[quotes + 1 < n]
        quotes = quotes[~opens[quotes + 1]]
        one = data[at[quotes + 1]]
        third = np.minimum(quotes + 2, n - 1)
        two = np.where((quotes + 2 < n) & ~opens[third], data[at[third]], 0)
        short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
        long = (((one == 114) | (one == 118)) & (two == 101)) | ((one == 108) & (two == 108))
        length = np.where(short, 2, np.where(long, 3, 0))
        for q, k in zip(quotes[length > 0].tolist(), length[length > 0].tolist(), strict=True):
            start[q + 1] = False
            if k == 3:
                start[q + 2] = False
            if q + k < n:
                start[q + k] = True
        first = at[np.flatnonzero(start)]
        last = np.append(first[1:], len(data))
        keys = S.range_hashes(S.prefix_hashes(data), first, last)
        _, sample, which = np.unique(keys, return_index=True, return_inverse=True)
        count = self.transducer.count
        per_kind = np.fromiter((count(raw[a:b]) for a, b in zip(first[sample].tolist(), last[sample].tolist(), strict=True)),
                               dtype=np.int64, count=len(sample))
        per_piece = per_kind[which]
        # equal hashes are compared byte by byte; pieces that only share the hash are counted one by one
        shift = np.repeat(first[sample][which] - first, last - first)
        spot = np.arange(first[0], len(data))
        differs = np.logical_or.reduceat(data[spot + shift] != data[spot], first - first[0])
        for i in np.flatnonzero(differs).tolist():
            per_piece[i] = count(raw[first[i]:last[i]])
        for a, b in spans:
            inside = slice(*np.searchsorted(first, (a, b)))
            per_piece[inside] = 0
            per_piece[inside.start] = 1
        total = np.concatenate(([0], np.cumsum(per_piece)))
        border = np.searchsorted(first, offsets)
        return total[border[1:]] - total[border[:-1]]

    def count_bytes(self, raw: bytes) -> int:
        return int(self.count_block(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))[0]) if raw else 0

    def chunk_map(self, chunk: np.ndarray) -> tuple[bytes, int | None, bytes]:
        """(bytes before the first sure border, tokens between, bytes after the last); a piece
        always ends where ASCII white space follows a visible ASCII character."""
        visible = (chunk[:-1] > 32) & (chunk[:-1] < 127)
        border = np.flatnonzero(visible & ~S.NOT_SPACE[chunk[1:]]) + 1
        if not len(border):
            return chunk.tobytes(), None, b""
        a, b = int(border[0]), int(border[-1])
        return chunk[:a].tobytes(), self.count_bytes(chunk[a:b].tobytes()), chunk[b:].tobytes()

    def compose(self, left, right):
        head, count, tail = left
        head2, count2, tail2 = right
        if count is None:
            return (head + head2, count2, tail2)
        if count2 is None:
            return head, count, tail + head2
        return head, count + self.count_bytes(tail + head2) + count2, tail2

    def count_long(self, data: np.ndarray, chunk_bytes: int = S.BLOCK_BYTES) -> int:
        maps = [self.chunk_map(data[i:i + chunk_bytes]) for i in range(0, len(data), chunk_bytes)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, count, tail = maps[0]
        return self.count_bytes(head) + (count or 0) + self.count_bytes(tail)


_ready: dict[int, tuple[Compiled, Counter]] = {}


def _counter(compiled: Compiled) -> Counter:
    """One counter per worker and tokenizer, so its tables serve all tasks."""
    if id(compiled) not in _ready:
        _ready.clear()
        _ready[id(compiled)] = compiled, Counter(compiled)
    return _ready[id(compiled)][1]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Counts are those of the library without added begin or end; special strings inside a
    text are one token, as its default has it. A null or empty text has no bytes and no
    tokens. Repeated rows are counted one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compile_tokenizer(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            sizes, counts = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for row, data, offsets in S.blocks(batch.column("text")):
                last = row + len(offsets) - 1
                sizes[row:last] = np.diff(offsets)
                counts[row:last] = counter.count_long(data) if len(data) > S.BLOCK_BYTES else counter.count_block(data, offsets)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes),
                                              "n_tokens": pa.array(counts), "over_limit": pa.array(counts > limit)})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
