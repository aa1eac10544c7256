"""Toxicity of texts behind a noisy channel.

Disguised words are restored before anything is scored: every doubtful stretch (a token with
look-alike characters, separators or repeated letters, a line's letters set apart) becomes a
lattice of what its characters may stand for, with word borders, skipped separators and
letter doubling as transitions. A Viterbi search under a character trigram model, counted
over the whole corpus, finds the likeliest readings. Restored words and their beginnings are
the features of a ridge logistic regression on the labelled rows outside the held-out fold.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import Scratch

# labelled rows a fit uses at most (in expectation; chosen by hash); a documented bound
FIT_ROWS = 12_000
MAX_FEATURES = 4_000  # weights of the regression, the most telling first; with FIT_ROWS it bounds the fit
MIN_HITS = 3.0  # toxic documents behind a feature, copies counted once
MIN_EVIDENCE = 30.0  # log likelihood ratio of a feature: what chance gives to about one of ten million
RIDGE = 0.1
BEGINNINGS = range(3, 9)  # letters of the word beginnings that are features
BASE_SCORE = 0.02  # of a text without any feature
THRESHOLD = 0.7
SEVERAL = ("*1", "*2", "*3", "*4")  # features of having so many different telling words
ALONE = 3.0  # rows that a feature's own share of toxic rows counts for in the regression
READINGS, SPACED_READINGS = 3, 12
CACHE = 300_000
CHUNK_CHARS = 1_000_000
WINDOW = 64  # symbols of a stretch decoded at once; a longer one is decoded in windows that overlap by half

# letters of the model: word border, a-z, and the accented Latin-1 letters
LETTERS = "\x00abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
SIZE = len(LETTERS)
INDEX = {c: i for i, c in enumerate(LETTERS)}

# fixed values: characters and the letters they are used for
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SAME, SWAPPED, SKIPPED, REPEATED = (math.log(x) for x in (0.9, 0.3, 0.02, 0.2))
# a separator or blank: chance that the word goes on, chance that it ends
SEPARATOR, BLANK, WIDE = ((math.log(x), math.log(1 - x)) for x in (0.6, 0.8, 0.1))

_EDGE = re.compile(r"^[^\w@$!|+(€£]+|[^\w]+$")
_SPACED = re.compile(r"(?<!\w)(?:[^\W_]|[@$!|+(€£])(?:[ \t]+(?:[^\W_]|[@$!|+(€£])){2,}(?!\w)")
_ENDS = ".,;:?%&#*-"  # frequent ends of words that stand for no letter
_DOUBLE = re.compile(r"(.)\1+")


@dataclass(frozen=True)
class Model:
    trigrams: bytes  # log probabilities, SIZE ** 3 doubles
    weights: dict[str, float]


def _letter_codes() -> np.ndarray:
    codes = np.zeros(0x250, dtype=np.int64)
    for c, i in INDEX.items():
        if i:
            codes[ord(c)] = i
            upper = c.upper()
            if len(upper) == 1 and ord(upper) < len(codes):
                codes[ord(upper)] = i
    return codes


_CODES = _letter_codes()


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.zeros(SIZE ** 3, dtype=np.int64)
        part, size = [], 0
        texts = batch.column("text").to_pylist()
        for k, text in enumerate(texts):
            if text:
                part.append(text)
                size += len(text)
            if part and (k == len(texts) - 1 or size > CHUNK_CHARS):
                points = np.frombuffer(f"  {'  '.join(part)}  ".encode("utf-32-le", "replace"), dtype=np.uint32)
                c = _CODES[np.where(points < len(_CODES), points, 0)]
                key = (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]
                counts += np.bincount(key[c[1:-1] + c[2:] > 0], minlength=SIZE ** 3)
                part, size = [], 0
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["trigram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Smoothed trigram log probabilities from all texts; the table is as large as the alphabet allows."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_trigrams, "trigram bigint, n bigint")
    found = rows.groupBy("trigram").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(SIZE ** 3)
    n[found["trigram"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=float)
    n = n.reshape(SIZE, SIZE, SIZE)
    two = n.sum(axis=0)
    one = two.sum(axis=0) + 1.0
    p1 = one / one.sum()
    p2 = (two + 5.0 * p1) / (two.sum(axis=1, keepdims=True) + 5.0)
    p3 = (n + 5.0 * p2[None]) / (n.sum(axis=2, keepdims=True) + 5.0)
    return np.log(p3)


def _options(c: str, length: int) -> list[tuple[str, float]]:
    """What a run of one character may stand for; a blank in a reading is a word border."""
    if c in " \t":
        goes_on, ends = WIDE if length > 1 else BLANK
        return [("", goes_on), (" ", ends)]
    options: list[tuple[str, float]] = []
    for letter, cost in [(c, SAME)] * (c in INDEX) + [(x, SWAPPED) for x in LOOK_ALIKES.get(c, "")]:
        options.append((letter, cost + REPEATED * (length > 2)))
        if length > 1:
            options.append((letter * 2, cost if length == 2 else cost + REPEATED))
    if c not in INDEX:
        if c in LOOK_ALIKES:
            options.append(("", SKIPPED))
        else:
            options += [("", SEPARATOR[0]), (" ", SEPARATOR[1])]
    return options


def _decode(runs: list[tuple[str, int]], trigrams: list, best: int) -> list[str]:
    """Exact list Viterbi: a state is the last two letters, it keeps its best few paths."""
    front: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
    for c, length in runs:
        options = _options(c, length)
        following: dict[tuple[int, int], dict[str, float]] = {}
        for (a, b), paths in front.items():
            for letters, cost in options:
                x, y, gain = a, b, cost
                for letter in letters:
                    z = 0 if letter == " " else INDEX[letter]
                    if z == 0 and y == 0:
                        continue  # a border after a border is one border
                    gain += trigrams[x][y][z]
                    x, y = y, z
                state = following.setdefault((x, y), {})
                for s, text in paths:
                    longer = text if letters == " " and b == 0 else text + letters
                    if state.get(longer, -math.inf) < s + gain:
                        state[longer] = s + gain
        front = {key: sorted(((s, t) for t, s in paths.items()), reverse=True)[:best] for key, paths in following.items()}
    ends = [(s + (trigrams[a][b][0] if b else 0.0), text) for (a, b), paths in front.items() for s, text in paths]
    return [text for _, text in sorted(ends, reverse=True)[:best]]


def readings(stretch: str, trigrams: list) -> list[list[str]]:
    """The likeliest word sequences behind a lower-case stretch, best first.

    A long stretch is read in windows; the words at an inner edge of a window are left to
    the window that holds them whole.
    """
    runs = [(m.group(0)[0], len(m.group(0))) for m in re.finditer(r"[ \t]+|(.)\1*", stretch, re.S)]
    out, best = [], SPACED_READINGS if " " in stretch or "\t" in stretch else READINGS
    for start in range(0, max(1, len(runs) - WINDOW // 2), WINDOW // 2):
        last = start + WINDOW >= len(runs)
        for text in _decode(runs[start:start + WINDOW], trigrams, best):
            words = text.split(" ")
            out.append([w for w in words[(start > 0 and len(words) > 1):len(words) - (not last and len(words) > 1)] if w])
    return out


def squeeze(word: str) -> str:
    return _DOUBLE.sub(r"\1", word)


def parts(word: str) -> list[str]:
    """A word and its beginnings."""
    return ["=" + word, *[word[:k] + "~" for k in BEGINNINGS if len(word) > k]]


def features(words: Iterable[str]) -> set[str]:
    """Words, their beginnings, and beginnings that two or three different words share."""
    once: set[str] = set()
    twice: set[str] = set()
    thrice: set[str] = set()
    for w in words:
        for f in parts(w):
            if f not in once:
                once.add(f)
            else:
                (thrice if f in twice else twice).add(f)
    return once.union((f + "2" for f in twice), (f + "3" for f in thrice))


def alone(feature: str) -> set[str]:
    """The features of a text with nothing but ``feature`` in it."""
    level = int(feature[-1]) if feature[-2:-1] == "~" else 1
    if feature.startswith("="):
        own = parts(feature[1:])
    else:
        stem = feature[:feature.rindex("~")]
        own = [stem[:k] + "~" for k in BEGINNINGS if k <= len(stem)]
    return {*own, *SEVERAL[:level], *(f + str(k) for f in own if f[-1] == "~" for k in range(2, level + 1))}


def telling(words: set[str], weights: dict[str, float] | dict[str, int]) -> set[str]:
    """The features that have a weight, and how many different words have one."""
    found = features(words) & weights.keys()
    if found:
        n = sum(not weights.keys().isdisjoint(parts(w)) for w in words)
        found |= {f for k, f in enumerate(SEVERAL, 1) if k <= n and f in weights}
    return found


class Reader:
    """Words of a text, disguised ones restored; decoded stretches are remembered.

    With ``known`` features only words that have one are returned, and a plain word with a
    doubled letter is decoded if, with single letters, it begins like one of them; no other
    reading of it could have one. Without, such a word is taken as it stands.
    """

    def __init__(self, trigrams: bytes, known: Iterable[str] | None = None):
        self.trigrams = np.frombuffer(trigrams).reshape(SIZE, SIZE, SIZE).tolist()
        self.memory: dict[str, tuple[str, ...]] = {}
        self.known = None if known is None else {f.rstrip("23") if f[-2:-1] == "~" else f for f in known if f not in SEVERAL}
        self.starts = None if known is None else {squeeze(f.strip("=~")) for f in self.known}
        self.heads = None if known is None else {start[:2] for start in self.starts}
        self.longest = max(map(len, self.starts), default=0) if self.starts else 0

    def words_of(self, stretch: str) -> tuple[str, ...]:
        found = self.memory.get(stretch)
        if found is None:
            if len(self.memory) >= CACHE:
                self.memory.clear()
            words = dict.fromkeys(self._read(stretch))
            if self.known is not None:
                words = [w for w in words if not self.known.isdisjoint(parts(w))]
            found = self.memory[stretch] = tuple(words)
        return found

    def _may_tell(self, core: str) -> bool:
        if self.starts is None:
            return False
        single = squeeze(core)
        return any(single[:k] in self.starts for k in range(1, self.longest + 1))

    def _read(self, stretch: str) -> Iterator[str]:
        core = _EDGE.sub("", stretch)
        if not core:
            return
        if core.isalpha():
            yield core
            if not _DOUBLE.search(core) or not self._may_tell(core):
                return
        else:
            plain = "".join(c for c in core if c.isalpha())
            if plain and " " not in core and "\t" not in core:
                yield plain
        if sum(c.isalpha() for c in core) * 3 >= len(core) or all(c.isalpha() or c in LOOK_ALIKES for c in core):
            for words in readings(core, self.trigrams):
                yield from words

    def words(self, text: str) -> set[str]:
        low = text.lower()
        found: set[str] = set()
        tokens = {t.rstrip(_ENDS) for t in low.split()}
        if self.heads is not None:  # most plain words begin unlike any feature
            heads = self.heads
            tokens = [t for t in tokens if t[:2] in heads or not t.isalpha() or t[0] == t[1:2] or t[:1] in heads]
        for token in tokens:
            found.update(self.words_of(token))
        for spaced in _SPACED.findall(low):
            found.update(self.words_of(spaced))
        return found


def _fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def held_out(doc_id: Column) -> Column:
    return _fold(doc_id) == 1


def _logistic(row: np.ndarray, col: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Ridge logistic regression on a sparse 0/1 matrix; the intercept is that of ``BASE_SCORE``.

    Newton steps, each solved by conjugate gradients and halved until the loss falls.
    """
    base, n = math.log(BASE_SCORE / (1 - BASE_SCORE)), len(y)

    def across(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=v[col], minlength=n)

    def down(v: np.ndarray) -> np.ndarray:
        return np.bincount(col, weights=v[row], minlength=size)

    def loss(v: np.ndarray) -> float:
        z = base + across(v)
        return float(weight @ (np.logaddexp(0, z) - y * z) + RIDGE / 2 * v @ v)

    theta = np.zeros(size)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-(base + across(theta))))
        slope = down(weight * (mu - y)) + RIDGE * theta
        if np.abs(slope).max(initial=0.0) < 1e-6:
            break
        bend = weight * mu * (1 - mu)
        step, left = np.zeros(size), -slope
        way, norm = left.copy(), left @ left
        for _ in range(60):
            image = down(bend * across(way)) + RIDGE * way
            far = norm / (way @ image)
            step += far * way
            left = left - far * image
            norm, before = left @ left, norm
            if norm < 1e-12 * (slope @ slope):
                break
            way = left + norm / before * way
        now, t = loss(theta), 1.0
        while t > 1e-6 and loss(theta + t * step) > now:
            t /= 2
        theta = theta + t * step
    return theta


def _kin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        least = []
        for text in batch.column("text").to_pylist():
            row = (text or "").lower().split()
            least.append(min((_stable_hash(f"{a} {b}") for a, b in zip(row, row[1:], strict=False)), default=0))
        yield batch.append_column("kin", pa.array(least, pa.int64()))


def fit(docs: DataFrame, labels: DataFrame, trigrams: bytes, fit_rows: int = FIT_ROWS) -> dict[str, float]:
    """Weights of the features, in log odds.

    Copies would make every word of a toxic text look telling, so documents with the same
    smallest hash of two neighbouring words share the weight of one. Features with enough
    evidence for the label are counted over the fit rows; their regression runs on the driver,
    on at most about ``fit_rows`` rows and ``MAX_FEATURES`` features.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = fit_rows / max(1, known.count())
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # at most about fit_rows rows of two numbers, so the broadcast is bounded
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(
        F.col("toxic").cast("int").alias("toxic"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.keep(rows.mapInArrow(_kin, "toxic int, text string, kin bigint"), "fit_rows")
    rows = rows.join(rows.groupBy("kin").agg((1 / F.count(F.lit(1))).alias("weight")), "kin").select("toxic", "weight", "text")
    total = rows.groupBy("toxic").agg(F.sum("weight").alias("weight")).collect()
    toxic_sum = sum(r["weight"] for r in total if r["toxic"])
    clean_sum = sum(r["weight"] for r in total if not r["toxic"])
    if not toxic_sum or not clean_sum:
        return {}

    def count(among: frozenset[str] | None):
        def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, sums = Reader(trigrams), {}
            for batch in batches:
                for w, text in zip(batch.column("weight").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    found = features(reader.words(text or ""))
                    for f in found if among is None else found & among:
                        sums[f] = sums.get(f, 0.0) + w
                    if len(sums) > 500_000:
                        yield _sums_batch(sums)
                        sums = {}
            yield _sums_batch(sums)

        return sums_of

    def counted(part: DataFrame, name: str, among: frozenset[str] | None = None) -> DataFrame:
        # summed as whole millionths, so that their order does not matter
        return part.mapInArrow(count(among), "feature string, n bigint").groupBy("feature").agg((F.sum("n") / 1e6).alias(name))

    # only features of toxic rows can be telling; others are not counted in the rest
    hit, miss = F.col("hit"), F.coalesce(F.col("miss"), F.lit(0.0))
    hits = scratch.keep(counted(rows.filter("toxic <> 0"), "hit").filter(hit >= MIN_HITS), "hits")
    among = frozenset(r["feature"] for r in hits.select("feature").collect())
    stats = hits.join(counted(rows.filter("toxic = 0"), "miss", among), "feature", "left")
    rate = toxic_sum / (toxic_sum + clean_sum)

    def part(n: Column, share: float) -> Column:
        return F.when(n > 0, n * F.log(n / ((hit + miss) * share))).otherwise(0.0)

    evidence = F.round(2 * (part(hit, rate) + part(miss, 1 - rate)), 6)
    stats = stats.filter(hit > rate * (hit + miss)).withColumn("evidence", evidence).filter(F.col("evidence") >= MIN_EVIDENCE)
    top = stats.orderBy(F.desc("evidence"), "feature").limit(MAX_FEATURES).select("feature", "hit", miss.alias("miss")).collect()
    names = [r["feature"] for r in top]
    names += SEVERAL
    index = {f: i for i, f in enumerate(names)}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(trigrams, index)
        for batch in batches:
            ids = [sorted(index[f] for f in telling(reader.words(t or ""), index)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("weight"), pa.array(ids, pa.list_(pa.int32()))],
                                             ["toxic", "weight", "ids"])

    # rows without a feature have the base score whatever the weights
    matrix = rows.mapInArrow(found, "toxic int, weight double, ids array<int>").filter(F.size("ids") > 0).groupBy("toxic", "ids").agg(
        F.round(F.sum("weight"), 6).alias("weight")).orderBy("ids", "toxic").collect()
    scratch.drop()
    ids = [r["ids"] for r in matrix]
    y = [float(bool(r["toxic"])) for r in matrix]
    weight = [r["weight"] for r in matrix]
    for r in top:  # what a feature says on its own
        ids.append(sorted(index[f] for f in alone(r["feature"]) if f in index))
        y.append((r["hit"] + 0.5) / (r["hit"] + r["miss"] + 1))
        weight.append(ALONE)
    if not ids:
        return {}
    row = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    theta = _logistic(row, np.concatenate(ids).astype(np.int64), np.array(y), np.array(weight), len(names))
    return {f: float(x) for f, x in zip(names, theta, strict=True) if x}


def _stable_hash(words: str) -> int:
    import zlib

    raw = words.encode("utf-8", "replace")
    return zlib.crc32(raw) << 31 | zlib.adler32(raw) & 0x7FFFFFFF


def _sums_batch(sums: dict[str, float]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([round(v * 1e6) for v in sums.values()], pa.int64())],
                                      ["feature", "n"])


def score_words(words: set[str], weights: dict[str, float]) -> float:
    """Logistic score of the features; a text without any gets the base score."""
    z = math.log(BASE_SCORE / (1 - BASE_SCORE)) + math.fsum(weights[f] for f in telling(words, weights))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    The score depends on the text alone. Null, empty and wordless texts get the base score;
    a null doc_id is not held out. Without labels nothing is learned and every text gets the
    base score. Repeated rows are scored one by one.
    """
    spark = docs.sparkSession
    trigrams = character_model(docs).tobytes()
    shared = spark.sparkContext.broadcast(Model(trigrams, fit(docs, labels, trigrams, fit_rows)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader = shared.value, Reader(shared.value.trigrams, shared.value.weights)
        for batch in batches:
            scores = [score_words(reader.words(t or ""), model.weights) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(apply, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
