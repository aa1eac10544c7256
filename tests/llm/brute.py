"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def archives(pages):
    """page_id, url, html -> {page_id: (bytes, digest, type, refers)}; ids are unique here."""
    first, out = {}, {}
    for page_id, _, html in sorted(pages, key=lambda p: p[0]):
        raw = (html or "").encode()
        digest = sha(raw)
        seen = first.setdefault(digest, page_id)
        again = seen != page_id and len(raw) >= 100
        out[page_id] = (len(raw), digest, "revisit" if again else "response", seen if again else None)
    return out


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(docs):
    """(doc_id, text) -> {doc_id: (set size, smallest id reachable)}; ids are unique here."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    under = {i + k for i in range(len(w) - 2) if count[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(under)


def conversation(turns):
    """(role, text) in order -> n_turns, digest, loss chars, loss digest."""
    learned = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), len(learned), sha(learned)


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: words} -> {source: target}, resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in stopped)
        total = sum(weight[s] for s in order if s not in stopped)
        target = {s: most * sizes[s] if s in stopped else rest * weight[s] / total for s in order}
        above = {s for s in order if s not in stopped and target[s] > most * sizes[s]}
        if not above:
            return target
        stopped |= above


def pareto_copies(docs, target):
    """(id, size, draw, tie) of one source and its target -> {id: copies}; ids are unique here."""
    total = sum(d[1] for d in docs)
    whole = math.floor(target / total + 1e-12) if total else 0
    left = max(0.0, target - whole * total)
    weight = {d[0]: 2 ** (d[1].bit_length() - 1) if d[1] else 0 for d in docs}
    sure, open_ = set(), [d for d in docs if d[1]]
    while True:
        mass = sum(d[1] * weight[d[0]] for d in open_)
        rate = left / mass if mass else 0
        heavy = max((weight[d[0]] for d in open_), default=0)
        if rate * heavy < 1:
            break
        certain = {d[0] for d in open_ if weight[d[0]] == heavy}
        left -= sum(d[1] for d in open_ if d[0] in certain)
        sure |= certain
        open_ = [d for d in open_ if d[0] not in certain]

    def rank(d):
        p = rate * weight[d[0]]
        return d[2] / (1 - d[2]) / (p / (1 - p))

    copies, words = {d[0]: whole + (d[0] in sure) for d in docs}, 0
    for d in sorted(open_ if rate else [], key=lambda d: (rank(d), d[3])):
        copies[d[0]] += words + d[1] / 2 <= left
        words += d[1]
    return copies


def repeats(docs, length=100):
    """(doc_id, text) -> {doc_id: (bytes, removed, runs, digest of the rest)}; ids are unique here."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p:p + length] in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(raw[p:p + length])
        rest = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(raw), sum(gone), runs, sha(rest))
    return out


def contamination(text, items, size=10):
    """n_words, n_hit, n_items, digest, contaminated for (item_id, text) items."""
    w = ITEM_WORD.findall(lower(text))
    hit, found = set(), set()
    for item_id, item in items:
        x = ITEM_WORD.findall(lower(item))
        n = min(size, len(x))
        for k in range(len(x) - n + 1) if n else ():
            for i in range(len(w) - n + 1):
                if w[i:i + n] == x[k:k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item_id))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def line_dedup(rows, min_chars=10):
    """{(doc, text): (lines, dropped, kept text)}; ids compare as numbers, null last."""
    import string

    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    rank = lambda doc: (doc is None, doc or 0)
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(line.strip(" \t\n\x0b\f\r").translate(lower), set()).add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = line.strip(" \t\n\x0b\f\r").translate(lower)
            if len(key) < min_chars or rank(min(holders[key], key=rank)) == rank(doc):
                kept.append(line)
        out[doc, text] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def hard_negatives(rows, anchors, n_positives=5, n_negatives=3):
    """rows: (id, label, integer vector), one per id."""
    dim = max((len(v) for _, _, v in rows), default=0)
    full = [(i, label, [*v, *[0] * (dim - len(v))]) for i, label, v in rows]
    out = []
    for i, label, v in full:
        if not anchors(i):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in full if j != i))
        for s, j, other in [x for x in scored if x[2] == label][:n_positives]:
            fits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits[:n_negatives])]
    return sorted(out)
