"""The operators against plain versions, on cases with nulls, ties, repeats and long texts."""

import random

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sextant.llm import chat, decontaminate, mixing, ngram_join, pii, quality, suffixes, textscan, tokens, toxicity, warc
from sextant.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}{'.' if k % 9 == 8 else ''}" for k in range(words))


def corpus():
    """Copies, near copies, shared passages, markup, accents, blank, null and long texts."""
    base = [prose(k, 120, 4000) for k in range(8)]
    near = [" ".join([*t.split()[:60], f"changed{i}", *t.split()[61:]]) for i, t in enumerate(base[:4])]
    passage = prose(99, 45, 4000)
    shared = [f"{prose(200 + k, 90, 4000)}\n{passage}\n{prose(300 + k, 90, 4000)}" for k in range(6)]
    odd = [None, "", " \t\n", "One two", "one TWO", "é ü ß — 漢字 x", "a" * 450, "the " * 200, "x\ny\nx\n\n x\nx",
           "1 # * $ % & | < > 2", prose(7, 3000, 60), "don't 's <|endoftext|> I'll  \n 've"]
    texts = [*base, *base[:3], *near, *shared, *odd]
    return [(i, t, "en", None if i % 7 == 3 else f"src{i % 5}", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select(df.columns[0], *columns).collect()}


def test_archives_round_trip(spark):
    pages = [(i, f"http://x.org/{i}?q=ä b\n" if i % 3 else None, h) for i, h in enumerate(
        ["a" * 100, "a" * 100, "b" * 99, "b" * 99, None, "", "é" * 60, "a" * 100, "é" * 60, *[f"page {k} " * 40 for k in range(30)]])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("shard", F.lit(1))
    out = by_id(warc.round_trip(df), "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert out == brute.archives(pages)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archives_are_deterministic_and_roll(spark, tmp_path):
    pages = [(i * 3, "u", f"<p>{i * 7919 % 1000}" * 200) for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    seen = []
    for k, parts in enumerate((2, 7)):
        scratch = Scratch(spark, "t")
        manifest = warc.write_archives(df.repartition(parts), f"file://{tmp_path}/{k}", scratch, roll_bytes=1000, min_shards=3)
        rows = sorted(tuple(r) for r in manifest.collect())
        seen.append(rows)
        assert sum(r[2] for r in rows) == 200 and len(rows) > 3
        stray = warc.read_archives(spark, f"file://{tmp_path}/{k}", manifest.filter("shard = 0"))
        assert stray.count() == sum(r[2] for r in rows if r[0] == 0)
    assert seen[0] == seen[1]


def test_archives_with_repeated_and_missing_ids(spark):
    page = "z" * 150
    rows = [(5, "u", page), (5, "u", page), (None, "u", page), (9, "v", page), (None, "v", "w" * 120), (5, "u", "other" * 40)]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    kinds = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in out)
    assert kinds == [(0, 120, "response", 0), (0, 150, "revisit", 5), (5, 150, "response", 0), (5, 150, "revisit", 5),
                     (5, 200, "response", 0), (9, 150, "revisit", 5)]


def test_ngram_join_equals_all_pairs(docs):
    assert by_id(ngram_join.report(docs), "n_shingles", "component_id") == brute.components([(r[0], r[1]) for r in corpus()])


def test_ngram_join_of_a_group_of_near_copies(spark):
    """Copies that link to the original only, and chains: hubs alone would not find them all."""
    rng = random.Random(4)
    original = prose(1, 100, 5000).split()
    rows = []
    for i in range(60):
        w = list(original)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(100)] = f"edit{rng.randrange(10_000)}"
        rows.append((1000 - i, " ".join(w)))
    assert by_id(ngram_join.report(spark.createDataFrame(rows, "doc_id long, text string")),
                 "n_shingles", "component_id") == brute.components(rows)


def test_keep_one_keeps_columns_and_rows_without_ids(spark, nothing):
    text = prose(1, 40)
    rows = [(3, text, "en", "a", 1), (2, text, "en", "a", 1), (2, text, "en", "a", 1), (None, text, "en", "a", 1), (7, None, "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("_text_hash", F.lit("mine"))
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7]
    assert ngram_join.keep_one(nothing).count() == 0


def test_quality_counts_equal_plain_ones(docs, nothing):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    out = by_id(quality.assess(docs), *names)
    for doc_id, text, *_ in corpus():
        counts = brute.quality(text)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert out[doc_id][:6] == (*counts, failed), text
        assert not (failed and out[doc_id][6])
    assert quality.keep_good(nothing).count() == 0


def test_quality_rules_tell_prose_from_junk(spark):
    good = " ".join(f"the {w} of and {w}x in" for w in prose(3, 60).split())
    rows = [(1, good), (2, good.replace(" ", "### ")), (3, good.upper()), (4, "short text"), (5, "the same line of it\n" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("mine"))
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]
    tight = (quality.Rule("length", "word_chars", "n_words", high=1.0),)
    assert quality.keep_good(df, tight).count() == 0


def test_pseudonyms_keep_format_and_links(spark, nothing):
    rows = [(1, "card 4111 1111 1111 1111, again 4111111111111111; bad 1234567890123"), (2, "4111111111111111 born 1987-02-28 not 2001-02-30"),
            (3, "mail ann.b@mail.example.com or +1 (988) 555-2485 at 10.20.30.40"), (4, "DE89 3704 0044 0532 0130 00 SSN 123-45-6789"),
            (5, None), (6, ""), (7, "no data, 4.0. or 12")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("parts", F.lit(1))
    out, count = pii.pseudonymize(df, "key")
    got = {r.doc_id: (r.text, r[count]) for r in out.collect()}
    assert [got[i][1] for i in range(1, 8)] == [2, 2, 3, 2, 0, 0, 0]
    assert got[5][0] is None and got[6][0] == "" and got[7][0] == rows[6][1]

    def luhn(s):
        d = [int(c) for c in s if c.isdigit()][::-1]
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0

    spaced, plain = got[1][0][5:24], got[1][0][32:48]
    assert luhn(spaced) and spaced.replace(" ", "") == plain == got[2][0][:16] != "4111111111111111"
    assert got[2][0].endswith("not 2001-02-30") and got[2][0][22:32] != "1987-02-28"
    assert got[3][0].split()[1].endswith(".com") and "ann.b" not in got[3][0] and "+1 (" in got[3][0]
    iban = got[4][0][:27].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban.startswith("DE")
    other = {r.doc_id: r.text for r in pii.pseudonymize(df, "other key")[0].collect()}
    assert other[1] != got[1][0]
    assert pii.pseudonymize(nothing)[0].count() == 0


def test_failing_numbers_stay(spark):
    kept = ["1700000000000 ms", "order 1234567890123", "4111 1111 1111 1112", "DE89 3704 0044 0532 0135 02 paid", "on 2001-02-30 x"]
    near = ["4111 1111 1111 1112 then 555-123-4567", "1234567890123, 4111111111111111", "DE00 1234 5678 9012 2019-03-04"]
    df = spark.createDataFrame(list(enumerate(kept + near)), "doc_id long, text string")
    out, count = pii.pseudonymize(df, "key")
    got = out.orderBy("doc_id").collect()
    assert [r.text for r in got[:len(kept)]] == kept
    assert [r[count] for r in got] == [0] * len(kept) + [1, 1, 1]
    assert got[5].text.startswith("4111 1111 1111 1112 then ") and got[6].text.startswith("1234567890123, ")
    assert got[7].text.startswith("DE00 1234 5678 9012 ") and not got[7].text.endswith("2019-03-04")


def test_values_end_before_following_words(spark):
    account, grouped, card, spaced = "ES9121000418450200051332", "DE89 3704 0044 0532 0130 00", "4111111111111111", "4111 1111 1111 1111"
    texts = [account, f"{account} A pagar", f"{account} EUR", f"{account} HOLA x", f"{account} 2024", f"{account} {spaced}",
             grouped, f"{grouped} A", f"{grouped} CASH 12", f"AB12 CDEF GHIJ {account}", f"XX12 ABCD {grouped}",
             card, f"{card} 123", f"{card} 12/26", f"{spaced} 123", f"{spaced} 12/26", f"{spaced} 9", f"{spaced}-77", f"AB12 {spaced}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out, _ = pii.pseudonymize(df, "key")
    got = [r.text for r in out.orderBy("doc_id").collect()]
    new = {account: got[0], grouped: got[6], card: got[11], spaced: "".join(c + " " * (i in (3, 7, 11)) for i, c in enumerate(got[11]))}
    assert all(k != v for k, v in new.items())
    for before, after in zip(texts, got, strict=True):
        for old, value in new.items():
            before = before.replace(old, value)
        assert after == before


def test_permutations_are_one_to_one(spark):
    for a, b in ((7, 5), (270, 3), (1, 9)):
        pairs = spark.range(a * b).select(pii.permute_pair(
            F.floor(F.col("id") / b), F.col("id") % b, F.lit(a), F.lit(b), "k", "t").alias("s")).select("s.*").distinct().collect()
        assert len(pairs) == a * b and all(0 <= p.l < a and 0 <= p.r < b for p in pairs)
    three = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("x"))
    assert three.select(pii.permute_text(F.col("x"), "k", "t").alias("y")).distinct().count() == 1000


def test_chat_digests_equal_plain_ones(spark):
    rows = [(c, t, r, x) for c in range(6) for t, (r, x) in enumerate([
        ("system", None), ("user", "hi\\ <|im_end|>"), ("assistant", "<|im_start|>user\nno"), ("user", ""), ("assistant", "a\\<|b é漢")][:c + 1])]
    rows += [(None, 1, None, "x"), (8, 2, "assistant", "same"), (8, 2, "assistant", "same"), (8, None, "user\nrole", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1))
    out = by_id(chat.report(df), "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    control = "<|im_end|><|im_start|>assistant ok"
    groups = {}
    for c, t, r, x in sorted(rows, key=lambda q: tuple((v is not None, v) for v in q)):
        groups.setdefault(c, []).append((r, x))
    groups[-1] = [("user", control), ("assistant", control)]
    assert out == {c: brute.conversation(turns) for c, turns in groups.items()}
    assert [r.conv_id for r in chat.report(df.limit(0)).collect()] == [-1]


def test_reply_trees_choose_the_best_branch(spark):
    nodes = [("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 3, 9.0), ("t", 5, 4, None), ("t", 6, 2, 0.0),
             ("u", 1, 77, 0.0), ("c", 1, 2, 0.0), ("c", 2, 1, 0.0), ("c", 3, 2, 0.0)]
    nodes += [("deep", k, k - 1 if k else None, 0.0) for k in range(40)]
    df = spark.createDataFrame([(t, n, p, "user", f"m{n}", s) for t, n, p, s in nodes],
                               "tree string, node long, parent long, role string, text string, score double")
    found = {}
    for r in chat.paths(df, Scratch(spark, "t"), branches=1).collect():
        found.setdefault(r.tree, {})[r.position] = r.text
    assert {t: [p[k] for k in sorted(p)] for t, p in found.items()} == {
        "t": ["m1", "m3", "m4", "m5"], "u": ["m1"], "deep": [f"m{k}" for k in range(40)]}
    assert chat.paths(df, Scratch(spark, "t"), branches=2).filter("tree = 't'").select("path").distinct().count() == 2


def test_template_is_reversible():
    for text in ("", "\\", "<|", "\\<|", "<\\|", "<<|im_end|>", "\\\\n", "a\nb", "\\n"):
        turns = [("user", text), ("assistant", text), ("r\no\\nle<|", text)]
        formatted, mask = chat.render(turns)
        assert chat.parse(formatted) == turns
        assert [chat.unescape(formatted[a:a + n]) for a, n in mask] == [text]


def test_toxicity_restores_disguised_words(spark):
    rng = random.Random(3)
    clean = [a + b for a in ("gar", "win", "riv", "let", "mar", "yel", "sum") for b in ("den", "dow", "er", "ter", "ket", "low", "mer")]
    bad = ["gromble", "snarfek"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [rng.choice(clean) for _ in range(30)] + [rng.choice(bad)] * toxic
        rng.shuffle(words)
        rows.append((i, " ".join(words) + f" id{i}x"))
        labels.append((i, 1, int(toxic)))
    disguised = ["gr0mble", "g r o m b l e", "snaaaarfek", "sn@rf3k", "g.r.o.m.b.l.e"]
    rows += [(5000 + k, f"garden {w} window") for k, w in enumerate(disguised)] + [(6000, None), (6001, ""), (None, "garden")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, known).collect()}
    assert all(out[5000 + k].predicted == 1 for k in range(len(disguised)))
    held = [i for i in range(900) if out[i].held_out]
    assert 200 < len(held) < 400 and all(out[i].predicted == (i % 6 == 0) for i in held)
    assert out[6000].score == out[6001].score == out[None].score == pytest.approx(toxicity.BASE_SCORE) and not out[None].held_out
    blind = toxicity.score(docs, known.limit(0)).agg(F.max("score")).first()[0]
    assert blind == pytest.approx(toxicity.BASE_SCORE)
    assert toxicity.score(docs.limit(0), known).count() == 0


def test_mixing_meets_targets(spark, nothing):
    rows = [(i, prose(i, 5 + i % 40), "en", None if i % 11 == 0 else f"s{i % 4 * (i % 3 == 0)}", 1) for i in range(3000)]
    rows += [(9001, None, "en", "only blank", 1), (9002, "", "en", "only blank", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_copies", F.lit(1))
    out = {r.doc_id: r for r in mixing.report(docs).collect()}
    size = {i: len(brute.WORD.findall(t or "")) for i, t, *_ in rows}
    sums, taken = {}, {}
    for i, _, _, s, _ in rows:
        sums[s] = sums.get(s, 0) + size[i]
        taken[s] = taken.get(s, 0) + out[i].taken
    target = brute.mix_targets(sums)
    for i, _, _, s, _ in rows:
        assert out[i].size == size[i] and out[i].source_size == sums[s]
        assert out[i].target == pytest.approx(target[s]) and out[i].taken <= 2 * size[i]
    assert all(abs(taken[s] - target[s]) <= 45 for s in sums)
    again = {r.doc_id: r.taken for r in mixing.report(docs.repartition(9)).collect()}
    assert again == {i: r.taken for i, r in out.items()}
    copies = mixing.resample(docs)
    assert copies.columns == docs.columns
    assert copies.count() == sum(r.copies for r in out.values())
    assert mixing.report(nothing).count() == 0


def test_repeats_equal_plain_search(docs, spark, nothing):
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_id(suffixes.report(docs), *names) == brute.repeats([(r[0], r[1]) for r in corpus()])
    rng = random.Random(8)
    line = prose(5, 40, 5000)
    rows = []
    for i in range(80):
        a, b = sorted((rng.randrange(len(line)), rng.randrange(len(line))))
        rows.append((i, f"{prose(1000 + i, 12, 9000)} {line[a:b]} {prose(2000 + i, 12, 9000)} {line[:rng.randrange(len(line))]}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(suffixes.report(df), *names) == brute.repeats(rows)
    assert suffixes.report(nothing).count() == 0


def test_repeats_with_repeated_and_missing_ids(spark):
    text, other = prose(1, 40, 900), prose(2, 40, 900)
    rows = [(1, text), (1, text), (1, other), (None, text), (2, text + other)]
    out = suffixes.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in out)
    assert [k for k in kept if k[0] == 0] == [(0, len(text), 0)]
    assert [k for k in kept if k[0] == 2] == [(2, len(text + other), len(text + other))]
    assert len(kept) == 5


@pytest.mark.parametrize("extra", [[], [(None, "short")]])
def test_a_repeated_row_is_no_earlier_document(spark, extra):
    alone, common = prose(3, 40, 900), prose(4, 40, 900)
    rows = [(1, alone), (1, alone), (2, common), (3, common), (3, common), *extra]
    out = suffixes.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    kept = sorted((r.doc_id or 0, r.n_removed) for r in out)
    assert kept == [*[(0, 0)] * len(extra), (1, 0), (1, 0), (2, 0), (3, len(common)), (3, len(common))]


@pytest.mark.parametrize("limit", [1, 6])
def test_repeats_in_groups_over_the_bound(docs, spark, monkeypatch, limit):
    monkeypatch.setattr(suffixes, "GROUP_ROWS", limit)
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_id(suffixes.report(docs), *names) == brute.repeats([(r[0], r[1]) for r in corpus()])
    rng = random.Random(9)
    line = prose(6, 40, 5000)
    rows = []
    for i in range(60):
        a, b = sorted((rng.randrange(len(line)), rng.randrange(len(line))))
        rows.append((i, f"{prose(1000 + i, 12, 9000)} {line[a:b]} {prose(2000 + i, 12, 9000)} {line[:rng.randrange(len(line))]}"))
    assert by_id(suffixes.report(spark.createDataFrame(rows, "doc_id long, text string")), *names) == brute.repeats(rows)


def test_a_task_holds_no_group_over_the_bound(monkeypatch):
    held = []
    whole = suffixes._repeats
    monkeypatch.setattr(suffixes, "_repeats", lambda rows: held.append(rows.num_rows) or whole(rows))
    rows = [(7, 0, b"f" * 100, b"p" * 25, k, 50) for k in range(5_000)] + [(8, 0, b"g" * 100, b"", k, 50) for k in range(3)]
    batches = [suffixes._tuple_batch(rows[k:k + 1000]) for k in range(0, len(rows), 1000)]
    out = [r for batch in suffixes._inducer(1200)(iter(batches)) for r in batch.to_pylist()]
    assert max(held) == 3
    assert sum(r["end"] is None for r in out) == 5_000 and sum(r["end"] == 150 for r in out) == 2


def test_contamination_equals_plain_scan(docs, nothing, spark):
    items = [(1, corpus()[0][1][40:260]), (2, "w1 w2"), (3, None), (4, "!!"), (5, corpus()[19][1]), (5, "ONE Two"), (10, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = by_id(decontaminate.report(docs, bench), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    known = [(i, t) for i, t in items if t]
    assert out == {i: brute.contamination(t, known) for i, t, *_ in corpus()}
    clean = decontaminate.drop_contaminated(docs.withColumn("_runs", F.lit(1)), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, v in out.items() if not v[4]}
    cut = decontaminate.cut_spans(docs, bench)
    assert cut.columns == docs.columns
    assert not any(r.contaminated for r in decontaminate.report(cut, bench).filter("n_items > 0").collect() if r.n_hit > 30)
    assert decontaminate.report(nothing, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(docs, bench.limit(0)).collect())


def test_contamination_in_blocks_is_the_same(docs, spark, monkeypatch):
    items = [(i, prose(i, 30, 4000)) for i in range(8)] + [(50, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    whole = by_id(decontaminate.report(docs, bench), *names)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 400)
    assert len(decontaminate._item_blocks(bench)) > 2
    assert by_id(decontaminate.report(docs, bench), *names) == whole


def test_one_block_of_items_at_a_time(docs, spark, monkeypatch):
    bench = spark.createDataFrame([(i, prose(i, 30, 4000)) for i in range(8)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 400)
    alive, most = set(), []
    context = type(spark.sparkContext)
    real = context.broadcast

    def broadcast(self, value):
        shared = real(self, value)
        if isinstance(value, decontaminate.GramSet) and value.grams:
            alive.add(id(shared))
            most.append(len(alive))
            destroy = shared.destroy
            shared.destroy = lambda *a: (alive.discard(id(shared)), destroy(*a))
        return shared

    monkeypatch.setattr(context, "broadcast", broadcast)
    out, _ = decontaminate.scan(docs, bench)
    assert len(most) > 2 and max(most) == 1 and not alive
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert out.count() == len(corpus())


def test_token_counts_equal_the_library(docs, nothing):
    library = Tokenizer.from_file(VOCABULARY)
    out = by_id(tokens.count_tokens(docs, VOCABULARY), "n_bytes", "n_tokens", "over_limit")
    for i, text, *_ in corpus():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert out[i] == (len((text or "").encode()), n, n > 512), text
    assert tokens.count_tokens(nothing, VOCABULARY).count() == 0


def test_token_counts_of_odd_texts_and_chunks():
    import numpy as np
    import pyarrow as pa

    counter, library = tokens.Counter(tokens.compile_tokenizer(VOCABULARY)), Tokenizer.from_file(VOCABULARY)
    odd = ["  a", "a \n b", "'sabc ''s \"'s I'M 're'", "x\n\n\ny ", "<|endoftext|>", " a<|endoftext|> b<|endoftext|>", "é  x　　y 12٣½🙂🙂  ",
           "\u0085 ", "'", "1'st\n'm", "   x", "\x1c\x1d a", "𑨩"]
    for text in odd:
        assert counter.count_bytes(text.encode()) == len(library.encode(text, add_special_tokens=False).ids), text
    whole = pa.array(odd)
    for _, data, offsets in textscan.blocks(whole):
        assert counter.count_block(data, offsets).sum() == sum(counter.count_bytes(t.encode()) for t in odd)
    long = (prose(1, 4000) + "  \n " + "unbroken" * 400 + " ").encode()
    assert counter.count_long(np.frombuffer(long, dtype=np.uint8), 700) == counter.count_bytes(long)


def test_ngram_join_by_blocks_only(spark, monkeypatch):
    """Without hubs and with tiny blocks, every pair is found by the block comparison."""
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 7)
    rng = random.Random(6)
    original = prose(1, 100, 5000).split()
    rows = []
    for i in range(50):
        w = list(original)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(100)] = f"edit{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    assert by_id(ngram_join.report(spark.createDataFrame(rows, "doc_id long, text string")),
                 "n_shingles", "component_id") == brute.components(rows)


def thue_morse(letters, bits):
    return "".join(letters[bin(k).count("1") % 2] for k in range(1 << bits))


def test_words_built_to_share_a_hash(spark):
    words = [thue_morse(pair, bits) for pair in ("ab", "ba", "xy", "yx") for bits in (10, 11)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate([*words, " ".join(words)])], "doc_id long, text string").coalesce(1)
    known = Tokenizer.from_file(VOCABULARY)
    want = {r.doc_id: len(known.encode(r.text, add_special_tokens=False).ids) for r in df.collect()}
    assert {k: v[0] for k, v in by_id(tokens.count_tokens(df, VOCABULARY), "n_tokens").items()} == want
    assert {k: v[0] for k, v in by_id(ngram_join.report(df), "component_id").items()} == {i: i for i in range(len(words) + 1)}


def test_mix_takes_part_of_repeated_rows(spark):
    same = [(1, " ".join(["word"] * 50), "a", k % 3) for k in range(4000)]
    rows = [*same, *[(10 + k, " ".join(["x"] * (1 + k % 7)), "b", 0) for k in range(500)], *[(2000 + k, "only few words here", "c", 0) for k in range(900)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tie int")
    for parts in (1, 9):
        out = mixing.report(df.repartition(parts)).groupBy("source_size").agg(
            F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size"), F.max("copies").alias("copies")).collect()
        assert len(out) == 3
        for r in out:
            assert abs(r.taken - r.target) <= r.size / 2 + 1e-6 and r.copies <= 2
    assert mixing.resample(df).columns == df.columns


def test_mix_equals_a_plain_pareto_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    key = (F.col("doc_id"), F.col("source"), F.col("text"))
    rows = docs.select("doc_id", "source", "text", mixing._uniform(7, *key).alias("draw"), F.xxhash64(F.lit(8), *key).alias("tie")).collect()
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append((r.doc_id, len(brute.WORD.findall(r.text or "")), r.draw, r.tie))
    target = brute.mix_targets({s: sum(d[1] for d in ds) for s, ds in sources.items()})
    want = {}
    for s, ds in sources.items():
        want.update(brute.pareto_copies(ds, target[s]))
    got = {r.doc_id: r.copies for r in mixing.report(docs).collect()}
    assert got == want and len(set(want.values())) > 1


def test_mix_includes_by_size(spark):
    rows = [(i, f"t{i} " * (9 if i % 2 else 40), "s") for i in range(6000)]
    rows += [(6000 + i, "long " * 30_000, "s") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out, names = mixing.mix(docs, weights=(1,), share=0.5)
    means = {r[0]: r[1] for r in out.groupBy(names["size"]).agg(F.avg(names["copies"])).collect()}
    left = 0.5 * (3000 * 49 + 60_000) - 60_000  # the long ones are certain
    rate = left / (3000 * 9 * 8 + 3000 * 40 * 32)
    assert means[30_000] == 1 and means[9] == pytest.approx(8 * rate, abs=0.03) and means[40] == pytest.approx(32 * rate, abs=0.03)
