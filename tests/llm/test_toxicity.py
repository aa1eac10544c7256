"""The lattice decoder against enumeration, the disguises it must restore, held-out accuracy."""

import itertools
import math
import re

import numpy as np
import pytest

from sextant.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    return out.filter("held_out AND toxic IS NOT NULL").select("lang", "toxic", "predicted").toPandas()


@pytest.fixture(scope="module")
def trigrams(spark):
    return toxicity.character_model(spark.read.parquet(f"{SF}/documents.parquet"))


def test_decoder_finds_the_best_of_all_readings(trigrams):
    for stretch in ("m0r0n", "i d t", "a-bb-c", "1d1", "l00se", "x y  z"):
        runs = [(m.group(0)[0], len(m.group(0))) for m in re.finditer(r"[ \t]+|(.)\1*", stretch)]
        best: dict[str, float] = {}
        for choice in itertools.product(*[toxicity._options(c, n) for c, n in runs]):
            a = b = 0
            cost, text, dead = 0.0, "", False
            for letters, price in choice:
                cost += price
                for letter in letters:
                    z = 0 if letter == " " else toxicity.INDEX[letter]
                    if z == b == 0:
                        dead = True  # no empty word between two borders
                        break
                    cost += trigrams[a][b][z]
                    a, b, text = b, z, text + letter
            if not dead:
                cost += trigrams[a][b][0] if b else 0.0
                best[text] = max(best.get(text, -math.inf), cost)
        want = sorted(best, key=lambda t: -best[t])[:3]
        assert toxicity._decode(runs, trigrams.tolist(), 3) == want, stretch


def test_disguises_go_through_the_lattice(trigrams):
    reader = toxicity.Reader(trigrams.tobytes(), ["=moron", "=idiot", "=stupid", "=pathetic"])
    for text, words in {
        "m o r o n.": {"moron"}, "a i d i o t here": {"idiot"}, "iidiot": {"idiot"}, "s t u p i d  m o r o n": {"stupid", "moron"},
        "i-d-i-o-t": {"idiot"}, "m0r0n!": {"moron"}, "you are a p a t h e t i c one": {"pathetic"}, "stuuuupid": {"stupid"},
        "s.t.u.p.i.d," + "x" * 50: set(), " ".join("idiot" * 40): {"idiot"}, ".".join("stupid" * 30): {"stupid"},
        "idiot" + "t" * 3_000_000: {"idiot"}, "clean words only": set(), "": set(),
    }.items():
        assert words <= reader.words(text), text[:60]


def test_one_word_as_long_as_a_document_is_read_in_windows(trigrams):
    reader = toxicity.Reader(trigrams.tobytes(), ["=moron"])
    assert "moron" in reader.words("ab.cd-" * 5_000 + "m0r0n" + "-ab.cd" * 5_000)
    assert reader.words("ab" * 200_000) == set()


def test_regression_meets_its_gradient():
    rng = np.random.default_rng(1)
    x = rng.random((200, 12)) < 0.3
    y, weight = (rng.random(200) < 0.4).astype(float), rng.random(200)
    row, col = np.nonzero(x)
    theta = toxicity._logistic(row, col, y, weight, 12)
    base = math.log(toxicity.BASE_SCORE / (1 - toxicity.BASE_SCORE))
    mu = 1 / (1 + np.exp(-(base + x @ theta)))
    assert np.abs(x.T @ (weight * (mu - y)) + toxicity.RIDGE * theta).max() < 1e-5


def test_held_out_accuracy(scored):
    toxic, found = scored["toxic"] == 1, scored["predicted"] == 1
    assert (toxic & found).sum() / toxic.sum() >= 0.9
    assert (toxic & found).sum() / found.sum() >= 0.9
    for lang in ("en", "fr", "de", "es"):
        here = scored["lang"] == lang
        assert (toxic & found & here).sum() / (toxic & here).sum() >= 0.8, lang
        assert (~toxic & found & here).sum() / (~toxic & here).sum() <= 0.05, lang


def test_the_same_text_has_the_same_score_wherever_it_stands(spark):
    # every text has words of its own: copies would count as one row
    rows = [(i, f"w{i}a v{i}b " + ("bad gromble here" if i % 5 == 0 else "good fellow there"), "x") for i in range(300)]
    docs = spark.createDataFrame([*rows, (7, None, "y"), (7, None, "y"), (None, "gromble", "z")], "doc_id long, text string, SCORE string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    out = toxicity.score(docs, labels)
    assert out.count() == 303
    one = sorted((r.doc_id or -1, round(r.score, 9)) for r in out.collect())
    assert one == sorted((r.doc_id or -1, round(r.score, 9)) for r in toxicity.score(docs.repartition(5), labels).collect())
    scores = dict(one)
    assert scores[5] > 0.7 > scores[6]
