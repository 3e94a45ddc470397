import random

import numpy as np
from pyspark.sql import functions as F

from marginflow.llm.language import (
    Bounds,
    CrossParser,
    fold,
    identify,
    language_id,
    letters,
    suffix_automaton,
    training_sample,
)

SMALL = "/root/testdata/sf0.01"


def brute_phrases(text, training):
    """Longest matches, one after the other; a letter the language lacks stands alone."""
    n = i = 0
    while i < len(text):
        length = 0
        while i + length < len(text) and text[i : i + length + 1] in training:
            length += 1
        i += max(1, length)
        n += 1
    return n


def test_automaton_accepts_exactly_the_factors():
    draw = random.Random(1)
    for _ in range(20):
        text = "".join(draw.choice("ab") for _ in range(12))
        moves = suffix_automaton([ord(c) for c in text])

        def accepts(word):
            state = 0
            for c in word:
                if ord(c) not in moves[state]:
                    return False
                state = moves[state][ord(c)]
            return True

        for n in range(1, 6):
            for k in range(2**n):
                word = "".join("ab"[k >> j & 1] for j in range(n))
                assert accepts(word) == (word in text)


def test_phrases_against_brute_force():
    draw = random.Random(4)

    def text(symbols, n):
        return "".join(draw.choice(symbols) for _ in range(n))

    sample = {"a": [text("abc ", 200)], "b": [text("bcdé ", 200)]}
    bounds = Bounds(segment=50)
    parser = CrossParser(sample, bounds)
    texts = [text("abcdé zß.", n) for n in (0, 1, 3, 49, 50, 51, 130, 400)] + ["ABC, abc", "..."]
    found, n_letters = parser.phrases(texts)
    for i, t in enumerate(texts):
        plain = "".join(c if c.isalpha() else " " for c in t.lower())
        plain = "".join(c for j, c in enumerate(plain) if c != " " or (j and plain[j - 1] != " "))
        assert n_letters[i] == sum(c != " " for c in plain)
        pieces = [plain[k : k + 50] for k in range(0, len(plain), 50)]
        for k, lang in enumerate(parser.languages):
            training = " ".join(letters(x) for x in sample[lang])
            assert found[k, i] == sum(brute_phrases(p, training) for p in pieces), (t, lang)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    got = language_id(docs).filter("held_out")
    hits = got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert hits >= 0.97
    assert got.filter("score < 0 OR score > 1").count() == 0


def test_learns_from_the_other_folds_only(docs):
    rows = [(i, f"text number {i}", "en" if i % 2 else None, "s") for i in range(40)]
    sample = training_sample(docs(rows), Bounds(), "text", "lang", "doc_id")
    held = {r.doc_id for r in docs(rows).filter(fold(F.col("doc_id")) == 0).collect()}
    learned = set(sample["en"])
    assert set(sample) == {"en"}
    assert learned <= {t for i, t, lang, _ in rows if lang and i not in held}


def test_sample_is_bounded(docs):
    rows = [(i, "abcdefghij " * 30, f"l{i % 3}", "s") for i in range(600)]
    bounds = Bounds(docs=5, chars=1000)
    sample = training_sample(docs(rows), bounds, "text", "lang", "doc_id")
    assert len(sample) == 3
    assert all(len(ts) <= 5 and sum(map(len, ts)) <= 1000 for ts in sample.values())


def test_many_copies_of_few_texts(docs):
    few = [f"wort nummer {i} steht hier im satz" for i in range(20)]
    rows = [(i, few[i % 20], "de", "s") for i in range(10_000)]
    rows += [(10_000 + i, f"the word {i} is here in a row", "en", "s") for i in range(500)]
    sample = training_sample(docs(rows), Bounds(), "text", "lang", "doc_id")
    assert sorted(sample["de"]) == sorted(few)  # each once
    assert len(set(sample["en"])) == len(sample["en"]) == Bounds().docs
    got = language_id(docs(rows)).groupBy("lang", "lang_pred").count().collect()
    assert {(r.lang, r.lang_pred, r["count"]) for r in got} == {("de", "de", 10_000), ("en", "en", 500)}


def test_many_languages(docs):
    rows = [(i, f"{chr(97 + i % 26)}{i % 300} wort", f"l{i % 300:03}", "s") for i in range(3000)]
    assert len(training_sample(docs(rows), Bounds(), "text", "lang", "doc_id")) == 300
    got = language_id(docs(rows)).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    assert all(r.lang_pred != "und" for r in got)
    # Of more languages than the bound, the most frequent are learned and all rows are identified.
    rows += [(3000 + i, f"text {i}", "often", "s") for i in range(50)]
    few = Bounds(languages=2)
    learned = training_sample(docs(rows), few, "text", "lang", "doc_id")
    assert len(learned) == 2 and "often" in learned
    assert language_id(docs(rows), few).count() == len(rows)


def test_long_texts_stand_in(docs):
    long = "abc def " * 2000
    rows = [(i, long + "x" * (i % 3), "en", "s") for i in range(30)]
    sample = training_sample(docs(rows), Bounds(), "text", "lang", "doc_id")
    assert sample == {"en": [long[:32_000]]}


def test_odd_rows(docs, odd):
    df = docs(odd + [(8, "1234 !!"), (9, "été où ça")], clashing=True)
    got = identify(df, {"en": ["the quick brown fox"], "fr": ["été où ça va"]}).collect()
    by = {r.text: (r.lang_pred, r.score) for r in got}
    assert by[None] == by[""] == by["1234 !!"] == by[" \n\t "] == ("und", 0.0)
    assert by["été où ça"][0] == "fr" and by[odd[0][1]][0] == "en"
    assert {r.lang_pred for r in identify(docs([(1, "abc")]), {}).collect()} == {"und"}
    assert language_id(docs([])).collect() == []
    tie = identify(docs([(1, "zzz")]), {"b": ["x"], "a": ["x"]}).first()
    assert (tie.lang_pred, tie.score) == ("a", 0.0)
    assert np.isfinite([r.score for r in got]).all()
