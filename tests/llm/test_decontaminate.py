import random
import re

import pytest
from llm.plain_versions import has_near

from marginflow.llm.decontaminate import Budget, Index, benchmark_hits, decontaminate, plain


@pytest.fixture
def items(spark):
    def make(rows):
        return spark.createDataFrame(rows, "item_id long, text string")

    return make


def corpus(seed=1):
    draw = random.Random(seed)
    syllables = ["the", "ing", "an", "er", "to", "re", " ", " ", "st", "on"]

    def run(n):
        return "".join(draw.choice(syllables) for _ in range(n))

    bench = [(i, run(draw.randint(15, 60))) for i in range(8)]
    rows = []
    for i in range(60):
        text = run(draw.randint(0, 120))
        if i % 2:
            item = list(plain(draw.choice(bench)[1]))
            for _ in range(draw.choice([0, 1, 2, 4, 8, 12])):
                at = draw.randrange(len(item))
                change = draw.choice("sid")
                if change == "s":
                    item[at] = draw.choice("aeiou")
                elif change == "i":
                    item.insert(at, draw.choice("xyz"))
                else:
                    del item[at]
            at = draw.randint(0, len(text))
            text = text[:at] + "".join(item) + text[at:]
        rows.append((i, text.upper() if i % 5 == 0 else text))
    return rows, bench


def test_against_brute_force(docs, items):
    rows, bench = corpus()
    got = {(r.doc_id, r.item_id): r.edits for r in benchmark_hits(docs(rows), items(bench)).collect()}
    budget, want = Budget(), {}
    for i, t in rows:
        for k, b in bench:
            b = plain(b)
            near, edits = has_near(b, plain(t), budget.edits(len(b)))
            if near and len(b) >= budget.q:
                want[i, k] = edits
    assert set(got) == set(want) and len(want) > 10
    assert all(want[p] <= got[p] <= Budget().edits(10**3) for p in want)


def test_blocks_of_items_give_the_same(docs, items):
    rows, bench = corpus(3)
    one = benchmark_hits(docs(rows), items(bench))
    many = benchmark_hits(docs(rows), items(bench), block_chars=100)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    clean = {r.doc_id for r in decontaminate(docs(rows), items(bench), block_chars=100).collect()}
    assert clean == {i for i, _ in rows} - {r.doc_id for r in one.collect()}


def test_odd_rows(docs, items, odd):
    bench = [(1, "Fox  jumps\nover the LAZY dog"), (1, "fox jumps over the lazy dog"), (2, None)]
    bench += [(None, "fox jumps over the lazy dog"), (3, "dog"), (4, "")]
    df = docs(odd, clashing=True)
    got = [(r.doc_id, r.item_id, r.edits) for r in benchmark_hits(df, items(bench)).collect()]
    assert set((i or 0, k, e) for i, k, e in got) == {
        (i, k, 0) for i in (0, 1, 7) for k in (1, 3, None)
    }
    kept = decontaminate(df, items(bench))
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 3, 4, 5, 6]
    assert benchmark_hits(docs([]), items(bench)).collect() == []
    assert benchmark_hits(df, items([])).collect() == []
    assert decontaminate(df, items([])).count() == len(odd)


def test_a_match_over_the_end_of_a_text_does_not_count():
    index = Index([(1, "abcdefghijklmnopqrstuvwxyz")], Budget())
    assert index.matches(["xx abcdefghijklm", "nopqrstuvwxyz yy"]) == {}
    assert list(index.matches(["", "abcdefghijklmnopqrstuvwxyz"])) == [(1, 0)]


def test_short_items_are_found_as_whole_words(docs, items):
    rows = [
        (1, "say YES now"), (2, "yesterday"), (3, "oh\nyes"), (4, "一二三四五"),
        (5, "x y  z"), (6, ""), (7, None), (8, "yes-no, a1"), (None, "yes"),
    ]
    bench = [(10, "Yes"), (11, "yes"), (12, "二三"), (13, "y z"), (14, " "), (15, "a"), (16, "s n")]
    got = benchmark_hits(docs(rows), items([*bench, (None, "yes")])).collect()
    want = {(i, k) for i in (1, 3, 8, None) for k in (10, 11, None)} | {(4, 12), (5, 13)}
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {(r.edits, r.end) for r in got if r.doc_id == 3} == {(0, 6)}
    kept = {r.doc_id for r in decontaminate(docs(rows), items([(None, "yes")])).collect()}
    assert kept == {2, 4, 5, 6, 7}


def test_short_items_against_brute_force():
    draw = random.Random(5)
    texts = [plain("".join(draw.choice("ab. ") for _ in range(draw.randint(0, 60)))) for _ in range(80)]
    bench = [(k, "".join(draw.choice("ab ") for _ in range(draw.randint(1, 9)))) for k in range(60)]
    got = Index(bench, Budget()).matches(texts)
    index, want = Index(bench, Budget()), set()
    for t, text in enumerate(texts):
        for k, item in bench:
            found = re.search(rf"(?<![a-z]){re.escape(plain(item))}(?![a-z])", text)
            if plain(item) and found:
                want.add((t, k))
    assert {(t, index.ids[i]) for t, i in got} == want and len(want) > 50


def test_items_without_an_id_are_items(docs, items):
    passage = "what is the boiling point of water at the top of a high mountain"
    rows = [(1, f"intro {passage} outro"), (2, "nothing of the kind in here at all")]
    hits = benchmark_hits(docs(rows), items([(None, passage), (None, passage), (4, passage)])).collect()
    assert {(r.doc_id, r.item_id) for r in hits} == {(1, None), (1, 4)} and len(hits) == 2
    assert [r.doc_id for r in decontaminate(docs(rows), items([(None, passage)])).collect()] == [2]
