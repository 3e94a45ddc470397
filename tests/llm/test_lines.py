import random

from llm.plain_versions import late_lines, words

from marginflow.llm.lines import drop_lines, line_dedup
from marginflow.llm.queries import QUERIES


def corpus(seed=2):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    lines = [
        " ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 60))) for _ in range(60)
    ]
    rows = []
    for i in range(60):
        own = []
        for _ in range(draw.randint(0, 8)):
            w = draw.choice(lines).split()
            for _ in range(draw.choice([0, 0, 1, 2])):
                at = draw.choice([0, len(w) - 1, draw.randrange(len(w))])
                w[at] = draw.choice(vocabulary)
            own.append(" ".join(w))
        rows.append((i, "\n".join(own)))
    return rows


def test_against_brute_force(docs):
    rows = corpus()
    got = {(r.doc_id, k) for r in line_dedup(docs(rows)).collect() for k in r.removed}
    want = late_lines(rows)
    assert got == want and len(want) > 50


def test_a_chain_of_lines_in_which_the_first_is_far_from_the_last(docs):
    """A line may have an earlier partner that is not the first of any key they share."""
    base = [f"b{i}" for i in range(60)]
    rows, line = [], list(base)
    for i in range(30):
        line = list(line)
        line[(7 * i) % 60] = f"x{i}"
        rows.append((i, " ".join(line)))
    rows += [(50 + i, t) for i, (_, t) in enumerate(rows[::-1])]
    got = {(r.doc_id, k) for r in line_dedup(docs(rows)).collect() for k in r.removed}
    assert got == late_lines(rows)


def test_a_hot_line_and_its_near_copies_in_many_blocks(docs, monkeypatch):
    from marginflow.llm import links

    monkeypatch.setattr(links, "BLOCK_ITEMS", 16)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(base) + "\nown line of number %d here" % i) for i in range(60)]
    rows += [(100 + i, " ".join([*base[: i % 80], f"x{i}", *base[i % 80 + 1 :]])) for i in range(90)]
    got = {(r.doc_id, k) for r in line_dedup(docs(rows)).collect() for k in r.removed}
    assert got == late_lines(rows)


def test_lines_of_a_least_length(docs):
    rows = corpus(4)
    got = {(r.doc_id, k) for r in line_dedup(docs(rows), least=5).collect() for k in r.removed}
    assert got == late_lines(rows, least=5)


def test_text_without_the_lines(docs):
    rows = [(1, "a b c d e f\n\nshort"), (2, "g h i j k\na b c d e f\nlast"), (3, None)]
    df = docs(rows, clashing=True)
    found = line_dedup(df)
    out = drop_lines(df, found)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {
        1: "a b c d e f\n\nshort", 2: "g h i j k\nlast", 3: None
    }


def test_odd_rows(docs, odd):
    got = {r.doc_id: r for r in line_dedup(docs(odd, clashing=True)).collect()}
    assert set(got) == {i for i, _ in odd}
    # The null id comes first; its line is a near copy that the others repeat.
    assert got[1].n_lines == 2 and list(got[1].removed) == [0] and list(got[7].removed) == [0]
    assert got[None].n_removed == 0 and got[2].n_lines == got[3].n_lines == got[4].n_lines == 0
    assert got[5].n_lines == 1 and len(words(odd[7][1])) == 60_000
    assert line_dedup(docs([])).collect() == []


def test_short_lines_against_brute_force(docs):
    draw = random.Random(3)
    menu = ["Home", "Read more", "Read  more", "Log in now", "a a", "a a a", "All rights are kept"]
    rows = [
        (i, text + "\n" + "\n".join(draw.choices([*menu, "", " "], k=draw.randint(0, 5))))
        for i, text in corpus(9)
    ]
    found = line_dedup(docs(rows)).collect()
    got = {(r.doc_id, k) for r in found for k in r.removed}
    want = late_lines(rows)
    assert got == want and len(want) > len(late_lines(rows, least=5)) + 50
    lines = {i: sum(bool(words(k)) for k in text.split("\n")) for i, text in rows}
    assert {r.doc_id: r.n_lines for r in found} == lines


def test_the_query_looks_at_short_lines(spark, docs, tmp_path):
    rows = [(1, "one two three\nRead more"), (2, "four\n\nRead more"), (3, "Read more")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_lines, list(r.removed)) for r in got} == {
        1: (2, []), 2: (2, [2]), 3: (1, [0])
    }
