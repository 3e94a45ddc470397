import random

from llm.plain_versions import classes, grams, jaccard_links, similar, words

from marginflow.llm import links as links_module
from marginflow.llm.jaccard import jaccard_groups, keep_one


def corpus(seed=1, n=40):
    """Texts with exact copies, near copies at many similarities and chains of them."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[draw.choice(vocabulary) for _ in range(draw.randint(1, 60))] for _ in range(n)]
    rows = []
    for b in base:
        rows.append(b)
        for _ in range(draw.randint(0, 4)):
            copy = list(draw.choice(rows[-3:]))
            for _ in range(draw.randint(0, 2)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append(copy)
    draw.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def expected(rows):
    links = jaccard_links(rows)
    label = classes(len(rows), links)
    return {rows[i][0]: (rows[label[i]][0], len(links[i])) for i in range(len(rows))}


def holds(rows, got):
    """Classes are those of all links; what is told of links is true and holds classes together."""
    want, text = expected(rows), dict(rows)
    assert {r.doc_id: r.class_id for r in got} == {i: c for i, (c, _) in want.items()}
    for r in got:
        known = want[r.doc_id][1]
        assert (r.n_links > 0) == (known > 0) and r.n_links <= known
        mine, other = grams(text[r.doc_id]), grams(text[r.rep_id])
        assert mine == other or similar(mine, other)
    # Every class hangs together by its links: n - 1 at least, each counted at both ends.
    size, told = {}, {}
    for r in got:
        size[r.class_id] = size.get(r.class_id, 0) + 1
        told[r.class_id] = told.get(r.class_id, 0) + r.n_links
    assert all(told[c] >= 2 * (n - 1) or len({text[r.doc_id] for r in got if r.class_id == c}) < n for c, n in size.items())


def test_against_brute_force(docs):
    rows = corpus()
    holds(rows, jaccard_groups(docs(rows)).collect())
    assert sum(n > 0 for _, n in expected(rows).values()) > 20


def test_whole_table_against_brute_force(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    holds([tuple(r) for r in given.collect()], jaccard_groups(given).collect())


def crowd(n, draw):
    """Near copies of one text, each with a word of its own."""
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(n):
        copy = list(base)
        copy[draw.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    return rows


def test_a_large_group_of_near_copies_moves_once_for_each_representative(docs, monkeypatch):
    monkeypatch.setattr(links_module, "BLOCK_ITEMS", 16)
    seats, whole = [], links_module.compared_seats

    def counted(rows, *others):
        seats.append(rows.count())
        return whole(rows, *others)

    monkeypatch.setattr(links_module, "compared_seats", counted)
    moved = {}
    for n in (150, 1500):
        rows = crowd(n, random.Random(9))
        rows += [(n + i, "the same few words again") for i in range(50)]
        seats.clear()
        got = jaccard_groups(docs(rows)).collect()
        assert {r.class_id for r in got if r.doc_id < n} == {0}
        assert {(r.class_id, r.n_links, r.rep_id) for r in got if r.doc_id >= n} == {(n, 49, n)}
        moved[n] = sum(seats)
        if n == 150:
            holds(rows, got)
    assert moved[1500] < 14 * moved[150]  # in proportion, not with the square


def test_links_between_crowds_and_strangers(docs):
    """Texts at the edge of a crowd, linked to members other than its representatives."""
    draw = random.Random(5)
    rows = crowd(60, draw)
    for i in range(40):
        words_ = rows[draw.randrange(60)][1].split()
        for k in range(draw.randint(1, 4)):
            words_[draw.randrange(120)] = f"y{i}-{k}"
        rows.append((100 + i, " ".join(words_)))
    holds(rows, jaccard_groups(docs(rows)).collect())


def test_keeps_one_of_each_class(docs):
    rows = corpus(7, 20)
    want = {c for c, _ in expected(rows).values()}
    kept = keep_one(docs(rows, clashing=True))
    assert kept.columns == docs(rows, clashing=True).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_odd_rows(docs, odd):
    df = docs(odd, clashing=True)
    got = [((r.doc_id or -1), r.class_id, r.n_links) for r in jaccard_groups(df).collect()]
    assert len(got) == len(odd)
    by_id = {i: (c, n) for i, c, n in got}
    # Three rows with the same text; the null id's text is a near copy of it.
    assert by_id[1] == by_id[7] == (1, 3) and by_id[2] == (2, 0) and by_id[3] == (3, 0)
    assert by_id[4] == (4, 0) and by_id[5] == (5, 0) and by_id[6] == (6, 0)
    kept = [r.doc_id for r in keep_one(df).collect()]
    without = [i for i, t in odd if not words(t)]
    assert all(kept.count(i) == without.count(i) for i in without)
    assert 7 not in kept and kept.count(5) == kept.count(6) == 1
    assert jaccard_groups(docs([])).collect() == [] and keep_one(docs([])).collect() == []


def test_rows_that_repeat_an_id_with_other_texts(docs):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (2, "g h i j k l")]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_groups(docs(rows)).collect())
    assert got == [(1, 1, 0), (1, 1, 2), (2, 1, 2), (2, 1, 2)]
    assert sorted(r.text for r in keep_one(docs(rows)).collect()) == ["a b c d e f", "g h i j k l"]


def test_every_link_of_a_crowd_counts(docs, monkeypatch):
    """Members of a crowd are linked to each other, not to representatives alone, across blocks too."""
    monkeypatch.setattr(links_module, "BLOCK_ITEMS", 16)
    draw = random.Random(12)
    for rows in (crowd(50, draw) + [(100 + i, crowd(1, draw)[0][1]) for i in range(3)], corpus(4)):
        rows += [(1000 + i, rows[0][1]) for i in range(4)]  # equal copies count one by one
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_groups(docs(rows)).collect()}
        assert got == expected(rows)
