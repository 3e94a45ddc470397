from marginflow.llm.quality import LineRules, clean, judge, quality_rules, repeated_words

GOOD = "This line is prose, as one would write it down. It ends in a full stop."


def brute_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 5))
    return len(hit)


def test_repeated_words_against_brute_force():
    import random

    draw = random.Random(3)
    for n in [*range(0, 12), 40, 90]:
        for letters in (1, 2, 3):
            words = [draw.choice("abc"[:letters]) for _ in range(n)]
            assert repeated_words(words) == brute_repeats(words)


def test_line_rules():
    rules = LineRules()

    def kept(text):
        v = judge(text, rules)
        return v["kept"], v["clean_text"]

    nav = "Home | News | Sports | About | Contact"
    assert kept(f"{GOOD}\n{nav}") == (True, GOOD)
    assert kept(f"{GOOD}\nAll rights reserved.") == (True, GOOD)
    assert kept(f"{GOOD}\n{GOOD}")[1] == GOOD  # a repeated line goes
    assert not kept(f"{GOOD}\n{GOOD}")[0]  # and its windows repeat
    assert not kept("\n".join([nav] * 3 + ["A short line, fine."]))[0]
    assert not kept(" ".join(f"ab{i}$$$" for i in range(30)))[0]
    assert not kept(" ".join(f"WORD{i}!!" for i in range(30)))[0]
    assert not kept(" ".join(w for i in range(20) for w in [f"w{i}."] * 2))[0]
    assert not kept("no sentence mark in this line at all but many words follow here")[0]


def test_contract_columns():
    v = judge("a#b c\x0bd\n\na#b c\x0bd e", LineRules())
    # The no-break space is no blank here, the vertical tab is one.
    assert (v["n_words"], v["word_chars"], v["n_symbols"], v["n_dup_lines"]) == (6, 12, 2, 0)
    assert v["base_failed"] and not v["kept"]


def test_odd_rows(docs, odd):
    got = quality_rules(docs(odd, clashing=True)).collect()
    assert len(got) == len(odd)
    by_text = {r.text: r for r in got}
    assert by_text[None].n_words == 0 and not by_text[None].kept and by_text[None].clean_text == ""
    assert by_text[""].base_failed and by_text[" \n\t "].n_words == 0
    assert by_text[odd[7][1]].n_words == 60_000
    assert by_text[odd[0][1]].kept and by_text[odd[0][1]]["size"] == "x"
    assert quality_rules(docs([])).collect() == []
    cleaned = clean(docs(odd, clashing=True))
    assert cleaned.columns == docs(odd, clashing=True).columns
    assert {r.doc_id for r in cleaned.collect()} <= {1, 5, 7, None}
