import hashlib
import random

import pytest

from marginflow.llm import middle
from marginflow.llm.middle import Cut, Frames


def plain_cut(doc_id, text):
    """The contract on whole strings."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, mid, suffix = text[:a], text[a:b], text[b:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{mid}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


TEXTS = ["", "a", "é", "<P", "S>", "<", "a<S>b", "äöü€😀" * 50, "x" * 1000, "<S<S<M<P<" * 9, "\n \t", "日本語 text " * 40]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10_000])
def test_frames_are_seekable_and_cut_between_code_points(size):
    draw = random.Random(size)
    for text in TEXTS:
        made = Frames.of([text.encode()], size)
        assert made.n == len(text)
        assert b"".join(made.part(0, made.n)).decode() == text
        for _ in range(20):
            i, j = sorted((draw.randint(0, len(text)), draw.randint(0, len(text))))
            assert b"".join(made.part(i, j)).decode() == text[i:j]
            mark = draw.choice(["<S>", "<S", "x", "😀"])
            if mark.isascii():
                assert made.find(mark.encode(), i) == text.find(mark, i)


@pytest.mark.parametrize("size", [1, 2, 5, 4096])
def test_every_form_is_restored_from_its_output(size):
    draw = random.Random(7)
    for text in TEXTS:
        if any(m in text for m in ("<P>", "<S>", "<M>")):
            continue
        framed = Frames.of([text.encode()], size)
        for form in ("psm", "spm", "plain"):
            for _ in range(10):
                i, j = sorted((draw.randint(0, len(text)), draw.randint(0, len(text))))
                how = Cut(form, i, j)
                output = Frames.of(middle.rearranged(framed, how), size)
                assert b"".join(middle.restored(output, form)).decode() == text


def run(df, **options):
    return middle.digests(middle.fill_middle(middle.frame_texts(df, **options)))


def test_digests_as_the_contract_says(docs, odd):
    rows = [*odd, *((100 + i, t) for i, t in enumerate(TEXTS)), *((1000 + i, f"Text {i} – ü" * i) for i in range(60))]
    got = run(docs(rows, clashing=True)).collect()
    assert len(got) == len(rows)
    want = sorted(
        (-1 if i is None else i, *map(str, plain_cut(i, t or "")[:4]), sha(plain_cut(i, t or "")[4]), sha(t or ""))
        for i, t in rows
    )
    assert want == sorted(
        (-1 if r.doc_id is None else r.doc_id, str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars),
         r.output_sha256, r.restored_sha256)
        for r in got
    )
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_small_frames_give_the_same(docs, odd):
    rows = [*odd, (50, "äöü€😀" * 400)]
    one = sorted(map(str, run(docs(rows)).collect()))
    many = middle.digests(middle.fill_middle(middle.frame_texts(docs(rows), size=64), size=50))
    assert one == sorted(map(str, many.collect()))


def test_real_outputs_and_the_way_back(docs, odd):
    rows = [(i, t) for i, t in odd if i is not None]
    filled = middle.fill_middle(middle.frame_texts(docs(rows)))
    assert sorted((r.doc_id, r.text) for r in middle.output_texts(filled).collect()) == sorted(
        (i, plain_cut(i, t or "")[4]) for i, t in rows
    )
    assert sorted((r.doc_id, r.text) for r in middle.restore(filled).collect()) == sorted(
        (i, t or "") for i, t in rows
    )


def test_empty_table_and_other_columns(docs):
    assert run(docs([])).collect() == []
    row = run(docs([(1, "some text here")], clashing=True)).first()
    assert row.lang == "en" and row.row == "x" and "text" not in row
    assert middle.fill_middle(middle.frame_texts(docs([(1, "x" * 9)]), keep=["doc_id"])).columns == [
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "frames", "upto"]


def test_one_very_long_text(docs):
    text = "".join(f"wört{i} " for i in range(400_000))
    got = run(docs([(3, text)])).first()
    want = plain_cut(3, text)
    assert (got.n, got.form, got.prefix_chars, got.middle_chars) == want[:4]
    assert (got.output_sha256, got.restored_sha256) == (sha(want[4]), sha(text))
