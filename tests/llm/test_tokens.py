import pytest

from marginflow.llm import tokens

FOLDER = "/opt/tokenizers"
VOCABULARY = f"{FOLDER}/byte_bpe_50k.tiktoken"


def brute(texts):
    count = tokens.encoder(open(VOCABULARY, "rb").read(), "tiktoken")
    return count([t or "" for t in texts])


def test_counts_and_every_limit(docs):
    texts = [f"Some words, {'more ' * (i % 40)}{i}" for i in range(400)] + [None, ""]
    df = docs(list(enumerate(texts)))
    lengths = brute(texts)
    counts = tokens.token_counts(df, VOCABULARY, keep=["doc_id"])
    assert {r.doc_id: r.n_tokens for r in counts.collect()} == dict(enumerate(lengths))
    limits = tokens.context_limits(tokens.length_histogram(counts)).cache()
    for r in limits.collect():
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_longer == sum(n > r.n_tokens for n in lengths)
        assert r.tokens_longer == sum(n for n in lengths if n > r.n_tokens)
        assert r.truncated_tokens == sum(min(n, r.n_tokens) for n in lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
    for limit in (0, 3, 7, 10**6):
        got = tokens.truncated_total(limits, limit).first()
        assert got.truncated_tokens == sum(min(n, limit) for n in lengths)
        assert got.docs_longer == sum(n > limit for n in lengths)
    for share in (0.01, 0.5, 0.99, 1.0):
        n = tokens.quantile(limits, share).first().n_tokens
        assert sum(x <= n for x in lengths) >= share * len(lengths)
        assert sum(x < n for x in lengths) < share * len(lengths)


def test_sums_run_over_many_runs_of_lengths(spark):
    rows = [(n, 1 + n % 3) for n in [0, 1, 4095, 4096, 8192, 50_000, 2**31]]
    hist = spark.createDataFrame(rows, "n_tokens long, n_docs long")
    for r in tokens.context_limits(hist).collect():
        assert r.docs_longer == sum(k for n, k in rows if n > r.n_tokens)
        assert r.tokens_longer == sum(n * k for n, k in rows if n > r.n_tokens)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(docs, name):
    got = tokens.token_counts(docs([(1, "Hello there, world"), (2, "")]), f"{FOLDER}/{name}")
    n = {r.doc_id: r.n_tokens for r in got.collect()}
    assert 3 <= n[1] <= 6 and n[2] == 0


def test_odd_rows(docs, odd):
    got = tokens.token_counts(docs(odd, clashing=True), VOCABULARY).collect()
    assert sorted(r.n_tokens for r in got) == sorted(brute([t for _, t in odd]))
    empty = tokens.token_counts(docs([]), VOCABULARY)
    assert tokens.context_limits(tokens.length_histogram(empty)).collect() == []


def test_special_tokens_in_a_text_are_text():
    assert brute(["<|endoftext|>"])[0] > 1
