from collections import Counter, defaultdict

import corpus_pipeline
from llm.plain_versions import classes, jaccard_links

from marginflow.llm import mixing
from marginflow.llm.decontaminate import Budget, Index, plain
from marginflow.llm.quality import LineRules, judge

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    rows = {r.doc_id: r for r in docs.collect()}
    reached = docs
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, reached, SMALL).write.parquet(f"{tmp_path}/{i}")
        reached = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert reached.columns == docs.columns
        seen.append(reached.collect())
    # Quality: the verdicts of the rules, and cleaned texts.
    judged = {i: judge(r.text, LineRules()) for i, r in rows.items()}
    kept = sorted((i, v["clean_text"]) for i, v in judged.items() if v["kept"])
    assert sorted((r.doc_id, r.text) for r in seen[0]) == kept
    assert all(r.n_chars == len(r.text) for r in seen[0])
    # Near copies: the first of each class.
    label = classes(len(kept), jaccard_links(kept))
    firsts = [kept[k] for k in sorted(set(label))]
    assert sorted((r.doc_id, r.text) for r in seen[1]) == firsts
    # Decontamination.
    index = Index([(b.item_id, b.text) for b in bench], Budget())
    clean = [(i, t) for i, t in firsts if not index.matches([plain(t)])]
    assert sorted((r.doc_id, r.text) for r in seen[2]) == clean and len(clean) < len(firsts)
    # Mix: whole documents, three times at most.
    copies = Counter(r.doc_id for r in seen[3])
    assert set(copies) <= {i for i, _ in clean} and max(copies.values()) <= 3
    # Shards: all that was mixed, gapless, near-equal bytes.
    assert Counter(r.doc_id for r in seen[4]) == copies
    slots, sizes = defaultdict(list), Counter()
    for r in seen[4]:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in seen[4])
    # The order of the mix stays, so its shards and its shuffle do.
    mixed = mixing.copies(mixing.mix(spark.read.parquet(f"{tmp_path}/2"))).collect()
    in_mix = [r.doc_id for r in sorted(mixed, key=lambda r: (r.mix_shard, r.mix_order))]
    assert [r.doc_id for r in sorted(seen[4], key=lambda r: (r.shard, r.slot))] == in_mix
    # Copies of a document do not lie side by side, but for a few by chance.
    several = {i for i, n in copies.items() if n > 1}
    side_by_side = {a for a, b in zip(in_mix, in_mix[1:]) if a == b}
    assert len(several) > 20 and len(side_by_side) < len(several) / 5


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SMALL).columns[-3:] == ["size", "shard", "slot"]


def test_odd_documents(spark, docs, odd):
    reached = docs(odd, clashing=True)
    for _, stage in corpus_pipeline.STAGES:
        reached = stage(spark, reached, SMALL)
    assert reached.count() >= 1
    empty = docs([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.collect() == []
