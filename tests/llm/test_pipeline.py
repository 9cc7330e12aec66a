"""The pipeline against the operators' brute-force versions, stage by stage."""

from collections import Counter

import corpus_pipeline
from test_operators import WORD, brute_components, brute_fingerprint, brute_mix, odd_docs, tokenizer

from glyphmill.llm import quality_rules, queries

DATA = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    verdict = {r["doc_id"]: r["kept"] for r in queries.op6_quality_rules(spark, DATA).collect()}  # held against SQL elsewhere
    left = [d for d in docs if verdict[d[0]]]
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t)
    first = {}
    for d in sorted(left):
        first.setdefault(norm(d[1]), d)
    left = list(first.values())
    root = brute_components([(d[0], brute_fingerprint(d[1])) for d in left])
    left = [d for d in left if root[d[0]] == d[0]]
    sizes, targets = brute_mix([(d[0], d[1], d[3]) for d in left])
    got = corpus_pipeline.run(spark, DATA).collect()
    library, texts = tokenizer(), {d[0]: d for d in left}
    times = Counter(r["doc_id"] for r in got)
    assert set(times) <= set(texts) and max(times.values()) <= 3
    for r in got:
        assert list(r["ids"]) == library.encode(texts[r["doc_id"]][1], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    taken = Counter()
    for doc, n in times.items():
        taken[texts[doc][3]] += n * len(WORD.findall(texts[doc][1]))
    longest = {s: max(len(WORD.findall(d[1])) for d in left if d[3] == s) for s in sizes}
    assert all(abs(taken[s] - targets[s]) <= longest[s] / 2 + 1 for s in sizes)


def test_stages_take_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    for n in (100, 0):
        rows = docs.limit(n)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, DATA)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == list(corpus_pipeline.COLUMNS), name
            out.collect()


def test_stages_are_the_named_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "bpe_encode"]
    assert quality_rules.MIN_WORDS == 20
