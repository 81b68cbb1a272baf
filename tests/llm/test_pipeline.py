"""Each stage of the pipeline against a plain version of it, on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
from tests.llm import cases, test_mixing, test_packing, test_pii, test_quality, test_simhash
from tillroll.session import stage


def plain(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_stages(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    schema = docs.schema
    kept, rows = [], docs.collect()
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, cases.SF), name)
        kept.append(docs.collect())
        if name != "pack_sequences":
            assert docs.schema == schema

    good = {r["doc_id"] for r in kept[0]}
    passed = {r["doc_id"] for r in rows if not test_quality.brute(r["text"])[-1]}
    assert good <= passed and len(good) > 0.9 * len(passed)

    prints = [test_simhash.brute_fingerprint(r["text"]) for r in kept[0]]
    groups = test_simhash.brute_components(prints, [r["doc_id"] for r in kept[0]])
    assert sorted(r["doc_id"] for r in kept[1]) == sorted(set(groups))

    before = dict(plain(kept[1]))
    assert sorted(before) == sorted(r["doc_id"] for r in kept[2])
    for r in kept[2]:
        spans = test_pii.brute(before[r["doc_id"]])
        assert not spans or r["text"] != before[r["doc_id"]]
        assert not test_pii.brute(r["text"])
        assert r["n_chars"] == len(r["text"])
        if not any(c.isdigit() or c in "@+" for c in before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]

    times = Counter(r["doc_id"] for r in kept[3])
    taken = []
    for r in kept[2]:
        n = len(r["text"].split())
        taken.append({"doc_id": r["doc_id"], "size": n, "taken": n * times[r["doc_id"]], "source": r["source"]})
    sizes = Counter()
    for t in taken:
        sizes[t["source"]] += t["size"]
    target = test_mixing.brute_targets(dict(sizes))
    for source in sizes:
        got = sum(t["taken"] for t in taken if t["source"] == source)
        assert target[source] - 400 <= got <= target[source] + 1e-6
    assert max(times.values()) <= 3

    test_packing.check(plain(kept[3]), kept[4])


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, cases.SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 0


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet").where("false")
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, cases.SF), name)
    assert docs.count() == 0
