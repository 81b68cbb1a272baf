import zlib
from collections import Counter

import numpy as np

from tests.llm import cases
from tillroll.llm import language
from tillroll.llm.queries import QUERIES


def brute_grams(text):
    words, word = [], ""
    for c in text or "":
        if c.isalpha():
            low = c.lower()
            word += low if len(low) == 1 and low.isalpha() else c
        elif word:
            words.append(word)
            word = ""
    words += [word] if word else []
    n = Counter()
    for w in words:
        n.update(w)
        padded = f" {w} "
        n.update(padded[i : i + 2] for i in range(len(padded) - 1))
        n.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return n


def code(gram):
    out = 0
    for c in gram:
        out = out * language.WIDE + ord(c)
    return out


def brute_predict(text, profiles):
    n = brute_grams(text)
    if not n:
        return "und", 0.0
    place = {g: i for i, g in enumerate(profiles.known.tolist())}
    seen = sorted((-c, place[code(g)]) for g, c in n.items() if code(g) in place)[: language.PROFILE]
    distances = [
        sum(min(abs(int(ranks[p]) - i), language.PROFILE) for i, (_, p) in enumerate(seen)) for ranks in profiles.rank
    ]
    best = int(np.argmin(distances))
    return profiles.languages[best], 1 - distances[best] / (len(seen) * language.PROFILE) if seen else 0.0


def test_query_on_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in cases.given("/root/testdata/sf0.01")}
    got = QUERIES["op10_language"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    right = []
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if r["held_out"] and len(rows[r["doc_id"]]["text"] or "") > 60:
            right.append(r["lang_pred"] == rows[r["doc_id"]]["lang"])
    assert len(right) > 100 and np.mean(right) > 0.97


def test_counts_and_predictions_against_brute_force(spark):
    texts = ["The cat, the HAT! İı ß", "le chat noir été", "der Hund 漢字", "x", "123", "Ünder the   sea\n\nsea", "ΑΒΓ"]
    rows = cases.odd_rows(texts)
    docs = cases.frame(spark, rows)
    profiles = language.learn(docs)
    want = {}
    for r in rows:
        if r[2] is not None and r[1] is not None:
            want.setdefault(r[2], Counter()).update(brute_grams(r[1]))
    assert profiles.languages == sorted(k for k, v in want.items() if v)
    for name, ranks in zip(profiles.languages, profiles.rank):
        order = sorted(want[name], key=lambda g: (-want[name][g], code(g)))[: language.PROFILE]
        got = {profiles.known[i]: r for i, r in enumerate(ranks.tolist()) if r < language.PROFILE}
        assert got == {code(g): i for i, g in enumerate(order)}
    for r in language.predict(docs, profiles, keep=("doc_id", "text")).collect():
        lang, score = brute_predict(r["text"], profiles)
        assert (r["lang_pred"], round(r["score"], 9)) == (lang, round(score, 9))


def test_nothing_learned_and_empty_table(spark):
    profiles = language.learn(cases.empty(spark))
    got = language.predict(cases.frame(spark, cases.odd_rows()), profiles).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert language.predict(cases.empty(spark), profiles).count() == 0
