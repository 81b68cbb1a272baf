import re
from collections import Counter

import pytest

from tests.llm import cases
from tillroll.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    again = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(again), failed,
    )


MORE = [
    "a b c a b c",
    "x x x x",
    "a b c d a b c e a b",
    "## ** $$ %% && || <> " * 20 + "\nsame line\nsame line\n \n \nsame line",
    "é ü 漢字 " * 40,
    " ".join(f"w{i}" for i in range(60)),
]


def test_measures_of_odd_texts(spark):
    rows = cases.odd_rows(MORE)
    got = quality.judge(cases.frame(spark, rows), carry=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (
            r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]
        ) == brute(r["text"])
        assert not (r["base_failed"] and r["kept"])


def test_outlier_of_a_source_goes_and_its_like_stay(spark):
    plain = [(i, " ".join(f"word{i}x{j}" for j in range(80)), "en", "s", None, None, None) for i in range(150)]
    loud = (999, " ".join(f"word{j} ###" for j in range(80)), "en", "s", None, None, None)
    noisy = [(1000 + i, " ".join(f"{i}a{j} |" for j in range(60)), "en", "t", None, None, None) for i in range(150)]
    docs = cases.frame(spark, [*plain, loud, *noisy])
    kept = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    assert kept == {r[0] for r in plain} | {r[0] for r in noisy}


def test_small_groups_use_merged_sketches(spark):
    rows = [(i, " ".join(f"word{i}x{j}" for j in range(80)), None, f"s{i}", None, None, None) for i in range(120)]
    rows.append((500, " ".join(f"word{j} ###" for j in range(80)), None, "own", None, None, None))
    kept = {r["doc_id"] for r in quality.keep_good(cases.frame(spark, rows)).collect()}
    assert kept == set(range(120))


def test_only_built_in_functions(spark):
    plan = quality.measure(cases.frame(spark, cases.odd_rows()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_columns_stay_in_a_filter(spark):
    docs = cases.frame(spark, cases.odd_rows(MORE))
    assert quality.keep_good(docs).schema == docs.schema


@pytest.mark.parametrize("fn", [quality.judge, quality.keep_good])
def test_empty_table(spark, fn):
    assert fn(cases.empty(spark)).count() == 0


def test_fences_too_large_to_broadcast(spark, no_broadcast):
    rows = [(i, " ".join(f"word{i}x{j}" for j in range(80)), "en", "s", None, None, None) for i in range(150)]
    rows += [(1000 + i, " ".join(f"word{i}x{j}" for j in range(80)), None, f"t{i}", None, None, None) for i in range(9)]
    rows.append((999, " ".join(f"word{j} ###" for j in range(80)), "en", "s", None, None, None))
    kept = sorted(r["doc_id"] for r in quality.keep_good(cases.frame(spark, rows)).collect())
    assert kept == [r[0] for r in rows if r[0] != 999]
