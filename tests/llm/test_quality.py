import re
from collections import defaultdict

from mediajobs.llm import quality

SCHEMA = "doc_id long, text string, n_words string"


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(repeated),
    )


TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "a b c d e",
    "a b c d e a b c d e",
    "x x x x x x x x",
    "é ü " * 7 + "\n\n é \x0b z",
    "same line here\nsame line here\n \nother | # <x>",
    " ".join(f"w{i % 97}" for i in range(30000)),
    " ".join(f"w{i}" for i in range(50)),
    " ".join(f"w{i}" for i in range(50)),
]


def test_base_counts_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "a b", None)], SCHEMA)
    got = {r.doc_id: r for r in quality.digest(docs).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        r = got[i]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed
        assert not (failed and r.kept)
    assert got[10].kept


def test_order_changes_no_verdict_and_rejects_junk(spark):
    rows = [
        (1, " ".join(f"word{i}" for i in range(40)), "x"),
        (2, " ".join(f"w{i}%%%" for i in range(40)), "x"),
        (3, " ".join(f"W{i}!!" for i in range(40)), "x"),
        (4, " ".join(f"w{i} w{i} w{i}" for i in range(40)), "x"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [r.doc_id for r in quality.keep_good(docs).collect()] == [1]
    assert quality.keep_good(docs).columns == docs.columns
    for n in (1, 4):
        out = {r.doc_id: r.rejected_by for r in quality.apply_rules(docs, sample_rows=n).collect()}
        assert out == {1: None, 2: "symbols", 3: "bangs", 4: "stutter"}


def test_greedy_order_looks_at_what_is_left():
    # rule 1 rejects most, but only what the cheap rule 0 rejects already
    sets = {0b000: 50, 0b011: 30, 0b001: 5, 0b100: 10, 0b010: 1}
    assert quality.greedy(sets, [10.0, 11.0, 10.0]) == [0, 2, 1]
    assert quality.greedy(sets, [10.0, 1.0, 1000.0]) == [1, 0, 2]
    assert quality.greedy({}, [3.0, 2.0]) == [1, 0]


def test_measures_every_rule_on_a_sample(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j % (3 + i)}" for j in range(200)), "x") for i in range(120)], SCHEMA)
    sets, costs = quality.measured(docs, "text", 60)
    assert 20 < sum(sets.values()) < 110
    assert len(costs) == len(quality.rules(quality.features()))
    assert all(0 < t < 1e9 for t in costs)
    assert costs[0] < max(costs)  # counting words that are there already is cheap


def test_empty_table(spark):
    assert quality.digest(spark.createDataFrame([], SCHEMA)).count() == 0
