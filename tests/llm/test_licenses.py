import random
import re

from mediajobs.llm import licenses

SCHEMA = "doc_id long, text string, labels string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(text):
    w = words(text)
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_matching_statistics_equal_brute_force():
    r = random.Random(1)
    for _ in range(60):
        seqs = [[r.randrange(4) for _ in range(r.randrange(1, 12))] for _ in range(3)]
        auto = licenses.SuffixAutomaton(seqs)
        text = [r.randrange(5) for _ in range(25)]
        inside = lambda run: any(run == s[i : i + len(run)] for s in seqs for i in range(len(s)))
        longest = [max((n for n in range(1, e + 1) if inside(text[e - n : e])), default=0) for e in range(len(text) + 1)]
        want = [(e, longest[e]) for e in range(1, len(text) + 1) if longest[e] and (e == len(text) or longest[e + 1] != longest[e] + 1)]
        got = auto.matches(text)
        assert [(e, n) for e, n, _ in got] == want
        for e, n, s in got:
            holders = {k for k, q in enumerate(seqs) if any(text[e - n : e] == q[i : i + n] for i in range(len(q)))}
            assert set(auto.ends[s]) == holders
            for k, q in enumerate(seqs):
                want_ends = [i + n for i in range(len(q) - n + 1) if q[i : i + n] == text[e - n : e]]
                assert sorted(auto.ends[s].get(k, [])) == want_ends


def test_best_chain_equals_brute_force():
    from itertools import combinations

    r = random.Random(3)
    for _ in range(150):
        ms = sorted({(r.randrange(150), r.randrange(60), r.randrange(1, 15)) for _ in range(r.randrange(1, 9))})
        best = 0
        for size in range(1, len(ms) + 1):
            for chain in combinations(ms, size):
                total, ok = chain[0][2], True
                for (a, p, m), (b, q, n) in zip(chain, chain[1:]):
                    over = max(0, a + m - b, p + m - q)
                    ok &= a < b and p < q and over < n and b - a - m <= licenses.GAP and q - p - m <= licenses.GAP
                    total += n - over
                if ok:
                    best = max(best, total)
        covered, chain = licenses.best_chain(ms)
        assert covered == best and set(chain) <= set(ms)


def test_labels_and_spans_of_templates_equal_brute_force(spark):
    """Whole templates among words that no template has: spans are the places where they stand."""
    r = random.Random(6)
    rows, want = [], {}
    for i in range(60):
        text, spans, at = [], set(), 0
        for _ in range(r.randrange(4)):
            text += [f"q{r.randrange(999)}x" for _ in range(r.randrange(licenses.GAP + 1, 90))]
            name, label, body = r.choice(licenses.TEMPLATES)
            at = len(text)
            text += words(body)
            spans.add((label, at, len(text)))
        rows.append((i, " ".join(text), "x"))
        want[i] = spans
    for row in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect():
        got = {(s.label, s.start, s.stop) for s in row.spans if s.share == 1.0}
        assert want[row.doc_id] <= got, row.doc_id
        assert {s[0] for s in want[row.doc_id]} <= set(filter(None, row.labels.split(",")))
        # nothing but templates that stand there (or in one that does)
        assert all(any(a <= s.start and s.stop <= b for _, a, b in want[row.doc_id]) for s in row.spans)
        assert row.score == (1.0 if want[row.doc_id] else 0.0)


def test_paragraphs_out_of_order_keep_the_best_chain():
    one = licenses.Scanner(licenses.TEMPLATES)
    body = next(t for n, _, t in licenses.TEMPLATES if n == "zlib")
    w = licenses.tokens(body)
    moved = w[60:70] + [1, 2] + w[:60] + [3] + w[70:]  # a piece that stands too early doesn't close the chain
    ms = one.matches(0, [x for x in moved])
    spans = [s for s in one.chains(ms) if s[0] == "zlib"]
    assert len(spans) == 1 and spans[0][4] >= 0.9


def test_base_and_spans(spark):
    mit = licenses.TEMPLATES[0][2]
    broken = " ".join(x for i, x in enumerate(mit.split()) if i % 17)
    rows = [
        (1, "x " * 30 + "Under the MIT License, under-the-mit.license y"),
        (2, "Licensed under CC BY-NC 4.0."),
        (3, None), (4, ""), (5, "Apache License, Version 2.0 applies"), (6, "é" + mit + " z"), (7, "a b " + broken),
        (8, "ccé by nc cc BY nc"), (None, "CC by\nNC"), (2, "cc by nc by nc cc by nc"), (9, "w " * 200000 + "cc by nc"), (10, "under the MIT"),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    out = licenses.scan(docs.coalesce(1)).collect()
    assert len(out) == len(rows)
    for (i, t), r in zip(rows, out, strict=True):
        assert r.doc_id == i
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t and t[:60]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in out if r.doc_id in (3, 6, 7, 10)}
    assert by[3].labels == by[10].labels == ""
    assert by[6].labels == by[7].labels == "mit"
    (span,) = by[6].spans
    assert span.share == 1.0 and span.covered == len(words(mit)) and span.start <= 1
    assert 0.6 <= by[7].spans[0].share < 1
    assert licenses.scan(docs.limit(0)).count() == 0
