import random
import zlib

from mediajobs.llm import toxicity

SCHEMA = "doc_id long, text string, score string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    r = random.Random(3)
    terms = {"".join(r.choice("abc") for _ in range(r.randrange(1, 9))): r.randrange(3) for _ in range(12)}
    auto = toxicity.Automaton(terms)
    for _ in range(3000):
        word = "".join(r.choice("abcd") for _ in range(r.randrange(10)))
        near = [(distance(word, t), t) for t, k in terms.items() if distance(word, t) <= k]
        assert auto.match(word) == (min(near)[::-1] if near else None), word


def nearest(word, terms):
    """The nearest term within its distance, by brute force; of stems, any beginning of the word counts."""
    found = []
    for t, k in terms.items():
        starts = [word[:i] for i in range(len(word) + 1)] if t.endswith("*") else [word]
        e = min(distance(x, t.removesuffix("*")) for x in starts)
        found += [(e, t)] * (e <= k)
    return min(found)[::-1] if found else None


def test_stems_match_beginnings():
    r = random.Random(4)
    terms = {"".join(r.choice("abc") for _ in range(r.randrange(2, 7))) + r.choice(["", "*"]): r.randrange(2) for _ in range(12)}
    auto = toxicity.Automaton(terms)
    for _ in range(3000):
        word = "".join(r.choice("abcd") for _ in range(r.randrange(10)))
        assert auto.match(word) == nearest(word, terms), word


def test_lexicon_prefers_what_says_most():
    from types import SimpleNamespace as R

    rows = [R(word=w, bound=b, odds=3.0) for w, b in (("abc*", 9.0), ("abcd", 5.0), ("abcx", 4.0), ("idiot", 8.0), ("idio*", 8.0), ("id*", 2.0), ("ab*", 7.0))]
    assert [r.word for r in toxicity.lexicon(rows)] == ["abc*", "idiot"]


def test_scores_equal_brute_force(spark):
    """Lexicon, evidence, contexts and scores from their definitions, on texts without near copies."""
    import math

    import numpy as np

    rows, labels = corpus(300)
    toxic = dict(labels)
    learn = [(i, t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    counts = {}
    for i, t in learn:
        words = set(t.split())
        for w in words | {w[:k] + "*" for w in words for k in range(3, min(16, len(w) - 1) + 1)}:
            counts.setdefault(w, [0, 0])[1 - toxic[i]] += 1
    n1 = sum(toxic[i] for i, _ in learn)
    n0 = len(learn) - n1
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    share = n1 / (n1 + n0)
    assert model.terms
    for term in model.terms:
        a, c = counts[term]
        # texts that share their least triple count once, so a few counts are lower
        assert abs(model.weights[term, 0] - math.log((a + 0.5) / (n1 + 1)) + math.log((c + 0.5) / (n0 + 1))) < 0.3
        # the exact tail of the binomial distribution is below the bound
        tail = sum(math.comb(a + c, k) * share**k * (1 - share) ** (a + c - k) for k in range(a, a + c + 1))
        assert tail < 0.01
    out = {r.doc_id: r.score for r in toxicity.score(docs, marks).collect()}
    for i, t, _ in rows:
        sums, hits = [0.0, 0.0], 0
        words = t.split()
        for k, w in enumerate(words):
            found = nearest(w, model.terms)
            weight = model.weights.get(found, 0) if found else 0
            if weight > 0:
                around = set(words[max(0, k - 4) : k] + words[k + 1 : k + 5])
                assert not around & (toxicity.ADDRESS | toxicity.REPORTING)
                sums[found[1] > 0] += weight
                hits += 1
        x = np.array([[sums[0], sums[1], 0.0, hits / (len(words) + 10.0)]])
        z = (toxicity.design(x) @ np.array(model.coefficients))[0]
        assert abs(out[i] - 1 / (1 + math.exp(-z))) < 1e-9


def test_very_long_texts_and_repeated_ids(spark):
    rows, labels = corpus(200)
    rows += [(3, "stoneingo " * 300_000 + "grubface snotling", "x"), (3, "x" * 2_000_000, "x"), (5, rows[0][1], "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score(docs, marks).collect()
    assert len(out) == len(rows)
    assert len([r for r in out if r.doc_id == 3]) == 3


def corpus(n=400):
    r = random.Random(5)
    common = [f"{a}{b}{c}" for a in ("stone", "river", "cloud") for b in ("ing", "est", "al") for c in ("o", "u", "er")]
    bad = ["grubface", "snotling"]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(common) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(60)] = r.choice(bad)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_and_misspelled_and_edge_cases(spark):
    rows, labels = corpus()
    rows += [(1000, "you are a grubfacee and a sn0tling " + "stoneingo " * 40, "x")]
    rows += [(1001, None, "x"), (1002, "", None), (None, "riveresto " * 5, "x"), (1003, rows[1][1], "x"), (1003, rows[1][1], "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([*labels, labels[0], (None, 1), (7, None), (99999, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, marks).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    for i, toxic in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i].score <= 1
        assert got[i].predicted == toxic == int(got[i].score >= 0.3)
    assert got[1000].predicted == 1
    assert got[1001].predicted == got[1002].predicted == got[None].predicted == got[1003].predicted == 0
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(kept.toPandas().doc_id.fillna(-1)) == sorted(
        -1 if r.doc_id is None else r.doc_id for r in out if not r.predicted
    )


def test_context_separates_quotation():
    model = toxicity.Model({"grubface": 1}, {("grubface", 0): 4.0, ("grubface", 1): 3.0})
    m = toxicity.Matcher(model)
    assert toxicity.hit_features("they wrote \"grubface\" on it", m)[2] == 4.0
    assert toxicity.hit_features("such a grubface", m)[0] == 4.0
    assert toxicity.hit_features("such a grubfase!!", m)[1] == 3.0
    assert toxicity.hit_features("you grubface", m)[0] > 4.0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "x")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.score(docs, none).collect()] == [(0.0, 0)]
    assert toxicity.score(docs.limit(0), none).count() == 0
