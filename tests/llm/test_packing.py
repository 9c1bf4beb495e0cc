import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from mediajobs.llm import packing
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, length string"


def check_plan(histogram, capacity):
    used = defaultdict(list)
    for length, a, b, first, per, offset in packing.plan(histogram, capacity):
        for r in range(a, b):
            k = r - a
            used[first + k // per].append((offset + k % per * length, length, r))
    ranks = Counter((n, r) for s in used.values() for _, n, r in s)
    assert ranks == {(n, r): 1 for n, c in histogram.items() for r in range(c)}
    for slots in used.values():
        at = 0
        for offset, length, _ in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(used) == list(range(len(used)))
    return len(used)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 40), max_size=12))
def test_plan_places_every_piece_gapless(histogram):
    check_plan(histogram, 20)


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        i = min((i for i, r in enumerate(bins) if r >= n), key=lambda i: bins[i], default=None)
        if i is None:
            bins.append(capacity - n)
        else:
            bins[i] -= n
    return len(bins)


def test_as_good_as_best_fit_over_pieces():
    r = random.Random(1)
    for _ in range(30):
        lengths = [r.randrange(1, 64) for _ in range(500)]
        assert check_plan(dict(Counter(lengths)), 64) <= best_fit(lengths, 64)


def test_ids_are_those_of_the_whole_text():
    t = Tokenizer.from_file(packing.vocabulary_path())
    ids = packing.TokenIds(t, most=4000)
    r = random.Random(2)
    alphabet = "abAB.,!'s t\n\t éÉİßſ́ΣςK12³#|<>中ñ\x1c "
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["<|endoftext|> a<|startoftext|>b It's we'll. END, a., ..", "<|EndOfText|>", "Don't. don'T,"]
    for k in range(0, len(texts), 300):
        part = texts[k : k + 300]
        for x, got in zip(part, ids.of(pa.array(part)), strict=True):
            assert got.tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
    assert [x.tolist() for x in ids.of(pa.array([None, "", "a"]))][:2] == [[], []]


def test_packed_rows(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["one", "Two.", "trés"]) for _ in range(r.choice([3, 40, 3000, 7000]))), "x") for i in range(60)]
    rows += [(100, None, "x"), (101, "", None), (None, "a b", "x"), (5, rows[5][1], "x"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = packing.packed(docs.repartition(3)).collect()
    t = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter()
    for i, text, _ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], np.uint32)
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, p, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = defaultdict(list)
    for x in out:
        by[x.sequence_id].append((x.offset, x.length))
    for slots in by.values():
        at = 0
        for o, n in sorted(slots):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= best_fit([x.length for x in out], 2048)


def test_empty(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0
