import hashlib
import random
from collections import Counter, defaultdict

from mediajobs.llm import chat, sharding


def brute_shards(rows, limit):
    bits = lambda i: f"{int(hashlib.md5(str('null' if i is None else i).encode()).hexdigest()[:8], 16):032b}"
    out = {}

    def split(prefix, members):
        if sum(b for _, b in members) <= limit or len(members) == 1 or len(prefix) == 32:
            for i, _ in members:
                out[i] = prefix
            return
        for c in "01":
            part = [m for m in members if bits(m[0])[len(prefix)] == c]
            if part:
                split(prefix + c, part)

    split("", [(i, len((t or "").encode())) for i, t in rows])
    return out


def test_shards_equal_recursive_splitting(spark):
    r = random.Random(3)
    rows = [(i, "é" * r.randrange(200)) for i in range(400)] + [(900, "x" * 5000), (901, None), (None, "abc")]
    rows += [(77777, "y" * 300)] * 9  # one id that no bit can split
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bytes string")
    out = sharding.shards(docs, 1000).collect()
    assert Counter((x.doc_id, x.bytes) for x in out) == Counter((i, len((t or "").encode())) for i, t in rows)
    want = brute_shards(rows, 1000)
    size = defaultdict(int)
    for x in out:
        assert x.shard == want[x.doc_id] and x.depth == len(x.shard)
        size[x.shard, x.page] += x.bytes
    assert all(b <= 1000 or k[0] == want[900] for k, b in size.items())
    assert sharding.shards(docs.limit(0), 10).count() == 0
    assert {x.shard for x in sharding.shards(docs, 10**9).collect()} == {""}


def brute_chat(rows):
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t is not None, t or 0, role or "unknown", text or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        people = {x[2] for x in turns}
        for me in (people - {"system"}) or people:
            at = 0
            for k, (_, _, role, text) in enumerate(turns):
                name = "assistant" if role == me else "system" if role == "system" else f"user name={role}"
                head = f"<|{name}|>\n"
                seg = head + text + "<|end|>\n"
                mask = (at + len(head), at + len(seg)) if role == me else (at, at)
                out.append((c, me, k, role, seg, at, *mask))
                at += len(seg)
    return sorted(out, key=str)


def test_rotation_equals_brute_force(spark):
    r = random.Random(5)
    rows = []
    for c in [*range(12), None]:
        people = r.sample(["user", "assistant", "ann", "böb", None], r.randrange(1, 5))
        n = 600 if c == 3 else r.randrange(1, 12)
        rows += [(c, t, r.choice(people), r.choice(["hi", "née x", None, ""]), "x") for t in range(n)]
        rows += [(c, 0, "system", "be nice", "x")] * r.randrange(3)
    rows += [(50, 0, "system", "alone", "x"), (51, None, "user", "late", "x"), (51, 2, "user", "late", "x"), (51, -9, "b", "q", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start string")
    got = sorted((tuple(x) for x in chat.rotate(turns).collect()), key=str)
    assert got == brute_chat(rows)
    assert chat.rotate(turns.limit(0)).count() == 0


def test_null_conversation_is_no_text_null(spark):
    long = "é" * 300_000
    turns = spark.createDataFrame([(None, 1, "a", "x"), ("null", 1, "b", long), (None, 2, "c", None)], "conv_id string, turn long, role string, text string")
    got = {(r.conv_id, r.perspective): r for r in chat.rotate(turns).where("role = perspective").collect()}
    assert set(got) == {(None, "a"), (None, "c"), ("null", "b")}
    r = got["null", "b"]
    assert r.segment == f"<|assistant|>\n{long}<|end|>\n" and r.mask_end - r.mask_start == len(long) + len("<|end|>\n")
