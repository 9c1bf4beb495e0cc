"""Exact n-gram Jaccard join in the metric space of word-shingle sets (operator 10).

Distance is 1 - Jaccard, a metric; documents link within RADIUS = 0.2. Exact
copies are one point of the space from the start. The join narrows in levels:

1. Regions of shingle pivots. A pivot {s} is nearer to a set that holds s than
   to one that doesn't; ties go to the first pivot in a global order of
   shingles (frequent ones last, else by hash). A set's own region is that of
   its first shingle. Whatever lies within the radius of a set of n shingles
   shares at least ceil(0.8 n) of them, so also one of its first
   n - ceil(0.8 n) + 1: the set is replicated to these boundary regions.
2. Runs. Each region's members are cut at gaps of set size that the triangle
   inequality forbids (the empty set as pivot, in the symmetric-difference
   metric); pairs are dropped whose first common shingle stands too late.
   Regions with the same members are one.
3. Regions of document pivots, for runs of more than ``block`` members. About
   PIVOTS members become pivots, all members' exact distances to them are
   computed, and links to pivots are kept as links. What they connect needs no
   more comparisons with its like, so of a group of near copies, however large,
   few members stay apart from its largest connected part. Where the pivots
   divide a region, members are dealt to the Voronoi regions of their nearest
   centres (pivots more than twice the radius from each other) and replicated to those whose pivot is within twice the radius beyond
   the nearest; of the connected part only those stay whose distance to the pivot
   is within the radius of that of some other member; and regions are joined
   recursively. Where windows would replicate nearly all (near copies have about
   the same distance to all pivots), the region stays whole and gets new pivots,
   half of them from what isn't connected, as long as that shrinks. What remains
   is cut into blocks, and pairs of blocks that may hold unconnected pairs are
   cells.
4. A cell first sees the heads of its members' sets (the shingles of step 1):
   the symmetric difference of two sets is at least that of their heads up to
   where the shorter head ends, and beyond a ninth of the sum of the sizes no
   link is possible. Members fall into clusters of pairs that remain; the same
   cluster of several regions is one.
5. In a cluster, whole sets are compared, exactly. It returns a spanning forest
   of its links, so its output is linear in its members.

Components of the links come from alternating star contraction.

A shingle is known by a 64-bit hash and a set by a 64-bit digest of its sorted
hashes. Any order of shingles gives the same result; the list of frequent ones
is a bounded help against large regions, never a filter.

Defined cases: null and empty texts have no shingles and link with nothing;
texts under N words are one shingle of all their words. Null ids take part
(component: the smallest non-null id, else null), and repeated rows and ids are
rows of their own. Texts are read whole. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textbuf
from .common import cut

#: Words of a shingle.
N = 5
#: Links: NUM * union <= DEN * intersection, a similarity of 0.8 or more.
NUM, DEN = 4, 5
#: Shingles that are counted this often are put last in the order of shingles...
FREQUENT = 8
#: ... and at most so many of them (8 bytes each are sent to the executors).
MOST_FREQUENT = 200_000
#: Shingles are counted where they recur within so many ...
COUNTED = 4_000_000
#: ... and at most so many of them, the most frequent.
MOST_COUNTED = 250_000
#: Members of a block of a region.
BLOCK = 256
#: Document pivots of a large region, about.
PIVOTS = 64
#: Rows that windows may make of a member, on average, and members apart that a further round must leave fewer than of those before.
REPLICAS, SHRINK = 2.0, 0.6
RADIUS = 1 - NUM / DEN
#: Neighbours from which on a node is hot: its neighbours aren't gathered in one place. At most 1 of HOT edges or rows has one.
HOT = 256
#: Rows of a run that a task holds before it hands them on.
HELD = 1 << 16
#: Rows of 50 bytes up to which small tables of large regions are broadcast, and of 8 bytes up to which ids are.
SMALL, WANTED = 200_000, 1_000_000

_PLACE = textbuf.mix(np.arange(1, 2 * N + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Position of each text and its sorted distinct shingle hashes (uint64)."""
    for w in textbuf.slices(texts):
        counts, h = w.counts, w.hashes
        if len(h) >= N:
            grams = sum((h[k : len(h) - N + 1 + k] * _PLACE[k] for k in range(N)), np.uint64(0))
            grams = textbuf.mix(grams)
        for i, (a, n) in enumerate(zip(w.first[:-1].tolist(), counts.tolist(), strict=True)):
            if n >= N:
                s = np.sort(grams[a : a + n - N + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield w.lo + i, s[keep]
            elif n:
                one = (h[a : a + n] * _PLACE[N : N + n]).sum(dtype=np.uint64) + np.uint64(n)
                yield w.lo + i, textbuf.mix(np.array([one], np.uint64))
            else:
                yield w.lo + i, np.zeros(0, np.uint64)


def _key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signed(a) -> pa.Array:
    return pa.array(np.asarray(a, np.uint64).view(np.int64))


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def recurring(sets: list[np.ndarray], most: int = MOST_COUNTED) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that two or more of ``sets`` hold, and how many hold them; beyond ``most``, the most frequent."""
    values, times = np.unique(np.concatenate(sets), return_counts=True)
    values, times = values[times >= 2], times[times >= 2]
    if len(values) > most:
        top = np.argpartition(times, len(times) - most)[len(times) - most :]
        values, times = values[top], times[top]
    return values, times


def _points(batches):
    """Kind 0: a document's id, set size and set key. Kind 1: a shingle (as key) that recurs here, and how often (as n).

    A shingle that many texts share recurs among few of them already, if pairs count: so the number found here grows with
    the input, however small the share of the texts that hold it.
    """
    many, held, seen = [], 0, set()

    def counted():
        values, times = recurring(many)
        many.clear()
        return _table(kind=pa.array(np.ones(len(values), np.int32)), doc_id=pa.nulls(len(values), pa.int64()), n=pa.array(times.astype(np.int64)), key=_signed(values))

    for b in batches:
        n, keys = [], []
        for _, s in shingle_sets(b.column(1)):
            n.append(len(s))
            keys.append(_key(s) if len(s) else None)
            if len(s) and keys[-1] not in seen:
                seen.add(keys[-1])
                many.append(s)
                held += len(s)
                if held > COUNTED:
                    held = 0
                    yield counted()
                    if len(seen) > 1_000_000:
                        seen.clear()
        yield _table(
            kind=pa.array(np.zeros(len(n), np.int32)),
            doc_id=b.column(0).cast(pa.int64()),
            n=pa.array(n, pa.int64()),
            key=pa.array(keys, pa.int64()),
        )
    if many:
        yield counted()


def _prefixes(frequent: np.ndarray):
    """For each set the rows of its boundary regions: shingle, place in the set's order, set size, set key."""

    def run(batches):
        seen = set()  # copies within a task; those of other tasks meet in the region
        for b in batches:
            parts, held = [], 0

            def out():
                s, p, n, k = (np.concatenate(x) for x in zip(*parts, strict=True))
                return _table(shingle=_signed(s), place=pa.array(p), n=pa.array(n), key=pa.array(k))

            for _, s in shingle_sets(b.column(0)):
                if not len(s):
                    continue
                key = _key(s)
                if key in seen:
                    continue
                seen.add(key)
                s = in_order(s, frequent)
                m = len(s)
                take = m - -(-NUM * m // DEN) + 1
                parts.append(
                    (s[:take], np.arange(take, dtype=np.int32), np.full(take, m, np.int32), np.full(take, key, np.int64))
                )
                held += take
                if held > 200_000:
                    yield out()
                    parts, held = [], 0
            if parts:
                yield out()
            if len(seen) > 1_000_000:
                seen.clear()

    return run


def in_order(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Places of shingles in the global order as sorted numbers: by hash, frequent shingles behind the others."""
    place = s >> np.uint64(1)
    if len(frequent):
        hot = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
        place[hot] |= np.uint64(1 << 63)
        place.sort()
    return place


def head(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set, by the upper 24 bits of their places. Places that fall together can only hide a difference."""
    m = len(s)
    return np.unique((in_order(s, frequent)[: m - -(-NUM * m // DEN) + 1] >> np.uint64(40)).astype(np.uint32))


def packed_head(h: np.ndarray) -> bytes:
    """Three bytes a place: all low bytes of the steps between places, then the middle and the high ones, which are mostly 0."""
    steps = np.diff(h, prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def head_of(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(3, -1).astype(np.uint32)
    return np.cumsum(planes[0] | planes[1] << 8 | planes[2] << 16, dtype=np.uint32)


def _heads(frequent: np.ndarray):
    """Set key, set size and head of each set."""

    def run(batches):
        seen = set()
        for b in batches:
            rows = []
            for _, s in shingle_sets(b.column(0)):
                if len(s) and (key := _key(s)) not in seen:
                    seen.add(key)
                    rows.append((key, len(s), packed_head(head(s, frequent))))
            if len(seen) > 1_000_000:
                seen.clear()
            k, n, h = zip(*rows, strict=True) if rows else ((), (), ())
            yield _table(member=pa.array(k, pa.int64()), n=pa.array(n, pa.int32()), head=pa.array(h, pa.binary()))

    return run


def possible(sizes: np.ndarray, heads: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets may link, as far as their heads tell."""
    last = np.array([h[-1] for h in heads])
    below = np.array([np.searchsorted(h, last) for h in heads])  # shingles before the end of another's head
    below = np.minimum(below, np.diag(below)[:, None])
    differ = below + below.T - 2 * overlaps(heads)
    a, b = sizes[:, None], sizes[None, :]
    return ((NUM + DEN) * differ <= (DEN - NUM) * (a + b)) & (DEN * np.minimum(a, b) >= NUM * np.maximum(a, b))


def trees(linked: np.ndarray) -> np.ndarray:
    """For each member the first member of its component."""
    label = np.full(len(linked), -1)
    for i in range(len(linked)):
        if label[i] < 0:
            todo = [i]
            label[i] = i
            while todo:
                near = np.flatnonzero(linked[todo.pop()] & (label < 0))
                label[near] = i
                todo.extend(near.tolist())
    return label


def _clusters(batches):
    """Rows sorted by cell, each with a member's head, to rows (cluster, member)."""
    cell, members, out = None, {}, ([], [])

    def solve():
        if len(members) < 2:
            return
        keys = sorted(members)
        may = possible(np.array([members[k][0] for k in keys], np.int64), [members[k][1] for k in keys])
        main = np.array([members[k][2] for k in keys])
        may &= ~(main[:, None] & main[None, :])  # connected already
        label = trees(may)
        for first in np.flatnonzero(np.bincount(label, minlength=len(keys)) > 1).tolist():
            own = [keys[i] for i in np.flatnonzero(label == first).tolist()]
            name = int.from_bytes(hashlib.blake2b(repr(own).encode(), digest_size=8).digest(), "little", signed=True)
            out[0].extend([name] * len(own))
            out[1].extend(own)

    for b in batches:
        names, main = zip(*(b.column(i).to_pylist() for i in range(3)), strict=True), b.column(6).to_pylist()
        for i, (name, key, n) in enumerate(zip(names, b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
            if name != cell:
                solve()
                cell, members = name, {}
            members[key] = n, head_of(b.column(5)[i].as_py()), main[i]
        if out[0]:
            yield _table(cluster=pa.array(out[0], pa.int64()), member=pa.array(out[1], pa.int64()))
            out[0].clear()
            out[1].clear()
    solve()
    yield _table(cluster=pa.array(out[0], pa.int64()), member=pa.array(out[1], pa.int64()))


def _runs(batches, held: int = HELD):
    """Rows (shingle, place, n, key) sorted by (shingle, n, key) to rows (pivot, member) of runs.

    A run ends where the shingle changes or sizes differ too much; its pivot is its smallest member, of the first HELD
    ones: so runs of one group mostly have the same. Runs of two are dropped if their first common shingle stands too
    late. A run may go on over any number of batches.
    """
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int64))
    rest, open_run, last = empty, None, None  # rows held back; pivot of a run that goes on; its last row

    def emit(shingle, place, n, key, whole):
        nonlocal rest, open_run, last
        if last is not None and len(key):  # rows of one set, with the same place
            fresh = np.append((shingle[0] != last[0]) | (key[0] != last[3]), (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1]))
        else:
            fresh = np.append(np.ones(min(1, len(key)), bool), (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1]))
        shingle, place, n, key = shingle[fresh], place[fresh], n[fresh], key[fresh]
        if not len(key):
            return None
        head = np.append(True, (shingle[1:] != shingle[:-1]) | (DEN * n[:-1].astype(np.int64) < NUM * n[1:].astype(np.int64)))
        goes_on = open_run is not None and shingle[0] == last[0] and DEN * int(last[2]) >= NUM * int(n[0])
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(key)))
        pivot = np.repeat(np.minimum.reduceat(key, at), size)
        keep = size > 1
        two = np.flatnonzero(size == 2)
        a = at[two]
        most = np.minimum(n[a] - place[a], n[a + 1] - place[a + 1]).astype(np.int64)
        # intersection >= NUM / (NUM + DEN) * (sum of sizes) is the same as similarity >= NUM / DEN
        keep[two[(NUM + DEN) * most < NUM * (n[a].astype(np.int64) + n[a + 1])]] = False
        if goes_on:
            pivot[: size[0]], keep[0] = open_run, True
        rest = empty
        if not whole:  # the last run may go on
            lo = int(at[-1])
            long = size[-1] > held or (goes_on and len(at) == 1)
            if long:
                keep[-1], open_run = True, int(pivot[-1])
                last = tuple(x[-1] for x in (shingle, place, n, key))
            else:
                keep[-1], open_run, last = False, None, None
                rest = tuple(x[lo:] for x in (shingle, place, n, key))
        rows = np.repeat(keep, size)
        if not rows.any():
            return None
        pairs = np.unique(np.stack([pivot[rows], key[rows]], 1), axis=0)
        return _table(pivot=pa.array(pairs[:, 0]), member=pa.array(pairs[:, 1]))

    for b in batches:
        now = tuple(np.concatenate(x) for x in zip(rest, (b.column(i).to_numpy() for i in range(4)), strict=True))
        if (out := emit(*now, False)) is not None:
            yield out
    if len(rest[0]):
        last = open_run = None
        if (out := emit(*rest, True)) is not None:
            yield out


def _bodies(batches):
    """Set key and compressed text of each set; of a task's copies, the first.

    A text takes about a third of the bytes that its shingle hashes would take, so texts travel, and are hashed where they arrive.
    """
    seen, compress = set(), zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        keys, bodies, held = [], [], 0
        if len(seen) > 1_000_000:
            seen.clear()
        texts = b.column(0).cast(pa.large_binary())
        for i, s in shingle_sets(texts):
            if len(s) and (key := _key(s)) not in seen:
                seen.add(key)
                keys.append(key)
                bodies.append(compress(texts[i].as_py()))
                held += len(bodies[-1])
            if held > 1 << 23:
                yield _table(member=pa.array(keys, pa.int64()), body=pa.array(bodies, pa.binary()))
                keys, bodies, held = [], [], 0
        yield _table(member=pa.array(keys, pa.int64()), body=pa.array(bodies, pa.binary()))


def sets_of(bodies: pa.Array) -> Iterator[np.ndarray]:
    """The shingle sets of compressed texts, in order; a megabyte of text (or one longer text) is held at a time."""
    decompress = zstandard.ZstdDecompressor().decompress
    held, texts = 0, []
    for body in bodies:
        raw = decompress(body.as_py())
        texts.append(raw)
        held += len(raw)
        if held > textbuf.SLICE_BYTES:
            yield from (s for _, s in shingle_sets(pa.array(texts, pa.large_binary())))
            held, texts = 0, []
    if texts:
        yield from (s for _, s in shingle_sets(pa.array(texts, pa.large_binary())))


class Pivots:
    """Sets to which the distances of others are wanted."""

    def __init__(self, keys: list[int], sets: list[np.ndarray]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.keys, sets = [keys[i] for i in order], [sets[i] for i in order]
        self.sizes = np.array([len(s) for s in sets])
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        values, self.owner = values[order], owner[order]
        new = np.append(True, values[1:] != values[:-1])
        self.values, self.at = values[new], np.append(np.flatnonzero(new), len(values))  # owners of a value: a slice
        both = overlaps(sets)
        d = 1 - both / (self.sizes[:, None] + self.sizes[None, :] - both)
        # those that divide the space: no two within a window of each other
        self.centres: list[int] = []
        for j in range(len(sets)):
            if (d[j, self.centres] > 2 * RADIUS).all():
                self.centres.append(j)

    def near(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pivots that link with a set, and all distances."""
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        at = at[self.values[at] == s]
        first, many = self.at[at], self.at[at + 1] - self.at[at]
        slices = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(self.owner[slices], minlength=len(self.keys))
        union = self.sizes + len(s) - both
        return DEN * both >= NUM * union, 1 - both / union


NEAR = "region long, member long, label long, parent long, was long, links array<long>, near array<struct<pivot:long,d:double>>"


def _distances(batches):
    """Rows sorted by (region, cell, kind): a cell's pivots (kind 0) and its members, to NEAR rows of members.

    ``links`` are pivots that a member links with, the smallest first; ``near`` those centres in whose regions it belongs.
    """
    kind = pa.list_(pa.struct([("pivot", pa.int64()), ("d", pa.float64())]))
    name, pivots, asked = None, None, {}
    for b in batches:
        out: list[list] = [[] for _ in range(7)]
        columns = [b.column(i).to_pylist() for i in range(7)]
        for (region, cell, what, member, label, parent, was), s in zip(zip(*columns, strict=True), sets_of(b.column(7)), strict=True):
            if (region, cell) != name:
                name, pivots, asked = (region, cell), None, {}
            if what == 0:
                asked[member] = s
                continue
            if pivots is None:
                pivots = Pivots(list(asked), list(asked.values()))
            linked, d = pivots.near(s)
            wanted = [j for j in pivots.centres if d[j] <= d[pivots.centres].min() + 2 * RADIUS + 1e-9]
            row = (region, member, label, parent, was, [pivots.keys[j] for j in np.flatnonzero(linked).tolist()], [{"pivot": pivots.keys[j], "d": float(d[j])} for j in wanted])
            for c, v in zip(out, row, strict=True):
                c.append(v)
        types = [pa.int64()] * 5 + [pa.list_(pa.int64()), kind]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["region", "member", "label", "parent", "was", "links", "near"])


def _roots(batches):
    """Rows (region, a, b) of joined pivots, sorted by region, to (region, pivot, root)."""
    region, parent, out = None, {}, ([], [], [])

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def solve():
        for x in list(parent):
            for column, v in zip(out, (region, x, find(x)), strict=True):
                column.append(v)

    def table():
        t = _table(region=pa.array(out[0], pa.int64()), pivot=pa.array(out[1], pa.int64()), root=pa.array(out[2], pa.int64()))
        for column in out:
            column.clear()
        return t

    for rows in batches:
        for name, a, b in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
            if name != region:
                solve()
                region, parent = name, {}
            a, b = sorted((find(a), find(b)))
            parent[b] = a
        yield table()
    solve()
    yield table()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a few sets."""
    m = len(sets)
    if m == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return np.array([[sets[0].size, both], [both, sets[1].size]])
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1 if len(column) else column
    total = np.zeros((m, m), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((m, 4096), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        total += part @ part.T
    np.fill_diagonal(total, [len(s) for s in sets])
    return total.astype(np.int64)


def spanning(sets: list[np.ndarray]) -> list[int]:
    """For each set the first set of its component of links."""
    o = overlaps(sets)
    n = np.diag(o)
    linked = DEN * o >= NUM * (n[:, None] + n[None, :] - o)
    return trees(linked).tolist()


def _forests(batches):
    """Rows sorted by cluster, each with a member's compressed text, to links (member, first member of its forest's tree)."""
    cluster, members, u, v = None, {}, [], []

    def solve():
        keys = list(members)
        if len(keys) < 2:
            return
        for k, j in zip(keys, spanning(list(members.values())), strict=True):
            if keys[j] != k:
                u.append(k)
                v.append(keys[j])

    for b in batches:
        for name, key, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), sets_of(b.column(2)), strict=True):
            if name != cluster:
                solve()
                cluster, members = name, {}
            members[key] = s
        if u:
            yield _table(u=pa.array(u, pa.int64()), v=pa.array(v, pa.int64()))
            u.clear()
            v.clear()
    solve()
    yield _table(u=pa.array(u, pa.int64()), v=pa.array(v, pa.int64()))


def _spread(rows: DataFrame, per: DataFrame, key: str, value: str, hot: int) -> DataFrame:
    """``rows`` with ``value`` of their key from ``per`` (key, value, n); keys with ``hot`` rows or more are broadcast."""
    few = per.where(F.col("n") >= hot).select(key, F.col(value).alias("_hot"))
    tagged = rows.join(F.broadcast(few), key, "left")
    cold = tagged.where("_hot is null").drop("_hot").join(per.select(key, value), key)
    warm = tagged.where("_hot is not null").withColumnRenamed("_hot", value)
    return warm.select(*rows.columns, value).union(cold.select(*rows.columns, value))


def components(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """(node, root): every node of the edges (u, v), with the smallest node of its component.

    Alternating large-star and small-star steps, each cut by a checkpoint, until
    the edges no longer change. Every step is a join of the edges with one row
    per node; the few nodes with HOT neighbours or more are broadcast instead,
    so no node's neighbours are gathered in one place.
    """

    def neighbours(e):
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e, large: bool):
        near = neighbours(e)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        both = _spread(near, least, "u", "m", hot).select("u", "v", "m")
        if large:
            out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            below = both.where("v < u")
            out = below.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                below.select("u", F.col("m").alias("v"))
            )
        return out.where("u <> v").distinct()

    edges = cut(edges.where("u <> v").distinct())
    state = None
    while True:
        edges = cut(star(cut(star(edges, True)), False))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()


def _texts(docs: DataFrame, firsts: DataFrame, members: DataFrame, all_of_many: bool = False) -> DataFrame:
    """The texts of ``members``, one for each set, and those without an id; ``all_of_many``: all texts, where members are many."""
    named = firsts.join(members.select(F.col("member").alias("key")).distinct(), "key", "left_semi")
    wanted = cut(named.select("doc_id").where("doc_id is not null").distinct())
    # few ids are broadcast, so that texts stay where they are
    few = wanted.count() <= WANTED
    if all_of_many and not few:
        return docs.select("text")
    chosen = docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi").select("text")
    return chosen.union(docs.where("doc_id is null").select("text"))


def _sets(docs: DataFrame, firsts: DataFrame, members: DataFrame) -> DataFrame:
    """(member, body: its compressed text) of ``members``; only their texts are hashed again."""
    return _texts(docs, firsts, members).mapInArrow(_bodies, "member long, body binary")


def _with(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join with a table of few rows for each large region: broadcast if they are few in all."""
    few = cut(few)
    return rows.join(F.broadcast(few) if few.count() <= SMALL else few, on, how)


def _hash(*columns) -> F.Column:
    return F.xxhash64(*columns)


def by_pivots(large: DataFrame, sets: DataFrame, block: int, pivots: int = PIVOTS) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links and cells of large regions (region, member, parent: its size), by document pivots, recursively.

    Cells (pivot, i, j, member, main: whether it is in the largest connected part) hold all pairs that may link and aren't connected by the links.
    """
    links, cells, turn = [], [], 0
    # ``apart``: members outside the largest connected part, which ``main`` marks
    state = large.withColumns({"label": F.col("member"), "main": F.lit(False), "apart": F.col("parent")})
    while not state.isEmpty():
        turn += 1
        n_cells = F.ceil(F.col("parent") / F.lit(block)).cast("int")
        cell = F.pmod(_hash("member"), n_cells).cast("int")
        # half of the pivots come from either part, by chance; the first member is one in any case
        chance = F.when(F.col("apart") == F.col("parent"), F.lit(pivots)).otherwise(F.lit(pivots / 2))
        of = F.when(F.col("main"), F.col("parent") - F.col("apart")).otherwise(F.col("apart"))
        drawn = F.pmod(_hash("region", "member", F.lit(turn)), F.lit(1 << 30)) < chance / of * (1 << 30)
        asked = state.where(drawn).select("region", "member", "parent").union(
            state.groupBy("region").agg(F.min("member").alias("member"), F.first("parent").alias("parent"))
        ).distinct()
        every = F.explode(F.sequence(F.lit(0), n_cells - 1))
        rows = asked.select("region", every.alias("cell"), F.lit(0).alias("kind"), "member", F.col("member").alias("label"), "parent", F.lit(0).cast("long").alias("was"))
        rows = rows.union(state.select("region", cell.alias("cell"), F.lit(1).alias("kind"), "member", "label", "parent", F.col("apart").alias("was")))
        found = cut(
            _with(sets, rows, ["member"]).select("region", "cell", "kind", "member", "label", "parent", "was", "body")
            .repartition("region", "cell").sortWithinPartitions("region", "cell", "kind").mapInArrow(_distances, NEAR)
        )
        first = F.try_element_at("links", F.lit(1))
        joined = found.where(F.size("links") > 1).select("region", first.alias("a"), F.explode(F.slice("links", 2, F.size("links"))).alias("b")).distinct()
        # a tree: each member to its first pivot, and pivots to each other
        links.append(found.select(F.col("member").alias("u"), first.alias("v")).where("u <> v").union(joined.select("a", "b")))
        roots = joined.repartition("region").sortWithinPartitions("region").mapInArrow(_roots, "region long, pivot long, root long")
        labelled = _with(found.withColumn("pivot", first), roots, ["region", "pivot"], "left").withColumn("label", F.coalesce("root", "pivot", "label"))
        # regions stay whole where windows would replicate much, or hold all members alike
        own = F.xxhash64(F.transform("near", lambda x: x["pivot"]))
        many = F.sum(F.size("near")) > REPLICAS * F.first("parent")
        replicas = found.groupBy("region").agg((many | (F.min(own) == F.max(own))).alias("whole"))
        labelled = _with(labelled, replicas, ["region"]).withColumn(
            "x", F.explode(F.when(F.col("whole"), F.array(F.struct(F.lit(None).cast("long").alias("pivot"), F.lit(0.0).alias("d")))).otherwise(F.col("near")))
        )
        dealt = cut(labelled.select(
            F.when(F.col("whole"), F.col("region")).otherwise(_hash("region", "x.pivot")).alias("region"), "member", "label", "parent", "was", "whole", "x.d"
        ))
        # the largest connected part of each region, and where the others lie
        parts = cut(dealt.groupBy("region", "label").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")))
        most = parts.groupBy("region").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
        others = _with(parts, most, ["region"]).where("label <> largest").groupBy("region", "largest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        main = F.col("label") == F.col("largest")
        within = F.col("d").between(F.col("lo") - RADIUS - 1e-9, F.col("hi") + RADIUS + 1e-9)
        left = cut(_with(dealt, others, ["region"]).where(~main | within).select("region", "member", "label", "parent", "was", "largest", main.alias("main")))
        sizes = left.groupBy("region").agg(F.count("*").alias("n"), F.count_if(~F.col("main")).alias("apart"))
        left = _with(left, sizes, ["region"])
        small = F.col("n") <= block
        cells.append(left.where(small & (F.col("n") > 1)).select(F.col("region").alias("pivot"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "member", "main"))
        # regions must be half as large, or have fewer members apart, or they are cut into blocks
        again = (2 * F.col("n") < F.col("parent")) | ((F.col("apart") > block) & (F.col("apart") < SHRINK * F.col("was")))
        left = cut(left.withColumn("again", ~small & again))
        cells.append(_blocks(left.where(~small & ~F.col("again")), block))
        state = left.where("again").select("region", "member", F.col("n").alias("parent"), "label", "main", "apart")
    return links, cells


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Cells of regions (region, member, main, n, apart): all pairs of blocks but those within the largest connected part."""
    count = lambda n: F.ceil(n / F.lit(block)).cast("long")
    others, part = count(F.col("apart")), count(F.col("n") - F.col("apart"))
    own = F.pmod(_hash("member"), F.when(F.col("main"), part).otherwise(others))
    # the others' blocks come first, then those of the part
    mine = F.when(F.col("main"), others + own).otherwise(own)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("main"), others - 1).otherwise(others + part - 1)))
    return rows.select("region", "member", "main", mine.alias("mine"), other.alias("other")).select(
        F.col("region").alias("pivot"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "member", "main"
    )


def links(docs: DataFrame, block: int = BLOCK, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Points (doc_id, n, key) of all rows, and links (u, v) between set keys whose components are exact."""
    docs = docs.select("doc_id", "text")
    found = cut(docs.mapInArrow(_points, "kind int, doc_id long, n long, key long"))
    points = found.where("kind = 0").drop("kind")
    firsts = cut(points.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")))
    often = (
        found.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent)
        .orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).select("key")
    )
    hot = np.sort(np.array([r.key for r in often.collect()], np.int64).view(np.uint64))
    rows = docs.select("text").mapInArrow(_prefixes(hot), "shingle long, place int, n int, key long")
    regions = cut(
        rows.repartition("shingle")
        .sortWithinPartitions("shingle", "n", "key")
        .mapInArrow(_runs, "pivot long, member long")
        .distinct()
    )
    big = cut(regions.groupBy("pivot").agg(F.count("*").alias("parent")).where(F.col("parent") > block))
    zero = F.lit(0).cast("long")
    cells = regions.join(big, "pivot", "left_anti").select("pivot", zero.alias("i"), zero.alias("j"), "member", F.lit(False).alias("main"))
    near = []
    if not big.isEmpty():
        large = cut(regions.join(big, "pivot").select(F.col("pivot").alias("region"), "member", "parent"))
        sets = cut(_sets(docs, firsts, large))
        if sets.count() > large.select("member").distinct().count():  # rows with one id and one text, or none
            sets = cut(sets.dropDuplicates(["member"]))
        near, more = by_pivots(large, sets, block)
        for m in more:
            cells = cells.union(m)
    cells = cut(cells)
    heads = _texts(docs, firsts, cells, all_of_many=True).mapInArrow(_heads(hot), "member long, n int, head binary")
    clusters = cut(
        cells.join(heads, "member")
        .select("pivot", "i", "j", "member", "n", "head", "main")
        .repartition("pivot", "i", "j")
        .sortWithinPartitions("pivot", "i", "j")
        .mapInArrow(_clusters, "cluster long, member long")
        .distinct()
    )
    edges = (
        clusters.join(_sets(docs, firsts, clusters), "member")
        .select("cluster", "member", "body")
        .repartition("cluster")
        .sortWithinPartitions("cluster")
        .mapInArrow(_forests, "u long, v long")
    )
    for e in near:
        edges = edges.union(e)
    return points, edges


def _groups(docs: DataFrame, block: int, frequent: int) -> tuple[DataFrame, DataFrame]:
    """Points of all rows, and per set key the smallest id, the number of rows and the root of its component."""
    points, edges = links(docs, block, frequent)
    firsts = points.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    named = components(edges).withColumnRenamed("node", "key")
    return points, firsts.join(named, "key", "left").withColumn("root", F.coalesce("root", "key"))


def near_duplicates(docs: DataFrame, block: int = BLOCK, frequent: int = FREQUENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id."""
    points, roots = _groups(docs, block, frequent)
    roots = cut(roots)
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    ids = cut(_spread(roots.select("root", "key", F.col("n").alias("rows")), least, "root", "component_id", HOT))
    empty = points.where("key is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    full = points.where("key is not null").select("key", "doc_id", F.col("n").alias("n_shingles"))
    out = _spread(full, ids.select("key", "component_id", F.col("rows").alias("n")), "key", "component_id", HOT)
    return out.select("doc_id", "n_shingles", "component_id").union(empty)


def _keyed(batches):
    """Rows that have shingles, with their set key; of a task's rows of one id and key, the first."""
    seen = set()  # those of other tasks meet behind the shuffle
    for b in batches:
        ids, keys, take = b.column("doc_id").to_pylist(), [None] * b.num_rows, []
        for i, s in shingle_sets(b.column("text")):
            if len(s):
                keys[i] = _key(s)
                if (ids[i], keys[i]) not in seen:
                    seen.add((ids[i], keys[i]))
                    take.append(i)
        rows = pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], [*b.schema.names, "_key"])
        yield rows.take(pa.array(take, pa.int64()))


def _by_key(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are ``chosen`` (_key, _id, _none), one of each, and all rows without shingles."""
    rows = docs.mapInArrow(_keyed, StructType([*docs.schema.fields, StructField("_key", LongType())]))
    rows = rows.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_none": F.col("doc_id").isNull()})
    kept = rows.join(chosen, chosen.columns, "left_semi").dropDuplicates(chosen.columns)
    empty = docs.where(~F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]"))
    return kept.select(docs.columns).union(empty)


def keep_one(docs: DataFrame, wanted: int = WANTED) -> DataFrame:
    """One row of each component, that with the smallest (doc_id, nulls last; set key), and all rows without shingles.

    The columns are those of ``docs``. Of rows with the same id and set key, any one is kept. Where an id is of one row
    only, the id tells whether the row goes; if the ids of those that go are few, they are broadcast, so that texts are
    neither hashed again nor shuffled. Rows with null or repeated ids are known by their set keys, too.
    """
    points, roots = _groups(docs, BLOCK, FREQUENT)
    order = F.struct(F.col("first").isNull().alias("none"), "first", "key")
    chosen = cut(roots.groupBy("root").agg(F.min(order).alias("c")).select(
        F.col("c.key").alias("_key"), F.coalesce("c.first", F.lit(0)).alias("_id"), F.col("c.none").alias("_none")
    ))
    named = points.where("doc_id is not null")
    repeated = cut(named.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    rows = named.where("key is not null").select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"), F.lit(False).alias("_none"))
    gone = cut(rows.join(chosen, chosen.columns, "left_anti").select(F.col("_id").alias("doc_id")).distinct())
    n = repeated.count()
    if n + gone.count() > wanted:
        return _by_key(docs, chosen)
    single = docs.where("doc_id is not null").join(F.broadcast(gone.union(repeated).distinct()), "doc_id", "left_anti")
    rest = docs.where("doc_id is null")
    if n:
        rest = rest.union(docs.join(F.broadcast(repeated), "doc_id", "left_semi").select(docs.columns))
    return single.select(docs.columns).union(_by_key(rest, chosen))
