"""Best-fit packing of token sequences by a length histogram (operator 7).

Documents become token ids and an end id; only those over CAPACITY are cut into
pieces of CAPACITY (the last may be shorter). The plan is made over the
histogram of piece lengths, at most CAPACITY numbers: lengths go from long to
short, each into the open sequences with the least room that still fits.
Sequences of one kind (same room, consecutive numbers) are one entry, so the
plan costs the same for any number of documents. A plan row says: of the pieces
of this length, ranks a..b go to sequences from s on, k in each, at offset o.

Pieces find their slot by their rank within their length. Ranks are counted in
blocks of about BLOCK_ROWS pieces of one length, from the sums of the blocks
before, so a length of any number of pieces is never in one task.

Null and empty texts are the end id alone. Texts are tokenised whole. Rows with
equal or null ids are documents of their own; equal ones take equal slots in any
order. Extra columns aren't looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textbuf
from .common import cut

CAPACITY = 2048
END_ID = 0
BLOCK_ROWS = 2_000
VOCABULARY = "word_bpe_49k.json"
_BYTES = 4


#: Bytes of parts of a text: all but space and newline.
PARTS = np.ones(256, bool)
PARTS[[0x20, 0x0A]] = False


class TokenIds:
    """Ids of many texts at once, each the same as the tokenizer gives for the whole text.

    The tokenizer splits at white space before anything else and lower-cases, so
    a text's ids are those of its parts between spaces and newlines. Parts are
    known by a 64-bit hash, found for a whole buffer of texts at once; only parts
    not met before are tokenised, and up to ``most`` are remembered.
    """

    def __init__(self, tokenizer, most: int = 900_000):
        self.tokenizer, self.most = tokenizer, most
        self.ends_word = np.zeros(tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self._reset()

    def _reset(self):
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # known parts, by hash
        self.words: dict[str, np.ndarray] = {"": np.zeros(0, np.uint32)}
        self.length, self.start = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.uint32), 0

    @staticmethod
    def stem(part: str) -> tuple[str, str]:
        """What of a part to tokenise, and a sign behind it that is a token of its own (exact for this vocabulary's rules)."""
        if part[-1:] in (".", ",") and part.isascii() and part[:-1].isalpha():
            return part[:-1], part[-1:]
        return part, ""

    def together(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of ASCII letters, many in one text: each ends with the only one of its tokens that ends a word."""
        texts = [" ".join(words[i : i + 256]) for i in range(0, len(words), 256)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.array(list(chain.from_iterable(found)), np.uint32)
        return np.split(ids, np.flatnonzero(self.ends_word[ids])[:-1] + 1) if len(ids) else []

    def learn(self, parts: list[str]) -> np.ndarray:
        """Places of new parts."""
        stems = [self.stem(p) for p in parts]
        fresh = list({w for s in stems for w in s if w not in self.words})
        plain = [w for w in fresh if w.isascii() and w.isalpha()]
        self.words.update(zip(plain, self.together(plain), strict=True))
        other = [w for w in fresh if w not in self.words]
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, np.uint32)
        new = [self.words[x] for s in stems for x in s if x]
        count, total = len(self.place), sum(map(len, new))
        while len(self.length) < count + len(parts):
            self.length, self.start = np.resize(self.length, 2 * len(self.length)), np.resize(self.start, 2 * len(self.start))
        while len(self.flat) < self.used + total:
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        if new:
            self.flat[self.used : self.used + total] = np.concatenate(new)
        sizes = np.array([len(self.words[a]) + len(self.words[b]) for a, b in stems], np.int64)
        self.length[count : count + len(parts)] = sizes
        self.start[count : count + len(parts)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        if len(self.words) > self.most // 10:
            self.words = {"": self.words[""]}
        return np.arange(count, count + len(parts))

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (null: none)."""
        for w in textbuf.slices(texts, PARTS):
            if b"<|" in w.buf.tobytes():  # special tokens are told by case: such texts are tokenised as they are
                for t in texts.slice(w.lo, len(w.counts)).to_pylist():
                    yield np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, np.uint32)
                continue
            hashes, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
            if len(self.place) + len(hashes) > self.most:
                self._reset()
            at = np.searchsorted(self.hashes, hashes)
            met = at < len(self.hashes)
            met[met] = self.hashes[at[met]] == hashes[met]
            place = np.empty(len(hashes), np.int64)
            place[met] = self.place[at[met]]
            if not met.all():
                new = first[~met]
                buf = w.buf.tobytes()
                parts = [buf[a:b].decode("utf-8", "replace") for a, b in zip(w.start[new].tolist(), w.end[new].tolist(), strict=True)]
                place[~met] = self.learn(parts)
                self.hashes = np.insert(self.hashes, at[~met], hashes[~met])
                self.place = np.insert(self.place, at[~met], place[~met])
            part = place[inverse]
            sizes = self.length[part]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.flat[np.repeat(self.start[part] - (ends - sizes), sizes) + np.arange(total)]
            edges = np.append(0, ends)[w.first].tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield ids[a:b]


_shared: dict[str, TokenIds] = {}


def token_ids(vocabulary: str) -> TokenIds:
    """One for all tasks of a Python worker, so that what one task met serves the next."""
    if vocabulary not in _shared:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        _shared[vocabulary] = TokenIds(Tokenizer.from_file(vocabulary_path(vocabulary)))
    return _shared[vocabulary]


def vocabulary_path(name: str = VOCABULARY) -> str:
    """A public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def run(batches):
        ids_of = token_ids(vocabulary).of
        end, step = np.array([end_id], "<u4").tobytes(), capacity * _BYTES
        for b in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for i, found in enumerate(ids_of(b.column(1))):
                whole = found.astype("<u4").tobytes() + end
                for at in range(0, len(whole), step):
                    part = whole[at : at + step]
                    ids.append(i)
                    piece.append(at // step)
                    start.append(at // _BYTES)
                    length.append(len(part) // _BYTES)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()).take(pa.array(ids, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, behind the last rank, first sequence, pieces in each, offset).

    Best fit, from long to short. ``room`` holds runs of open sequences by the room left.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rows, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                per = capacity // length
                fit, first, count = capacity, sequences, -(-left // per)
                sequences += count
            else:
                first, count = room[fit].pop()
                if not room[fit]:
                    del room[fit]
            per = fit // length
            full = min(count, left // per)
            offset = capacity - fit
            if full:
                rows.append((length, rank, rank + full * per, first, per, offset))
                rank, left = rank + full * per, left - full * per
                room.setdefault(fit - per * length, []).append((first, full))
            if full < count and left:  # the last sequence of this length gets fewer
                rows.append((length, rank, rank + left, first + full, left, offset))
                room.setdefault(fit - left * length, []).append((first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < count:
                room.setdefault(fit, []).append((first + full, count - full))
    return rows


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (doc_id, piece, length, ...; a checkpoint, read several times) with sequence_id and offset."""
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    rows = plan(histogram, capacity)
    spark = found.sparkSession
    blocks = spark.createDataFrame(
        [(n, max(1, -(-c // BLOCK_ROWS))) for n, c in histogram.items()], "length long, n_blocks long"
    )
    slots = spark.createDataFrame(
        rows, "at_length long, rank_from long, rank_to long, first_sequence long, per long, first_offset long"
    )
    # at most CAPACITY rows, and a few plan rows for each of CAPACITY lengths
    # numbers of rows, as one id may have any share of them; a checkpoint gives the same ones each time
    blocked = found.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(blocks), "length").withColumn(
        "block", F.pmod(F.xxhash64("_row"), F.col("n_blocks"))
    )
    counts = blocked.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = blocked.join(starts, ["length", "block"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    k = F.col("rank") - F.col("rank_from")
    return ranked.join(
        F.broadcast(slots), (F.col("length") == F.col("at_length")) & F.col("rank").between(F.col("rank_from"), F.col("rank_to") - 1)
    ).select(
        *found.columns,
        (F.col("first_sequence") + F.floor(k / F.col("per"))).alias("sequence_id"),
        (F.col("first_offset") + k % F.col("per") * F.col("length")).alias("offset"),
    )


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(pieces(docs, vocabulary, capacity)), capacity)
