"""License scans with a generalised suffix automaton (operator 4).

The automaton accepts every run of words of the license templates. Texts are
streamed through it once: at each word it gives the longest run that ends there
and is in some template (matching statistics). Runs of MIN_MATCH words or more
that go no further are matches, at every place of a template where they stand. Of
each template's matches, the best chain (most words covered, in the order of both
text and template, without wide gaps) is found by dynamic programming; if it
covers enough of its template it is a span with the template's label, and the
rest of the text is chained again. Matches beyond a gap of GAP words are chained
on their own, so long texts cost no more a word.

Only stretches of words that templates know are streamed: a word outside their
vocabulary sends the automaton to its start anyway. Words are compared by 64-bit
hashes. Fixed phrases (PHRASES) are found by comparing word by word.

Words are runs of letters and digits after A-Z are lower-cased; characters
beyond ASCII count as letters. Null and empty texts have no words, no labels and
score 0. Texts are scanned whole; repeated rows and null ids are rows of their
own. Extra columns aren't looked at; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbuf
from .license_texts import TEMPLATES

#: Phrase to label (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Shortest match that chains may use; templates that are shorter must match whole.
MIN_MATCH = 5
#: Share of a template that a chain must cover.
COVER = 0.6
#: Words between matches of a chain, in text and in template, at most.
GAP = 60

def tokens(text: str) -> list[int]:
    """Word hashes of one text."""
    return [h for w in textbuf.slices(pa.array([text]), textbuf.ALNUM) for h in w.hashes.tolist()]


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; ``ends``: state to {sequence: positions behind all occurrences}."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for k, words in enumerate(sequences):
            state = 0
            for i, w in enumerate(words):
                state = up = self.next[state][w]
                while up > 0:
                    self.ends[up].setdefault(k, []).append(i + 1)
                    up = self.link[up]

    def _new(self, length, following, link):
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p, q, w):
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last, w):
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def matches(self, words: list[int]) -> list[tuple[int, int, int]]:
        """(position behind, length, state) of the longest matches that the next word doesn't lengthen."""
        out, state, n = [], 0, 0
        for i, w in enumerate(words):
            if n and w not in self.next[state]:
                out.append((i, n, state))
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            else:
                n = 0
        if n:
            out.append((len(words), n, state))
        return out


def apart(matches: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Sorted matches (text position, template position, length) cut where the text has a gap of more than GAP words."""
    out, end = [], None
    for m in matches:
        if end is None or m[0] - end > GAP:
            out.append([])
            end = m[0]
        out[-1].append(m)
        end = max(end, m[0] + m[2])
    return out


def best_chain(matches: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int, int]]]:
    """Words that the best chain of sorted matches covers, and its matches.

    A match may follow one that begins before it in text and template and ends before it does, at most GAP words
    behind its end in both; where they overlap, words count once.
    """
    covered, before, first = [], [], 0
    longest = max((n for _, _, n in matches), default=0)
    for i, (at, place, n) in enumerate(matches):
        best, last = n, -1
        while matches[first][0] + longest + GAP < at:
            first += 1
        for j in range(first, i):
            a, p, m = matches[j]
            over = max(0, a + m - at, p + m - place)
            if a < at and p < place and over < n and at - a - m <= GAP and place - p - m <= GAP and covered[j] + n - over > best:
                best, last = covered[j] + n - over, j
        covered.append(best)
        before.append(last)
    if not matches:
        return 0, []
    i = max(range(len(matches)), key=lambda k: (covered[k], -k))
    most, chain = covered[i], []
    while i >= 0:
        chain.append(matches[i])
        i = before[i]
    return most, chain[::-1]


@dataclass
class Scanner:
    """Templates ready for scanning."""

    templates: list[tuple[str, str, str]]

    def __post_init__(self):
        self.sequences = [tokens(text) for _, _, text in self.templates]
        self.automaton = SuffixAutomaton(self.sequences)
        self.phrases = [(np.array(tokens(p), np.uint64), label) for p, label in sorted(PHRASES.items())]
        self.known = np.unique(
            np.concatenate([np.array(s, np.uint64) for s in self.sequences] + [p for p, _ in self.phrases])
        )
        self.shortest = min([MIN_MATCH, *map(len, self.sequences)])

    def matches(self, first: int, words: list[int]) -> list[tuple[int, int, int, int]]:
        """(template, text position, template position, length) of the matches in a stretch of known words."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, state in self.automaton.matches(words):
            for k, places in self.automaton.ends[state].items():
                if n >= min(MIN_MATCH, len(self.sequences[k])):
                    found.setdefault(k, []).extend((first + end - n, behind - n, n) for behind in places)
        return [(k, *m) for k, ms in found.items() for m in ms]

    def chains(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, int, float]]:
        """Matches chained to (label, first word, behind the last word, words covered, share of the template covered)."""
        out = []
        of_template: dict[int, list[tuple[int, int, int]]] = {}
        for k, *m in matches:
            of_template.setdefault(k, []).append(tuple(m))
        for k, found in sorted(of_template.items()):
            size = len(self.sequences[k])
            for part in apart(sorted(found)):
                todo = [part]
                while todo:
                    left = todo.pop()
                    covered, chain = best_chain(left)
                    if not chain or covered < COVER * size or (size < 2 * MIN_MATCH and covered < size):
                        continue
                    start, stop = chain[0][0], chain[-1][0] + chain[-1][2]
                    out.append((self.templates[k][1], start, stop, covered, covered / size))
                    todo += [[m for m in left if m[0] + m[2] <= start], [m for m in left if m[0] >= stop]]
        return sorted(out, key=lambda s: (s[1], s[0], s[2]))

    def scan(self, w: textbuf.Words):
        """Of each text of a slice: words, places of phrases, labels of phrases, spans."""
        texts = len(w.first) - 1
        hits: list[list[int]] = [[] for _ in range(texts)]
        labels: list[set[str]] = [set() for _ in range(texts)]
        matches: list[list] = [[] for _ in range(texts)]
        h = w.hashes
        known = self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h
        if known.any():
            owner = np.repeat(np.arange(texts), w.counts)
            for phrase, label in self.phrases:
                n = len(phrase)
                at = np.flatnonzero(known[: len(h) - n + 1]) if len(h) >= n else np.zeros(0, int)
                for j, p in enumerate(phrase):
                    at = at[h[at + j] == p]
                at = at[owner[at] == owner[at + n - 1]] if len(at) else at
                for i in at.tolist():
                    text = int(owner[i])
                    hits[text].append(i - int(w.first[text]))
                    labels[text].add(label)
            # stretches of known words of one text
            new = known.copy()
            new[1:] &= ~known[:-1] | (owner[1:] != owner[:-1])
            start = np.flatnonzero(new)
            stop = np.append(known, False)[1:] & np.append(owner[1:] == owner[:-1], False)
            end = np.flatnonzero(known & ~stop) + 1
            long = end - start >= self.shortest
            for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True):
                text = int(owner[a])
                matches[text].extend(self.matches(a - int(w.first[text]), h[a:b].tolist()))
        return w.counts, hits, labels, [self.chains(m) if m else [] for m in matches]


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,start:long,stop:long,covered:long,share:double>>"
)


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts and places of phrases, labels, and covered template spans."""

    def run(batches):
        scanner = Scanner(templates or TEMPLATES)
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))
        for b in batches:
            columns: list[list] = [[] for _ in range(8)]
            for w in textbuf.slices(b.column(1), textbuf.ALNUM):
                for n, at, base, spans in zip(*scanner.scan(w), strict=True):
                    own = base | {s[0] for s in spans}
                    score = max([s[4] for s in spans] + [1.0] * bool(base), default=0.0)
                    row = (
                        int(n), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(own)),
                        min(1.0, score), [dict(zip(("label", "start", "stop", "covered", "share"), s, strict=True)) for s in spans],
                    )
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
