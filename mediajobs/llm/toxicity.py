"""Toxicity scores of whole texts (operator 1).

A lexicon is learned from labelled documents: words, and stems (a beginning of
words with any ending, written with a star), that toxic ones have significantly
more often. Near copies count once (they share the least hash of their word
triples), a term must recur in both halves of the labelled texts, and the chances
of all terms that could be this certain add up to ORDINARY at most. The lexicon
has no other limit, nor have the words matched. Texts are matched against it by Levenshtein automata of all terms at
once: the automata are intersected with the trie of the lexicon, and the
product is made deterministic as words need it, so a word costs one lookup for
each of its letters and dies at the first letter that no term can explain.
Digits and symbols that stand for letters are folded first. What a misspelled
form counts is learned too, for each term and distance: forms near a term that
are ordinary words count nothing.

Each hit is judged in a window of words around it: inside quotation marks or
beside words that report speech it counts as quotation, beside words of address
as abuse. A logistic model over the sums of direct, misspelled and quoted hits
gives the score.

The fit looks at LABELLED_ROWS labelled ids at most (by a hash of the id; all
texts of an id have its label); scoring covers all rows and whole texts, however
long. Null and empty texts have no hits and
get the score of such texts. Repeated rows are scored alike; labels that repeat
count once, toxic if any of them is. Rows with null ids are scored, but can't be
labelled. Without any toxic label the lexicon is empty and all scores are 0.
Only text enters a score. Extra columns are not looked at; an empty table gives
an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Labelled documents that the fit looks at, at most.
LABELLED_ROWS = 20_000
#: Ordinary words that may get into the lexicon by chance.
ORDINARY = 1.0
#: Letters of stems that are tried; a longer common beginning is found by its first ones.
STEM = (3, 16)
#: Longer words are matched, but not remembered.
REMEMBERED = 64
#: Words on either side of a hit that make its context.
CONTEXT = 4
THRESHOLD = 0.3
#: Share of its weight that a quoted hit counts.
QUOTED = 0.2
FEATURES = ("direct", "misspelled", "quoted", "density")

QUOTES = "\"“”„«»‹›"
#: Signs that stand for letters in disguised words.
FOLD = str.maketrans("013457@$!", "oieastasi")
REPORTING = frozenset("said says called calls wrote writes quoted quote quotes term word phrase reported dit dijo sagte".split())
ADDRESS = frozenset("you your you're youre u ur are vous tu du ihr tú usted".split())


class Automaton:
    """All words within a term's own distance of it, for all terms at once.

    ``terms``: term to the largest edit distance at which it is still matched. Of
    a stem ("abc*"), some beginning of the word must be within its distance.
    """

    def __init__(self, terms: dict[str, int]):
        self.children: list[dict[str, int]] = [{}]
        self.final: dict[int, str] = {}
        self.stems: dict[int, str] = {}
        self.most = [0]  # largest distance of any term at or below a node
        for term, k in sorted(terms.items()):
            node = 0
            self.most[0] = max(self.most[0], k)
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            (self.stems if term.endswith("*") else self.final)[node] = term
        self.limits = dict(terms)
        self._reset()

    def _reset(self):
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, str] | None] = []
        self.begins: list[tuple[int, str] | None] = []
        self.start = self._state({0: 0})

    def _state(self, least: dict[int, int]) -> int:
        """Number of the state of trie nodes and their least edits; -1 if it is empty."""
        todo = list(least)
        while todo:  # leaving out letters of a term
            node = todo.pop()
            for child in self.children[node].values():
                e = least[node] + 1
                if e <= self.most[child] and e < least.get(child, 99):
                    least[child] = e
                    todo.append(child)
        if not least:
            return -1
        key = frozenset(least.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            for names, out in ((self.final, self.accepts), (self.stems, self.begins)):
                out.append(min(((e, names[n]) for n, e in key if n in names and e <= self.limits[names[n]]), default=None))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        least: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e < self.most[node] and e + 1 < least.get(node, 99):  # a letter too many
                least[node] = e + 1
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and cost < least.get(child, 99):
                    least[child] = cost
        return self._state(least)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its distance (ties to the smaller term) and the distance."""
        if len(self.sets) > 50_000:
            self._reset()
        state = self.start
        best = self.begins[state] if state >= 0 else None
        for c in word:
            steps = self.steps[state] if state >= 0 else {}
            if state >= 0 and c not in steps:
                steps[c] = self._step(state, c)
            state = steps.get(c, -1)
            if state < 0:
                break
            if self.begins[state] and (best is None or self.begins[state] < best):
                best = self.begins[state]
        whole = self.accepts[state] if state >= 0 else None
        found = min((x for x in (best, whole) if x), default=None)
        return found and found[::-1]


def reach(term: str) -> int:
    """Edit distance at which a term of this length may still be recognised."""
    n = len(term.removesuffix("*"))
    return 0 if n < 5 else 1 if n < 9 else 2


def core(token: str) -> str:
    """A lower-cased token without signs around it."""
    lo, hi = 0, len(token)
    while lo < hi and not token[lo].isalnum():
        lo += 1
    while hi > lo and not token[hi - 1].isalnum():
        hi -= 1
    return token[lo:hi]


@dataclass
class Model:
    """``weights``: (term, distance) to what a hit counts; ``coefficients``: intercept and one for each of FEATURES."""

    terms: dict[str, int]
    weights: dict[tuple[str, int], float]
    coefficients: list[float] = field(default_factory=list)


class Matcher(dict):
    """Token to (weight, distance), or None; remembers a bounded number of tokens."""

    def __init__(self, model: Model):
        super().__init__()
        self.automaton = Automaton(model.terms)
        self.weights = model.weights

    def __missing__(self, token):
        word = core(token)
        found = None
        if word:
            best = self.automaton.match(word)
            if not word.isalpha():
                folded = self.automaton.match(word.translate(FOLD))
                if folded and (best is None or folded[1] < best[1]):
                    best = folded[0], max(folded[1], 1)
            if best and self.weights.get(best, 0) > 0:
                found = self.weights[best], best[1]
        if len(self) > 300_000:
            self.clear()
        if len(token) <= REMEMBERED:
            self[token] = found
        return found


def hit_features(text: str, matcher: Matcher) -> tuple[float, float, float, float]:
    """FEATURES of one text."""
    tokens = text.lower().split()
    look = matcher.__getitem__
    direct = misspelled = quoted = 0.0
    n = 0
    for i, hit in enumerate(map(look, tokens)):
        if hit is None:
            continue
        weight, distance = hit
        n += 1
        before, after = tokens[max(0, i - CONTEXT) : i], tokens[i + 1 : i + 1 + CONTEXT]
        around = {core(t) for t in before} | {core(t) for t in after}
        own = tokens[i]
        opened = sum(sum(t.count(q) for q in QUOTES) for t in before) + sum(own[: own.find(core(own)[:1])].count(q) for q in QUOTES)
        closed = sum(sum(t.count(q) for q in QUOTES) for t in after) + sum(own.rstrip().count(q) for q in QUOTES)
        inside = opened % 2 == 1 and closed > 0
        if around & ADDRESS:
            weight *= 1.25
        if inside or around & REPORTING:
            quoted += weight
        elif distance:
            misspelled += weight
        else:
            direct += weight
    return direct, misspelled, quoted, n / (len(tokens) + 10.0)


def features(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and FEATURES of every row."""

    def run(batches):
        matcher = Matcher(model)
        for b in batches:
            rows = [hit_features(t or "", matcher) for t in b.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *(pa.array(c, pa.float64()) for c in columns)], ["doc_id", *FEATURES]
            )

    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out(doc_id) -> F.Column:
    """True for rows that no label may be learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_labels(labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, toxic) of at most ``rows`` labelled documents that are not held out."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id"))
    return (
        known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )


def log_odds(toxic: float, clean: float, n_toxic: float, n_clean: float) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def _group(tokens):
    """Column: the least hash of a text's word triples (of its words, if it has fewer); near copies mostly share it."""
    n = F.size(tokens)
    triples = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2))
    )
    return F.array_min(triples)


def _stems(word):
    """Column: all stems of a word."""
    n = F.least(F.lit(STEM[1]), F.length(word) - 1)
    found = F.transform(F.sequence(F.lit(STEM[0]), F.greatest(F.lit(STEM[0]), n)), lambda i: F.concat(F.substring(word, F.lit(1), i), F.lit("*")))
    return F.when(n >= STEM[0], found).otherwise(F.array().cast("array<string>"))


def _counts(seen: DataFrame) -> DataFrame:
    """Per word of ``seen`` (toxic, group, word): its toxic and clean groups, and those of the toxic ones that are even."""
    half = (F.col("toxic") == 1) & (F.pmod("group", F.lit(2)) == 0)
    return seen.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"), F.count_if(half).alias("even"))


def surprise(toxic, clean, share):
    """Column: a bound (Chernoff's) of how unlikely so many toxic ones among a word's texts are, as -log of the chance."""
    n = toxic + clean
    rate = toxic / n
    rest = F.when(clean > 0, (1 - rate) * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    return F.when(rate > share, n * (rate * F.log(rate / share) + rest)).otherwise(0.0)


def lexicon(rows):
    """Of ``rows`` (word, bound, odds) those that say most: no term beside a stem of it, no stem beside a term that says as much."""
    out, stems, begun = [], set(), set()
    for r in sorted(rows, key=lambda r: (-r.bound, r.word.endswith("*"), -len(r.word), r.word)):
        word = r.word.removesuffix("*")
        starts = {word[:i] for i in range(1, len(word) + 1)}
        if starts & stems or (r.word.endswith("*") and word in begun):
            continue
        out.append(r)
        begun |= starts
        if r.word.endswith("*"):
            stems.add(word)
    return out


def fit_terms(labelled: DataFrame) -> Model:
    """A model without coefficients from labelled texts (text, toxic)."""
    tokens = F.filter(F.split(F.lower("text"), "\\s+"), lambda w: w != "")
    rows = labelled.select("toxic", tokens.alias("tokens")).select("toxic", "tokens", _group(F.col("tokens")).alias("group"))
    token = F.regexp_replace(F.col("token"), "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")
    seen = rows.select("toxic", "group", F.explode(F.array_distinct("tokens")).alias("token")).select("toxic", "group", token.alias("word")).where("word <> ''")
    words = cut(_counts(seen.distinct()))
    totals = rows.select("toxic", "group").distinct().agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    n_toxic, n_clean = (float(x or 0) for x in totals)
    if not n_toxic or not n_clean:
        return Model({}, {})
    share = n_toxic / (n_toxic + n_clean)
    # what a stem may have at best: all texts of its words, and no clean ones but those of one word
    stems = cut(
        words.where("toxic > 0").select("toxic", "clean", F.explode(_stems(F.col("word"))).alias("word"))
        .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.max("clean").alias("clean"), F.sum(F.col("toxic") + F.col("clean")).alias("n"))
    )
    # a term of few texts can't be certain, so it isn't tried
    n_words = words.where("toxic > 0").select((F.col("toxic") + F.col("clean")).alias("n"))
    sizes = n_words.union(stems.select("n")).groupBy("n").agg(F.count("*").alias("terms")).collect()
    tried = 0
    for r in sorted(sizes, reverse=True):
        if (tried + r.terms) * share**r.n > ORDINARY:
            break
        tried += r.terms
    if not tried:
        return Model({}, {})
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    bound = surprise(F.col("toxic"), F.col("clean"), share)
    certain = F.col("bound") > math.log(tried / ORDINARY)
    # the labelled texts bound how many terms are this certain
    likely = F.broadcast(cut(stems.withColumn("bound", bound).where(certain).select("word")))
    begun = _counts(seen.select("toxic", "group", F.explode(_stems(F.col("word"))).alias("word")).join(likely, "word").distinct())
    both = words.union(begun).where("even > 0 and even < toxic").withColumn("bound", bound).where(certain).withColumn("odds", odds)
    found = lexicon(both.where("odds > 2").select("word", "bound", "odds").collect())
    terms = {r.word: reach(r.word) for r in found}
    weights = {(r.word, 0): r.odds for r in found}
    # what forms at each distance of a term count, as far as the labelled texts have them
    forms = [(t, d) for t, k in terms.items() for d in range(1, k + 1)]

    def near(batches):
        matcher = Automaton(terms)
        for b in batches:
            words = b.column(0).to_pylist()
            hits = [matcher.match(w) for w in words]
            at = [i for i, h in enumerate(hits) if h and h[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hits[i][0] for i in at], pa.string()), pa.array([hits[i][1] for i in at], pa.int32()),
                 b.column(1).take(pa.array(at, pa.int64())), b.column(2).take(pa.array(at, pa.int64()))],
                ["term", "distance", "toxic", "clean"],
            )

    seen = (
        words.mapInArrow(near, "term string, distance int, toxic long, clean long")
        .groupBy("term", "distance").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    )
    evidence = {(r.term, r.distance): log_odds(r.toxic, r.clean, n_toxic, n_clean) for r in seen}
    for t, d in forms:
        full = weights[t, 0] * (0.7 if d == 1 else 0.5)
        if d == 2 and evidence.get((t, 1), full) < 1:
            full = 0.0
        weights[t, d] = min(full, evidence.get((t, d), full)) if evidence.get((t, d), full) >= 1 else 0.0
    return Model(terms, weights)


def design(x: np.ndarray) -> np.ndarray:
    """Rows of FEATURES to inputs of the logistic model.

    The first input holds all evidence, so that kinds of hits which the labelled
    texts lack still count; the others correct it as far as there are any.
    """
    evidence = x[:, 0] + x[:, 1] + QUOTED * x[:, 2]
    return np.column_stack([np.ones(len(x)), np.log1p(evidence), np.log1p(x[:, 1:3]), np.minimum(20 * x[:, 3:4], 5.0)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept isn't shrunk."""
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge * len(y) ** 0.5] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """A model from the labelled documents."""
    chosen = cut(training_labels(labels, rows))
    # chosen has at most LABELLED_ROWS rows of 12 bytes
    labelled = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    model = fit_terms(labelled.select("text", "toxic"))
    # of repeated ids, the row with most evidence
    per = features(labelled, model).groupBy("doc_id").agg(F.max(F.struct(*FEATURES)).alias("f")).join(chosen, "doc_id")
    found = per.select("f.*", "toxic").toPandas()
    y = found.toxic.to_numpy(float)
    if len(y) and 0 < y.sum() < len(y):
        model.coefficients = logistic(design(found[list(FEATURES)].to_numpy(float)), y).tolist()
    return model


def score_column(model: Model):
    """Column: the score over the columns of ``features``."""
    if not model.coefficients:
        return F.lit(0.0)
    b = model.coefficients
    evidence = F.col("direct") + F.col("misspelled") + QUOTED * F.col("quoted")
    inputs = [F.log1p(evidence), F.log1p("misspelled"), F.log1p("quoted"), F.least(F.col("density") * 20, F.lit(5.0))]
    z = sum((c * x for c, x in zip(b[1:], inputs, strict=True)), F.lit(b[0]))
    return 1 / (1 + F.exp(-z))


def score(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    model = fit(docs, labels, rows)
    return features(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), score_column(model).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, with the columns of ``docs``.

    Rows are scored where they are, without joins, so repeated and null ids are judged by their own text.
    """
    model = fit(docs, labels)
    if not model.coefficients:
        return docs
    b, schema = np.array(model.coefficients), docs.schema

    def run(batches):
        matcher = Matcher(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            x = np.array([hit_features(t or "", matcher) for t in texts]).reshape(-1, len(FEATURES))
            clean = 1 / (1 + np.exp(-(design(x) @ b))) < THRESHOLD
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, schema)
