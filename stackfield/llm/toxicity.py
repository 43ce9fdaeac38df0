"""Toxicity by gradient-boosted trees over dense features.

Features of a whole text: densities of a lexicon, second-person words near
lexicon words, capitals, punctuation and obfuscation (leet letters, stretched
letters, separators within words, words spelled out). The lexicon is a short
list of common insults and what the labelled sample adds: words that stand in
many toxic rows and hardly in others. Trees are boosted on the logistic loss,
and an isotonic regression, fitted on rows that the trees did not see, turns
their sum into a probability. All of it is fitted on the driver on a bounded
sample of labelled rows; scoring is a map over all rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKENS_KEPT, arrow_map

#: Labelled rows that a model is fitted on, at most: those with the least hashes of their ids.
MAX_TRAIN = 5000
#: Characters of their texts, at most; rows beyond it, in that order, are left out of the fit.
MAX_TRAIN_CHARS = 200_000_000
#: Letters of a word's beginning that the lexicon can hold, for inflected words.
STEM = 4

# Common insults in four languages, and words for the person spoken to.
INSULTS = ("idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting scum trash clown clowns fool fools imbecile cretin jerk creep pig vermin filth "
           "idiota estúpido imbécil basura imbécile crétin abruti ordure trottel dummkopf abschaum")  # fmt: skip
SECOND = "you your yours yourself u ur tu vous toi ton ta tes votre vos tú usted vosotros vuestro du dich dir dein deine sie ihr euch euer"
LEET = str.maketrans("013457@$!|", "oieastasii")

FEATURES = ("lexicon_rate", "lexicon_count", "lexicon_kinds", "known_rate", "near_second", "second_rate", "caps_words", "caps_letters", "punct_rate", "exclaim_rate", "question_rate", "obfuscated_rate", "obfuscated_count", "log_words", "digit_rate", "word_length", "lexicon_window", "repeat_rate")


_STRETCHED = re.compile(r"(.)\1\1")


def bare(token: str) -> str:
    return re.sub(r"[\W\d_]+", "", token.lower())


def unmasked(token: str) -> str:
    """The word behind leet letters, separators and stretched letters."""
    return re.sub(r"(.)\1{2,}", r"\1", re.sub(r"[\W_]+", "", token.rstrip(".,!?").lower().translate(LEET)))


class Tokens(dict):
    """Token to a row of numbers; each token is looked at once.

    Columns: 0 in the lexicon, 1 in the fixed part of it, 2 second person, 3 all
    capitals, 4 letters, 5 capital letters, 6 punctuation, 7 !, 8 ?, 9 hidden
    lexicon word, 10 digits, 11 a single letter, 12 characters.
    """

    def __init__(self, lexicon: frozenset[str], stems: frozenset[str] = frozenset()):
        self.stems = stems
        self.lexicon, self.fixed, self.second = lexicon, frozenset(INSULTS.split()), frozenset(SECOND.split())
        self.kind: dict[int, str] = {}
        self.rows: list[tuple] = []
        self.room, self.done = np.zeros((0, 13), dtype=np.float32), 0

    def __missing__(self, token: str) -> int:
        body = token.rstrip(".,!?")
        if body.isalpha() and (len(body) < 3 or not _STRETCHED.search(body)):  # most tokens: letters, and what ends a sentence
            word = hidden = body.lower()
            letters, capitals = len(body), 0 if body.islower() else sum(map(str.isupper, body))
            punct, digits, masked = len(token) - letters, 0, False
        else:
            word, hidden = bare(token), unmasked(token)
            letters, capitals, digits = (sum(map(f, token)) for f in (str.isalpha, str.isupper, str.isdigit))
            punct = sum(not c.isalnum() for c in token)
            masked = hidden in self.lexicon and hidden != word
        self.rows.append((word in self.lexicon or masked or (word[:STEM] in self.stems and len(word) > STEM), word in self.fixed or (masked and hidden in self.fixed), word in self.second, letters > 1 and capitals == letters, letters, capitals, punct, token.count("!"), token.count("?"), masked, digits, len(word) == 1, len(token)))
        i = self[token] = len(self.rows) - 1
        if self.rows[-1][0]:
            self.kind[i] = hidden if masked else word
        return i

    def table(self) -> np.ndarray:
        """All rows; what came since the last call is appended, with room to spare."""
        if len(self.rows) > len(self.room):
            self.room = np.concatenate([self.room, np.zeros((max(len(self.rows), 4096), 13), dtype=np.float32)])
        if len(self.rows) > self.done:
            self.room[self.done : len(self.rows)] = self.rows[self.done :]
            self.done = len(self.rows)
        return self.room

    def forget(self) -> None:
        if len(self) > TOKENS_KEPT:
            self.clear()
            self.kind.clear()
            self.rows.clear()
            self.done = 0


def features(texts: list[str], tokens: Tokens) -> np.ndarray:
    """A row of FEATURES for each text; of zeros for one without tokens."""
    tokens.forget()
    split = [t.split() for t in texts]
    n = np.array([len(s) for s in split])
    out, full = np.zeros((len(texts), len(FEATURES))), np.flatnonzero(n)
    if not len(full):
        return out
    flat = list(chain.from_iterable(split))
    ix = np.array(list(map(tokens.__getitem__, flat)), dtype=np.int64)
    x, ends = tokens.table()[ix], n.cumsum()
    starts = ends - n
    s = np.add.reduceat(x, starts[full], axis=0, dtype=np.float64)
    seen = np.sort((np.repeat(np.arange(len(texts)), n) << 40) | ix)
    seen = seen[np.concatenate([[True], seen[1:] != seen[:-1]])] >> 40  # distinct tokens of each text
    kinds, near, window, hidden = np.zeros(len(full)), np.zeros(len(full)), np.zeros(len(full)), s[:, 9].copy()
    for j in np.flatnonzero((s[:, 0] > 0) | (s[:, 11] >= 4)):  # few texts: the others have no lexicon word
        i = full[j]
        own = x[starts[i] : ends[i]]
        at = np.flatnonzero(own[:, 0] > 0)
        if s[j, 11] >= 4:
            one = own[:, 11] > 0
            if (one[:-3] & one[1:-2] & one[2:-1] & one[3:]).any():
                hidden[j] += spelled(split[i], one, tokens.lexicon)
        if len(at):
            kinds[j] = len({tokens.kind[k] for k in ix[starts[i] + at]})
            window[j] = (np.searchsorted(at, at + 50) - np.arange(len(at))).max()
            who = np.flatnonzero(own[:, 2] > 0)
            if len(who):
                gap = np.abs(at[:, None] - who[np.clip(np.searchsorted(who, at)[:, None] + [-1, 0], 0, len(who) - 1)]).min(1)
                near[j] = (1.0 / (1 + gap)).sum()
    m, total, letters = n[full], np.maximum(1.0, s[:, 12]), np.maximum(1.0, s[:, 4])
    out[full] = np.stack([s[:, 0] / m, s[:, 0], kinds, s[:, 1] / m, near, s[:, 2] / m, s[:, 3] / m, s[:, 5] / letters, s[:, 6] / total, s[:, 7] / m, s[:, 8] / m, hidden / m, hidden, np.log1p(m), s[:, 10] / total, s[:, 4] / m, window, 1 - np.bincount(seen, minlength=len(texts))[full] / m], 1)
    return out


def spelled(words: list[str], single: np.ndarray, lexicon: frozenset[str]) -> int:
    """Lexicon words spelled out, in runs of single letters."""
    found, run = 0, ""
    for w, one in zip([*words, ""], [*single, False], strict=True):
        if one:
            run += bare(w)
        else:
            found += any(run[i : i + k] in lexicon for k in range(4, 13) for i in range(len(run) - k + 1)) if len(run) >= 4 else 0
            run = ""
    return found


def learn_lexicon(texts: list[str], y: np.ndarray, least: int = 8, odds: float = 12.0) -> tuple[list[str], list[str]]:
    """Words, and beginnings of STEM letters, in at least `least` toxic texts and
    `odds` times as often in toxic texts as in others."""
    known: dict[str, str] = {}
    words, stems = (Counter(), Counter()), (Counter(), Counter())
    for t, label in zip(texts, y, strict=True):
        own = set()
        for w in set(t.split()):
            if (v := known.get(w)) is None:
                v = known[w] = bare(w)
            own.add(v)
        words[int(label)].update(own)
        stems[int(label)].update({w[:STEM] for w in own if len(w) > STEM})
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))

    def telling(count: tuple[Counter, Counter], times: float, share: float) -> list[str]:
        need = max(least, share * n1)
        return sorted(w for w, n in count[1].items() if len(w) > 2 and n >= need and n / n1 >= times * (count[0][w] + 1) / n0)

    return telling(words, odds, 0.02), telling(stems, 2 * odds, 0.04)


@dataclass
class Trees:
    """Boosted regression trees of fixed depth, as complete binary trees."""

    depth: int = 3
    rounds: int = 80
    rate: float = 0.15
    reg: float = 2.0
    least: int = 12
    bins: int = 48
    base: float = 0.0
    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    leaf: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        codes = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = math.log(p / (1 - p))
        f = np.full(n, self.base)
        width = self.bins + 1
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-f))
            g, h = y - prob, prob * (1 - prob)
            node = np.zeros(n, dtype=np.int64)
            feats, cuts = [], []
            for level in range(self.depth):
                m = 1 << level
                best = np.full(m, 1e-9)
                feat, cut, code = np.zeros(m, dtype=np.int64), np.full(m, np.inf), np.full(m, width)
                for j in range(d):
                    key = node * width + codes[:, j]
                    G, H, C = (np.bincount(key, w, m * width).reshape(m, width).cumsum(1) for w in (g, h, np.ones(n)))
                    G1, H1, C1 = G[:, -1:], H[:, -1:], C[:, -1:]
                    gain = G**2 / (H + self.reg) + (G1 - G) ** 2 / (H1 - H + self.reg) - G1**2 / (H1 + self.reg)
                    gain[(C < self.least) | (C1 - C < self.least)] = 0
                    gain = gain[:, : len(edges[j])]
                    if gain.shape[1]:
                        k = gain.argmax(1)
                        better = gain[np.arange(m), k] > best
                        best[better] = gain[np.arange(m), k][better]
                        feat[better], cut[better], code[better] = j, edges[j][k[better]], k[better]
                node = 2 * node + (codes[np.arange(n), feat[node]] > code[node])
                feats.append(feat)
                cuts.append(cut)
            G, H = (np.bincount(node, w, 1 << self.depth) for w in (g, h))
            leaf = self.rate * G / (H + self.reg)
            f += leaf[node]
            self.feature.append(feats)
            self.cut.append(cuts)
            self.leaf.append(leaf)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feats, cuts, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for feat, cut in zip(feats, cuts, strict=True):
                node = 2 * node + (x[rows, feat[node]] > cut[node])
            f += leaf[node]
        return f


def isotonic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending values of f and their probabilities."""
    order = np.argsort(f, kind="stable")
    fs, ys = f[order], y[order].astype(float)
    values, first = np.unique(fs, return_index=True)
    counts = np.diff([*first, len(fs)]).astype(float)
    means = np.add.reduceat(ys, first) / counts
    blocks: list[list[float]] = []
    for v, m, c in zip(values, means, counts, strict=True):
        blocks.append([v, v, m, c])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([a[0], b[1], (a[2] * a[3] + b[2] * b[3]) / (a[3] + b[3]), a[3] + b[3]])
    xs = np.array([v for b in blocks for v in (b[0], b[1])])
    return xs, np.array([b[2] for b in blocks for _ in (0, 1)])


@dataclass
class Model:
    lexicon: frozenset[str]
    stems: frozenset[str]
    trees: Trees | None
    xs: np.ndarray
    ps: np.ndarray

    def score(self, texts: list[str], tokens: Tokens | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each text the calibrated probability of label 1, and the trees' sum,
        which ranks texts of equal probability."""
        tokens = tokens or Tokens(self.lexicon, self.stems)
        x = np.concatenate([features(texts[i : i + 500], tokens) for i in range(0, len(texts), 500)]) if texts else np.zeros((0, len(FEATURES)))
        if not self.trees:
            return np.full(len(texts), self.ps[0]), np.zeros(len(texts))
        f = self.trees.raw(x)
        return np.interp(f, self.xs, self.ps), f


def fit(texts: list[str], y: np.ndarray) -> Model:
    """A model of texts and labels. With one class, or hardly any row, its score is the class's share."""
    y = np.asarray(y, dtype=float)
    fixed = frozenset(INSULTS.split())
    if len(y) < 20 or y.min() == y.max():
        return Model(fixed, frozenset(), None, np.zeros(1), np.array([y.mean() if len(y) else 0.0]))
    fold = np.arange(len(y)) % 4 == 0
    if y[~fold].min() == y[~fold].max() or y[fold].min() == y[fold].max():
        fold = np.zeros(len(y), dtype=bool)
    words, stems = map(frozenset, learn_lexicon([t for t, out in zip(texts, fold, strict=True) if not out], y[~fold]))
    lexicon = fixed | words
    tokens = Tokens(lexicon, stems)
    x = np.concatenate([features(texts[i : i + 500], tokens) for i in range(0, len(texts), 500)])
    held = Trees().fit(x[~fold], y[~fold])
    f, labels = (held.raw(x[fold]), y[fold]) if fold.any() else (held.raw(x), y)
    return Model(lexicon, stems, held, *isotonic(f, labels))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MAX_TRAIN, most_chars: int = MAX_TRAIN_CHARS) -> tuple[list[str], np.ndarray]:
    """At most `most` labelled rows, of at most `most_chars` characters together:
    those with the least hashes of their ids, of which crc32(id as text) mod 5 is
    not 0. Of repeated ids the least text and the largest label count."""
    labels = labels.select("doc_id", label).dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y"))
    before = F.sum(F.length("text").cast("long")).over(Window.orderBy("h", "doc_id"))  # over at most `most` rows
    got = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("before", before).filter(F.col("before") <= most_chars).orderBy("h", "doc_id").select("text", "y").collect()
    return [r["text"] for r in got], np.array([r["y"] for r in got], dtype=float)


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 0 by 5; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, margin) of every row, by its text alone: the calibrated
    probability, and the trees' sum. A null text is empty; an empty text has the
    score of no features; equal texts have equal scores; further columns are
    ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(model.lexicon, model.stems)
        for b in batches:
            s, f = model.score([t or "" for t in b.column(1).to_pylist()], tokens)
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64()), pa.array(f, pa.float64())], names=["doc_id", "score", "margin"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double, margin double")


def keep_below(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose score is below threshold."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(model.lexicon, model.stems)
        for b in batches:
            yield b.filter(pa.array(model.score([t or "" for t in b.column(at).to_pylist()], tokens)[0] < threshold))

    return arrow_map(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
