"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

Kernel of two words: the gap-weighted subsequence kernel of order three.  Every
choice of three characters within ``SPAN`` positions counts with
``DECAY ** width``, so "idxiot" and "id-iot" still share most of their weight
with "idiot".  The kernel is normalised, values under ``FLOOR`` are taken as
zero, and the rest is raised to ``POWER``.  The kernel of two sentences is the
sum over the pairs of their distinct words.

A token is scored in several spellings, of which the nearest to a landmark of a
toxic word counts: as it is, without inner non-letters, with runs of one character
squeezed, without a padding character, and above ``PART`` characters in parts of a
landmark's length; long words are searched for the landmark itself, and near ones
for it with one more character.  Words that clean texts use themselves are scored as they are written.
Insults split by a space into parts of several letters ("id iot") are not joined.

Landmarks are words that stand out in distinct sentences of toxic documents,
thinned so that no two are near-equal, and the most frequent words of clean ones
that the kernel finds near to them.  The Nystroem map of a sentence is its kernel values with the landmarks
times the inverse root of the landmarks' own kernel matrix; on it a linear SVM
(squared hinge, Newton steps) is trained.  Sentences of clean documents are
negative; of a toxic document those are positive that the current model holds
for its witnesses, chosen anew after a first round; the landmarks themselves are
added as sentences of one word.  A document's raw score is
its largest sentence score; a sigmoid fitted on documents kept out of the SVM,
weighted to the classes' shares, turns it into a probability.

As the decision function is a sum over words, a worker scores each distinct word
once, whatever punctuation stands around it; bounded tables of known tokens and
words save work and never change a score.
Sentences above ``WINDOW`` words are scored in windows, words above
``WORD_CHARS`` characters in overlapping parts, so every text is read whole.

Training is on a bounded sample: at most ``docs_per_class`` labelled documents of
each class (those with the smallest hashes of doc_id) and ``sentences_per_doc``
sentences of each.  Labels, language, source and doc_id are never part of a score.

Defined cases: null and empty texts have the score of a text without words;
rows that repeat a doc_id are scored row by row; a doc_id with several labels is
toxic if one of them says so; null labels are left out; if either class has no
training row every score is 0; input columns with the names of result columns
are replaced.
"""

from __future__ import annotations

import itertools
import math
import re
import string
import sys
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.tables import sent_once, tidy

DECAY, SPAN, FLOOR, POWER = 0.7, 7, 0.4, 3
LANDMARKS, LOOKALIKES, NEAR = 128, 64, 0.6
DOCS_PER_CLASS, SENTENCES_PER_DOC = 2000, 100
WINDOW, WORD_CHARS, CACHED = 32, 32, 400_000
CACHED_CHARS = 16_000_000
PART, PARTS = 12, ((8, 3), (14, 4))
CUT = 0.3
FOLDS, HELD_OUT = 4, 2
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_SPELLED = re.compile(r"(?<!\S)\w(?:[ ]\w){2,}(?!\w)")
_EDGE = string.punctuation + "…«»“”„’‘¿¡"
_INNER = re.compile(r"[\W_]+")
_RUN, _LONG_RUN = re.compile(r"(.)\1+", re.S), re.compile(r"(.)\1{2,}", re.S)


# --- the kernel


def combos(n: int, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a word of n characters and their weights."""
    found = [
        (i, j, k) for i in range(n) for j, k in itertools.combinations(range(i + 1, min(n, i + span)), 2)
    ]
    idx = np.array(found, dtype=np.int64).reshape(-1, 3)
    return idx, DECAY ** (idx[:, 2] - idx[:, 0] + 1).astype(np.float64)


_COMBOS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _combos(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _COMBOS:
        _COMBOS[n] = combos(n)
    return _COMBOS[n]


def _points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(np.int64)


def norms(chars: np.ndarray) -> np.ndarray:
    """Root of k(w, w) of words of equal length."""
    idx, weight = _combos(chars.shape[1])
    codes = (chars[:, idx[:, 0]] << 42) | (chars[:, idx[:, 1]] << 21) | chars[:, idx[:, 2]]
    order = np.argsort(codes, axis=1, kind="stable")
    codes = np.take_along_axis(codes, order, axis=1)
    begins = np.ones(codes.shape, dtype=bool)
    begins[:, 1:] = codes[:, 1:] != codes[:, :-1]
    at = np.flatnonzero(begins.ravel())
    sums = np.add.reduceat(weight[order].ravel(), at)
    return np.sqrt(np.bincount(at // codes.shape[1], weights=sums**2, minlength=len(codes)))


@dataclass
class LandmarkKernel:
    """Kernel values of words with the landmarks."""

    landmarks: list[str]
    as_written: frozenset[str] = frozenset()  # words of clean texts, scored in no changed spelling
    telling: int = 0  # the first so many landmarks stand for toxic words
    ids: dict[int, int] = field(init=False)
    slots: np.ndarray = field(init=False)
    weights: np.ndarray = field(init=False)
    most: np.ndarray = field(init=False)
    bound: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)  # by feature: where its landmarks begin in ``owner`` and ``part``
    owner: np.ndarray = field(init=False)
    part: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        chars = sorted({ord(c) for z in self.landmarks for c in z})
        self.ids = {c: i + 1 for i, c in enumerate(chars)}
        size = len(chars) + 1
        features: dict[int, int] = {}
        rows: list[np.ndarray] = []
        for m, z in enumerate(self.landmarks):
            own = _points([z])
            idx, weight = _combos(len(z))
            local = np.array([self.ids[c] for c in own[0].tolist()])
            norm = norms(own)[0]
            for code, w in zip((local[idx] @ [size * size, size, 1]).tolist(), weight.tolist(), strict=True):
                if code not in features:
                    features[code] = len(rows)
                    rows.append(np.zeros(len(self.landmarks)))
                rows[features[code]][m] += w / norm
        self.slots = np.full(size**3, len(rows), dtype=np.int32)
        for code, row in features.items():
            self.slots[code] = row
        self.weights = np.array([*rows, np.zeros(len(self.landmarks))], dtype=np.float32)
        self.most = self.weights.max(axis=1)
        self.bound = self.most[self.slots]  # by code: one lookup for the words that fall under the floor
        feature, self.owner = np.nonzero(self.weights)  # a feature belongs to few landmarks
        self.part = self.weights[feature, self.owner]
        self.first = np.searchsorted(feature, np.arange(len(self.weights) + 1))

    def _local(self, chars: np.ndarray) -> np.ndarray:
        table = np.zeros(0x110000, dtype=np.int32 if len(self.slots) < 1 << 31 else np.int64)
        table[list(self.ids)] = list(self.ids.values())
        self._local = lambda c: table[c]  # built once per process
        return table[chars]

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "_local"}

    def _most_shared(self, slots: np.ndarray, light: np.ndarray) -> np.ndarray:
        """Per word (a row of feature numbers) the largest weight it shares with one landmark, over the features it has."""
        word, place = np.nonzero(slots < len(self.weights) - 1)
        begin = self.first[slots[word, place]]
        many = self.first[slots[word, place] + 1] - begin
        at = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        cell = np.repeat(word, many) * len(self.landmarks) + self.owner[at]
        shared = np.bincount(cell, self.part[at] * np.repeat(light[place], many), minlength=len(slots) * len(self.landmarks))
        return shared.reshape(len(slots), -1).max(axis=1)

    def values(self, words: list[str]) -> dict[str, np.ndarray]:
        """For the words with a value above ``FLOOR``: their kernel values with the landmarks.

        The weight a word shares with any one landmark is bounded by summing, per
        feature, the largest weight; many words fall under the floor by that bound.
        Of the others most do by the features they really share with one landmark.
        """
        found: dict[str, np.ndarray] = {}
        by_length = defaultdict(list)
        for w in words:
            if len(w) >= 3:
                by_length[len(w)].append(w)
        size = len(self.ids) + 1
        for n, group in by_length.items():
            idx, weight = _combos(n)
            least = math.sqrt(float((weight**2).sum()))
            light = weight.astype(np.float32)[None, :]
            for first in range(0, len(group), 1000):
                some = group[first : first + 1000]
                chars = _points(some)
                local = self._local(chars)
                code = (local[:, idx[:, 0]] * size + local[:, idx[:, 1]]) * size + local[:, idx[:, 2]]
                near = np.flatnonzero(self.bound[code] @ light[0] >= FLOOR * least * 0.999)
                if near.size:
                    near = near[self._most_shared(self.slots[code[near]], light[0]) >= FLOOR * least * 0.999]
                if not near.size:
                    continue
                norm = norms(chars[near])
                for part in range(0, len(near), 64):
                    rows = near[part : part + 64]
                    shared = (light @ self.weights[self.slots[code[rows]]])[:, 0]
                    value = shared / norm[part : part + 64, None]
                    value = np.where(value >= FLOOR, value, 0.0) ** POWER
                    for r in np.flatnonzero(value.any(axis=1)):
                        found[some[rows[r]]] = value[r]
        return found


def kernel(a: str, b: str) -> float:
    """Normalised kernel of two words before floor and power."""
    if min(len(a), len(b)) < 3:
        return 0.0
    bags = []
    for w in (a, b):
        bag: Counter = Counter()
        idx, weight = _combos(len(w))
        for (i, j, k), x in zip(idx.tolist(), weight.tolist(), strict=True):
            bag[w[i], w[j], w[k]] += x
        bags.append(bag)
    dot = sum(x * bags[1][f] for f, x in bags[0].items())
    return dot / math.sqrt(math.prod(sum(x * x for x in bag.values()) for bag in bags))


# --- texts


def plain(text: str | None) -> str:
    """Lower case, with spelled-out words ("i d i o t") joined."""
    return _SPELLED.sub(lambda m: m.group().replace(" ", ""), (text or "").lower())


def sentences(text: str) -> Iterator[list[str]]:
    """Raw tokens of each sentence of a plain text, at most ``WINDOW`` together."""
    for part in _SENTENCE.split(text):
        tokens = part.split()
        for first in range(0, len(tokens), WINDOW):
            yield tokens[first : first + WINDOW]


def forms(token: str) -> list[str]:
    """The words a raw token is scored as: stripped, and without inner non-letters; long ones in parts."""
    word = token.strip(_EDGE)
    out = [word]
    bare = _INNER.sub("", word)
    if bare != word:
        out.append(bare)
    if max(map(len, out)) > WORD_CHARS:
        step = WORD_CHARS // 2
        out = [w[i : i + WORD_CHARS] for w in out for i in range(0, max(1, len(w) - step), step)]
    return out


def spellings(token: str) -> list[str]:
    """Changed spellings of a raw token's bare word.

    Runs of one character are cut to one, and those above two also to two; a
    character that makes up a third of the word is left out, as it may be padding
    ("ixdxixoxt"); words above ``PART`` characters also come in overlapping parts,
    every six characters in one of 8 and every eleven in one of 14.
    """
    word = token.strip(_EDGE)
    bare = word if word.isalnum() else _INNER.sub("", word)
    out, n = [bare], len(bare)
    if _RUN.search(bare):
        out += [_RUN.sub(r"\1", bare), _LONG_RUN.sub(r"\1\1", bare)]
    chars = set(bare)
    if n > 4 and 3 * len(chars) <= 2 * n + 3:
        out += [bare.replace(c, "") for c in chars if 3 * (k := bare.count(c)) >= n and k >= 3]
    for w in list(out) if n > PART else ():
        if len(w) > PART:
            out += [w[i : i + m] for m, step in PARTS for i in range(0, max(1, len(w) - m + step), step)]
    return out


def token_values(kern: LandmarkKernel, tokens: Iterable[str]) -> dict[str, np.ndarray]:
    """Kernel values of raw tokens; of several spellings the one nearest to a telling landmark counts."""
    by_token, simple = {}, {}
    for t in tokens:
        word = t.strip(_EDGE)
        n = len(word)
        if n <= PART and word.isalpha() and not _RUN.search(word) and (n < 5 or 3 * len(set(word)) > 2 * n + 3):
            simple[t] = word  # the only form and spelling
            continue
        own = forms(t)
        if own[0] not in kern.as_written:
            more = spellings(t)
            if len(more) > 1 or more[0] not in own:
                own = list(dict.fromkeys(own + more))
        by_token[t] = own
    values = kern.values(list({f for fs in by_token.values() for f in fs}.union(simple.values())))
    by_token |= {t: [word] for t, word in simple.items() if word in values}

    def nearness(v: np.ndarray) -> tuple[float, float]:
        return float(v[: kern.telling].max(initial=0.0)), float(v.max())

    # a landmark that stands free in a long word, or in a near one without one of its characters
    told = set(kern.landmarks[: kern.telling])
    free = re.compile("|".join(re.escape(z) for z in sorted(told) if len(z) > 3) or "(?!)")
    closer: dict[str, list[str]] = {}
    for t, fs in by_token.items():
        near = [w for w in fs if w in values]
        long = len(fs[0]) > PART
        if not (near or long) or fs[0] in kern.as_written:
            continue
        found = [z for w in fs if len(w) > PART for z in free.findall(w)] if long else []
        for w in near:
            if 4 < len(w) <= WORD_CHARS and 0 < nearness(values[w])[0] < 0.99:
                found += told.intersection(w[:i] + w[i + 1 :] for i in range(len(w)))
        if found:
            closer[t] = found
    values.update(kern.values(list({z for zs in closer.values() for z in zs} - values.keys())))
    out = {}
    for t, fs in by_token.items():
        near = [values[f] for f in itertools.chain(fs, closer.get(t, ())) if f in values]
        if near:
            out[t] = near[0] if len(near) == 1 else max(near, key=nearness)
    return out


# --- the model


@dataclass
class Model:
    kern: LandmarkKernel
    per_landmark: np.ndarray  # inverse root times the SVM's weights
    bias: float
    slope: float
    shift: float

    def token_scores(self, tokens: Iterable[str]) -> dict[str, float]:
        return {t: float(v @ self.per_landmark) for t, v in token_values(self.kern, tokens).items()}

    def new_scores(self, tokens: Iterable[str], seen: set[str], by_word: dict[str, float]) -> dict[str, float]:
        """``token_scores``, which depend on a token's word only: words not in ``seen`` are scored and noted."""
        word = {t: t.strip(_EDGE) for t in tokens}
        fresh = set(word.values()) - seen
        seen |= fresh
        by_word.update(self.token_scores(fresh))
        return {t: by_word[w] for t, w in word.items() if w in by_word}

    def raw(self, text: str, scores: dict[str, float]) -> float:
        """Largest sentence score; ``scores`` holds the tokens that have one."""
        if not scores:
            return self.bias
        known = scores.keys()
        best = max((0.0 if known.isdisjoint(s) else sum(scores[t] for t in known & set(s)) for s in sentences(text)), default=0.0)
        return self.bias + best

    def probability(self, raw: float) -> float:
        x = self.slope * raw + self.shift
        return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Primal squared-hinge SVM; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        gap = np.maximum(0, 1 - y * (x @ v))
        return float(0.5 * v @ ridge @ v + cost * (weight * gap**2).sum())

    for _ in range(50):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        gradient = ridge @ w - 2 * cost * xa.T @ (wa * (y[active] - xa @ w))
        step = np.linalg.solve(ridge + 2 * cost * (xa * wa[:, None]).T @ xa, gradient)
        rate, now = 1.0, loss(w)
        while rate > 1e-6 and loss(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
        if rate * np.abs(step).max() < 1e-8 or rate <= 1e-6:
            break
    return w


def fit_sigmoid(raw: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve, classes weighted to ``prior``, targets smoothed, slope not negative."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(toxic, prior / max(n1, 1), (1 - prior) / max(n0, 1)) * len(raw)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * raw).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-6), float(b)


@dataclass
class Contexts:
    """Distinct (word before, word) pairs of a class, so that copied passages count once."""

    pairs: int
    count: Counter  # pairs by word
    bringers: Counter  # texts that brought a new pair, by word


def contexts(docs: Iterable[list[list[str]]]) -> Contexts:
    """Pairs whose word has three and more characters, as sorted numbers: 12 bytes each, where a set takes some 100."""
    number: dict[str, int] = {"": 0}
    shape: dict[str, int] = {}  # number of a raw token's word
    codes, texts = array("q"), array("i")
    for d, sents in enumerate(docs):
        for s in sents:
            before = 0
            for t in s:
                at = shape.get(t)
                if at is None:
                    at = shape[t] = number.setdefault(forms(t)[0], len(number))
                codes.append(before << 32 | at)
                texts.append(d)
                before = at
    del shape
    words = list(number)
    long = np.fromiter((len(w) >= 3 for w in words), dtype=bool, count=len(words))
    pair, first = np.unique(np.frombuffer(codes, dtype=np.int64), return_index=True)
    own = long[pair & 0xFFFFFFFF]
    word, brought = pair[own] & 0xFFFFFFFF, np.frombuffer(texts, dtype=np.int32)[first[own]]
    bringers = np.unique(brought.astype(np.int64) << 32 | word) & 0xFFFFFFFF
    tally = (np.bincount(x, minlength=len(words)).tolist() for x in (word, bringers))
    count, by = ({w: k for w, k in zip(words, ks, strict=True) if k} for ks in tally)
    return Contexts(max(1, len(word)), Counter(count), Counter(by))


def choose_landmarks(toxic: Contexts, clean: Contexts) -> tuple[list[str], dict[str, float]]:
    """Landmarks, and how much each of the telling words speaks for a toxic sentence.

    A word tells if it follows at least four different words in toxic documents, brought by at least three of
    them, far more often than in clean ones.
    """
    evidence, strength = {}, {}
    for w, k in toxic.count.items():
        other = clean.count[w]
        p = (k + other) / (toxic.pairs + clean.pairs)
        strength[w] = (k / toxic.pairs - other / clean.pairs) / math.sqrt(
            max(p * (1 - p), 1e-12) * (1 / toxic.pairs + 1 / clean.pairs)
        )
        lift = math.log((k + 0.5) / toxic.pairs) - math.log((other + 0.5) / clean.pairs)
        if k >= 4 and toxic.bringers[w] >= 3 and strength[w] >= 4 and lift >= 2:
            evidence[w] = lift
    chosen: list[str] = []
    for w in sorted(evidence, key=lambda w: (-strength[w], w))[:1000]:
        if len(chosen) == LANDMARKS:
            break
        if all(kernel(w, z) < NEAR for z in chosen):
            chosen.append(w)
    if not chosen:
        chosen = sorted(strength, key=lambda w: (-strength[w], w))[:8]
        evidence = {w: 1.0 for w in chosen}
    if not chosen:
        return [], evidence
    kern, near = LandmarkKernel(chosen), {}
    common = sorted(w for w, k in clean.count.items() if k >= 2 and w not in evidence and w not in chosen)
    for first in range(0, len(common), 20_000):
        near.update({w: float(v.max()) for w, v in kern.values(common[first : first + 20_000]).items()})
    alike = sorted(near, key=lambda w: (-clean.count[w] * near[w], w))
    return chosen + alike[:LOOKALIKES], evidence


def own_words(kern: LandmarkKernel, toxic: Contexts, clean: Contexts) -> frozenset[str]:
    """Words at least as usual in clean texts as in toxic ones of which a changed spelling is near a landmark."""
    usual = sorted(w for w, k in clean.count.items() if k >= 2 and k * toxic.pairs >= toxic.count[w] * clean.pairs)
    found: set[str] = set()
    for first in range(0, len(usual), 20_000):
        found.update(token_values(kern, usual[first : first + 20_000]))
    return frozenset(found)


def distinct(sample: list[tuple[int, bool, list[list[str]]]]) -> Iterator[tuple[int, bool, list[list[str]]]]:
    """Texts with sentences, without those of which a third or more was seen before: copies would outvote the rest."""
    seen: set[str] = set()
    for d, toxic, sents in sample:
        own = {" ".join(s) for s in sents}
        if own and 3 * len(own & seen) < len(own):
            yield d, toxic, sents
        seen |= own


def fit(sample: list[tuple[int, bool, list[list[str]]]], prior: float) -> Model | None:
    """``sample``: (doc_id, toxic, token lists of sentences); None if a class is missing."""
    docs = [(zlib.crc32(str(d).encode()) // FOLDS % 5 == 0, toxic, sents) for d, toxic, sents in distinct(sample)]
    if not {True, False} <= {toxic for kept, toxic, _ in docs if not kept}:
        docs = [(False, toxic, sents) for _, toxic, sents in docs]
    if {toxic for _, toxic, _ in docs} != {True, False}:
        return None
    toxic_words, clean_words = (
        contexts(sents for kept, toxic, sents in docs if toxic == c and not kept) for c in (True, False)
    )
    landmarks, evidence = choose_landmarks(toxic_words, clean_words)
    if not landmarks:
        return None
    kern = LandmarkKernel(landmarks, telling=sum(z in evidence for z in landmarks))
    kern.as_written = own_words(kern, toxic_words, clean_words)
    del toxic_words, clean_words
    # (landmark numbers, values) of the tokens that have any: a few each
    values: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    every = sorted({t for _, _, sents in docs for s in sents for t in s})
    for first in range(0, len(every), 20_000):
        for t, v in token_values(kern, every[first : first + 20_000]).items():
            at = np.flatnonzero(v)
            values[t] = (at.astype(np.int16), v[at].astype(np.float32))
    del every
    own = kern.values(landmarks)
    gram = np.array([own.get(z, np.zeros(len(landmarks))) for z in landmarks], dtype=np.float64)
    eig, vec = np.linalg.eigh((gram + gram.T) / 2)
    root = vec @ np.diag(1 / np.sqrt(np.maximum(eig, 1e-2))) @ vec.T

    # sentences of a class with the same visible words and the same hint share a row; clean ones need no hint
    rows, toxic_row, hint, times = [np.zeros(len(landmarks), dtype=np.float32)], [False], [0.0], [0]
    known: dict[tuple, int] = {}
    for kept, toxic, sents in docs:
        for s in sents if not kept else ():
            have = tuple(sorted(t for t in set(s) if t in values))
            if not have:
                # nothing the kernel sees: no witness of a toxic text; clean ones share the first row
                times[0] += not toxic
                continue
            told = sum(sorted(evidence.get(forms(t)[0], 0.0) for t in set(s))) if toxic else 0.0
            at = known.setdefault((toxic, have, told), len(rows))
            if at < len(rows):
                times[at] += 1
                continue
            row = np.zeros(len(landmarks), dtype=np.float32)
            for t in have:
                row[values[t][0]] += values[t][1]
            rows.append(row)
            toxic_row.append(toxic)
            times.append(1)
            hint.append(told)
    del known
    n_sentences = len(rows)
    for z, row in zip(landmarks, gram.astype(np.float32), strict=True):  # landmarks are sentences of one word as well
        rows.append(row)
        toxic_row.append(z in evidence)
        times.append(1)
        hint.append(evidence.get(z, 0.0))
    x = np.array(rows)
    rows.clear()
    x = x @ root
    often = np.array(times, dtype=np.float64)
    is_toxic, score = np.array(toxic_row), np.array(hint)
    w = np.zeros(len(landmarks) + 1)
    single = np.arange(len(x)) >= n_sentences
    for turn in range(3):
        positive = is_toxic & (single | (score > (0.0 if turn == 0 else -0.5)))
        use = positive | ~is_toxic
        weight = np.zeros(len(x))
        for kind in (positive & single, positive & ~single, ~is_toxic & single, ~is_toxic & ~single):
            weight[kind] = 0.25 * often[kind] / max(1.0, often[kind].sum())
        w = train_svm(x[use], np.where(positive[use], 1.0, -1.0), weight[use] * often[use].sum())
        score = x @ w[:-1] + w[-1]
    model = Model(kern, root @ w[:-1], float(w[-1]), 1.0, 0.0)
    scores = {t: float(v @ model.per_landmark[at]) for t, (at, v) in values.items()}
    judged = [d for d in docs if d[0]]
    if {t for _, t, _ in judged} != {True, False}:
        judged = docs
    raw = np.array([
        model.bias + max((sum(scores.get(t, 0.0) for t in set(s)) for s in sents), default=0.0) for _, _, sents in judged
    ])
    model.slope, model.shift = fit_sigmoid(raw, np.array([t for _, t, _ in judged]), prior)
    return model


# --- Spark


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(
    documents: DataFrame,
    labels: DataFrame,
    docs_per_class: int = DOCS_PER_CLASS,
    sentences_per_doc: int = SENTENCES_PER_DOC,
) -> Model | None:
    """A model from the labelled rows outside the held-out fold."""
    usable = (
        labels.select("doc_id", "toxic")
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).alias("toxic"))
    )
    counts = dict(usable.groupBy("toxic").count().collect())
    if len(counts) < 2:
        return None
    sampled = [
        usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_per_class)
        for c in (True, False)
    ]
    # bounded by twice docs_per_class
    texts = documents.select("doc_id", "text").join(F.broadcast(sampled[0].union(sampled[1])), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found = list(dict.fromkeys(" ".join(s) for s in sentences(plain(text)) if s))
                if len(found) > sentences_per_doc:
                    found = sorted(found, key=lambda s: (zlib.crc32(s.encode()), s))[:sentences_per_doc]
                out.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(out, type=pa.list_(pa.string()))],
                names=["doc_id", "toxic", "sentences"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(tidy(cut), f"doc_id {kind}, toxic boolean, sentences array<string>").collect()
    share = sys.intern  # one object per distinct token
    sample = sorted((r.doc_id, r.toxic, [[share(t) for t in s.split(" ")] for s in r.sentences]) for r in rows)
    del rows
    return fit(sample, counts[True] / (counts[True] + counts[False]))


def score(
    docs: DataFrame, model: Model | None, keep: list[str] | None = None, cut: float = CUT, text: str = "text"
) -> DataFrame:
    """Columns ``keep`` (all by default) plus score and predicted."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {"score", "predicted"}]
    source, at = sent_once(docs, keep, text, "_judged")
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known: set[str] = set()
        strong: dict[str, float] = {}
        words: set[str] = set()
        by_word: dict[str, float] = {}
        held = 0
        for batch in batches:
            column = batch.column(at)
            scores: list[float] = []
            for first in range(0, batch.num_rows, 256):
                texts = [plain(t) for t in column.slice(first, 256).to_pylist()] if model else []
                bags = [set(t.split()) for t in texts]
                if len(known) > CACHED or held > CACHED_CHARS:
                    for table in (known, strong, words, by_word):
                        table.clear()
                    held = 0
                new = set().union(*bags) - known
                held += sum(map(len, new))
                known |= new
                strong.update(model.new_scores(new, words, by_word) if model else {})
                for text, bag in zip(texts, bags, strict=True):
                    own = {t: strong[t] for t in bag & strong.keys()}
                    scores.append(model.probability(model.raw(text, own)))
            if model is None:
                scores = [0.0] * batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(scores, pa.float64())], names=schema.names
            )

    return source.mapInArrow(tidy(run), schema).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(documents, train(documents, labels), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with its columns."""
    aside = docs.select(*(F.col(c).alias(f"_own_{c}") for c in docs.columns))
    clean = score(aside, model, text="_own_text").where("predicted = 0")
    return clean.select(*(F.col(f"_own_{c}").alias(c) for c in docs.columns))
