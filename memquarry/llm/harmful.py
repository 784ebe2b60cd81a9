"""Scores for abusive, hateful and sexually explicit language.

A convolutional classifier in numpy: a word is the mean of hashed embeddings (the
word in normal form and its character trigrams, so that disguised spellings stay
near the plain ones), filters of several widths run over the words of a sentence,
the strongest answer of each filter is kept, and a linear layer gives the
sentence's score. A document has the score of its worst sentence.

Labels are for documents, so training looks for the sentence: at first the one
whose words are most typical of documents labelled harmful, then the one that the
model itself finds worst. Of harmless documents all sentences that are not rejected
clearly are learned, a tenth of the others, and fragments of both. Labels that
models fitted without the document contradict are left out. Thresholds are set by
language on cross-fitted scores of the other labelled documents; the fewer harmful
ones a language has, the nearer its threshold is to the overall one.

The fit uses at most ``MAX_LABELLED`` labelled documents of at most ``MAX_CHARS``
characters, chosen by a hash of their id; every document is scored, on its whole
text. Several labels of a document are decided by majority; ties and nulls do not
count. Without labels of both kinds nothing can be learned and that is an error.

Defined results: null and blank texts have score 0 and are not flagged.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LABELLED = 5000
MAX_CHARS = 50_000
BUCKETS = 1 << 15
DIM, FILTERS, WIDTHS = 16, 16, (1, 2, 3)
#: Sentences are filled up with zero rows to a multiple of FOLD, which the maximum folds.
FOLD = 8
GAP = max(WIDTHS) - 1
#: Sentences of harmless documents with a lower logit are learned well enough.
REJECTED = -4.0
#: The share of harmful documents that thresholds are set for.
SHARE = 0.05
#: Words kept with their embeddings by a worker; beyond it the store is emptied.
CACHE = 200_000

#: A word written letter by letter.
_SPACED = re.compile(rb"(?<= )(?:[a-z]|\xc3[\x80-\xbf])(?: (?:[a-z]|\xc3[\x80-\xbf])){3,}(?= )")
#: A break between sentences, as a word.
BREAK = b"."
_BREAKS = ".!?:;\n\r\x0b\x0c"
_INSIDE = "@$*!|+_"  # may stand for letters within a word
_TABLE = bytes(c if c > 127 or chr(c).isalnum() or chr(c) in _INSIDE + "." else 32 for c in range(256))
#: Marks beyond ASCII that part words or sentences, or are invisible.
_MARKS = [(m.encode(), b" ") for m in "\xa0§–—“”„‘’«»·•¿¡‹›"] + [(m.encode(), b" . ") for m in "…\u2028\u2029"] + [(m.encode(), b"") for m in "\xad\u200b\u200c\u200d\u2060\ufeff"]
#: Letters that look like Latin ones, and signs used for letters.
LOOKALIKES = str.maketrans("аеорсухіїјѕԁԛԝһкмнтвзαεορτυνικμ", "aeopcyxiijsdqwhkmhtb3aeoptuvikm")
SIGNS = str.maketrans("01345789@$!|+", "oieastbgasiit")
LETTER = re.compile(r"[^\W\d_]")
AGAIN = re.compile(r"(.)\1+")


def normal(word: str) -> str:
    """A word without disguises: look-alikes and signs replaced, letters not repeated."""
    if not word.isascii():
        word = unicodedata.normalize("NFKC", word).translate(LOOKALIKES)
    if not LETTER.search(word):
        return "0"
    return AGAIN.sub(r"\1", word.translate(SIGNS))


def features(word: bytes) -> list[int]:
    """The buckets of a word."""
    w = normal(word.decode("utf-8", "replace").strip("!|+_"))
    if w == "0":
        return [zlib.crc32(b"0") % BUCKETS]
    around = f"^{w}$"
    parts = [w, *(around[i : i + 3] for i in range(len(around) - 2))]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def tokens(text: str) -> list[bytes]:
    """Words and breaks of a text, lower-cased, in UTF-8."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    if not text.isascii():
        for mark, by in _MARKS:
            if mark in raw:
                raw = raw.replace(mark, by)
    for c in (b"\n", b"\r", b"\x0b", b"\x0c", b"?", b":", b";", b"."):
        raw = raw.replace(c, b" . ")
    raw = raw.replace(b"! ", b" . ").replace(b"!!", b" . ").translate(_TABLE)
    if _SPACED.search(raw):
        raw = _SPACED.sub(lambda m: m[0].replace(b" ", b""), raw)
    return raw.split()


def sentences(text: str) -> list[list[bytes]]:
    out: list[list[bytes]] = [[]]
    for t in tokens(text):
        if t == BREAK:
            if out[-1]:
                out.append([])
        else:
            out[-1].append(t)
    return out if out[-1] else out[:-1]


class _Words(dict):
    """Word to number, numbered as met; what to do with a new one is up to the owner."""

    def __init__(self, new) -> None:
        super().__init__({BREAK: 0})
        self.new = new

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.new(word)
        return n


@dataclass
class Model:
    emb: np.ndarray
    conv: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def vector(self, word: bytes) -> np.ndarray:
        return self.emb[features(word)].mean(0)

    def logits(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Per sentence: the strongest answer of each filter, or 0, and the linear layer.
        A sentence's rows begin at ``starts``, multiples of FOLD, with GAP zero rows, so
        that no filter sees two sentences; x ends with GAP more."""
        n = len(x) - GAP
        answers = []
        for w, c in zip(WIDTHS, self.conv):
            y = x[:n] @ c[0]
            for j in range(1, w):
                y += x[j : n + j] @ c[j]
            answers.append(y)
        y = np.hstack(answers)
        step = FOLD
        while step > 1:
            y = np.maximum(y[0::2], y[1::2])
            step //= 2
        top = np.maximum.reduceat(y, starts // FOLD, axis=0)
        return np.maximum(np.maximum(top, 0) + self.bias, 0) @ self.out + self.out_bias


def _fold(lengths: np.ndarray) -> np.ndarray:
    """Rows that sentences of so many words take."""
    return -(-(lengths + GAP) // FOLD) * FOLD


def _laid_out(table: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows for ``ids`` (0 where a sentence ends), the sentences' first rows and
    their places in ``ids``."""
    word = ids > 0
    begin = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])))
    past = np.flatnonzero(word & np.concatenate((~word[1:], [True]))) + 1
    lengths = past - begin
    rows = _fold(lengths)
    starts = np.cumsum(rows) - rows
    x = np.zeros((int(rows.sum()) + GAP, DIM), np.float32)
    kept = ids[word]
    x[np.arange(len(kept)) + np.repeat(starts + GAP - (np.cumsum(lengths) - lengths), lengths)] = table[kept]
    return x, starts, begin


class Scorer:
    """Document scores with a store of the embeddings of words met before."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.index = _Words(self._new)
        self.table = np.zeros((4096, DIM), np.float32)
        self.used = 1

    def _new(self, word: bytes) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[self.used] = self.model.vector(word)
        self.used += 1
        return self.used - 1

    def scores(self, texts: list[str]) -> np.ndarray:
        """The largest logit of a sentence of each text; -inf without words."""
        result = np.full(len(texts), -np.inf, np.float32)
        first = 0
        while first < len(texts):
            if self.used > CACHE:
                self._reset()
            ids: list[int] = []
            starts, docs = [], []
            past = first
            while past < len(texts) and len(ids) < 30_000:
                found = list(map(self.index.__getitem__, tokens(texts[past])))
                if any(found):
                    starts.append(len(ids))
                    docs.append(past)
                    ids += found
                    ids.append(0)
                past += 1
            if docs:
                x, rows, begin = _laid_out(self.table, np.array(ids))
                result[docs] = np.maximum.reduceat(self.model.logits(x, rows), np.searchsorted(begin, starts))
            first = past
        return result


class _Corpus:
    """Labelled documents as numbers: words with their buckets, sentences, documents."""

    def __init__(self, texts: list[str]) -> None:
        index: dict[bytes, int] = {}
        ids: list[int] = []
        starts, lengths, owners = [], [], []
        for d, t in enumerate(texts):
            for s in sentences(t):
                starts.append(len(ids))
                lengths.append(len(s))
                owners.append(d)
                ids += [index.setdefault(w, len(index) + 1) for w in s]
                ids.append(0)
        self.ids, self.starts, self.lengths, self.owner = (np.array(x, np.int64) for x in (ids, starts, lengths, owners))
        found = [features(w) for w in index]
        self.sizes = np.array([len(f) for f in found], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.buckets = np.array([b for f in found for b in f], np.int64)
        self.normal = [normal(w.decode("utf-8", "replace")) for w in index]

    def logits(self, model: Model) -> np.ndarray:
        """The model's answer for every sentence."""
        table = np.zeros((len(self.sizes) + 1, DIM), np.float32)
        table[1:] = np.add.reduceat(model.emb[self.buckets], self.first, axis=0) / self.sizes[:, None]
        out, i = np.zeros(len(self.starts), np.float32), 0
        while i < len(self.starts):
            j = int(np.searchsorted(self.starts, self.starts[i] + 30_000, side="right"))
            x, rows, _ = _laid_out(table, self.ids[self.starts[i] : self.starts[j - 1] + self.lengths[j - 1] + 1])
            out[i:j] = model.logits(x, rows)
            i = j
        return out

    def typical(self, labels: np.ndarray) -> np.ndarray:
        """For every sentence the word most typical of harmful documents, as log odds of
        the shares of documents of each label that hold the word."""
        names = {}
        form = np.array([names.setdefault(n, len(names)) for n in self.normal], np.int64)
        doc_of = np.repeat(self.owner, self.lengths)
        pairs = np.unique(doc_of * max(len(names), 1) + form[self.ids[self.ids > 0] - 1])
        docs, held = np.divmod(pairs, max(len(names), 1))
        c1, c0 = (np.bincount(held[labels[docs] == kind], minlength=len(names)) for kind in (1, 0))
        n0, n1 = max(int((labels == 0).sum()), 1), max(int((labels == 1).sum()), 1)
        odds = np.log((c1 + 0.1) / (n1 + 0.2)) - np.log((c0 + 0.3) / (n0 + 0.6))
        return np.maximum.reduceat(np.concatenate(([-10.0], odds[form]))[self.ids], self.starts)

    def worst(self, value: np.ndarray) -> np.ndarray:
        """Whether a sentence has the largest value of its document, the first of equals."""
        _, first = np.unique(self.owner, return_index=True)
        top = np.flatnonzero(value == np.repeat(np.maximum.reduceat(value, first), np.diff(np.append(first, len(value)))))
        _, at = np.unique(self.owner[top], return_index=True)
        out = np.zeros(len(value), bool)
        out[top[at]] = True
        return out


def train(texts: list[str], labels: np.ndarray, seed: int = 5, epochs: int = 10, batch: int = 128) -> Model:
    """Fits the classifier to labelled documents (1 harmful, 0 not).

    Buckets that no labelled text fills stay zero, so an unknown word adds nothing. In
    each epoch a harmful document gives its worst sentence; of all sentences of the
    others come those that the model does not yet reject clearly and a tenth of the rest."""
    rng = np.random.default_rng(seed)
    corpus, labels = _Corpus(texts), np.asarray(labels)
    n_out = len(WIDTHS) * FILTERS
    emb = np.zeros((BUCKETS, DIM), np.float32)
    met = np.unique(corpus.buckets)
    emb[met] = rng.normal(0, 0.1, (len(met), DIM))
    model = Model(
        emb,
        [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(n_out, np.float32),
        rng.normal(0, 0.3, n_out).astype(np.float32),
        -1.0,
    )
    adam = _Adam(model)
    by_odds = corpus.typical(labels)
    harmful = labels[corpus.owner] == 1
    weight = float(np.sqrt((labels == 0).sum() / max((labels == 1).sum(), 1)))
    for epoch in range(epochs):
        if epoch < 3:
            value = by_odds + rng.random(len(by_odds)) * 1e-3
        elif epoch % 2:
            value = corpus.logits(model)
        worst = corpus.worst(value)
        some = rng.random(len(value)) < 0.1
        hard = value > REJECTED if epoch >= 3 else worst
        picked = np.flatnonzero(np.where(harmful, worst, hard | some))
        starts, lengths, y = corpus.starts[picked], corpus.lengths[picked], harmful[picked]
        # What is harmless stays so when it is cut: fragments, many of a single word.
        cut = rng.permutation(picked[~y])[: len(picked) // 2]
        size = np.ceil(corpus.lengths[cut] * rng.random(len(cut)) ** 3).astype(np.int64)
        at = corpus.starts[cut] + ((corpus.lengths[cut] - size + 1) * rng.random(len(cut)) * (rng.random(len(cut)) < 0.5)).astype(np.int64)
        starts, lengths = np.concatenate((starts, at)), np.concatenate((lengths, np.maximum(size, 1)))
        y = np.concatenate((y, np.zeros(len(cut), bool))).astype(np.float32)
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            adam.step(corpus, starts[part], lengths[part], y[part], weight, rng)
    return model


class _Adam:
    """Steps of Adam on batches of sentences; of the embeddings only those met change."""

    def __init__(self, model: Model, rate: float = 0.01) -> None:
        self.model, self.rate, self.n = model, rate, 0
        self.params = [model.emb, *model.conv, model.bias, model.out]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params]
        self.bias_moment = [0.0, 0.0]

    def step(self, corpus: _Corpus, begin: np.ndarray, lengths: np.ndarray, y: np.ndarray, weight: float, rng: np.random.Generator) -> None:
        """One batch: spans of the corpus's words with their labels."""
        model = self.model
        starts = np.cumsum(lengths + GAP) - (lengths + GAP)
        rows = int((lengths + GAP).sum())
        within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        word = corpus.ids[np.repeat(begin, lengths) + within] - 1
        place = np.repeat(starts + GAP, lengths) + within
        sizes = corpus.sizes[word]
        bag = np.repeat(np.arange(len(word)), sizes)
        first = np.cumsum(sizes) - sizes
        flat = corpus.buckets[np.arange(len(bag)) - np.repeat(first, sizes) + np.repeat(corpus.first[word], sizes)]
        # Some words are hidden, so that no single word decides.
        share = ((rng.random(len(word)) > 0.15) / sizes).astype(np.float32)[:, None]
        x = np.zeros((rows + GAP, DIM), np.float32)
        x[place] = np.add.reduceat(model.emb[flat], first, axis=0) * share
        owner = np.repeat(np.arange(len(y)), lengths + GAP)
        tops, where = [], []
        for w, c in zip(WIDTHS, model.conv):
            z = x[:rows] @ c[0]
            for j in range(1, w):
                z += x[j : rows + j] @ c[j]
            top = np.maximum(np.maximum.reduceat(z, starts, axis=0), 0)
            at, filt = np.nonzero(z == top[owner])
            hit = np.zeros(top.shape, np.int64)
            hit[owner[at][::-1], filt[::-1]] = at[::-1]
            tops.append(top)
            where.append(hit)
        a = np.hstack(tops) + model.bias
        mask = (rng.random(a.shape) > 0.2).astype(np.float32) / 0.8
        h = np.maximum(a, 0) * mask
        p = 1 / (1 + np.exp(-np.clip(h @ model.out + model.out_bias, -30, 30)))
        g = ((p - y) * np.where(y > 0, weight, 1.0) / len(y)).astype(np.float32)
        da = g[:, None] * model.out * mask * (a > 0)
        grads: list = [None]
        dx = np.zeros_like(x)
        for i, (w, c) in enumerate(zip(WIDTHS, model.conv)):
            d = da[:, i * FILTERS : (i + 1) * FILTERS]
            s, f = np.nonzero(d * (tops[i] > 0))
            spread = np.zeros((rows, FILTERS), np.float32)
            spread[where[i][s, f], f] = d[s, f]
            dc = np.empty_like(c)
            for j in range(w):
                dc[j] = x[j : rows + j].T @ spread
                dx[j : rows + j] += spread @ c[j].T
            grads.append(dc)
        grads += [da.sum(0), h.T @ g]
        by = np.argsort(flat, kind="stable")
        touched, at = np.unique(flat[by], return_index=True)
        grads[0] = np.add.reduceat((dx[place] * share)[bag[by]], at, axis=0)
        self.n += 1
        fix1, fix2 = 1 - 0.9**self.n, 1 - 0.999**self.n
        for k, (q, (m, v), gr) in enumerate(zip(self.params, self.moments, grads)):
            idx = touched if k == 0 else slice(None)
            m[idx] = 0.9 * m[idx] + 0.1 * gr
            v[idx] = 0.999 * v[idx] + 0.001 * gr * gr
            q[idx] -= self.rate * (m[idx] / fix1) / (np.sqrt(v[idx] / fix2) + 1e-8)
        gb, bm = float(g.sum()), self.bias_moment
        bm[0], bm[1] = 0.9 * bm[0] + 0.1 * gb, 0.999 * bm[1] + 0.001 * gb * gb
        model.out_bias -= self.rate * (bm[0] / fix1) / (np.sqrt(bm[1] / fix2) + 1e-8)


def best_threshold(scores: np.ndarray, labels: np.ndarray, default: float = 0.0, slack: float = 0.01, share: float = SHARE) -> float:
    """The middle of the thresholds whose F1 is within ``slack`` of the best: a few wrong
    labels shall not decide. Labels are sought out, so harmless documents are rarer among
    them than elsewhere; they count as if ``share`` of all documents were harmful."""
    order = np.argsort(-scores)
    s, y = np.maximum(scores[order].astype(np.float64), -40), labels[order]
    if not y.any() or y.all():
        return default
    hits = np.cumsum(y)
    false = (np.arange(len(y)) + 1 - hits) * max(1.0, y.sum() / (len(y) - y.sum()) * (1 - share) / share)
    f1 = 2 * hits / (hits + false + y.sum())
    good = np.flatnonzero(f1 >= f1.max() - slack)
    low = np.append(s[1:], s[-1] - 2)[good]
    return float((s[good[0]] + max(low[-1], s[good[0]] - 12)) / 2)


def language(code: str | None) -> str:
    return (code or "").strip().lower().replace("_", "-").split("-")[0][:2]


def folds_of(y: np.ndarray, seed: int, folds: int) -> np.ndarray:
    """A fold for every label; folds have equal shares of each label."""
    rng = np.random.default_rng(seed)
    fold = np.empty(len(y), np.int64)
    for kind in (0, 1):
        at = rng.permutation(np.flatnonzero(y == kind))
        fold[at] = np.arange(len(at)) % folds
    return fold


def held_out(texts: list[str], y: np.ndarray, fold: np.ndarray, f: int, seed: int, epochs: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """For the texts of a fold the scores of a model trained without it, and a hash of the
    worst sentence of each; -inf and 0 for texts without words."""
    model = train([t for t, g in zip(texts, fold) if g != f], y[fold != f], seed, epochs)
    corpus = _Corpus([t for t, g in zip(texts, fold) if g == f])
    logits = corpus.logits(model)
    score, worst = np.full(int((fold == f).sum()), -np.inf), np.zeros(int((fold == f).sum()), np.int64)
    for i in np.flatnonzero(corpus.worst(logits)).tolist():
        d = corpus.owner[i]
        words = corpus.ids[corpus.starts[i] : corpus.starts[i] + corpus.lengths[i]]
        score[d], worst[d] = logits[i], zlib.crc32(" ".join(corpus.normal[w - 1] for w in words).encode("utf-8", "surrogatepass"))
    return score, worst


def cross_scores(texts: list[str], y: np.ndarray, seed: int, folds: int, run=map, epochs: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """``held_out`` of every text; ``run`` maps over the folds."""
    fold = folds_of(y, seed, folds)
    score, worst = np.empty(len(y)), np.empty(len(y), np.int64)
    for f, (s, w) in enumerate(run(lambda f: held_out(texts, y, fold, f, seed, epochs), range(folds))):
        score[fold == f], worst[fold == f] = s, w
    return score, worst


def thresholds(scores: np.ndarray, y: np.ndarray, langs: list[str | None], prior: int = 25) -> dict[str, float]:
    """The overall threshold, under ``''``, and one for every language: its own best one,
    drawn to the overall one as if by ``prior`` harmful documents more. A language with
    labels of one kind only has the overall one."""
    lang = np.array([language(c) for c in langs])
    overall = best_threshold(scores, y)
    out = {"": overall}
    for code in sorted(set(lang.tolist()) - {""}):
        mine = lang == code
        n = int(y[mine].sum())
        out[code] = (n * best_threshold(scores[mine], y[mine], overall) + prior * overall) / (n + prior)
    return out


def doubtful(scores: np.ndarray, y: np.ndarray, worst: np.ndarray, margin: float = 2.0) -> np.ndarray:
    """Labels that models fitted without the document contradict by more than ``margin``
    beyond the best threshold. One such label teaches a neutral sentence as harmful, or
    an insult as harmless. A document whose worst sentence is also that of others, most
    of which are labelled harmless too, is no such case: it only treats the subject."""
    cut = best_threshold(scores, y)
    _, group = np.unique(worst, return_inverse=True)
    n, bad = np.bincount(group), np.bincount(group, weights=y)
    agreed = ((n > 1) & (2 * bad < n))[group]
    return np.where(y == 1, scores < cut - margin, (scores > cut + margin) & ~agreed)


def fit(texts: list[str], labels: list[int], langs: list[str | None], seed: int = 5, folds: int = 2, run=map) -> Model:
    """Trains on all texts whose label is not doubtful and sets the thresholds on scores of
    models that did not see the text. With one document of a kind no such model can be
    trained and they are 0. ``run`` maps a function over numbers, elsewhere if it likes."""
    y = np.asarray(labels)
    if not (0 < y.sum() < len(y)):
        raise ValueError("labels of both kinds are needed")
    folds = min(folds, int(y.sum()), int((y == 0).sum()))
    if folds < 2:
        model = train(texts, y, seed)
        model.thresholds = {"": 0.0}
        return model
    scores, worst = cross_scores(texts, y, seed, min(folds + 1, int(y.sum()), int((y == 0).sum())), run, epochs=8)
    keep = np.flatnonzero(~doubtful(scores, y, worst))
    if 0 < y[keep].sum() < len(keep):
        texts, y, langs = [texts[i] for i in keep], y[keep], [langs[i] for i in keep]
    fold = folds_of(y, seed + 1, folds)
    # The folds again and, as one more task, the model in use.
    *parts, model = run(lambda f: held_out(texts, y, fold, f, seed + 1) if f < folds else train(texts, y, seed), range(folds + 1))
    scores = np.empty(len(y))
    for f, (s, _) in enumerate(parts):
        scores[fold == f] = s
    model.thresholds = thresholds(scores, y, langs)
    return model


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded sample: text, lang and the majority of each document's labels."""
    votes = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.avg("toxic").alias("share")).where(F.col("share") != 0.5)
    some = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    return some.join(docs.where(F.length("text") <= MAX_CHARS).select("doc_id", "text", "lang"), "doc_id").select("doc_id", "text", "lang", (F.col("share") > 0.5).cast("int").alias("toxic"))


def _on_executors(spark: SparkSession):
    """A map whose calls are tasks of the cluster: what trainings there are run side by side."""
    from pyspark.serializers import CPickleSerializer

    def run(f, numbers: range) -> list:
        pack = CPickleSerializer()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pack.dumps(f(i))], pa.binary())], names=["i", "made"])

        done = spark.range(numbers.start, numbers.stop, 1, len(numbers)).mapInArrow(work, "i bigint, made binary").collect()
        return [pack.loads(bytes(r["made"])) for r in sorted(done)]

    return run


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier for these documents (doc_id, text, lang) and labels (doc_id, toxic)."""
    rows = labelled(docs, labels).orderBy("doc_id").toArrow().to_pydict()
    return fit(rows["text"], rows["toxic"], rows["lang"], run=_on_executors(docs.sparkSession))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """(kept columns, score in 0..1, flagged) of every document (text, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wide = docs.select(*keep, F.col("lang").alias("_lang"), F.col("text").alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", score double, flagged boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        limits = shared.value.thresholds
        for b in batches:
            z = scorer.scores([t or "" for t in b.column("_text").to_pylist()])
            cut = np.array([limits.get(language(c), limits[""]) for c in b.column("_lang").to_pylist()], np.float64)
            s = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))
            s[np.isneginf(z)] = 0
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(s), pa.array(z > cut)], names=[*keep, "score", "flagged"])

    return wide.mapInArrow(work, schema)
