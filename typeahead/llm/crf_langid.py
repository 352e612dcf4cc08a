"""Language identification of words in code-switched text with a linear-chain CRF.

Emissions sum hashed affix and character n-gram weights and lexicon flags (the words most
typical of each language in the training sample); transitions are learned on sequences
that splice segments of different documents, so the chain knows both staying and switching.
Forward-backward gives every word a posterior over the languages; a document takes the
language with the largest posterior mass, its score being the mean posterior.

Training uses at most about ``docs_per_lang`` whole documents per language, chosen by a
hash of the id; prediction reads every word of every text.  A text that is null or has no
letter is ``und`` with score 0, as is every text when there is nothing to learn from.
Rows that repeat a document each get a row; an empty table gives none; other columns are
ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_remainder, in_worker, table
from .queries import register

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 15
DOCS_PER_LANG = 150   # documented bound of the training sample
LEXICON = 300         # words per language
SEGMENT, SEQUENCE = 40, 320
CACHE_WORDS = 250_000     # emissions kept per worker; a full cache is emptied
SLICE_WORDS = 400_000     # words per forward-backward run, about


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    words = WORD.findall((text or "").lower())
    if not "".join(words).isalpha():  # numerals that are no digits
        words = [w for w in words if any(map(str.isalpha, w))]
    return words


class Hashes(dict):
    """Feature name to bucket; affixes and n-grams repeat, so each is hashed once per worker."""

    def __missing__(self, name: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[name] = bucket = zlib.crc32(name.encode()) % BUCKETS
        return bucket


_hashes = Hashes()


def word_features(word: str, lexicon: dict[str, int]) -> list[int]:
    padded = f"<{word}>"
    names = [padded[i:i + n] for n in (2, 3) for i in range(len(padded) - n + 1)]
    names += ["<" + padded[1:5], padded[-5:-1] + ">"]  # affixes beyond the n-grams' reach
    mask = lexicon.get(word, 0)
    if mask:
        names += [f"={b}" for b in range(mask.bit_length()) if mask >> b & 1]
    return list(map(_hashes.__getitem__, names))


def feature_rows(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """All feature ids, and where each word's begin."""
    lists = [word_features(w, lexicon) for w in words]
    starts = np.cumsum([0] + [len(x) for x in lists[:-1]])
    return np.fromiter((f for x in lists for f in x), np.int64), starts


class Packed:
    """Sequences laid out by time step, longest first, so that one step is one slice."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        longest = int(lengths.max(initial=0))
        # active[t]: sequences longer than t
        active = len(lengths) - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest]
        self.bounds = np.concatenate([[0], np.cumsum(active)]).tolist()
        step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.at = np.asarray(self.bounds)[step] + np.repeat(rank, lengths)

    def posteriors(self, psi: np.ndarray, move: np.ndarray, begin: np.ndarray):
        """Node posteriors and expected transition counts; ``psi`` is in packed order."""
        b, n = self.bounds, len(self.bounds) - 1
        alpha = np.empty_like(psi)
        a = psi[:b[1]] * begin
        for t in range(n):
            if t:
                k = b[t + 1] - b[t]
                a = (a[:k] @ move) * psi[b[t]:b[t + 1]]
            a = a / a.sum(axis=1, keepdims=True)
            alpha[b[t]:b[t + 1]] = a
        pairs = np.zeros((psi.shape[1],) * 2)
        beta = np.ones((b[n] - b[n - 1], psi.shape[1]), psi.dtype)
        for t in range(n - 1, -1, -1):
            rows = alpha[b[t]:b[t + 1]]
            if t < n - 1:
                k = b[t + 2] - b[t + 1]
                ahead = psi[b[t + 1]:b[t + 2]] * beta
                joint = ahead / ((rows[:k] @ move) * ahead).sum(axis=1, keepdims=True)
                pairs += (rows[:k].T @ joint) * move
                full = np.ones((b[t + 1] - b[t], psi.shape[1]), psi.dtype)
                full[:k] = ahead @ move.T
                beta = full / full.sum(axis=1, keepdims=True)
            post = rows * beta
            alpha[b[t]:b[t + 1]] = post / post.sum(axis=1, keepdims=True)
        return alpha, pairs


def train(docs: list[tuple[str, str]], epochs: int = 25, rate: float = 0.3, l2: float = 1e-3,
          seed: int = 3) -> dict:
    """Fit by AdaGrad on the conditional log-likelihood of (text, language) documents."""
    labels = sorted({lang for _, lang in docs})
    n_labels, rng = len(labels), np.random.default_rng(seed)
    tokenised = [(words_of(text), labels.index(lang)) for text, lang in docs]
    counts = [Counter() for _ in labels]
    for ws, y in tokenised:
        counts[y].update(ws)
    lexicon: dict[str, int] = {}
    for y, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:LEXICON]:
            lexicon[w] = lexicon.get(w, 0) | 1 << y
    model = {"id": uuid.uuid4().hex, "labels": labels, "lexicon": lexicon,
             "weights": np.zeros((BUCKETS, max(n_labels, 1)), np.float32),
             "move": np.zeros((n_labels, n_labels)), "begin": np.zeros(n_labels)}
    index: dict[str, int] = {}
    segments = [([index.setdefault(w, len(index)) for w in ws[i:i + SEGMENT]], y)
                for ws, y in tokenised for i in range(0, len(ws), SEGMENT)]
    if not segments:
        return model
    rng.shuffle(segments)
    word = np.concatenate([s for s, _ in segments])
    truth = np.repeat([y for _, y in segments], [len(s) for s, _ in segments])
    lengths = np.full(-(-len(word) // SEQUENCE), SEQUENCE)
    lengths[-1] = len(word) - SEQUENCE * (len(lengths) - 1)
    packed = Packed(lengths)
    feats, starts = feature_rows(list(index), lexicon)
    spans = np.diff(np.append(starts, len(feats)))
    first = np.cumsum(lengths) - lengths
    inner = np.setdiff1d(np.arange(1, len(word)), first)
    seen_pairs = np.bincount(truth[inner - 1] * n_labels + truth[inner],
                             minlength=n_labels ** 2).reshape(n_labels, n_labels)
    seen_begin = np.bincount(truth[first], minlength=n_labels)
    params = [model["weights"].astype(float), model["move"], model["begin"]]
    sums = [np.full_like(p, 1e-8) for p in params]
    for _ in range(epochs):
        weights, move, begin = params
        emit = np.add.reduceat(weights[feats], starts)[word]
        psi = np.empty_like(emit)
        psi[packed.at] = np.exp(emit - emit.max(axis=1, keepdims=True)) + 1e-30
        post, pairs = packed.posteriors(psi, np.exp(move), np.exp(begin))
        post = post[packed.at]
        wrong = -post
        wrong[np.arange(len(word)), truth] += 1
        by_word = np.stack([np.bincount(word, wrong[:, y], len(index)) for y in range(n_labels)], 1)
        grad = np.stack([np.bincount(feats, np.repeat(by_word[:, y], spans), BUCKETS)
                         for y in range(n_labels)], 1)
        grads = [grad, seen_pairs - pairs, seen_begin - post[first].sum(axis=0)]
        for p, s, g in zip(params, sums, grads):
            g = g - l2 * p
            s += g * g
            p += rate * g / np.sqrt(s)
    model["weights"], model["move"], model["begin"] = params[0].astype(np.float32), params[1], params[2]
    return model


_emissions: dict[str, tuple[dict[str, int], list[np.ndarray]]] = {}


def emissions(model: dict, words: list[list[str]]) -> np.ndarray:
    """Emission scores of all words in order; each distinct word is scored once per worker."""
    if model["id"] not in _emissions or len(_emissions[model["id"]][0]) > CACHE_WORDS:
        _emissions.clear()
        _emissions[model["id"]] = ({}, [np.empty((0, len(model["labels"])), np.float32)])
    index, rows = _emissions[model["id"]]
    known = len(index)
    at = np.fromiter((index.setdefault(w, len(index)) for ws in words for w in ws), np.int64,
                     sum(map(len, words)))
    new = list(index)[known:]
    for lo in range(0, len(new), 50_000):
        feats, starts = feature_rows(new[lo:lo + 50_000], model["lexicon"])
        rows.append(np.add.reduceat(model["weights"][feats], starts))
    rows[:] = [np.concatenate(rows)]
    return rows[0][at]


def label_documents(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    labels = model["labels"]
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not labels:
        return names, scores
    move, begin = np.exp(model["move"]).astype(np.float32), np.exp(model["begin"]).astype(np.float32)

    def run(docs: list[int], words: list[list[str]]) -> None:
        lengths = np.array([len(w) for w in words])
        emit = emissions(model, words)
        packed = Packed(lengths)
        emit -= emit.max(axis=1, keepdims=True)
        np.exp(emit, out=emit)
        emit += np.float32(1e-30)
        psi = np.empty_like(emit)
        psi[packed.at] = emit
        del emit
        post = packed.posteriors(psi, move, begin)[0][packed.at]
        mean = np.add.reduceat(post.astype(float), np.cumsum(lengths) - lengths) / lengths[:, None]
        for d, row in zip(docs, mean):
            y = int(row.argmax())
            names[d], scores[d] = labels[y], min(1.0, float(row[y]))

    docs, words, size = [], [], 0
    for d, text in enumerate(texts):
        ws = words_of(text)
        if ws:
            docs.append(d)
            words.append(ws)
            size += len(ws)
        if size > SLICE_WORDS:
            run(docs, words)
            docs, words, size = [], [], 0
    if docs:
        run(docs, words)
    return names, scores


def drop_caches() -> None:
    _hashes.clear()
    _emissions.clear()


@in_worker("langid", drop_caches)
def label_batches(batches, model: dict):
    for batch in batches:
        names, scores = label_documents(batch.column(2).to_pylist(), model)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            ["id", "held_out", "lang_pred", "score"])
    _hashes.clear()  # the worker may go on to other work


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str,
                    docs_per_lang: int) -> list[tuple[str, str]]:
    """About ``docs_per_lang`` whole documents per language, chosen by a hash of the id."""
    share = {lang: docs_per_lang / n for lang, n in docs.groupBy(lang_col).count().collect()}  # a row per language
    if not share:
        return []
    table_ = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    draw = F.xxhash64(id_col, F.lit(17)) / F.lit(2.0 ** 64) + 0.5
    rows = docs.filter(draw < F.element_at(table_, F.col(lang_col))) \
        .select(F.coalesce(F.col(text_col), F.lit("")), F.col(lang_col)).collect()
    return sorted((t, lang) for t, lang in rows)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    Held out: crc32 of the id as text is 1 modulo 3; only the others, where labelled, train.
    """
    held = id_remainder(F.col(id_col), 3) == 1
    labelled = docs.filter(~held & F.col(lang_col).isNotNull())
    model = train(training_sample(labelled, id_col, text_col, lang_col, docs_per_lang))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(label_batches, model=model),
                           "id long, held_out boolean, lang_pred string, score double") \
        .withColumnRenamed("id", id_col)


@in_worker("langid", drop_caches)
def accept_batches(batches, model: dict, text_at: int, min_score: float):
    for batch in batches:
        texts = batch.column(text_at).to_pylist()
        if not model["labels"]:
            yield batch.filter(pa.array([len(words_of(t)) > 0 for t in texts], pa.bool_()))
            continue
        names, scores = label_documents(texts, model)
        yield batch.filter(pa.array([n != "und" and s >= min_score for n, s in zip(names, scores)], pa.bool_()))
    _hashes.clear()


def drop_unidentified(docs: DataFrame, min_score: float = 0.3, id_col: str = "doc_id",
                      text_col: str = "text", lang_col: str = "lang",
                      docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """``docs`` without texts that have no letters or whose language is less likely than
    ``min_score``, columns unchanged.  Where no document that may train has a language,
    nothing is learnt and every text with letters stays."""
    held = id_remainder(F.col(id_col), 3) == 1
    labelled = docs.filter(~held & F.col(lang_col).isNotNull())
    model = train(training_sample(labelled, id_col, text_col, lang_col, docs_per_lang))
    at = docs.columns.index(text_col)
    return docs.mapInArrow(partial(accept_batches, model=model, text_at=at, min_score=min_score), docs.schema)


@register("op5_crf_langid")
def op5(spark, sf_dir):
    return identify_languages(table(spark, sf_dir, "documents"))
