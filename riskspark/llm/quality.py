"""Quality by a generalised additive model with pairwise interactions.

Shallow trees boosted over one feature after another, round by round, leave one
look-up table per feature; then the same over pairs of features chosen by how much
they explain of what is left. A score is a sum of table entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskspark.llm.common import text_rows
from riskspark.llm.labelled import TRAINING_ROWS, labelled_rows, logistic, remainder, training_labels
from riskspark.llm.words import NOT_SPACE, SAME, as_bytes, run_of, spans

THRESHOLD = 0.3
MODULUS, HELD_OUT = 5, 0

FEATURES = ("log_words", "word_length", "upper", "digit", "symbol", "marked_words", "beyond_ascii", "comma", "stop",
            "loud", "bar", "distinct_words", "repeats_next", "log_lines", "repeated_lines", "longest_word",
            "words_per_line", "space")


def _class(*chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[b for c in chars for b in c.encode()]] = True
    return out


_UPPER = _class(*(chr(c) for c in range(65, 91)))
_DIGIT = _class(*"0123456789")
_LETTER = _UPPER | _class(*(chr(c) for c in range(97, 123)))
_LETTER[128:] = True
_SYMBOL = _class(*"#$%&*+/<=>@\\^_`{|}~[]()")
_COUNTED = {"upper": _UPPER, "digit": _DIGIT, "symbol": _SYMBOL, "comma": _class(","), "stop": _class(*".!?"),
            "loud": _class("!"), "bar": _class("|"), "space": ~NOT_SPACE}
_HIGH = np.arange(256) >= 192    # first bytes of characters beyond ASCII


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask)))
    return np.diff(total[offsets])


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each whole text; null counts as empty."""
    raw, offsets = as_bytes(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    col = {n: i for i, n in enumerate(FEATURES)}
    for a, b in spans(offsets):
        at = offsets[a: b + 1] - offsets[a]
        data = raw[offsets[a]: offsets[b]]
        run = run_of(data, at, NOT_SPACE, SAME)
        part = out[a:b]
        n, words = np.maximum(np.diff(at), 1), run.counts
        w = np.maximum(words, 1)
        for name, table in _COUNTED.items():
            part[:, col[name]] = _per_text(table[data], at) / n
        part[:, col["beyond_ascii"]] = _per_text(_HIGH[data], at) / n
        part[:, col["log_words"]] = np.log1p(words)
        length = run.ends - run.starts
        part[:, col["word_length"]] = np.bincount(run.doc, length, b - a) / w
        if len(length):
            longest = np.zeros(b - a)
            some = np.flatnonzero(words)
            longest[some] = np.maximum.reduceat(length, run.first[some])
            part[:, col["longest_word"]] = np.log1p(longest)
            # words with two or more bytes that are neither letters, digits nor one mark at the end
            odd = np.concatenate(([0], np.cumsum(~(_LETTER | _DIGIT)[data])))
            part[:, col["marked_words"]] = np.bincount(run.doc, (odd[run.ends] - odd[run.starts]) >= 2, b - a) / w
            same = (run.hashes[1:] == run.hashes[:-1]) & (run.doc[1:] == run.doc[:-1])
            part[:, col["repeats_next"]] = np.bincount(run.doc[1:], same, b - a) / w
            order = np.lexsort((run.hashes, run.doc))
            h, d = run.hashes[order], run.doc[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
            # types grow with the root of the length: compare with that
            part[:, col["distinct_words"]] = np.log1p(np.bincount(d[new], minlength=b - a)) / np.log1p(w)
        breaks = np.zeros(len(data), bool)
        breaks[data == 10] = True
        lines = _per_text(breaks, at) + 1
        part[:, col["log_lines"]] = np.log1p(lines)
        part[:, col["words_per_line"]] = np.log1p(words / lines)
        for i in np.flatnonzero(lines > 1):
            ls = data[at[i]: at[i + 1]].tobytes().split(b"\n")
            part[i, col["repeated_lines"]] = 1 - len(set(ls)) / len(ls)
    return out


def _splits(gradient, hessian, leaves, ridge):
    """Best piecewise constant steps of a histogram: ``leaves`` - 1 greedy cuts."""
    g, h = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(hessian)))
    cuts = [0, len(gradient)]

    def worth(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)

    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                mid = np.arange(a + 1, b)
                gain = (g[mid] - g[a]) ** 2 / (h[mid] - h[a] + ridge) + (g[b] - g[mid]) ** 2 / (
                    h[b] - h[mid] + ridge) - worth(a, b)
                if gain.max() > best:
                    best, where = gain.max(), int(mid[gain.argmax()])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(gradient))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


class AdditiveModel:
    """Look-up tables per feature and per chosen pair of features, for a 0/1 label."""

    def __init__(self, rounds: int = 200, rate: float = 0.1, bins: int = 32, pair_bins: int = 8, pairs: int = 6,
                 leaves: int = 3, ridge: float = 2.0):
        self.rounds, self.rate, self.leaves, self.ridge = rounds, rate, leaves, ridge
        self.bins, self.pair_bins, self.n_pairs = bins, pair_bins, pairs

    @staticmethod
    def _edges(x, bins):
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)

    def _coded(self, x, edges):
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        k = x.shape[1]
        self.edges = [self._edges(x[:, j], self.bins) for j in range(k)]
        self.coarse = [self._edges(x[:, j], self.pair_bins) for j in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        if len(np.unique(y)) < 2:       # nothing to tell apart
            return self
        code, wide = self._coded(x, self.edges), self._coded(x, self.coarse)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for j, table in enumerate(self.tables):
                p = logistic(f)
                step = self.rate * _splits(np.bincount(code[:, j], y - p, len(table)),
                                           np.bincount(code[:, j], p * (1 - p), len(table)), self.leaves, self.ridge)
                table += step
                f += step[code[:, j]]
        p = logistic(f)
        gains = []
        for i in range(k):
            for j in range(i + 1, k):
                m = len(self.coarse[j]) + 1
                cell, n = wide[:, i] * m + wide[:, j], (len(self.coarse[i]) + 1) * m
                g, h = np.bincount(cell, y - p, n), np.bincount(cell, p * (1 - p), n)
                gains.append(((g * g / (h + 4 * self.ridge)).sum(), i, j))
        chosen = sorted(gains, reverse=True)[: self.n_pairs]
        tables = [np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for _, i, j in chosen]
        for _ in range(self.rounds // 4):
            for (_, i, j), table in zip(chosen, tables):
                p = logistic(f)
                cell = wide[:, i] * table.shape[1] + wide[:, j]
                g = np.bincount(cell, y - p, table.size).reshape(table.shape)
                h = np.bincount(cell, p * (1 - p), table.size).reshape(table.shape)
                step = np.zeros(table.shape)
                # a cut of the first feature, then steps of the second on either side
                total = [_splits(g[:c].sum(0), h[:c].sum(0), 2, 4 * self.ridge) for c in range(1, len(g))]
                rest = [_splits(g[c:].sum(0), h[c:].sum(0), 2, 4 * self.ridge) for c in range(1, len(g))]
                if not total:
                    continue
                worth = [(g[:c].sum(0) * t).sum() + (g[c:].sum(0) * r).sum() for c, (t, r) in enumerate(zip(total, rest), 1)]
                c = int(np.argmax(worth)) + 1
                step[:c], step[c:] = total[c - 1], rest[c - 1]
                table += self.rate * step
                f += self.rate * step[wide[:, i], wide[:, j]]
        self.pairs = [(i, j, t) for (_, i, j), t in zip(chosen, tables)]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: table entries are added up for all rows at once."""
        code, wide = self._coded(x, self.edges), self._coded(x, self.coarse)
        f = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            f += table[code[:, j]]
        for i, j, table in self.pairs:
            f += table[wide[:, i], wide[:, j]]
        return logistic(f)


def fitted(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> AdditiveModel:
    """The model of at most ``most`` labelled documents; without any, every score is one half."""
    sample = training_labels(labels, "quality", MODULUS, HELD_OUT, most)

    def measure(batches):
        for batch in batches:
            x = features(batch["text"])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["label"], pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    rows = labelled_rows(text_rows(docs), sample).select("doc_id", "text", "label").mapInArrow(
        measure, "doc_id long, label int, x array<double>").orderBy("doc_id", "label", "x").limit(2 * most).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return AdditiveModel().fit(x, rows["label"].to_numpy(float))


def _scored(batches, model, at):
    for batch in batches:
        yield batch, np.concatenate([model.score(features(batch.column(at).slice(i, 512)))
                                     for i in range(0, batch.num_rows, 512)] or [np.zeros(0)])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                   most: int = TRAINING_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole text alone.

    Held out are documents whose crc32(doc_id) mod 5 is 0; null doc_ids are not. Null and empty
    texts get the score of a text without words. Repeated rows score alike; an empty table gives
    no rows; without labels every score is one half.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, most))

    def judge(batches):
        for batch, score in _scored(batches, model.value, 1):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score)], names=["doc_id", "score"])

    scored = text_rows(docs).mapInArrow(judge, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"),
                         "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                   most: int = TRAINING_ROWS) -> DataFrame:
    """The rows the classifier accepts, with their own columns; nothing is shuffled."""
    model, at = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, most)), docs.columns.index("text")

    def keep(batches):
        for batch, score in _scored(batches, model.value, at):
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(keep, docs.schema)
