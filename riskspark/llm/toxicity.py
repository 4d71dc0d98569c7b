"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel compares words by the letter triples they share, letters of a triple standing
apart up to a span and worth less the wider they stand, normalised and raised to a power;
an insult with gaps or inserted characters still shares most of its triples. A word is what
stands between white space, its letters only, and runs of one or two letters join up, so
"id-iot" and "i d i o t" are one word each. A text's score comes from how
many of its words are toxic.

The machine is trained on labelled sentences as bags of words (Andrews et al. 2003, "MI-SVM"): a toxic sentence stands for
its most telling word, its witness, a clean one for the word the machine finds worst. Landmarks are the witnesses and some words
of the rest. A table of the largest landmark entry per triple bounds every similarity from above; each distinct word is compared with
the landmarks unless the fitted machine gives no positive value to any similarities up to its bound.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskspark.llm.common import staged, text_rows
from riskspark.llm.labelled import fitted_logistic, labelled_rows, logistic, remainder, training_labels
from riskspark.llm.words import LOWER, NOT_SPACE, as_bytes, mix, runs, shingle_sets, spans

THRESHOLD = 0.7
MODULUS, HELD_OUT = 3, 1
#: Most labelled documents the machine is fitted on.
TRAINING_ROWS = 8_000
#: Landmarks: different witnesses (most documents first) and other words. More witnesses than that still train the machine.
MARKING, OTHERS = 1024, 32
TELLING, SEEN = 4.0, 3       # a witness's evidence in nats, and its documents, at least
SPAN = 6        # widest triple, in characters
DECAY = 0.7     # worth of each further character
POWER = 3
LONGEST, STRIDE = 32, 16    # a longer run of letters is read in overlapping pieces
REMEMBERED = 200_000
SURE = 0.8      # decision value of a word that is toxic beyond doubt

#: 1 is the edge of a word, 2 to 27 a letter a-z, 28 to 31 bytes of letters beyond ASCII, 0 what is skipped.
_CODES = np.zeros(256, np.int32)
_CODES[[0x20, *range(0x09, 0x0E)]] = 1
_CODES[97:123] = np.arange(2, 28)
_CODES[0xC0:] = 28
_CODES[0x80:0xC0] = 29 + np.arange(64) % 3
_BITS = 5
_SIZE = 1 << 3 * _BITS
_STEPS = [(a, b, np.float32(DECAY ** (b - 2))) for a, b in combinations(range(1, SPAN), 2)]
#: Length of a word's feature vector if no triple comes twice, by its letters.
_NORM = np.sqrt([max(sum(float(w) ** 2 * max(0, n + 2 - b) for _, b, w in _STEPS), 1e-9) for n in range(LONGEST + 1)])
_NORM[0] = 1e9


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words with an edge between them, where each begins (one more at the end), and its text."""
    codes = _CODES[LOWER[raw]]
    new = np.zeros(len(raw) + 1, bool)
    new[offsets] = True
    letters = np.flatnonzero(codes > 1)
    if not len(letters):
        return np.ones(1, np.int32), np.ones(1, np.int64), np.zeros(0, np.int64)
    number = np.cumsum((codes == 1) | new[:-1])[letters]
    start = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    size = np.diff(np.append(start, len(letters)))
    doc = np.searchsorted(offsets, letters[start], "right") - 1
    joined = np.concatenate(([False], (size[1:] <= 2) & (size[:-1] <= 2) & (doc[1:] == doc[:-1])))
    start, doc = start[~joined], doc[~joined]
    size = np.diff(np.append(start, len(letters)))
    if size.max() > LONGEST:
        cuts = np.maximum(1, -(-(size - LONGEST) // STRIDE) + 1)
        within = STRIDE * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        start, doc, size = np.repeat(start, cuts) + within, np.repeat(doc, cuts), np.minimum(np.repeat(size, cuts) - within, LONGEST)
        first = np.cumsum(size) - size
        letters = letters[np.arange(size.sum()) + np.repeat(start - first, size)]
        start = first
    at = np.arange(len(letters)) + np.repeat(np.arange(len(start)), size) + 1
    out = np.ones(len(letters) + len(start) + 1, np.int32)
    out[at] = codes[letters]
    return out, np.append(at[start], len(out)), doc


def _room(begin: np.ndarray, n: int) -> np.ndarray:
    """At each of ``n`` codes the steps to the edge that ends its word; an edge belongs to the word after it."""
    size = np.diff(begin) - 1
    room = np.zeros(n, np.int32)
    room[begin[0] - 1: begin[-1] - 1] = np.repeat(size + 1, size + 1) - (
        np.arange(begin[-1] - begin[0]) - np.repeat(begin[:-1] - begin[0], size + 1))
    return room


def bounds(codes: np.ndarray, begin: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For every word: the table's entries of its triples, with decay, over the word's norm."""
    size = np.diff(begin) - 1
    room = _room(begin, len(codes))
    long = np.concatenate((codes, np.zeros(SPAN, np.int32)))
    total, n = np.zeros(len(codes), np.float32), len(codes)
    for a, b, worth in _STEPS:
        triple = (((long[:n] << _BITS) | long[a: a + n]) << _BITS) | long[b: b + n]
        total += np.where(room >= b, worth * table[triple], np.float32(0))
    return np.add.reduceat(total, begin[:-1] - 1) / _NORM[size] if len(size) else np.zeros(0)


def _in_row(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of words with an edge between them, and where each begins (one more at the end)."""
    codes = np.frombuffer(b"\1" + b"".join(w + b"\1" for w in words), np.uint8).astype(np.int32)
    return codes, np.cumsum([1, *(len(w) + 1 for w in words)])


class Landmarks:
    """Words by their triples: the entries of triple t are ``first[t]`` to ``first[t + 1]``, each a word and its worth there.

    A word has some dozens of the 32,768 triples, so only these are held and met.
    """

    def __init__(self, words: list[bytes]):
        triples, worths = [], []
        for w in words:
            x = np.array([1, *w, 1])
            met = [((((x[:-b] << _BITS) | x[a: a + len(x) - b]) << _BITS) | x[b:], worth) for a, b, worth in _STEPS if len(x) > b]
            triple, at = np.unique(np.concatenate([t for t, _ in met] or [np.zeros(0, np.int64)]), return_inverse=True)
            worth = np.zeros(len(triple), np.float32)
            np.add.at(worth, at, np.repeat(np.array([v for _, v in met], np.float32), [len(t) for t, _ in met]))
            # the norm adds up triple after triple
            norm = np.sqrt(np.add.accumulate(worth * worth)[-1:].sum(dtype=np.float32))
            triples.append(triple)
            worths.append(worth / np.maximum(norm, np.float32(1e-9)))
        self.count = len(words)
        triple = np.concatenate(triples or [np.zeros(0, np.int64)])
        order = np.argsort(triple, kind="stable")
        self.word = np.repeat(np.arange(len(words)), np.array([len(t) for t in triples], np.int64))[order]
        self.worth = np.concatenate(worths or [np.zeros(0, np.float32)])[order]
        self.first = np.searchsorted(triple[order], np.arange(_SIZE + 1))
        self.most = np.zeros(_SIZE, np.float32)     # largest entry of each triple
        np.maximum.at(self.most, triple[order], self.worth)


def similarities(words: list[bytes], landmarks: Landmarks) -> np.ndarray:
    """Kernel of words (their codes as bytes) with landmarks, a column each."""
    out = np.zeros((len(words), landmarks.count), np.float32)
    for at in range(0, len(words), 1024):
        codes, begin = _in_row(words[at: at + 1024])
        size = np.diff(begin) - 1
        room = _room(begin, len(codes))
        row = np.repeat(np.arange(len(size)), size + 1) * landmarks.count
        cells = out[at: at + 1024].reshape(-1)
        for a, b, worth in _STEPS:
            i = np.flatnonzero(room >= b)
            triple = (((codes[i] << _BITS) | codes[i + a]) << _BITS) | codes[i + b]
            n = landmarks.first[triple + 1] - landmarks.first[triple]
            entry = np.arange(n.sum()) + np.repeat(landmarks.first[triple] - (np.cumsum(n) - n), n)
            np.add.at(cells, np.repeat(row[i], n) + landmarks.word[entry], worth * landmarks.worth[entry])
        met = np.flatnonzero(cells)
        cells[met] = np.clip((cells[met] / _NORM[size][met // landmarks.count]).astype(np.float32), 0, 1) ** POWER
    return out


def _encoded(word: str) -> bytes:
    codes = _CODES[LOWER[np.frombuffer(word.encode(), np.uint8)]]
    return codes[codes > 1][:LONGEST].astype(np.uint8).tobytes()


class KernelMachine:
    """``sum_j alpha_j k(x, z_j) + bias`` over landmarks ``z_j``."""

    def __init__(self, marking: list[bytes], others: list[bytes], alpha: np.ndarray | None = None, bias: float = 0.0):
        self.marking, self.others = marking, others
        words = [*marking, *others]
        self.z = Landmarks(words)
        self.bound = self.z.most
        self.alpha, self.bias = np.zeros(len(words)) if alpha is None else alpha, bias
        self.values: dict[bytes, float] = {}    # decision values of words already met, about REMEMBERED at most

    def __reduce__(self):
        # what travels to the executors is the landmarks' letters; their tables are built there
        return KernelMachine, (self.marking, self.others, self.alpha, self.bias)

    def fit(self, words: list[bytes], y: np.ndarray, cost: float = 10.0) -> "KernelMachine":
        """Squared-hinge support vector machine on the Nystroem features, by Newton steps."""
        kernel = similarities([*self.marking, *self.others], self.z).astype(np.float64)
        values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
        root = vectors / np.sqrt(np.maximum(values, 1e-3))      # K_mm^(-1/2), up to a rotation
        x = np.column_stack((similarities(words, self.z) @ root, np.ones(len(words))))
        sign = np.where(y > 0, 1.0, -1.0)
        weight = cost * np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y <= 0).sum()))
        w, keep = np.zeros(x.shape[1]), np.ones(x.shape[1])
        keep[-1] = 1e-3
        for _ in range(25):
            margin = 1 - sign * (x @ w)
            on = margin > 0
            grad = keep * w - 2 * x[on].T @ (weight[on] * sign[on] * margin[on])
            step = np.linalg.solve((2 * x[on] * weight[on, None]).T @ x[on] + np.diag(keep), grad)
            w -= step
            if np.abs(step).max() < 1e-7:
                break
        self.alpha, self.bias, self.values = root @ w[:-1], float(w[-1]), {}
        return self

    def least(self) -> float:
        """No word whose similarities are all up to this, before the power, has a positive decision value."""
        most = float(np.maximum(self.alpha, 0).sum())
        return (max(0.0, -self.bias) / max(most, 1e-9)) ** (1 / POWER) - 1e-3

    def decide(self, words: list[bytes]) -> np.ndarray:
        """Decision values of words; minus infinity for those that no similarities up to their bound make toxic."""
        out = np.full(len(words), -np.inf)
        codes, begin = _in_row(words)
        near = np.flatnonzero(bounds(codes, begin, self.bound) >= self.least())
        out[near] = similarities([words[i] for i in near.tolist()], self.z) @ self.alpha + self.bias
        return out

    def worst(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of each whole text: how many words are toxic, how many beyond doubt, and the worst word."""
        raw, offsets = as_bytes(texts)
        where = [b""] * len(texts)
        hits, sure = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for a, b in spans(offsets, 1 << 19):
            codes, begin, doc = words_of(raw[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
            if not len(doc):
                continue
            # equal words are told by a 64-bit sum over their letters and places
            place = np.zeros(len(codes), np.uint64)
            place[begin[0]:] = np.arange(begin[0], len(codes)) - np.repeat(begin[:-1], np.diff(begin))
            letters = mix((place << np.uint64(_BITS)) + codes.astype(np.uint64))
            name = np.add.reduceat(letters, begin[:-1])
            _, first, which = np.unique(name, return_index=True, return_inverse=True)
            small = codes.astype(np.uint8)
            words = [small[begin[i]: begin[i + 1] - 1].tobytes() for i in first.tolist()]
            if len(self.values) > REMEMBERED:
                self.values.clear()
            value = self.values
            new = [w for w in words if w not in value]
            if new:
                value.update(zip(new, self.decide(new).tolist()))
            of = np.array([value[w] for w in words])[which]
            hits[a: b] += np.bincount(doc[of > 0], minlength=b - a)
            sure[a: b] += np.bincount(doc[of > SURE], minlength=b - a)
            order = np.lexsort((np.arange(len(doc)), -of, doc))
            order = order[np.concatenate(([True], doc[order][1:] != doc[order][:-1]))]
            for i in order[of[order] > -np.inf].tolist():
                where[a + doc[i]] = words[which[i]]
        return hits, sure, where


def evidence(hits: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """What a text is judged by, from its counts of toxic words and of those beyond doubt."""
    return np.column_stack((np.log1p(hits), np.log1p(sure)))


def _witnesses(rows: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """(witnesses of toxic documents, most documents first; words of the rest by hash), as letter codes.

    A word's evidence is the likelihood ratio of its documents' labels against those of all; each toxic document
    takes its word of most evidence. Counted on Spark; at most one word a sampled document reaches the driver.
    """
    def bags(batches):
        for batch in batches:
            raw, offsets = as_bytes(batch["text"])
            for a, b in spans(offsets, 1 << 19):
                codes, begin, doc = words_of(raw[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                small = codes.astype(np.uint8)
                met = sorted({(d, small[i: j - 1].tobytes()) for d, i, j in zip(doc.tolist(), begin.tolist(), begin[1:].tolist()) if j - i > 3})
                at = pa.array(np.array([a + d for d, _ in met], np.int64))
                yield pa.RecordBatch.from_arrays([batch["row"].take(at), batch["label"].take(at), pa.array([w for _, w in met], pa.binary())],
                                                 names=["row", "label", "word"])

    words = rows.withColumn("row", F.xxhash64("doc_id", "text")).select("row", "label", "text").mapInArrow(bags, "row long, label int, word binary")
    total = rows.agg(F.sum("label"), F.count("*")).first()
    if not total[0] or total[0] == total[1]:
        return [], []
    share = float(total[0]) / float(total[1])
    p, n = F.col("p"), F.col("n")
    ratio = p * F.log(p / (n * share)) + F.when(n > p, (n - p) * F.log((n - p) / (n * (1 - share)))).otherwise(0.0)
    seen = words.groupBy("word").agg(F.sum("label").cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    told = seen.where((p > n * share) & (n >= SEEN)).withColumn("ratio", ratio).where(F.col("ratio") >= TELLING)
    best = words.where("label = 1").join(told, "word").groupBy("row").agg(F.max_by("word", F.struct("ratio", "word")).alias("word"))
    witnesses = best.groupBy("word").count().orderBy(F.desc("count"), "word").collect()
    others = seen.where(p < n * share).orderBy(F.xxhash64("word"), "word").limit(OTHERS).collect()
    return [bytes(r["word"]) for r in witnesses], [bytes(r["word"]) for r in others]


def _spellings(word: bytes) -> list[bytes]:
    """The word and what it becomes when one or two letters are put in."""
    out = [word]
    if len(word) > 3:
        rng = np.random.default_rng(list(word))
        for _ in range(3):
            a, b = sorted(rng.integers(1, len(word), 2).tolist())
            x, y = (bytes([c]) for c in rng.integers(2, 28, 2).tolist())
            out += [word[:a] + x + word[a:], word[:a] + x + word[a:b] + y + word[b:]]
    return [w[:LONGEST] for w in out]


def fitted(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS, rounds: int = 2) -> tuple[KernelMachine, np.ndarray]:
    """(machine, weights of the calibration) from at most ``most`` labelled documents.

    A round trains on the witnesses of toxic documents, also with letters put in, against the worst words of clean ones; then a
    toxic document without a witness takes its worst word. At last the counts of toxic words are calibrated on the labels.
    """
    sample = training_labels(labels, "toxic", MODULUS, HELD_OUT, most)
    def sketch(batches):
        # smallest 5-word hash: near copies of a document mostly share it
        for batch in batches:
            least = np.zeros(batch.num_rows, np.int64)
            for a, b, run in runs(batch["text"], NOT_SPACE):
                sets, at = shingle_sets(run)
                some = np.flatnonzero(np.diff(at))
                least[a + some] = sets[at[some]].astype(np.int64)
            yield batch.append_column("sketch", pa.array(least))

    rows = staged(labelled_rows(text_rows(docs), sample).select("doc_id", "text", "label").mapInArrow(
        sketch, "doc_id long, text string, label int, sketch long"), "toxic-sample")
    witnesses, others = _witnesses(rows.dropDuplicates(["sketch", "label"]))
    marking = witnesses[:MARKING]
    machine, none = KernelMachine(marking, others), np.zeros(3)
    if not marking or not others:
        return machine, none

    def look():
        shared = rows.sparkSession.sparkContext.broadcast(machine)

        def worst(batches):
            for batch in batches:
                hits, sure, where = shared.value.worst(batch["text"])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["label"], pa.array(hits), pa.array(sure), pa.array(where, pa.binary())],
                    names=["doc_id", "label", "hits", "sure", "word"])

        return rows.mapInArrow(worst, "doc_id long, label int, hits long, sure long, word binary").orderBy(
            "doc_id", "label", "hits", "word").limit(2 * most).toPandas()

    toxic, known = dict.fromkeys(witnesses), set(witnesses)
    clean = dict.fromkeys(w for w in others if w not in known)

    def train():
        words = list(dict.fromkeys(v for w in toxic for v in _spellings(w) if v not in clean))
        machine.fit([*words, *clean], np.array([1] * len(words) + [0] * len(clean)))
        return look()

    for _ in range(rounds):
        found = train()
        size = found["label"].value_counts()
        met = found.loc[found["word"].map(len) > 0, ["word", "label"]].groupby("word")["label"].agg(["sum", "count"])
        for word, (p, n) in zip(map(bytes, met.index), met.to_numpy().tolist()):
            if word in known:
                continue
            # the class in which the word is worst more often, by the classes' sizes
            if p * size.get(0, 0) > (n - p) * size.get(1, 0):
                if machine.decide([word])[0] > 0 and word not in clean:
                    toxic[word] = None
            else:
                toxic.pop(word, None)
                clean[word] = None
    found = train()
    if found["label"].nunique() < 2:
        return machine, none
    return machine, fitted_logistic(
        evidence(found["hits"].to_numpy(), found["sure"].to_numpy()), found["label"].to_numpy(float), 1e-3)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                    most: int = TRAINING_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole text alone.

    Held out are documents whose crc32(doc_id) mod 3 is 1; null doc_ids are not. A text's score comes
    from its toxic words. Null and empty texts get the score of a text without letters.
    Repeated rows score alike; an empty table gives no rows; without labels of both kinds, or words
    that mark toxic ones, every score is one half.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, most))

    def judge(batches):
        machine, w = shared.value
        for batch in batches:
            score = logistic(evidence(*machine.worst(batch["text"])[:2]) @ w[:2] + w[2])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score)], names=["doc_id", "score"])

    scored = text_rows(docs).mapInArrow(judge, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"),
                         "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
