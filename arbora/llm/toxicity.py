"""Toxic passages by maximum-scoring segments, with learned token log-odds and extreme-value calibration.

1. Features of a word are the word itself and its first 4, 5 and 6 bytes (so inflected and compounded forms share
   evidence). From the labelled training rows each feature gets a log-odds of toxic against clean under an
   informative Dirichlet prior (the background frequency of the feature); features whose shrunk log-odds are
   clearly positive form the lexicon, every other word scores slightly below zero.
2. One linear scan of a text's scores finds all maximal scoring segments (Ruzzo and Tompa 1999).
3. A segment of score s in a text of n words has the expected count E = K n exp(-lambda s) in clean text (Karlin and
   Altschul 1990), so the largest score of a clean text is Gumbel distributed; lambda and K are fitted to those maxima by
   maximum likelihood, texts without any segment counting as censored. Segments with E below ``max_e`` are
   significant; a text's statistic is the sum of their -log E, and a monotone fit turns it into a probability.

The maxima and the monotone fit come from texts that their lexicon has not seen: the training rows are dealt to ``FOLDS``
folds, each scored by a lexicon of the others. The lexicon that scores the input is of all training rows.

Bound, which does not depend on what is scored: about ``max_training_docs`` labelled rows at most are learned from
(chosen by a hash of the id); the lexicon holds features of theirs only. Every whole text is scored.

Defined cases: a null or empty text has no words and gets the score of statistic 0; null ``doc_id`` rows are
scored and never learned from; rows repeated in the labels count once; without labels of both kinds every score
is the base rate (0.0 if there are no labels); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm._spark import batches, id_text, table, training_sample, written
from arbora.llm._text import ALNUM, U, Words, mix, segment_hash, words_of

PREFIXES = (4, 5, 6)
BIN = 0.5  #: width of the calibration's bins
FOLDS = 3
UNIT = 1024  #: occurrences are counted in such parts, so that sums do not depend on their order
LEAST_MAXIMA = 20  #: of clean texts with a segment that lambda and K are fitted to; with fewer both are 1


def features_of(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indexes of words, feature hash) for whole words and for each prefix length; hashes as int64."""
    found = [(np.arange(len(words.starts)), words.hashes.view(np.int64))]
    size = words.ends - words.starts
    for k in PREFIXES:
        at = np.flatnonzero(size > k)
        h = segment_hash(words.data, words.starts[at], words.starts[at] + k, U(0x2545F4914F6CDD1D))
        found.append((at, mix(h + U(1000 + k)).view(np.int64)))
    return found


def max_segments(positions, scores, n_words: int, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text whose other words score ``drift`` < 0.

    ``positions`` are the ascending places of the words with positive ``scores``. Linear in their number,
    apart from the list search that the algorithm bounds.
    """
    segments: list[tuple[int, int, float, float]] = []  # first, last, sum before it, sum up to its end
    total, last = 0.0, -1
    for p, s in zip(positions, scores):
        total += drift * (p - last - 1)
        left, first = total, p
        total += s
        right, last = total, p
        while True:
            j = len(segments) - 1
            while j >= 0 and segments[j][2] >= left:
                j -= 1
            if j < 0 or segments[j][3] >= right:
                break
            first, left = segments[j][0], segments[j][2]
            del segments[j:]
        segments.append((first, p, left, right))
    return [(a, b, r - x) for a, b, x, r in segments]


@dataclass
class ToxicityModel:
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  #: sorted
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    drift: float = -0.05
    lam: float = 1.0
    k: float = 1.0
    max_e: float = 0.5
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0))  #: lower edges of the statistic
    levels: np.ndarray = field(default_factory=lambda: np.zeros(1))  #: probability below the first edge, then from each edge on

    def word_scores(self, words: Words) -> np.ndarray:
        best = np.zeros(len(words.starts))
        if not len(self.features):
            return best
        seen = np.zeros(1 << 16, bool)
        seen[(self.features.view(U) >> U(48)).astype(np.int64)] = True
        for at, h in features_of(words):
            some = seen[(h.view(U) >> U(48)).astype(np.int64)]
            at, h = at[some], h[some]
            k = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
            hit = self.features[k] == h
            np.maximum.at(best, at[hit], self.scores[k[hit]])
        return best

    def passages(self, column) -> list[list[tuple[int, int, float, float]]]:
        """For each text its significant segments (first word, last word, score, E), best first."""
        words = words_of(column, ALNUM, lower=True)
        best = self.word_scores(words)
        out: list[list] = [[] for _ in range(words.n_docs)]
        places = np.flatnonzero(best > 0)
        doc = np.searchsorted(words.offsets, places, "right") - 1
        edges = np.flatnonzero(np.diff(doc, prepend=-1, append=words.n_docs))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            d = int(doc[a])
            base, n = int(words.offsets[d]), int(words.offsets[d + 1] - words.offsets[d])
            found = max_segments((places[a:b] - base).tolist(), best[places[a:b]].tolist(), n, self.drift)
            rated = [(x, y, s, self.k * n * float(np.exp(-min(self.lam * s, 700)))) for x, y, s in found]
            out[d] = sorted((r for r in rated if r[3] <= self.max_e), key=lambda r: (r[3], r[0]))
        return out

    def maxima(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(words, score of the best segment or 0) of each text."""
        plain = replace(self, lam=0.0, k=0.0)  # every segment is kept
        best = [max((s for _, _, s, _ in found), default=0.0) for found in plain.passages(column)]
        return words_of(column, ALNUM, lower=True).counts(), np.array(best, float)

    def statistic(self, found: list[tuple[int, int, float, float]]) -> float:
        return min(sum(-float(np.log(max(e, 1e-300))) for *_, e in found), 200.0)

    def probability(self, statistic: np.ndarray) -> np.ndarray:
        return self.levels[np.searchsorted(self.steps, statistic, "right")]


def monotone(n: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing rates nearest to hits / n."""
    blocks: list[list[float]] = []
    for a, b in zip(n.tolist(), hits.tolist()):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            x = blocks.pop()
            blocks[-1] = [blocks[-1][i] + x[i] for i in range(3)]
    return np.concatenate([np.full(int(c), b / a) for a, b, c in blocks]) if blocks else np.zeros(0)


def gumbel(n: np.ndarray, best: np.ndarray, least: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of P(best < s) = exp(-K n exp(-lambda s)) by maximum likelihood; where ``best`` is 0 it is below ``least``."""
    seen = best > 0
    if seen.sum() < LEAST_MAXIMA:
        return 1.0, 1.0
    edge, m = np.where(seen, best, least), float(seen.sum())
    top = (-np.inf, 1.0, 1.0)
    for lam in np.geomspace(0.05, 10, 400):
        k = m / float((n * np.exp(-lam * edge)).sum())
        top = max(top, (m * np.log(lam) + m * np.log(k) - lam * float(best[seen].sum()), float(lam), k))
    return top[1], top[2]


def _lexicon(counts: DataFrame, without: int | None, n1: int, n0: int, prior: float, min_docs: int) -> ToxicityModel:
    """The features of the training rows, but for those of fold ``without``, that speak for toxic texts."""
    folds = [k for k in range(FOLDS) if k != without]
    counts = counts.select("feature", *[sum(F.col(f"{c}_{k}") for k in folds).alias(c) for c in ("d1", "d0", "y1", "y0")]).where(F.col("d1") >= min_docs)
    # So many features are tried that some look toxic by chance: the texts that have one must be more often toxic than all are
    # by a margin whose probability (Chernoff's bound) is below one in the number of features.
    n, q, p = F.col("d1") + F.col("d0"), F.col("d1") / (F.col("d1") + F.col("d0")), n1 / max(n1 + n0, 1)
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    margin = F.when(q > p, n * (part(q, p) + part(1 - q, 1 - p))).otherwise(0.0)
    sure = margin > float(np.log(max(counts.count(), 1)))
    # The prior of a feature is ``prior`` occurrences, spread over both kinds as it is overall.
    y1, y0 = F.col("y1") / UNIT, F.col("y0") / UNIT
    share = (y1 + y0) / float(n1 + n0)
    a1, a0 = F.lit(prior) * share * n1 / (n1 + n0) + 0.05, F.lit(prior) * share * n0 / (n1 + n0) + 0.05
    odds = F.log((y1 + a1) / (y0 + a0))
    sigma = F.sqrt(1 / (y1 + a1 + 0.5) + 1 / (y0 + a0 + 0.5))
    listed = counts.where(sure).withColumn("score", odds - sigma * 0.5).where((F.col("score") > 0.5) & (odds - F.lit(float(np.log(n1 / n0))) > 2 * sigma))
    rows = listed.select("feature", "score").orderBy("feature").collect()  # of the bounded sample's features
    return ToxicityModel(np.array([r["feature"] for r in rows], np.int64), np.array([r["score"] for r in rows]))


def fit(docs: DataFrame, labels: DataFrame, max_training_docs: int = 30_000, prior: float = 0.5, min_docs: int = 3) -> ToxicityModel:
    """``docs``: doc_id, text. ``labels``: doc_id, toxic (0 or 1), of training rows only."""
    rows = training_sample(docs, labels, "toxic", max_training_docs).withColumn("fold", F.expr(f"pmod(xxhash64(doc_id, 5), {FOLDS})"))

    def count(iterator):
        for t in batches(iterator):
            words = words_of(t.column("text"), ALNUM, lower=True)
            doc = words.doc_of_word()
            kind = 2 * t.column("fold").to_numpy() + t.column("label").to_numpy()
            for at, h in features_of(words):
                # Each further occurrence in a text says less than the one before.
                order = np.lexsort((doc[at], h))
                h, d = h[order], doc[at][order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, np.int64)
                n = np.rint(UNIT * (1 + np.log2(np.diff(np.append(first, len(h)))))).astype(np.int64)
                h, x = h[first], kind[d[first]]
                keys, of = np.unique(h, return_inverse=True)
                cols = []
                for k in range(FOLDS):
                    for toxic in (1, 0):
                        own = x == 2 * k + toxic
                        cols += [np.bincount(of[own], minlength=len(keys)), np.bincount(of[own], weights=n[own], minlength=len(keys))]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c.astype(np.int64)) for c in cols)], names=["feature", *names])

    names = [f"{c}{toxic}_{k}" for k in range(FOLDS) for toxic in (1, 0) for c in ("d", "y")]
    kinds = {(r["fold"], r["label"]): r["n"] for r in rows.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    total = [sum(n for (_, label), n in kinds.items() if label == x) for x in (0, 1)]
    if not all(total):
        return ToxicityModel(levels=np.array([float(bool(total[1]))]))
    counts = rows.mapInArrow(count, "feature bigint, " + ", ".join(f"{c} bigint" for c in names)).groupBy("feature").agg(*[F.sum(c).alias(c) for c in names])
    counts = written(counts.where(" + ".join(f"d1_{k}" for k in range(FOLDS)) + f" >= {min_docs}"), "features")
    left = lambda x, k: total[x] - kinds.get((k, x), 0)
    folds = [_lexicon(counts, k, left(1, k), left(0, k), prior, min_docs) if left(1, k) and left(0, k) else ToxicityModel() for k in range(FOLDS)]
    model = _lexicon(counts, None, total[1], total[0], prior, min_docs)
    if not len(model.features):
        return ToxicityModel(levels=np.array([total[1] / sum(total)]))

    def by_fold(kept, task):
        def run(iterator):
            for t in batches(iterator):
                fold = t.column("fold").to_numpy()
                for k in range(FOLDS):
                    own = t.filter(pa.array(fold == k))
                    if own.num_rows:
                        yield task(kept.value[k], own)

        return run

    def best(m, t):
        n, score = m.maxima(t.column("text"))
        return pa.RecordBatch.from_arrays([t.column("fold").combine_chunks(), pa.array(n.astype(np.int64)), pa.array(score)], names=["fold", "n", "best"])

    def rate(m, t):
        stats = np.array([m.statistic(x) for x in m.passages(t.column("text"))])
        return pa.RecordBatch.from_arrays([pa.array(np.floor(stats / BIN).astype(np.int64)), pa.array(t.column("label").to_numpy().astype(np.int64))], names=["bin", "toxic"])

    send = docs.sparkSession.sparkContext.broadcast
    # Three numbers a clean row of the bounded sample.
    clean = rows.where("label = 0").mapInArrow(by_fold(send(folds), best), "fold bigint, n bigint, best double").where("n > 0").collect()
    least = [float(m.scores.min()) if len(m.scores) else np.inf for m in folds]
    lam, k = gumbel(np.array([r["n"] for r in clean], float), np.array([r["best"] for r in clean]), np.array([least[r["fold"]] for r in clean]))
    folds, model = [replace(m, lam=lam, k=k) for m in folds], replace(model, lam=lam, k=k)
    # At most 200 / BIN rows come back, whatever the number of texts.
    bins = rows.mapInArrow(by_fold(send(folds), rate), "bin bigint, toxic bigint").groupBy("bin").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits")).orderBy("bin").collect()
    n, hits = np.array([r["n"] for r in bins], float), np.array([r["hits"] for r in bins], float)
    return replace(model, steps=np.array([r["bin"] * BIN for r in bins])[1:], levels=monotone(n + 0.2, hits + 0.1))


SCORED = "doc_id bigint, score double, statistic double, n_passages bigint, best_first bigint, best_last bigint, best_score double, best_e double"


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Each row's ``doc_id`` with its probability and its best passage (word places from 0)."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def rate(iterator):
        m = kept.value
        for t in batches(iterator):
            found = m.passages(t.column("text"))
            stats = np.array([m.statistic(x) for x in found], float)
            best = [x[0] if x else (None, None, None, None) for x in found]
            cols = [t.column("doc_id").combine_chunks(), pa.array(m.probability(stats)), pa.array(stats), pa.array([len(x) for x in found], pa.int64())]
            cols += [pa.array([b[k] for b in best], pa.int64() if k < 2 else pa.float64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCORED.split(", ")])

    return docs.mapInArrow(rate, SCORED)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the best passage, for every row of ``docs``."""
    docs = id_text(docs)
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    rated = score(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return rated.select("doc_id", "held_out", "score", "predicted", "n_passages", "best_first", "best_last", "best_score", "best_e")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``; nothing is shuffled."""
    kept = docs.sparkSession.sparkContext.broadcast(fit(id_text(docs), labels.where(~held_out(F.col("doc_id")))))

    def keep(iterator):
        m = kept.value
        for t in batches(iterator):
            stats = np.array([m.statistic(x) for x in m.passages(t.column("text"))], float)
            yield from t.filter(pa.array(m.probability(stats) < threshold)).to_batches()

    return docs.mapInArrow(keep, docs.schema)
