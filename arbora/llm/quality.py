"""Document quality by hierarchical empirical Bayes over sites.

A binned classifier over shape features of the text gives each document's evidence; its weights are learned from a
bounded sample of labelled rows. Grouped sums over all documents then give each path (source and language) and each
host (source) a posterior share of good documents: hosts are shrunk toward the global share and paths
toward their host, each by a strength that the spread between the groups determines (method of moments), so a
site with few documents stays close to its prior. A document's score joins both: the odds of its evidence times its path's
odds against the global odds, where the document's own evidence is left out of its path and of its host.

Bounds: about ``max_training_docs`` labelled rows at most are learned from; the model is one table of bins.

Defined cases: a null or empty text has the features of the empty text; null source or language is a site of its
own; repeated rows count as rows; without labels of both kinds the evidence is the global share (0.5 without any);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm._spark import batches, strings, table, training_sample, written
from arbora.llm._text import NOT_SPACE, words_of
from arbora.llm.toxicity import monotone

FEATURES = ("log_words", "upper", "signs", "digits", "word_length", "distinct_words", "distinct_lines", "line_words", "top_word")
BINS = 12


def shape(column) -> np.ndarray:
    """(documents, features): shares and lengths that junk, boilerplate and repetition change."""
    texts = strings(column)
    words = words_of(texts, NOT_SPACE)
    n, counts, doc = words.n_docs, words.counts(), words.doc_of_word()
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data, edges = words.data, edges - edges[0]
    size = np.maximum(np.diff(edges), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask))
        return (sums[edges[1:]] - sums[edges[:-1]]) / size

    upper = share((data >= 65) & (data <= 90))
    digits = share((data >= 48) & (data <= 57))
    signs = share((data > 32) & (data < 127) & ~((data >= 48) & (data <= 57)) & ~((data >= 65) & (data <= 90)) & ~((data >= 97) & (data <= 122)))
    lines = np.bincount(np.searchsorted(edges, np.flatnonzero(data == 10), "right") - 1, minlength=n)[:n] + 1
    order = np.lexsort((words.hashes, doc))
    h, d = words.hashes[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
    distinct = np.bincount(d[new], minlength=n)
    at = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, d[at], np.diff(np.append(at, len(h))).astype(float))
    seen = np.array([len(set(t.split("\n"))) for t in texts.to_pylist()], float) if n else np.zeros(0)
    c = np.maximum(counts, 1)
    length = np.bincount(doc, weights=words.ends - words.starts, minlength=n) / c
    return np.stack([np.log1p(counts), upper, signs, digits, length, distinct / c / np.power(c, -0.15), seen / lines, np.log1p(counts / lines), top / c], axis=1)


FOLDS = 3


def _fit(x: np.ndarray, good: np.ndarray) -> dict:
    """Bins and their log-odds; edges are quantiles of all kinds together."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    odds = []
    for k, e in enumerate(edges):
        b = np.searchsorted(e, x[:, k], "right")
        y1, y0 = (np.bincount(b, weights=w, minlength=len(e) + 1) for w in (good, 1 - good))
        share = (y1 + y0 + 1) / (y1 + y0 + 1).sum()
        odds.append(np.log((y1 + 4 * share) / (good.sum() + 4)) - np.log((y0 + 4 * share) / ((1 - good).sum() + 4)))
    return {"edges": edges, "odds": odds}


def train(rows: DataFrame) -> dict:
    """Bins and log-odds from ``text, label`` rows, as few as a sample, and levels from evidence on texts that its bins have not seen (folds by text)."""

    def features(iterator):
        for t in batches(iterator):
            x = shape(t.column("text"))
            fold = [zlib.crc32((v or "").encode()) % FOLDS for v in t.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(t.column("label").to_numpy().astype(np.int64)), pa.array(fold, pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["good", "fold", "x"])

    # A few numbers a row of the bounded sample.
    sample = rows.mapInArrow(features, "good bigint, fold bigint, x array<double>").collect()
    good, fold = np.array([r["good"] for r in sample], float), np.array([r["fold"] for r in sample])
    if not len(good) or good.min() == good.max():
        return {"edges": None, "base": float(good.mean()) if len(good) else 0.5}
    x = np.array([r["x"] for r in sample])
    model = _fit(x, good) | {"base": float(good.mean())}
    total = evidence(model, x)
    for k in range(FOLDS):
        out = fold == k
        # A fold without both kinds outside keeps the evidence of all.
        if out.any() and not out.all() and good[~out].min() < good[~out].max():
            total[out] = evidence(_fit(x[~out], good[~out]), x[out])
    total = np.floor(total * 2)
    keys, at = np.unique(total, return_inverse=True)
    n, hits = np.bincount(at).astype(float), np.bincount(at, weights=good)
    model["steps"], model["levels"] = keys[1:] / 2, monotone(n + 1.0, hits + model["base"])
    return model


def evidence(model: dict, x: np.ndarray) -> np.ndarray:
    return sum(o[np.searchsorted(e, x[:, k], "right")] for k, (e, o) in enumerate(zip(model["edges"], model["odds"])))


def classify(docs: DataFrame, labels: DataFrame, max_training_docs: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """``doc_id, host, path, evidence, host_rate, path_rate, score, keep`` for every row."""
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["source"].cast("string").alias("host"), docs["lang"].cast("string").alias("path"))
    model = train(training_sample(docs.select("doc_id", "text"), labels, "quality", max_training_docs))
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def rate(iterator):
        m = kept.value
        for t in batches(iterator):
            p = np.full(t.num_rows, m["base"])
            if m["edges"] is not None:
                p = m["levels"][np.searchsorted(m["steps"], np.floor(evidence(m, shape(t.column("text"))) * 2) / 2, "right")]
            p = np.round(np.clip(p, 0.001, 0.999), 6)
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("doc_id", "host", "path")), pa.array(p)], names=["doc_id", "host", "path", "evidence"])

    rated = written(docs.mapInArrow(rate, "doc_id bigint, host string, path string, evidence double"), "quality")
    # Sums in millionths are exact whatever the order of the rows.
    paths = rated.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round(F.col("evidence") * 1e6).cast("bigint")).alias("s"))
    paths = paths.withColumn("s", F.col("s") / 1e6)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))

    def strength(rates: DataFrame) -> float:
        """Method of moments: how far the groups' shares spread beyond what sampling alone gives."""
        r = rates.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("g"), F.sum((F.col("s") * F.col("s")) / F.col("n")).alias("q"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
        if not r["n"] or r["g"] < 2:
            return 100.0
        m = r["s"] / r["n"]
        between = r["q"] - r["n"] * m * m - (r["g"] - 1) * m * (1 - m)
        variance = max(between / max(r["n"] - r["nn"] / r["n"], 1e-9), 1e-9)
        return float(np.clip(m * (1 - m) / variance - 1, 1.0, 1e4))

    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    share = float(total["s"] / total["n"]) if total["n"] else 0.5
    a, b = strength(hosts), strength(paths)
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    # Null hosts and paths are groups like others.
    sites = paths.alias("p").join(hosts.alias("h"), F.expr("p.host <=> h.host")).select("p.host", "p.path", "n", "s", "host_n", "host_s")
    joined = rated.alias("r").join(sites.alias("g"), F.expr("r.host <=> g.host and r.path <=> g.path")).select("doc_id", "r.host", "r.path", "evidence", "n", "s", "host_n", "host_s")
    joined = joined.withColumn("host_rate", (F.col("host_s") - F.col("evidence") + a * share) / (F.col("host_n") - 1 + a))
    path_rate = (F.col("s") - F.col("evidence") + b * F.col("host_rate")) / (F.col("n") - 1 + b)
    joined = joined.withColumn("path_rate", F.least(F.greatest(path_rate, F.lit(1e-4)), F.lit(1 - 1e-4)))
    logit = lambda c: F.log(c / (1 - c))
    odds = logit(F.col("evidence")) + logit(F.col("path_rate")) - float(np.log(share / (1 - share)))
    joined = joined.withColumn("score", 1 / (1 + F.exp(-odds)))
    return joined.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("keep"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
