"""A text far larger than a batch goes through every text operator whole."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from arbora.llm import decontamination, jaccard, licenses, packing, quality, substrings, token_files, toxicity
from arbora.llm._spark import shared_dir
from arbora.llm.tokens import default_tokenizer

N = 1_300_000


@pytest.fixture(scope="module")
def long():
    """About 10 MB; the last words are a notice, a benchmark item and a passage of another document."""
    rng = np.random.default_rng(7)
    return " ".join(f"w{i}" for i in rng.integers(0, 900_000, N).tolist())


PASSAGE = " ".join(f"shared{i}" for i in range(30))
ITEM = " ".join(f"item{i}" for i in range(12))
END = f" SPDX-License-Identifier: MIT {ITEM} {PASSAGE}"


@pytest.fixture(scope="module")
def docs(spark, long):
    rows = [(1, f"start {PASSAGE} end"), (2, long + END), (3, long + END + " more"), (4, "short"), (5, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'s' as source", "'en' as lang").repartition(2)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id bigint, quality int, toxic int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_scans_take_the_whole_text(spark, docs, labels, long):
    assert len(long) > 9_000_000
    docs = docs.where("doc_id <> 3").cache()
    found = by_id(licenses.scan_licenses(docs))
    assert found[2]["labels"] == "mit" and found[2]["n_words"] == N + 4 + 12 + 30 and found[4]["labels"] == ""
    hit = by_id(decontamination.decontaminate(docs, spark.createDataFrame([(9, ITEM)], "item_id bigint, text string")))
    assert hit[2]["n_hit"] == 12 and not hit[1]["contaminated"]
    assert set(by_id(quality.classify(docs, labels))) == {1, 2, 4, 5}
    assert all(0 <= r["score"] <= 1 for r in by_id(toxicity.classify(docs, labels)).values())


def test_repeats_and_near_copies_of_the_whole_text(docs):
    cut = by_id(substrings.remove_repeats(docs, target=13, digest=True)[0])
    assert cut[1]["n_removed"] == 0 and cut[2]["n_removed"] == 30 and cut[3]["n_words"] - cut[3]["n_removed"] == 1
    kept = {r["doc_id"] for r in jaccard.keep_one_of_each(docs).collect()}
    assert kept >= {1, 2, 4} and 3 not in kept


def test_tokens_of_the_whole_text(spark, docs, long):
    import tokenizers

    docs = docs.where("doc_id <> 3").cache()
    own = tokenizers.Tokenizer.from_file(default_tokenizer()).encode(long + END, add_special_tokens=False).ids
    pieces = [r for r in packing.with_crc(packing.pack(docs, default_tokenizer())).collect() if r["doc_id"] == 2]
    assert sum(r["length"] for r in pieces) == len(own) + 1 == pieces[0]["doc_tokens"] and len(pieces) > len(own) // 1024
    first = next(r for r in pieces if r["start"] == 0)
    assert first["ids_crc32"] == zlib.crc32(np.array(own[: first["length"]], "<u4").tobytes())
    path = shared_dir(spark, "tokens")
    token_files.write_token_files(token_files.encode_documents(docs, default_tokenizer(), end_id=2), path)
    read = by_id(token_files.read_tokens(spark, path))
    assert list(read[2]["ids"]) == [*own, 2]
