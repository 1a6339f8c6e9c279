"""The training-data operators: edge cases, SQL, brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arbora.llm import decontamination, jaccard, licenses, packing, quality, substrings, token_files, topk, toxicity, warc
from arbora.llm._spark import shared_dir
from arbora.llm.queries import QUERIES, SQL
from arbora.llm.tokens import WordEncoder, default_tokenizer
from tests.compare import connect, rows_of_spark, rows_of_sql

DATA = "/root/testdata/sf0.001"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def words(text):
    return WORD.findall(text or "")


def phrase(rng, n):
    return " ".join("w%d" % rng.randrange(400) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, passages, odd white space."""
    rng = random.Random(11)
    shared, base = phrase(rng, 40), phrase(rng, 60)
    edit = base.split()
    edit[30] = "changed"
    texts = [(1, base), (2, None), (3, ""), (4, "  \n\t "), (5, base), (5, base), (6, " ".join(edit)), (7, phrase(rng, 20) + "\n" + shared + "\t" + phrase(rng, 9)), (8, phrase(rng, 3) + " " + shared.replace(" ", "  ")), (9, "one"), (10, "one two three four"), (None, base), (None, None), (11, phrase(rng, 6000)), (12, "Ünï cödé 漢字 <|endoftext|> it's ²"), (13, base + " " + phrase(rng, 3)), (14, "same same " * 40)]
    return [(i, t, None if i == 9 else "en", None if i == 10 else f"s{(i or 0) % 3}", len(t or "")) for i, t in texts]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names operators use inside."""
    extra = {c: F.lit("x") for c in ("n_words", "score", "label", "root", "block", "bucket", "key", "id", "row", "start", "evidence", "host", "text_key")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(extra).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, None), (3, 0, 1), (None, 0, 1), (6, 1, 0), (7, 0, 1)], "doc_id bigint, quality int, toxic int")


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    names, wanted = rows_of_sql(con, SQL[name])
    got_names, found = rows_of_spark(QUERIES[name](spark, DATA).select(*names))
    assert (got_names, found) == (names, wanted)


# --- 1 -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    long = "<p>" + "".join(rng.choice("abc é漢\r\n") for _ in range(60000)) + "WARC/1.1\r\nContent-Length: 5\r\n\r\n</p>"
    same = "<html>" + "x" * 120 + "</html>"
    data = [(5, "u5", same), (2, "u2\r\nX: y", same), (9, None, same), (1, "u", ""), (3, "u", None), (4, "u", "short"), (6, "u", "short"), (7, "u", long), (8, "u", long + "!"), (None, "u", same), (2, "u2", same), (None, None, None)]
    return spark.createDataFrame(data, "page_id bigint, url string, html string").withColumns({"digest": F.lit(1), "n": F.lit(2)}), data


def test_warc_round_trip(spark, pages):
    df, data = pages
    path = shared_dir(spark, "warc-test")
    warc.write_archive(df, path, segment_bytes=1000, chunk_bytes=300, records_per_file=7)
    found = warc.decode_payloads(warc.reassemble(warc.read_records(spark, path)), keep_payload=True).collect()
    assert all(r["problem"] is None for r in found)
    want = []
    for page, _, html in data:
        payload = (html or "").encode()
        first = min((p for p, _, h in data if h == html and p is not None), default=None) if len(payload) >= 100 else page
        revisit = first != page
        want.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None if revisit else payload))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert max(r["n_segments"] for r in found) > 50


def test_warc_faults_are_named(spark, pages):
    df, _ = pages
    path = shared_dir(spark, "warc-test")
    warc.write_archive(df.where("page_id in (7, 8)"), path, segment_bytes=50_000)
    records = warc.read_records(spark, path).cache()
    cut = records.where("segment is null or segment <> 2")
    assert {r["problem"] for r in warc.decode_payloads(warc.reassemble(cut)).collect()} <= {"segments are missing or repeated", "the total length does not hold"}
    headless = records.where("record_type = 'continuation'")
    assert {r["problem"] for r in warc.decode_payloads(warc.reassemble(headless)).collect()} == {"continuation records without their first one"}


def test_warc_damaged_files(spark, pages, tmp_path):
    """Every fault comes back with its name, and sound records around it are read."""
    import gzip

    record = lambda n, length=3, body=b"abc", more="": f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <r{n}>\r\n{more}Content-Length: {length}\r\n\r\n".encode() + body + b"\r\n\r\n"
    odd = b"junk\r\n" + record(1) + record(2).replace(b"Content-Length: 3\r\n", b"") + record(3) + record(4, "x") + record(5, more="X-Page-Id: seven\r\n") + record(6, 2) + record(7, more="WARC-Segment-Number: -4\r\n") + record(8)
    (tmp_path / "odd.warc").write_bytes(odd + record(9, 50))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(record(10))[:-6])
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(record(11)) + b"\x1f\x8b\x08\x00garbage garbage garbage")
    (tmp_path / "none.warc").write_bytes(b"")
    read = warc.read_records(spark, f"{tmp_path}/*.warc*")
    rows = {(r["record_id"], r["problem"]) for r in read.collect()}
    assert {i for i, p in rows if p is None} >= {"<r1>", "<r3>", "<r8>", "<r11>"}
    faults = " ".join(p for _, p in rows if p)
    for said in ("no WARC record at byte 0", "no length", "is no number", "does not hold", "out of range", "ends within", "cut short", "damaged"):
        assert said in faults, said
    found = warc.decode_payloads(warc.reassemble(read)).collect()
    assert sum(r["problem"] is None for r in found) >= 4 and {r["problem"] for r in found} >= {p for _, p in rows}


def test_warc_revisits_name_records(spark, pages, tmp_path):
    """WARC-Refers-To is the id of a response in the archive, of the page that the revisit refers to; no id stands twice."""
    df, _ = pages
    path = shared_dir(spark, "warc-test")
    warc.write_archive(df, path)
    import glob
    import gzip

    found = [h for f in glob.glob(path.removeprefix("file://") + "/*.gz") for h, _, fault in warc.parse_records(gzip.open(f).read())]
    ids = {h["warc-record-id"]: h for h in found}
    assert len(ids) == len(found)
    revisits = [h for h in found if h["warc-type"] == "revisit"]
    assert len(revisits) > 2
    for h in revisits:
        first = ids[h["warc-refers-to"]]
        assert first["warc-type"] == "response" and first["x-page-id"] == h["x-refers-to-page"] and first["warc-payload-digest"] == h["warc-payload-digest"]


def test_warc_empty(spark, pages):
    df, _ = pages
    path = shared_dir(spark, "warc-test")
    warc.write_archive(df.limit(0), path)
    assert warc.decode_payloads(warc.reassemble(warc.read_records(spark, path))).count() == 0


def test_chunks():
    for size in (1, 3, 100):
        assert warc.dechunked(warc.chunked(b"hello world", size)) == b"hello world"
    assert warc.dechunked(b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    for broken in (b"5\r\nhel", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            warc.dechunked(broken)


# --- 2 -------------------------------------------------------------------------------------------------------------


def test_quality_edges(spark, docs, empty, labels, rows):
    found = quality.classify(docs, labels).collect()
    assert len(found) == len(rows) and all(0 < r["score"] < 1 and r["keep"] == (r["score"] >= 0.5) for r in found)
    assert quality.classify(empty, labels).count() == 0
    base = quality.classify(docs, labels.limit(0)).collect()
    assert all(abs(r["evidence"] - 0.5) < 1e-9 for r in base)


def test_quality_shrinks_sparse_sites(spark):
    good = [(i, f"calm words make a plain sentence number {i} here", "en", "big", 0) for i in range(60)]
    bad = [(100 + i, "BUY!!! NOW!!! $$$ " * 6, "en", "bad", 0) for i in range(60)]
    lone = [(300, "BUY!!! NOW!!! $$$ " * 6, "en", "lone", 0)]
    df = spark.createDataFrame(good + bad + lone, SCHEMA)
    marks = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    rate = {r["host"]: r["path_rate"] for r in quality.classify(df, marks).collect()}
    assert rate["bad"] < rate["lone"] < rate["big"]


def test_quality_posteriors_brute_force(spark, docs, labels):
    """Posteriors and scores of every row from its evidence, in plain Python; hosts and paths of one row and of null among them."""
    found = quality.classify(docs, labels).collect() + quality.op2_quality(spark, DATA).collect()
    for part in (found[: docs.count()], found[docs.count() :]):
        ev = [(r["host"], r["path"], r["evidence"]) for r in part]
        share = sum(e for *_, e in ev) / len(ev)

        def sums(key):
            out = {}
            for h, p, e in ev:
                n, s = out.get(key(h, p), (0, 0.0))
                out[key(h, p)] = (n + 1, s + e)
            return out

        def strength(groups):
            n, s = sum(n for n, _ in groups), sum(s for _, s in groups)
            if not n or len(groups) < 2:
                return 100.0
            m = s / n
            between = sum(s * s / n for n, s in groups) - n * m * m - (len(groups) - 1) * m * (1 - m)
            variance = max(between / max(n - sum(k * k for k, _ in groups) / n, 1e-9), 1e-9)
            return min(max(m * (1 - m) / variance - 1, 1.0), 1e4)

        hosts, paths = sums(lambda h, p: h), sums(lambda h, p: (h, p))
        a, b = strength(list(hosts.values())), strength(list(paths.values()))
        odds = lambda x: np.log(x / (1 - x))
        for r in part:
            e, (hn, hs), (pn, ps) = r["evidence"], hosts[r["host"]], paths[r["host"], r["path"]]
            host = (hs - e + a * share) / (hn - 1 + a)
            path = min(max((ps - e + b * host) / (pn - 1 + b), 1e-4), 1 - 1e-4)
            score = 1 / (1 + np.exp(-(odds(e) + odds(path) - odds(share))))
            assert (r["host_rate"], r["path_rate"], r["score"]) == pytest.approx((host, path, score), abs=1e-5)
            assert r["keep"] == (r["score"] >= 0.5)


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = marks.where("doc_id % 3 <> 1")
    judged = quality.classify(docs, train).join(marks.where("doc_id % 3 = 1"), "doc_id")
    good, keep, both = judged.selectExpr("count_if(quality = 1)", "count_if(quality = 1 and keep)", "avg(cast((quality = 1) = keep as int))").first()
    assert keep / good > 0.9 and both > 0.85


# --- 3 -------------------------------------------------------------------------------------------------------------


def brute_repeats(data, n):
    first = {}
    for i, t in data:
        w = words(t)
        for p in range(len(w) - n + 1):
            g = tuple(w[p : p + n])
            k = i if i is not None else float("inf")
            first[g] = min(first.get(g, k), k)
    out = []
    for i, t in data:
        w = words(t)
        gone = set()
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < (i if i is not None else float("inf")):
                gone |= set(range(p, p + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [200, 4 << 20])
@pytest.mark.parametrize("target", [2, 5, 13])
def test_substrings_brute_force(spark, docs, rows, target, block):
    cleaned, _ = substrings.remove_repeats(docs, target=target, digest=True, block_bytes=block)
    assert tuples(cleaned, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats([r[:2] for r in rows], target)


def test_substrings_levels_go_on(spark, docs, rows, empty):
    cleaned, longer = substrings.remove_repeats(docs, target=5)
    assert cleaned.count() == len(rows)
    texts = {r["doc_id"]: r["text"] for r in cleaned.select("doc_id", "text").collect()}
    assert texts[1] == rows[0][1] and texts[5] == "" and texts[2] is None
    lengths = dict(tuples(longer, "doc_id", "longest"))
    assert cleaned.columns == docs.columns and {r[0] for r in cleaned.select("n_words").collect()} == {"x"}
    # Levels 10, 20, 40: 60 equal words hold a repeat of 40, a passage of 40 words one of 40, its 30-word halves one of 20.
    assert lengths[1] == 40 and lengths[7] == 40 and lengths[8] == 40 and 11 not in lengths
    assert substrings.remove_repeats(empty, digest=True)[0].count() == 0


def test_substrings_longest(spark, docs, rows):
    """The largest of 13, 26, 52 ... words of which a window stands in two documents, whatever their ids."""
    _, longer = substrings.remove_repeats(docs, target=13, block_bytes=300)
    want = {}
    for k in (13, 26, 52, 104, 208):
        seen = {}
        for n, (_, t, *_) in enumerate(rows):
            for p in range(len(words(t)) - k + 1):
                seen.setdefault(tuple(words(t)[p : p + k]), set()).add(n)
        for held in seen.values():
            if len(held) > 1:
                want |= {rows[n][0]: k for n in held if rows[n][0] is not None}
    assert dict(tuples(longer, "doc_id", "longest")) == want and 52 in want.values()


# --- 4 -------------------------------------------------------------------------------------------------------------


def test_licenses_brute_force(spark, docs, rows, empty):
    mit = dict((n, t) for n, t, _ in licenses.TEMPLATES)["mit"]
    extra = [(50, "x y. Licensed under CC-BY 4.0; all RIGHTS reserved. All rights. reserved"), (51, "z " * 30 + mit), (52, "This work is licensed under the GNU General Public License, version 3."), (53, "general public license, version 2 and all rights reserved CC by CC BY"), (54, "under the license version"), (55, "cc by")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    found = licenses.scan_licenses(df).collect()
    data = [r[:2] for r in rows] + extra
    want = []
    for i, t in data:
        w, starts, names = alnum(t), [], set()
        for p, name in licenses.BASE.items():
            p = p.split()
            for k in range(len(w)):
                if w[k : k + len(p)] == p:
                    starts.append(k)
                    names.add(name)
        want.append((i, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(names))))
    assert sorted((tuple(r[:6]) for r in found), key=str) == sorted(want, key=str)
    by = {r["doc_id"]: r for r in found}
    assert by[51]["labels"] == "mit" and by[51]["score"] == 1.0 and by[52]["labels"] == "gpl,gpl-3.0"
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in found)
    assert licenses.scan_licenses(empty).count() == 0


def test_licenses_several_notices(spark):
    """Labels and scores against every alignment of every template, in files of many notices and scattered licence words."""
    rng = random.Random(4)
    notices = [text for _, text, _ in licenses.TEMPLATES]
    scattered = sorted({w for text in notices for w in alnum(text)})
    by = {n: t for n, t, _ in licenses.TEMPLATES}
    data = [(1, " x ".join(t for n, t, _ in licenses.TEMPLATES if n in ("mit", "bsd", "mpl-2.0") or t.startswith("Licensed under the Apache"))), (2, " x ".join(["Licensed under the Apache License, Version 2.0", by["cc-by-nc-4.0"], by["gpl-2.0"], by["mit"]])), (3, " ".join(notices)), (4, " ".join(rng.choices(scattered, k=3000)) + " " + by["mit"] + " " + " ".join(rng.choices(scattered, k=3000))), (5, "MIT")]
    for i in range(6, 60):
        parts = [phrase(rng, 5)] + [rng.choice(notices) for _ in range(rng.randrange(7))] + [" ".join(rng.choices(scattered, k=rng.randrange(60))) for _ in range(2)]
        rng.shuffle(parts)
        w = " y ".join(parts).split()
        data.append((i, " ".join("z" if rng.random() < 0.03 else x for x in w)))
    data += [(100 + i, phrase(rng, 30) + " the of license") for i in range(60)]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    n = {w: sum(w in set(alnum(t)) for _, t in data) for w in scattered}
    idf = {w: np.log((len(data) + 1) / (n[w] + 0.5)) + 1e-6 for w in scattered}
    for i, t in data:
        w, scores = alnum(t), {}
        for label, text, phrases in licenses.TEMPLATES:
            own = alnum(text)
            for shift in range(-len(own) + 1, len(w)):
                same = sum(idf[x] for q, x in enumerate(own) if 0 <= shift + q < len(w) and w[shift + q] == x)
                share = same / sum(idf[x] for x in own)
                region = " ".join(["", *w[max(shift, 0) : shift + len(own) + 8], ""])
                if share >= 0.8 and all(" " + " ".join(alnum(p)) + " " in region for p in phrases):
                    scores[label] = max(scores.get(label, 0), share)
        base = set(filter(None, found[i]["base_labels"].split(",")))
        assert found[i]["labels"] == ",".join(sorted(base | set(scores))), i
        assert found[i]["score"] == pytest.approx(min(1.0, max([0.5 if base else 0.0, *scores.values()]))), i
    assert {"apache-2.0", "mit", "bsd", "mpl-2.0"} <= set(found[1]["labels"].split(","))
    assert {"apache-2.0", "mit", "cc-by-nc-4.0", "gpl-2.0"} <= set(found[2]["labels"].split(","))


# --- 5 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("spread", [2, 64])
def test_topk_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "PACKET", 7)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    data = [(i, (centre + rng.normal(size=64) * spread / 8).astype(float).tolist()) for i in range(300)]
    data += [(1000 + i, data[7][1]) for i in range(40)] + [(2000, None), (None, data[3][1]), (2020, [None] * 64)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumn("code", F.lit(0))
    codes = topk.sign_codes(df)
    got = tuples(topk.search(codes, codes.where("vec_id % 20 = 0"), k=5), "vec_id", "rank", "neighbor_id", "distance")
    bits = [(i, [(v or 0) > 0 for v in e]) for i, e in data if e is not None and i is not None]
    want = []
    for i, a in bits:
        if i % 20 == 0:
            near = sorted((sum(x != y for x, y in zip(a, b)), j) for j, b in bits if j != i)[:5]
            want += [(i, k, j, d) for k, (d, j) in enumerate(near, 1)]
    assert got == sorted(want, key=str)


def test_topk_small_tables(spark):
    one = spark.createDataFrame([(0, [1.0] * 64)], "vec_id bigint, embedding array<double>")
    for df in (one, one.limit(0)):
        codes = topk.sign_codes(df)
        assert topk.search(codes, codes).count() == 0


@pytest.mark.parametrize("width", [5, 128, 200])
def test_topk_other_widths(spark, width):
    rng = np.random.default_rng(width)
    data = [(i, rng.normal(size=width).tolist()) for i in range(80)]
    codes = topk.sign_codes(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"))
    bits = [(i, np.array(e) > 0) for i, e in data]
    want = []
    for i, a in bits[::20]:
        want += [(i, n, j, d) for n, (d, j) in enumerate(sorted((int((a != b).sum()), j) for j, b in bits if j != i)[:5], 1)]
    assert tuples(topk.search(codes, codes.where("vec_id % 20 = 0"), k=5), "vec_id", "rank", "neighbor_id", "distance") == sorted(want, key=str)
    mixed = spark.createDataFrame([*data, (99, [1.0] * (width + 1))], "vec_id bigint, embedding array<double>")
    with pytest.raises(ValueError, match="one number of dimensions"):
        topk.search(topk.sign_codes(mixed), codes)


def test_topk_repeated_ids(spark, tmp_path):
    """Rows repeated under one id, of queries and others, with equal and with other vectors: the rows of the SQL."""
    rng = np.random.default_rng(6)
    data = [(i, rng.normal(size=64).tolist()) for i in range(1, 61)]
    data += [data[19]] + [data[39]] * 11 + [data[2]] * 3 + [data[4]] * 25 + [(60, data[9][1])] * 4 + [(7, data[19][1])] * 2
    data += [(200 + i, data[39][1]) for i in range(3)] + [(300, data[59][1])] * 14 + [(400, data[0][1])] * 12
    spark.createDataFrame(data, "vec_id bigint, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = connect(tmp_path)
    con.sql(f"create or replace view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    names, want = rows_of_sql(con, topk.OP5_SQL)
    assert {r[names.index("vec_id")] for r in want} == {20, 40, 60, 200, 300, 400} and sum(want.values()) == 60
    assert rows_of_spark(topk.op5_topk_search(spark, str(tmp_path))) == (names, want)


# --- 6 -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def items(spark, rows):
    base = rows[0][1].split()
    data = [(1, " ".join(base[5:25]).upper()), (2, " ".join(base[0:9])), (10, " ".join(base[20:40])), (10, " ".join(base[20:40])), (3, "one"), (4, None), (5, "!!"), (None, " ".join(base[45:58])), (6, "never seen words in here at all by any means so"), (7, "two three")]
    return spark.createDataFrame(data, "item_id bigint, text string").withColumn("doc_id", F.lit(1)), data


def brute_hits(docs, items, n):
    out = []
    for i, t in docs:
        w, hit, ids = alnum(t), set(), set()
        for item, text in items:
            v = alnum(text)
            m = min(n, len(v))
            for q in range(len(v) - m + 1) if m else ():
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == v[q : q + m]:
                        hit |= set(range(p, p + m))
                        ids.add(item)
        found = sorted(ids - {None}, key=str)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_decontamination_brute_force(spark, docs, rows, items, most):
    df, data = items
    found = decontamination.decontaminate(docs, df, max_broadcast_bytes=most)
    got = tuples(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute_hits([r[:2] for r in rows], data, 10)
    clean = decontamination.reject_contaminated(docs, df, max_broadcast_bytes=most)
    assert clean.columns == docs.columns
    want = [r[:2] for r in rows if not brute_hits([r[:2]], data, 10)[0][5]]
    assert tuples(clean, "doc_id", "text") == sorted(want, key=str)


def test_decontamination_paths_agree(spark, docs, items):
    """The broadcast and the shuffled path, with their spans; many documents and items around one common phrase."""
    rng = random.Random(8)
    common = phrase(rng, 12)
    texts = [(i, f"{phrase(rng, 4)} {common} {phrase(rng, rng.randrange(9))} {common if i % 3 else ''}") for i in range(60)]
    bench = [(100 + i, f"{phrase(rng, i % 4)} {common} {phrase(rng, i % 5)}") for i in range(20)] + [(200, " ".join(common.split()[2:7])), (None, " ".join(common.split()[:3]))]
    made = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")
    for d, b in ((docs, items[0]), made):
        by = [tuples(decontamination.decontaminate(d, b, max_broadcast_bytes=most), "doc_id", "n_words", "n_hit", "items_sha256", "item_ids", "spans") for most in (1 << 20, 0)]
        assert by[0] == by[1]
    assert tuples(decontamination.decontaminate(*made, max_broadcast_bytes=0), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_hits(texts, bench, 10)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_decontamination_keeps_columns(spark, docs, items, most):
    """Columns of the names that the operator uses inside pass unchanged; a null id is judged by its own text."""
    df = docs.withColumns({c: F.lit("own") for c in ("_text", "c0", "c1", "text_key", "keys")}).drop("doc_id")
    clean = decontamination.reject_contaminated(df, items[0], max_broadcast_bytes=most)
    assert clean.columns == df.columns
    assert {tuple(r) for r in clean.select("_text", "c0", "c1", "text_key", "keys").collect()} == {("own",) * 5}
    assert clean.count() == decontamination.decontaminate(docs, items[0]).where("not contaminated").count()


def test_decontamination_empty(docs, empty, items):
    assert decontamination.decontaminate(empty, items[0]).count() == 0
    assert decontamination.decontaminate(docs, items[0].limit(0)).where("contaminated").count() == 0


# --- 7, 8 ----------------------------------------------------------------------------------------------------------


def encoded(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    return [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows]


def test_encoder_is_exact():
    rng = random.Random(3)
    signs = ["a", "B", "é", "1", "23", " ", "  ", "\n", "\t", ".", "!?", "'", "'s", "—", "²", "<|endoftext|>", "\0", "漢"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(600)] + [None, ""]
    encoder = WordEncoder(default_tokenizer())
    for part in (texts, texts[::-1]):
        ids, offsets = encoder.encode(pa.array(part))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [x for _, x in encoded([(0, t) for t in part])]


def test_packing_round_trip(spark, docs, rows, empty):
    pieces = packing.pack(docs, default_tokenizer(), length=64).collect()
    want = sorted((i, x + [0]) for i, x in encoded([r[:2] for r in rows if r[0] is not None]))
    by, stream = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"]
        stream.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        by.setdefault(p["doc_id"], []).append((p["start"], p["doc_tokens"], ids))
    for k, spans in stream.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert spans[-1][0] + spans[-1][1] == 64 or k == max(stream)
    assert sum(p["length"] for p in pieces) == sum(len(x) + 1 for _, x in encoded([r[:2] for r in rows]))
    for i, ids in dict(want).items():
        parts = sorted(by[i])
        joined = [x for _, _, part in parts for x in part]
        assert joined == ids * (2 if i == 5 else 1) or i == 5
    # Rows that repeat an id, and those without one, are packed as rows of their own.
    for i in (5, None):
        rows_of = [x + [0] for j, x in encoded([r[:2] for r in rows]) if j == i]
        starts = [p for p in by[i] if p[0] == 0]
        assert len(starts) == len(rows_of) and sum(len(x) for *_, x in by[i]) == sum(map(len, rows_of))
    # The stream follows the curve, and pieces come in its order but for where a range's file begins.
    stream = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    keys = [p["hilbert_key"] for p in stream]
    assert keys == sorted(keys)
    assert sum((a["sequence_id"] * 64 + a["offset"] + a["length"]) != b["sequence_id"] * 64 + b["offset"] for a, b in zip(pieces, pieces[1:])) < 4
    own = {i: int(packing.hilbert_key(packing.document_points(pa.array([t])), packing.BITS)[0]) for i, t, *_ in rows if i is not None}
    assert all(p["hilbert_key"] == own[p["doc_id"]] for p in pieces if p["doc_id"] is not None)
    assert packing.pack(empty, default_tokenizer()).count() == 0


def test_hilbert_neighbours():
    grid = np.array([(x, y) for x in range(8) for y in range(8)])
    key = packing.hilbert_key(grid, 3)
    assert sorted(key) == list(range(64))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, rows, encoding):
    path = shared_dir(spark, "tokens-test")
    token_files.write_token_files(token_files.encode_documents(docs, default_tokenizer(), 2), path, encoding)
    ids = [(i, x + [2]) for i, x in encoded([r[:2] for r in rows])]
    found = token_files.checked_index(spark, path).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found), key=str) == sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids), key=str)
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert order == sorted(order)
    some = token_files.read_tokens(spark, path, 7, 9).collect()
    assert sorted(r["doc_id"] for r in some) == [7, 8, 9] and {r["doc_id"]: r["ids"] for r in some}[9] == dict(ids)[9]
    assert token_files.read_metadata(spark, path).count() == len(rows)


def test_token_files_repeated_ids(spark, empty):
    """``start`` says where a row's ids stand in the files read one after the other, also among rows of one id."""
    import glob

    import pyarrow.parquet as pq

    rng = random.Random(6)
    data = [(5, phrase(rng, 50)), (5, "short"), (5, phrase(rng, 9)), (None, phrase(rng, 20)), (None, "a"), (4, "b"), (5, "short"), (6, None)] + [(7, phrase(rng, k % 13)) for k in range(40)]
    path = shared_dir(spark, "tokens-test")
    token_files.write_token_files(token_files.encode_documents(spark.createDataFrame(data, "doc_id bigint, text string").repartition(3), default_tokenizer(), 2), path)
    stored = [r for f in sorted(glob.glob(path.removeprefix("file://") + "/*.parquet")) for r in pq.read_table(f).to_pylist()]
    stream = [i for r in stored for i in r["ids"]]
    found = token_files.checked_index(spark, path).collect()
    assert len(found) == len(data)
    for r in found:
        part = stream[r["start"] : r["start"] + r["n_tokens"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    assert [r["doc_id"] for r in stored] == sorted((i for i, _ in data), key=lambda i: (i is not None, i))
    path = shared_dir(spark, "tokens-test")
    token_files.write_token_files(token_files.encode_documents(empty, default_tokenizer(), 2), path)
    assert token_files.checked_index(spark, path).count() == 0


def test_token_files_have_page_indexes(spark, docs):
    import glob

    import pyarrow.parquet as pq

    path = shared_dir(spark, "tokens-test")
    token_files.write_token_files(token_files.encode_documents(docs, default_tokenizer(), 2), path)
    column = pq.ParquetFile(glob.glob(path.removeprefix("file://") + "/*.parquet")[0]).metadata.row_group(0).column(2)
    assert column.has_offset_index and any("DICTIONARY" in e for e in column.encodings)


# --- 9 -------------------------------------------------------------------------------------------------------------


def brute_segments(scores):
    """All maximal scoring segments by their recursive definition."""
    best = None
    for a in range(len(scores)):
        total = 0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                best = (a, b, total)
    if best is None:
        return []
    a, b, total = best
    left, right = brute_segments(scores[:a]), brute_segments(scores[b + 1 :])
    return [*left, (a, b, total), *[(x + b + 1, y + b + 1, s) for x, y, s in right]]


def test_maximal_segments():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randrange(1, 14)
        scores = [rng.choice([-1.0, -1.0, 0.7, 1.9, 3.1]) for _ in range(n)]
        places = [k for k, s in enumerate(scores) if s > 0]
        got = toxicity.max_segments(places, [scores[k] for k in places], n, -1.0)
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores)]


def brute_toxic(data, marks, fold_of):
    """Scores of every text in plain Python: lexicons of strings, segments by their definition, Gumbel fit, pooled rates."""
    import math
    from collections import Counter, defaultdict

    def features(t):
        out = []
        for w in alnum(t):
            b = w.encode()
            out.append([("w", b)] + [(k, b[:k]) for k in toxicity.PREFIXES if len(b) > k])
        return out

    train = [(fold_of[i], marks[i], t) for i, t in data if i in marks]
    total = Counter(y for _, y, _ in train)

    def lexicon(rows):
        n = Counter(y for _, y, _ in rows)
        d, y = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        for _, toxic, t in rows:
            for f, c in Counter(f for fs in features(t) for f in fs).items():
                d[f][toxic] += 1
                y[f][toxic] += round(toxicity.UNIT * (1 + math.log2(c)))
        d = {f: c for f, c in d.items() if c[1] >= 3}
        p, out = n[1] / (n[1] + n[0]), {}
        for f, (d0, d1) in d.items():
            q = d1 / (d1 + d0)
            part = lambda a, b: a * math.log(a / b) if a > 0 else 0.0
            if q <= p or (d1 + d0) * (part(q, p) + part(1 - q, 1 - p)) <= math.log(max(len(d), 1)):
                continue
            y1, y0 = y[f][1] / toxicity.UNIT, y[f][0] / toxicity.UNIT
            share = (y1 + y0) / (n[1] + n[0])
            a1, a0 = 0.5 * share * n[1] / (n[1] + n[0]) + 0.05, 0.5 * share * n[0] / (n[1] + n[0]) + 0.05
            odds = math.log((y1 + a1) / (y0 + a0))
            sigma = math.sqrt(1 / (y1 + a1 + 0.5) + 1 / (y0 + a0 + 0.5))
            if odds - sigma * 0.5 > 0.5 and odds - math.log(n[1] / n[0]) > 2 * sigma:
                out[f] = odds - sigma * 0.5
        return out

    def segments(t, lex):
        scores = [max((lex.get(f, 0.0) for f in fs), default=0.0) or -0.05 for fs in features(t)]
        places = [k for k, s in enumerate(scores) if s > 0]
        return len(scores), [s for *_, s in toxicity.max_segments(places, [scores[k] for k in places], len(scores), -0.05)]

    by_fold = [lexicon([r for r in train if r[0] != k]) for k in range(toxicity.FOLDS)]
    maxima = [(*segments(t, by_fold[k]), k) for k, y, t in train if y == 0]
    maxima = [(n, max(s, default=0.0), min(by_fold[k].values(), default=math.inf)) for n, s, k in maxima if n]
    lam, k_ = toxicity.gumbel(*(np.array(x, float) for x in zip(*maxima)))

    def statistic(t, lex):
        n, s = segments(t, lex)
        e = [k_ * n * math.exp(-min(lam * x, 700)) for x in s]
        return min(sum(-math.log(max(x, 1e-300)) for x in e if x <= 0.5), 200.0)

    bins = defaultdict(lambda: [0, 0])
    for k, y, t in train:
        b = bins[math.floor(statistic(t, by_fold[k]) / toxicity.BIN)]
        b[0] += 1
        b[1] += y
    keys = sorted(bins)
    # Pool adjacent violators by its max-min form.
    n, hits = [bins[b][0] + 0.2 for b in keys], [bins[b][1] + 0.1 for b in keys]
    rates = [max(min(sum(hits[a : b + 1]) / sum(n[a : b + 1]) for b in range(j, len(keys))) for a in range(j + 1)) for j in range(len(keys))]
    final = lexicon(train)
    scored = {}
    for i, t in data:
        at = sum(b * toxicity.BIN <= statistic(t, final) for b in keys[1:])
        scored[i] = rates[at] if final and all(total[x] for x in (0, 1)) else total[1] / max(sum(total.values()), 1)
    return scored, lam, k_


def test_toxicity_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    known = {r["doc_id"]: r["toxic"] for r in marks.collect() if r["toxic"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    fold = {r[0]: r[1] for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id, 5), {toxicity.FOLDS})").collect()}
    want, lam, k = brute_toxic(data, known, fold)
    got = {r["doc_id"]: r["score"] for r in toxicity.op9_toxicity(spark, d).collect()}
    assert got.keys() == want.keys() and len(set(want.values())) > 1
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_gumbel_is_recovered():
    rng = np.random.default_rng(2)
    n = rng.integers(50, 3000, 4000).astype(float)
    best = (np.log(0.02 * n) - np.log(-np.log(rng.random(4000)))) / 1.3
    least = np.full(4000, 2.0)
    lam, k = toxicity.gumbel(n, np.where(best < least, 0.0, best), least)
    assert abs(lam - 1.3) < 0.08 and 0.5 < k / 0.02 < 2


def test_toxicity_edges(spark, docs, rows, empty, labels):
    for marks in (labels, labels.limit(0), labels.where("toxic = 1")):
        found = toxicity.classify(docs, marks).collect()
        assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert toxicity.classify(empty, labels).count() == 0
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    judged = toxicity.classify(docs, marks).join(marks, "doc_id").where("held_out")
    hit, toxic, wrong, clean = judged.selectExpr("count_if(toxic = 1 and predicted = 1)", "count_if(toxic = 1)", "count_if(toxic = 0 and predicted = 1)", "count_if(toxic = 0)").first()
    assert hit / toxic > 0.9 and wrong / clean < 0.01


# --- 10 ------------------------------------------------------------------------------------------------------------


def brute_classes(data):
    def sets(t):
        w = words(t)
        return {tuple(w[p : p + min(5, len(w))]) for p in range(max(len(w) - 4, 1))} if w else set()

    known = [(i, sets(t)) for i, t in data if i is not None]
    n = len(known)
    linked = [[j for j in range(n) if j != k and known[k][1] and 5 * len(known[k][1] & known[j][1]) >= 4 * len(known[k][1] | known[j][1])] for k in range(n)]
    out = [(None, None, 0) for i, _ in data if i is None]
    for k in range(n):
        seen, stack = set(), [k]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += linked[x]
        out.append((known[k][0], min(known[x][0] for x in seen), len(linked[k])))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2, 384])
def test_jaccard_brute_force(spark, docs, rows, block):
    found = jaccard.jaccard_classes(docs, block_entries=block)
    assert tuples(found, "doc_id", "class_id", "n_links") == brute_classes([r[:2] for r in rows])


def test_jaccard_dense_group(spark):
    """Several hundred texts that differ from each other, all of one group, in one block and in several."""
    rng = random.Random(1)
    base = phrase(rng, 80).split()
    data = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(80)] = "e%d" % rng.randrange(1000)
        data.append((i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    want = brute_classes(data)
    for block in (40, 384):
        assert tuples(jaccard.jaccard_classes(df, block_entries=block), "doc_id", "class_id", "n_links") == want


@pytest.mark.parametrize("block", [2, 384])
def test_jaccard_texts_under_one_id(spark, block):
    """One id with two texts that differ, each the smallest of a class; with two that are near; and with copies besides."""
    rng = random.Random(3)
    near = lambda t, k: t + " " + phrase(rng, k)
    a, b, c, d = (phrase(rng, 60) for _ in range(4))
    data = [(1, a), (1, b), (2, near(a, 2)), (3, near(b, 3)), (4, b), (1, b), (5, c), (5, near(c, 2)), (6, c), (7, d), (7, near(a, 3)), (8, near(d, 1)), (9, phrase(rng, 30))]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    assert tuples(jaccard.jaccard_classes(df, block_entries=block), "doc_id", "class_id", "n_links") == brute_classes(data)


def brute_kept(data):
    """One of each class: the smallest id, of its texts any one; null ids all."""
    classes = {}
    known = [(i, t) for i, t in data if i is not None]
    def sets(t):
        w = words(t)
        return {tuple(w[p : p + min(5, len(w))]) for p in range(max(len(w) - 4, 1))} if w else set()
    linked = lambda a, b: a and b and 5 * len(a & b) >= 4 * len(a | b)
    left = list(range(len(known)))
    groups = []
    while left:
        group, stack = set(), [left[0]]
        while stack:
            x = stack.pop()
            if x not in group:
                group.add(x)
                stack += [y for y in left if linked(sets(known[x][1]), sets(known[y][1])) or known[x] == known[y]]
        groups.append({known[x] for x in group})
        left = [x for x in left if x not in group]
    return groups, [t for i, t in data if i is None]


def test_keep_one_of_each(spark, docs, rows):
    """Each class keeps one row of its smallest id, whatever else that id or its other rows hold; no text of its own is lost."""
    rng = random.Random(13)
    a, b, c = (phrase(rng, 60) for _ in range(3))
    data = [r[:2] for r in rows] + [(30, a), (50, a), (50, b), (51, b), (51, a + " x"), (60, c), (60, c + " y"), (60, c), (61, c), (None, a), (None, None), (None, a), (2, None), (70, None)]
    df = spark.createDataFrame([(*d, f"v{k}", k) for k, d in enumerate(data)], "doc_id bigint, text string, _n string, c0 int").withColumn("id", F.lit(7)).withColumn("key", F.lit("k"))
    kept = jaccard.keep_one_of_each(df)
    assert kept.columns == df.columns
    got = kept.collect()
    groups, free = brute_kept(data)
    assert sorted((r["text"] for r in got if r["doc_id"] is None), key=str) == sorted(free, key=str)
    left = [(r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None]
    assert len(left) == len(groups)
    for g in groups:
        assert len(own := [x for x in left if x in g]) == 1 and own[0][0] == min(i for i, _ in g)
    assert all(r["key"] == "k" and r["id"] == 7 and data[r["c0"]] == (r["doc_id"], r["text"]) and r["_n"] == f"v{r['c0']}" for r in got)
    assert sorted(map(tuple, jaccard.keep_one_of_each(df.repartition(5)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert jaccard.keep_one_of_each(df.limit(0)).count() == 0


def test_jaccard_long_chain(spark):
    """Texts along a chain share bands with their neighbours only: blocks bring together what may be similar, and every link is counted."""
    rng = random.Random(5)
    w, data = phrase(rng, 200).split(), []
    for i in range(90):
        data.append((i, " ".join(w)))
        for _ in range(2):
            w[rng.randrange(200)] = f"n{i}"
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert tuples(jaccard.jaccard_classes(df, block_entries=7), "doc_id", "class_id", "n_links") == brute_classes(data)


def test_least_matches():
    least = jaccard.least_matches(0.8, 1e-9)
    assert all(0 <= least[n] <= n for n in least) and list(least.values()) == sorted(least.values())
    assert least[128] > 50


def test_jaccard_empty(empty):
    assert jaccard.jaccard_classes(empty).count() == 0


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = corpus_pipeline.reject_toxic(spark, docs, DATA)
    verdict = {r["doc_id"]: r["predicted"] for r in toxicity.op9_toxicity(spark, DATA).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if not verdict[r["doc_id"]])
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == rows
    first = {i: c for i, c, _ in brute_classes(rows)}
    rows = [(i, t) for i, t in rows if first[i] == i]
    lost = {i: n for i, _, n, _ in brute_repeats(rows, 13)}
    seen, cut = {}, []
    for i, t in rows:
        for p in range(len(words(t)) - 12):
            seen.setdefault(tuple(words(t)[p : p + 13]), i)
    for i, t in rows:
        w, gone = words(t), set()
        for p in range(len(w) - 12):
            if seen[tuple(w[p : p + 13])] < i:
                gone |= set(range(p, p + 13))
        assert len(gone) == lost[i]
        cut.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    clean = [(i, t) for i, t in cut if not brute_hits([(i, t)], items, 10)[0][5]]
    want = {i: len(x) + 1 for i, x in encoded(clean)}
    pieces = corpus_pipeline.run(spark, DATA).collect()
    got = {}
    for p in pieces:
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["length"]
        assert want[p["doc_id"]] == p["doc_tokens"]
    assert got == want


def test_pipeline_edges(spark, docs, rows, empty, tmp_path):
    """Nulls, repeated rows, an empty table and clashing columns through every stage and the whole."""
    import corpus_pipeline

    extra = {c: F.lit("own") for c in ("n_removed", "longest", "kept", "c0", "_n", "sig", "text_len", "contaminated", "predicted", "blob")}
    for name, df in (("full", docs.withColumns(extra)), ("empty", empty)):
        folder = f"{tmp_path}/{name}"
        df.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
        stage = spark.read.parquet(f"{folder}/documents.parquet")
        for _, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, stage, folder)
            assert out.columns == stage.columns and [x.dataType for x in out.schema] == [x.dataType for x in stage.schema]
            out.write.mode("overwrite").parquet(f"{folder}/out")
            stage = spark.createDataFrame(spark.read.parquet(f"{folder}/out").collect(), stage.schema)
        if name == "full":
            assert all(r[c] == "own" for r in stage.collect() for c in extra)
            ids = sorted((r["doc_id"] for r in stage.collect()), key=str)
            # Of the copies 1, 5, 5 and the near copy 6 the first stays, and null ids all.
            assert ids == sorted([1, 2, 3, 4, 7, 8, 9, 10, None, None, 11, 12, 14], key=str)
        assert corpus_pipeline.run(spark, folder).selectExpr("sum(length)").first()[0] == corpus_pipeline.pack(spark, stage, folder).selectExpr("sum(length)").first()[0]


def test_scratch_is_released(spark):
    import os

    from arbora.llm._spark import folders, release, written

    before = folders()
    df = written(spark.range(3), "short")
    path = [p for p in folders() if p not in before]
    assert df.count() == 3 and len(path) == 1 and os.path.isdir(path[0].removeprefix("file:"))
    release(spark, keep=before)
    assert folders() == before and not os.path.isdir(path[0].removeprefix("file:"))


def test_registry():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    json.dumps(entry.oracle_sql())


def test_search_over_many_blocks_and_packets(spark, monkeypatch):
    """Blocks and packets of a few rows; near neighbours that early radii cover, and far ones that the pass over all codes finds."""
    for name, n in (("BLOCK", 16), ("LEAST", 4), ("PACKET", 7)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(12)
    near = rng.normal(size=(1, 100)) + 0.05 * rng.normal(size=(40, 100))
    data = [(i, v.tolist()) for i, v in enumerate([*near, *rng.normal(size=(110, 100)), *near[:5]])]
    codes = topk.sign_codes(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"))
    bits = np.array([v for _, v in data]) > 0
    apart = (bits[:, None] != bits[None]).sum(2)
    want = [(i, k + 1, int(j), int(apart[i, j])) for i in range(0, len(data), 3) for k, j in enumerate(sorted((j for j in range(len(data)) if j != i), key=lambda j: (apart[i, j], j))[:6])]  # noqa: B023
    assert tuples(topk.search(codes, codes.where("vec_id % 3 = 0"), k=6), "vec_id", "rank", "neighbor_id", "distance") == sorted(want, key=str)


def test_licenses_of_tags_titles_and_bodies(spark):
    texts = {
        "SPDX-License-Identifier: MIT": "mit", "// SPDX-License-Identifier: GPL-2.0-or-later\nint main;": "gpl-2.0-or-later", "# SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "SPDX-License-Identifier: None": "",
        "The MIT License (MIT)": "mit", "MIT License\n\nCopyright (c) 2020 A B": "mit", "licensed under the terms of the MIT license": "mit",
        "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": "apache-2.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3": "agpl-3.0,gpl",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": "gpl,lgpl-2.1", "BSD 2-Clause License": "bsd-2-clause", "an mit student has a license": "", "the terms of the license are short": "",
    }
    rng = random.Random(4)
    data = [*enumerate(texts), *((100 + i, phrase(rng, 40)) for i in range(60))]
    found = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert [found[i] for i in range(len(texts))] == list(texts.values())
