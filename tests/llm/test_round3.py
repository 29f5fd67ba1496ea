"""Filter audit, Zstandard archives and ranked search against brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from graphwright.llm import filter_audit as fa, ranked_search as rs, warc_zstd as wz
from graphwright.llm.queries import QUERIES
from graphwright.session import scratch_path

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema="doc_id bigint, text string, source string"):
    return spark.createDataFrame(rows, schema)


# -- filter audit -----------------------------------------------------------------

def fails(docs):
    """Set of failed filters of every row, by plain Python."""
    first = {}
    for d in docs:
        if d["doc_id"] is not None:
            t = d["text"] or ""
            first[t] = min(first.get(t, d["doc_id"]), d["doc_id"])
    out = []
    for d in docs:
        t = d["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        if len(words) < 50:
            f.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            f.add("C")
        if re.search(r"[#$%&*|]", t):
            f.add("D")
        if d["doc_id"] is not None and first[t] < d["doc_id"]:
            f.add("E")
        out.append(f)
    return out


def audit_brute(docs, labels):
    rows = {}
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    bad = {r["doc_id"] for r in labels if r["toxic"] == 1 and r["doc_id"] is not None}
    failed = fails(docs)
    for part in {d["source"] or "" for d in docs}:
        here = [(d["doc_id"], f) for d, f in zip(docs, failed) if (d["source"] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = here
            for i, x in enumerate(order):
                out = [d for d, f in left if x in f]
                gone = {id(f) for _, f in here} - {id(f) for _, f in left}
                left = [(d, f) for d, f in left if x not in f]
                total[x] += len(out)
                rows[part, "".join(order), i + 1] = (
                    len(left), len(out), sum(x in f and id(f) in gone for _, f in here), sum(f == {x} for _, f in here),
                    sum(d in good for d in out), sum(d in bad for d in out))
        for (p, order, step), v in list(rows.items()):
            if p == part:
                rows[p, order, step] = (*v, total[order[step - 1]])
    return rows


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


def test_audit_equals_all_orders_by_hand(spark):
    got = audit_rows(QUERIES["op11_filter_audit"](spark, SF))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got == audit_brute(docs, spark.read.parquet(f"{SF}/labels.parquet").collect())


def test_audit_of_odd_rows(spark, odd, none):
    labels = frame(spark, [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, None, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = audit_rows(fa.audit(odd, labels))
    assert got == audit_brute(odd.collect(), labels.collect())
    assert fa.audit(none, labels).count() == 0 and len(fa.audit(odd, labels.limit(0)).collect()) == 600 * 4


def test_audit_of_white_space_and_capitals(spark):
    texts = ["a\tb\nc\vd\fe\rf g" * 10, "a b" * 30, "ÀÉ" * 100, "AB" + "x" * 38, "ABC" + "x" * 57, "ABCD" + "x" * 57,
             " ".join(map(str, range(50))), " ".join(map(str, range(49))), "a " * 65 + " ".join(map(str, range(35))), "𝔘𝔫" * 20 + "A"]
    docs = frame(spark, [(i // 2, t, "s") for i, t in enumerate(texts * 2)])
    assert audit_rows(fa.audit(docs, frame(spark, [], "doc_id bigint, quality int, toxic int"))) == audit_brute(docs.collect(), [])


def test_lattice_counts_orders():
    for k in range(1, 6):
        edges = fa.lattice(k)
        assert len(edges) == k * 2 ** (k - 1)
        for f in range(k):
            assert sum(w for _, g, w in edges if g == f) == math.factorial(k)
        count = {}
        for order in itertools.permutations(range(k)):
            for i, f in enumerate(order):
                key = (sum(1 << g for g in order[:i]), f)
                count[key] = count.get(key, 0) + 1
        assert {(s, f): w for s, f, w in edges} == count


def test_audit_of_other_filters(spark):
    docs = frame(spark, [(i, "x" * i, "s") for i in range(10)])
    got = fa.audit(docs, frame(spark, [], "doc_id bigint, quality int, toxic int"),
                   {"x": F.length("text") > 5, "y": F.length("text") % 2 == 0}, copies=None).collect()
    assert {(r.filter_order, r.step): r.removed for r in got} == {("xy", 1): 4, ("xy", 2): 3, ("yx", 1): 5, ("yx", 2): 2}
    assert {(r.filter_order[r.step - 1], r.shapley) for r in got} == {("x", 6), ("y", 8)}
    with pytest.raises(ValueError):
        fa.audit(docs, docs, {"long": F.lit(True)})


# -- archives -----------------------------------------------------------------------

def test_archives_give_the_pages_back(spark):
    path = scratch_path(spark, "warc-test")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    copies = pages.withColumn("page_id", F.col("page_id") + 1000)
    pages = pages.unionByName(copies)
    wz.write(pages, path, archive_bytes=40_000)
    got = wz.valid(wz.read(spark, path)).collect()
    rows = {r.page_id: r for r in pages.collect()}
    assert sorted(r.page_id for r in got) == sorted(rows) and len({r.archive for r in got}) > 3
    for r in got:
        body = rows[r.page_id].html.encode()
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(body), hashlib.sha256(body).hexdigest(), rows[r.page_id].url)
        same = min(i for i, p in rows.items() if p.html == rows[r.page_id].html)
        if len(body) < 100 or same == r.page_id:
            assert (r.record_type, bytes(r.payload), r.refers_to) == ("response", body, None)
        else:
            assert (r.record_type, r.payload, r.refers_to) == ("revisit", None, same)


def test_archives_of_odd_pages(spark):
    long, small = "é" * 60, "s" * 99
    rows = [(5, "http://a/\r\nb c", long), (3, None, long), (3, "u", long), (None, "ü", long), (7, "u", small), (8, "u", small),
            (9, None, None), (10, "", ""), (None, "u", "n" * 100), (None, "u", "n" * 100), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 20),
            (12, "u", "x" * 3_000_000), (-4, "u", "neg" * 50)]
    pages = frame(spark, rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("x")).withColumn("key", F.lit(1))
    path = scratch_path(spark, "warc-odd")
    wz.write(pages, path)
    got = wz.valid(wz.read(spark, path)).collect()
    key = lambda r: (str(r[0]), r[1], r[2], str(r[3]))
    want = sorted(((i, "revisit" if f is not None else "response", len((h or "").encode()), f) for (i, _, h), f in
                   zip(rows, [3, None, None, 3, None, None, None, None, None, None, None, None, None])), key=key)
    assert sorted(((r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in got), key=key) == want
    assert {r.url for r in got if r.page_id == 5} == {"http://a/%0D%0Ab%20c"} and {r.url for r in got if r.page_id == 9} == {None}
    empty = scratch_path(spark, "warc-empty")
    wz.write(pages.limit(0), empty)
    assert wz.read(spark, empty).count() == 0


def test_a_payload_with_many_copies(spark, monkeypatch):
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"),
                                     F.when(F.col("id") % 3 == 0, F.lit("h" * 200)).otherwise(F.concat(F.lit("c" * 200), F.col("id") % 700)).alias("html"))
    monkeypatch.setattr(wz, "HOT_SHARE", 100)
    marked = wz.mark_revisits(pages).select("page_id", "refers_to", F.decode("payload", "utf-8").alias("t")).collect()
    first = {}
    for r in sorted(marked):
        assert r.refers_to == first.get(r.t), r.page_id
        first.setdefault(r.t, r.page_id)
    assert len(marked) == 5000


def archive(*frames):
    return b"".join(frames)


def packed(data, **options):
    return zstandard.ZstdCompressor(write_checksum=True, **options).compress(data)


def good(page_id=1, body=b"payload", **over):
    fields = {"url": "http://a", "payload": body, "n_bytes": len(body), "digest": hashlib.sha256(body).hexdigest(), "refers_to": None, "date": wz.DATE}
    return wz.record(page_id, **{**fields, **over})


@pytest.mark.parametrize("data, error", [
    (good().replace(b"WARC/1.1", b"WARC/9.9"), "no WARC header"),
    (good().replace(b"WARC-Date: ", b"X-Date: "), "no warc-date"),
    (good().replace(b"1970-", b"70-"), "bad WARC-Date"),
    (good().replace(b"WARC-Type", b"WARC Type"), "not a header"),
    (good().replace(b"WARC-Type: response", b"WARC-Type: response\r\nwarc-type: revisit"), "header twice"),
    (good().replace(b"WARC-Type: response", b"WARC-Type: request"), "record of type"),
    (good()[:-2], "Content-Length"),
    (good() + b"x", "Content-Length"),
    (good(n_bytes=6), "HTTP Content-Length 6"),
    (good(digest="0" * 64), "payload differs"),
    (good(digest="0" * 63), "no SHA-256"),
    (good().replace(b"HTTP/1.1 200", b"HTTX/1.1 200"), "no HTTP header"),
    (good().replace(b"Content-Length: 7\r\n\r\n", b"Content-Length: -7\r\n\r\n", 1), "Content-Length"),
    (good(refers_to=3).replace(b"identical-payload-digest", b"server-not-modified"), "revisit"),
    (good(refers_to=3).replace(b"page-id:3", b"page-id:x"), "not a record id"),
    (b"", "no WARC header"),
])
def test_bad_records_are_told_and_the_next_is_read(data, error):
    found = list(wz.read_archive(archive(packed(data), packed(good(2)))))
    assert error in found[0][1]["error"], found[0]
    assert found[1][1]["page_id"] == 2 and found[1][0] == len(packed(data))


def test_frames_dictionary_and_cut_archives():
    samples = [good(i, b"some words of a page %d " % i * 9) for i in range(400)]
    trained = zstandard.train_dictionary(2000, samples)
    frames = [packed(s, dict_data=trained) for s in samples]
    head = wz._skippable(wz.DICT_FRAME, trained.as_bytes())
    plain, squeezed = archive(head, *frames), archive(wz._skippable(wz.DICT_FRAME, packed(trained.as_bytes())), frames[0], wz.EMPTY_FRAME, frames[1])
    assert [f["page_id"] for _, f in wz.read_archive(plain)] == list(range(400))
    assert [f["page_id"] for _, f in wz.read_archive(squeezed)] == [0, 1]
    assert all("error" in f for _, f in wz.read_archive(archive(*frames)))  # without its dictionary
    assert list(wz.read_archive(b"")) == [] == list(wz.read_archive(wz.EMPTY_FRAME))
    whole = archive(head, frames[0], frames[1])
    start = len(head) + len(frames[0])
    for cut in (1, 3, 4, 5, 9, 20, len(frames[1]) - 1):
        found = list(wz.read_archive(whole[:start + cut]))
        assert found[0][1]["page_id"] == 0 and found[-1][0] == start and "frame" in found[-1][1]["error"], cut
    broken = bytearray(whole)
    broken[-6] ^= 0x55
    assert "error" in list(wz.read_archive(bytes(broken)))[-1][1]
    no_size = zstandard.ZstdCompressor(write_content_size=False).compress(good())
    assert list(wz.read_archive(no_size))[0][1]["error"] == "frame without content size"
    blocks = packed(good(1, random.Random(1).randbytes(700_000)))  # raw and several blocks
    assert wz.frame_end(memoryview(blocks), 0) == len(blocks) and list(wz.read_archive(blocks))[0][1]["payload_bytes"] == 700_000


def test_valid_ends_the_job_on_an_error(spark):
    path = scratch_path(spark, "warc-bad").removeprefix("file:")
    import os
    os.makedirs(path)
    with open(f"{path}/a.warc.zst", "wb") as f:
        f.write(archive(packed(good(1)), packed(good(2, digest="0" * 64)), packed(good(3))))
    rows = wz.read(spark, path).orderBy("offset").collect()
    assert [(r.page_id, r.error) for r in rows] == [(1, None), (None, "payload differs from its digest"), (3, None)]
    with pytest.raises(Exception, match="payload differs"):
        wz.valid(wz.read(spark, path)).collect()


# -- ranked search --------------------------------------------------------------------

def search_brute(docs, items, best=10):
    term = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(rs.TERM, t or "")]
    texts = [(d, term(t)) for d, t in docs]
    texts = [(d, t) for d, t in texts if t]
    n_docs, all_terms = len(texts), sum(len(t) for _, t in texts)
    df = {}
    for _, t in texts:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = {}
    held = {}
    for i, t in items:
        held.setdefault(i, set()).update(term(t))
    for i, words in held.items():
        scores = []
        for d, t in texts:
            m = 100 - 90 + (90 * len(t) * n_docs) // all_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * t.count(w)) // (1000 * t.count(w) + 8 * m))
                    for w in words if w in t)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out[i] = [(None if none else d, -s) for s, none, d in sorted(scores)[:best]]
    return {i: r for i, r in out.items() if r}


def found(df):
    out = {}
    for r in df.orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return out


def test_search_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert found(QUERIES["op13_ranked_search"](spark, SF)) == search_brute(docs, items)


@pytest.mark.parametrize("bucket, block", [(4, 1 << 20), (64, 60), (4096, 1 << 20)])
def test_search_in_small_buckets_and_blocks(spark, monkeypatch, bucket, block):
    rng = random.Random(bucket)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(700)]
    docs += [(1000 + i, "w50 w51 w52 same text") for i in range(300)] + [(1100 + i, docs[5][1]) for i in range(40)]
    rng.shuffle(docs)
    items = [(i, text(rng.randrange(1, 30))) for i in range(12)] + [(50, "w50 w51"), (51, "W50, w50? same"), (52, "w0"), (53, "nothing here")]
    monkeypatch.setattr(rs, "BUCKET", bucket)
    d, q = frame(spark, docs, "doc_id bigint, text string"), frame(spark, items, "item_id bigint, text string")
    assert found(rs.search(d, q, block_bytes=block)) == search_brute(docs, items)
    if block == 60:
        assert found(rs.search(d, q, best=3)) == search_brute(docs, items, 3)


def test_search_of_odd_rows(spark, odd, none):
    items = [(1, "fox DOG"), (1, "river"), (2, None), (3, ""), (4, "one two"), (None, "Text"), (5, "é"), (6, "long words"), (7, "zzz"), (8, "it s we ll 3 5km")]
    q = frame(spark, items, "item_id bigint, text string").withColumn("score", F.lit(1))
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = found(rs.search(odd, q))
    assert got == search_brute(docs, items) and got[4] == [(6, got[4][0][1])] * 2 and got[None][0][0] is None
    assert rs.search(none, q).count() == 0 and rs.search(odd, q.limit(0)).count() == 0
    assert rs.search(frame(spark, [(1, None, "a"), (2, "!", "b")]), q).count() == 0


def test_terms_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(rs, "_hashes", lambda raw, start, end: (end - start).astype(np.uint64))
    import pyarrow as pa
    v = rs.Vocabulary.of(["aa", "bb", "c", "dd"])
    row, start, end, raw = rs._runs(pa.array(["BB c dd ee", "x aa", ""]))
    word, term = v.find(raw, start, end, rs._hashes(raw, start, end))
    assert sorted(zip(row[word].tolist(), term.tolist())) == [(0, 1), (0, 2), (0, 3), (1, 0)]


def test_only_ascii_capitals_are_lowered():
    assert rs.terms_of("ÄB aBİ-x_y\x7fz1@Q`") == ["Äb", "abİ", "x", "y", "z1", "q"] and rs.terms_of(None) == []
