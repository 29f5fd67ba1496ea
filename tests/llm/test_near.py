"""Fingerprints, Jaccard join, line and substring deduplication, against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from graphwright.llm import components as cc, fingerprints as fp, jaccard_join as jj, line_dedup as ld
from graphwright.llm import suffix_array as sa, suffix_dedup as sd
from pyspark.sql import functions as F

BLANK = " \t\n\v\f\r"


def shingles(text):
    w = re.findall(r"[^\W]+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 6))) for _ in range(n))


def test_fingerprints_of_odd_rows(spark, odd, none):
    assert fp.fingerprint_edits(none).count() == 0
    rows = [r for r in fp.fingerprint_edits(odd).collect()]
    docs = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    assert len(rows) == len(docs)
    left = [(r.doc_id, r.n_chars, r.edited_sha256) for r in rows]
    for i, (key, text) in enumerate(docs):
        follow = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + follow[:half]
        left.remove((key, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1.0
    assert by[3].fingerprint == "" and by[3].near_next == 1.0 and by[2].near_next == 0.0
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_next_document_across_buckets(spark):
    ids = [3, 300, 70_000, 1 << 40, 301, -5, 2]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.next_text for r in fp.with_next(docs).collect()}
    order = sorted(ids)
    assert got == {a: f"text {b}" for a, b in zip(order, order[1:] + order[:1])}
    one = spark.createDataFrame([(7, "only")], "doc_id bigint, text string")
    assert [r.next_text for r in fp.with_next(one).collect()] == ["only"]


def test_sketches_estimate_and_merge(spark):
    rng = random.Random(3)
    base = prose(rng, 3000)
    parts = [base, base[:len(base) // 2] + " " + prose(rng, 1500), prose(rng, 60), base]
    df = spark.createDataFrame(list(enumerate(parts)), "id int, text string").withColumn("sketch", fp.sketch(F.col("text")))
    a, b, c, d = (F.col(x) for x in "abcd")
    one = df.groupBy().pivot("id", [0, 1, 2, 3]).agg(F.first("sketch")).toDF("a", "b", "c", "d")
    r = one.select(fp.resemblance(a, b).alias("ab"), fp.resemblance(a, d).alias("ad"), fp.containment(c, fp.merge(a, c)).alias("in"),
                   fp.distinct(a).alias("n"), fp.resemblance(c, c).alias("cc")).first()
    s = [shingles(p) for p in parts]
    assert abs(r.ab - likeness(s[0], s[1])) < 0.15 and r.ad == r.cc == 1.0
    assert abs(r.n / len(s[0]) - 1) < 0.3 and abs(r["in"] - 1) < 0.3
    merged = {x.g: x.sketch for x in fp.merge_groups(df.withColumn("g", F.col("id") % 2), ["g"]).collect()}
    whole = one.select(fp.merge(a, c).alias("x"), fp.merge(b, d).alias("y")).first()
    assert merged[0] == whole.x and merged[1] == whole.y


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def near_corpus():
    rng = random.Random(5)
    rows, texts = [], [prose(rng, 80) for _ in range(12)]
    for i in range(60):  # one large group of near copies
        w = texts[0].split()
        w[rng.randrange(80)] = f"x{i % 40}"
        rows.append(" ".join(w))
    for t in texts:
        w = t.split()
        rows += [t, t, " ".join(w[:-3]), " ".join(w[10:]), " ".join(w[:40] + prose(rng, 40).split()), t.upper()]
    return list(enumerate(rows, 1))


def test_jaccard_join_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 16)  # several blocks for the large group
    rows = near_corpus()
    sets = {i: shingles(t) for i, t in rows}
    links = {i: {j for j in sets if j != i and likeness(sets[i], sets[j]) >= 0.8} for i in sets}
    label = dict.fromkeys(sets)
    for i in sets:
        if label[i] is None:
            todo = [i]
            while todo:
                k = todo.pop()
                if label[k] is None:
                    label[k] = i
                    todo += links[k]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in jj.join(docs).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    assert {i: r.class_id for i, r in got.items()} == label
    assert sorted(r.doc_id for r in jj.keep(docs).collect()) == sorted(set(label.values()))


def test_recall_reaches_its_target():
    for t in (0.5, 0.8, 0.9):
        d = jj.final_depth(t, 0.999)
        assert jj.recall(d, t) >= 0.999 or d == 1
        assert d == jj.MAX_DEPTH or jj.recall(d + 1, t) < 0.999


def test_jaccard_join_of_odd_rows(spark, odd, none):
    assert jj.join(none).count() == 0 and jj.keep(none).count() == 0
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jj.join(odd).collect())
    want = sorted([("1", "1", 1), ("2", "1", 1), ("None", "None", 0)] + [(str(i), str(i), 0) for i in (3, 4, 5, 6, 9, 10, 11)])
    assert got == want
    kept = jj.keep(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "None", "3", "4", "5", "6", "9", "10", "11"])


def test_jaccard_join_of_rows_that_share_an_id(spark):
    rng = random.Random(9)
    a, b, c, e = (prose(rng, 60) for _ in range(4))
    near = lambda t: t + " one more"
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (3, ""), (4, c), (4, e), (5, near(e)), (4, c), (6, prose(rng, 30)), (1, ""), (7, near(c)),
            (7, near(c) + " and"), (None, a), (None, b), (8, prose(rng, 3))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in jj.join(docs).collect())
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (3, 3, 0), (1, 1, 0), (4, 4, 2), (4, 4, 1), (5, 4, 1), (6, 6, 0),
                          (7, 4, 2), (7, 4, 2), (-1, -1, 0), (-1, -1, 0), (8, 8, 0)])
    texts = sorted((r.doc_id or -1, r.text) for r in jj.keep(docs).collect())
    assert texts == sorted([(1, a), (1, b), (1, ""), (3, ""), (4, c), (4, e), (6, rows[9][1]), (-1, a), (-1, b), (8, rows[15][1])])


def brute_lines(rows, min_chars=ld.MIN_CHARS):
    first = {}
    for key, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if line.strip(BLANK):
                first.setdefault(line.strip(BLANK), (key, k))

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < min_chars:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    gone = {a for a in first if any(first[b] < first[a] and near(a, b) for b in first)}
    out = {}
    for key, text in rows:
        lines = (text or "").split("\n")
        keep = [x for k, x in enumerate(lines) if not x.strip(BLANK) or (first[x.strip(BLANK)] == (key, k) and x.strip(BLANK) not in gone)]
        out[key] = (sum(bool(x.strip(BLANK)) for x in lines), len(lines) - len(keep), "\n".join(keep))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    pool = ["".join(rng.choices("abé", k=rng.randint(1, 14))) for _ in range(60)]
    rows = []
    for key in rng.sample(range(1000), 60):
        lines = []
        for _ in range(rng.randint(0, 8)):
            x = list(rng.choice(pool))
            if rng.random() < 0.5:
                at = rng.randrange(len(x))
                rng.choice([lambda: x.pop(at), lambda: x.insert(at, "ü"), lambda: x.__setitem__(at, "z")])()
            lines.append(rng.choice(["", " "]) + "".join(x) + rng.choice(["", "\t"]))
        rows.append((key, "\n".join(lines)))
    rows.sort()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for min_chars in (ld.MIN_CHARS, 1):
        got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in ld.dedup(docs, min_chars).collect()}
        assert got == brute_lines(rows, min_chars)


def test_lines_that_differ_in_one_quarter(spark):
    """One outer key holds most lines; its rows are joined to one row of the key, not gathered in a window."""
    numbers = random.Random(9).sample(range(100_000, 1_000_000), 400)
    rows = [(k, f"Order number {n} was sent to you\nline {k} of its own kind") for k, n in enumerate(numbers)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in ld.dedup(docs).collect()}
    assert got == brute_lines(rows) and any(x[1] for x in got.values())
    plan = ld._candidates(ld._keyed(docs), ld.MIN_CHARS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" in plan


def test_line_dedup_of_odd_rows(spark, odd, none):
    assert ld.dedup(none).count() == 0
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in ld.dedup(odd).collect()}
    assert got[1] == (1, 0) and got[2] == (1, 1) and got[3] == got[4] == (0, 0) and got[9] == (0, 0) and got[6] == (1, 0) and got[None] == (1, 0)


def test_suffix_arrays():
    rng = np.random.default_rng(4)
    for _ in range(150):
        x = np.r_[rng.integers(1, rng.integers(2, 6), rng.integers(1, 80)), 0].astype(np.uint16)
        got = sa.suffix_array(x).tolist()
        assert got == sorted(range(len(x)), key=lambda i: tuple(x[i:]))
    for x in ([0], [1] * 200 + [0], [1, 2] * 100 + [0]):
        assert sa.suffix_array(np.array(x, np.uint16)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_permuted_prefixes():
    rng = np.random.default_rng(6)
    raw = rng.integers(97, 99, 300).astype(np.uint8)
    text = np.r_[raw.astype(np.uint16) + 2, 0].astype(np.uint16)
    order = sa.suffix_array(text)
    got = sa.permuted_prefixes(np.r_[raw, np.full(59, 255, np.uint8)], order, 50)
    for a, b in zip(order, order[1:]):
        n = 0
        while n < 50 and max(a, b) + n < 300 and raw[a + n] == raw[b + n]:
            n += 1
        assert min(got[b], 300 - max(a, b)) == n


def brute_suffix(rows):
    """Bytes to remove of (key, text) rows."""
    first = {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        b = text.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p:p + 50], key)
    out = []
    for key, text in rows:
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < key:
                gone[p:p + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((key, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0,
                    hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeated_corpus(n=50):
    rng = random.Random(8)
    passages = [prose(rng, k) for k in (9, 15, 40, 300)]
    rows = []
    for key in rng.sample(range(10_000), n):
        t = " é ".join(rng.choice([*passages, prose(rng, 20), "a" * 70, ""]) for _ in range(rng.randint(0, 6)))
        cut = rng.randint(0, 30)
        rows.append((key, t[cut:]))
    return rows


def test_suffix_dedup_equals_brute_force(spark):
    rows = repeated_corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup(docs).collect())
    assert got == brute_suffix(rows)


def test_suffix_dedup_with_more_shards(spark, monkeypatch):
    assert [sd._shard_bits(n << 30) for n in (0, 30, 1 << 10, 100 << 10)] == [8, 8, 13, 16]
    monkeypatch.setattr(sd, "_shard_bits", lambda n: 14)
    rows = repeated_corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup(docs).collect())
    assert got == brute_suffix(rows)


def test_hot_anchors_go_window_by_window(monkeypatch):
    """The steps of the operator in one process, with every repeated anchor hot."""
    monkeypatch.setattr(sd, "HOT_COUNT", 2)
    monkeypatch.setattr(sd, "SHARD_BYTES", 1000)
    rows = repeated_corpus(40)
    rows += [(20_000 + i, "b" * n) for i, n in enumerate((49, 50, 51, 300, 90, 300))]
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t]), pa.array([7])], ["key", "text", "mark"]) for k, t in rows]

    class Shared:
        def __init__(self, value):
            self.value = value

    every = np.full(1 << sd.FILTER_BITS >> 6, (1 << 64) - 1, np.uint64)  # all documents are first: no chunk is left out
    packed = pa.Table.from_batches(sd._anchor_rows(Shared(every))(batches)).sort_by("shard").to_batches()
    bits, hot = np.zeros((256, 1 << sd.FILTER_BITS >> 14), np.uint64), np.zeros((256, 1 << sd.HOT_BITS >> 14), np.uint64)
    for b in sd._repeated(packed):
        shard = b.column(0)[0].as_py()
        bits[shard], hot[shard] = np.frombuffer(b.column(1)[0].as_py(), "<u8"), np.frombuffer(b.column(2)[0].as_py(), "<u8")
    assert hot.any()
    segments = pa.Table.from_batches(sd._segments(Shared(every), Shared((bits.ravel(), hot.ravel())))(batches)).sort_by("route")
    cuts = {}
    runs = [r for r in segments.to_pylist() if r["key"] >= 20_000]
    assert 0 < len(runs) <= 5 and {r["stop"] - r["start"] for r in runs} <= {50, 51, 90, 300}
    for b in sd._shards(segments.to_batches(max_chunksize=7)):
        for r in b.to_pylist():
            assert r["mark"] == 7
            cuts.setdefault(r["key"], []).append({"start": r["start"], "stop": r["stop"]})
    out = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows]),
                                      pa.array([cuts.get(k) for k, _ in rows], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                                     ["doc_id", "text", "cuts"])
    got = sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for b in sd._remove([out]) for r in b.to_pylist())
    assert got == brute_suffix(rows)


def test_suffix_dedup_of_rows_that_share_an_id(spark):
    a, b, c = ("".join(random.Random(i).choices("abcdefghij ", k=400)) for i in range(3))
    rows = [(1, a), (2, "x" + a), (2, "short"), (2, b + "x" + a[:200]), (2, b), (3, c + b), (3, c), (3, c), (None, c[:120]), (None, a[50:150]), (None, a[50:150] + "!")]
    low = {None: -1}
    got = sd.dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert sorted((low.get(r.doc_id, r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) \
        == brute_suffix([(low.get(k, k), t) for k, t in rows])
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_suffix_dedup_of_texts_of_one_letter(spark):
    rows = [(1, "z" * 3000), (2, "y" * 200 + "z" * 60), (3, "z" * 49), (4, "z" * 50), (5, "yz" * 2000), (6, "yz" * 90)]
    got = sd.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_suffix(rows)


def test_suffix_dedup_of_odd_rows(spark, odd, none):
    assert sd.dedup(none).count() == 0
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in sd.dedup(odd).collect()}
    n = len("The quick brown fox jumps over the lazy dog near the quiet river bank today.")
    assert got[1] == (n, 0, 0) and got[2] == (n, n, 1) and got[3] == got[4] == (0, 0, 0) and got[11][1] == 0 and got[6][1] == 0


def test_rows_of_one_id_keep_their_own_lines(spark):
    rows = [(None, "alpha line one\nbravo unique stays"), (None, "zzz first line\nalpha line onf"), (None, "zzz first line\ncharlie is here"),
            (7, "delta line four\necho line five"), (7, "delta line four\nfoxtrot line six\necho line five"), (7, "delta line four\necho line five"),
            (8, "foxtrot line six\ngolf line seven")]
    out = ld.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_lines) for r in out) == [(0, 2), (0, 2), (0, 2), (7, 2), (7, 2), (7, 3), (8, 2)]
    texts = {(r.doc_id, t) for r in out for t in r.kept_text.split("\n") if t}
    assert {t for _, t in texts} >= {"bravo unique stays", "zzz first line", "charlie is here", "delta line four", "echo line five",
                                     "foxtrot line six", "golf line seven"}
    assert len({"alpha line one", "alpha line onf"} & {t for _, t in texts}) == 1
    kept = [t for r in {(r.doc_id, r.kept_text) for r in out} for t in r[1].split("\n") if t]
    assert len(kept) == len(set(kept)) == 8 and (8, "foxtrot line six") not in texts
