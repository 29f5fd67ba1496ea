"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

Texts are sets of five-word shingles (44-bit hashes; a shorter text is one
shingle of all its words).  Texts with equal sets form one class of copies,
and one representative of each goes on:

1. Every representative gets ``TREES`` paths; a path is a string of min-hash
   values, so a tree is a sorted prefix trie of paths and two texts match to
   depth d when their paths share a prefix of d values.
2. Matching starts at the longest prefix and shortens it until the recall
   ``1 - (1 - t**d)**TREES`` for pairs at the threshold ``t`` reaches
   ``target_recall``.  What matched at a longer prefix goes on as one path.
   The members of a matched prefix are linked to its smallest member.
3. Connected candidates are verified exactly: a component is cut into blocks
   of ``BLOCK`` texts and every pair of blocks is one unit of work, which
   counts shared shingles by matrix products over the shingles that occur
   twice.  Counts and local classes leave it, never a list of pairs.

The result has one row per document: ``doc_id``, ``class_id`` (smallest
``doc_id`` linked directly or through others), ``n_links`` (other documents
with a similarity of at least ``t``, copies counted one by one) and
``copy_of`` (smallest ``doc_id`` with the same set).

Rows: null, empty and wordless texts link to nothing and are classes of their
own, and so is a null ``doc_id``.  Repeated rows of a ``doc_id`` with one text
count once; several texts of one id are documents of their own, known by the id and a hash
of the text, and each gets a row (classes that begin with texts of one id then share their
``class_id``; ``keep`` tells them apart).  An empty table gives no rows.
Other columns are ignored by ``join`` and kept by ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh, materialise, mix64, slices, text_or_empty
from .components import components
from .words import same_doc, window_hash, words

SIZE, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.999
TREES, MAX_DEPTH = 24, 7
BLOCK = 512
_SHIFT = np.uint64(20)


def recall(depth: int, threshold: float, trees: int = TREES) -> float:
    """Chance that a pair at the threshold shares a prefix of ``depth`` in some tree."""
    return 1 - (1 - threshold ** depth) ** trees


def final_depth(threshold: float, target: float, trees: int = TREES, longest: int = MAX_DEPTH) -> int:
    depth = longest
    while depth > 1 and recall(depth, threshold, trees) < target:
        depth -= 1
    return depth


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of all texts, ascending within a text; first place of each text, one more than texts)."""
    n = len(texts)
    w = words(texts)
    at = np.flatnonzero(same_doc(w.doc, SIZE))
    doc, h = w.doc[at], window_hash(w.hash, SIZE)[at]
    bounds = w.bounds(n)
    for i in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < SIZE)):
        part = w.hash[bounds[i]:bounds[i + 1]]
        doc, h = np.r_[doc, i], np.r_[h, window_hash(part, len(part)) + np.uint64(len(part))]
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> _SHIFT))
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    heads = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(44))
    return key & np.uint64((1 << 44) - 1), heads


def _paths(h: np.ndarray, heads: np.ndarray, depth: int, rows: np.ndarray) -> np.ndarray:
    """Path bytes (row, tree, 8 + 4 per deeper level): a 64-bit hash of the first
    ``depth`` min-hashes, then one 32-bit value per level up to ``MAX_DEPTH``."""
    x = mix64(h) >> np.uint64(32)
    x = x.astype(np.uint32)
    rng = np.random.Generator(np.random.PCG64(20))
    odd = rng.integers(0, 1 << 32, (TREES, MAX_DEPTH), np.uint32) | np.uint32(1)
    flip = rng.integers(0, 1 << 32, (TREES, MAX_DEPTH), np.uint32)
    out = np.zeros((len(rows), TREES, 8 + 4 * (MAX_DEPTH - depth)), np.uint8)
    first = heads[rows]
    v = np.empty_like(x)
    for t in range(TREES):
        key = np.full(len(rows), t + 1, np.uint64)
        for k in range(MAX_DEPTH):
            np.bitwise_xor(x, flip[t, k], out=v)
            np.multiply(v, odd[t, k], out=v)
            low = np.minimum.reduceat(v, first)
            if k < depth:
                key = mix64(key ^ low.astype(np.uint64))
            else:
                at = 8 + 4 * (k - depth)
                out[:, t, at:at + 4] = low.astype(">u4")[:, None].view(np.uint8).reshape(-1, 4)
        out[:, t, :8] = key.astype(">u8")[:, None].view(np.uint8).reshape(-1, 8)
    return out


def _signatures(depth: int):
    def run(batches):
        for b in slices(batches, 1, 1 << 20):
            h, heads = shingle_sets(b.column(1))
            sizes = np.diff(heads)
            rows = np.flatnonzero(sizes)
            if not len(rows):
                continue
            m = mix64(h + np.uint64(1))
            one = np.add.reduceat(m, heads[rows])
            two = np.bitwise_xor.reduceat(mix64(m), heads[rows])
            key = np.stack([one, two], 1).astype("<u8").tobytes()
            paths = _paths(h, heads, depth, rows)
            width = paths.shape[2]
            offs = pa.array(np.arange(0, len(rows) * TREES + 1, TREES, dtype=np.int32))
            flat = pa.Array.from_buffers(pa.binary(), len(rows) * TREES, [
                None, pa.py_buffer((np.arange(len(rows) * TREES + 1, dtype=np.int32) * width).tobytes()),
                pa.py_buffer(paths.tobytes())])
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(rows)), b.column(2).take(pa.array(rows)), pa.array([key[i:i + 16] for i in range(0, len(key), 16)], pa.binary()),
                pa.ListArray.from_arrays(offs, flat)], ["doc_id", "mark", "key", "paths"])
    return run


def _candidate_edges(reps: DataFrame, depth: int) -> DataFrame:
    """Links of the forest: (a, b) with b the smallest text of a matched prefix."""
    rows = reps.select("rep", F.posexplode("paths").alias("tree", "path"))
    key = F.substring("path", 1, 8)
    shared = (rows.groupBy("tree", key.alias("p")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tree", "p"))
    rows = materialise(rows.withColumn("p", key).join(shared, ["tree", "p"]).select("tree", "path", "rep"), "paths")
    edges = None
    for d in range(MAX_DEPTH, depth - 1, -1):
        level = rows.withColumn("p", F.substring("path", 1, 8 + 4 * (d - depth)))
        least = materialise(level.groupBy("tree", "p").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("n")), "prefixes")
        found = (level.join(least.where("n > 1"), ["tree", "p"]).where("rep != low")
                 .select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct())
        edges = found if edges is None else edges.unionByName(found)
        rows = least.select("tree", F.col("p").alias("path"), F.col("low").alias("rep"))
    return edges.distinct()


def _verify(threshold: float):
    """Exact links of block pairs; rows arrive sorted by (root, i, j)."""
    def work(group):
        rep = np.array([g[4] for g in group], np.int64)
        copies = np.array([g[5] for g in group], np.float64)
        side = np.array([g[3] for g in group])
        sets = [np.frombuffer(g[6], "<u8") for g in group]
        sizes = np.array([len(s) for s in sets], np.float64)
        distinct, code = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
        often = np.bincount(code, minlength=len(distinct)) > 1
        column = np.cumsum(often) - 1
        keep = often[code]
        owner, code = owner[keep], column[code[keep]]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        inter = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        for lo in range(0, int(often.sum()), width):
            s, e = np.searchsorted(code, [lo, lo + width])
            a = np.zeros((len(sets), width), np.float32)
            a[owner[s:e], code[s:e] - lo] = 1
            inter += a @ a.T
        union = sizes[:, None] + sizes[None, :] - inter
        linked = inter >= threshold * union - 1e-6
        np.fill_diagonal(linked, False)
        if group[0][1] != group[0][2]:  # two blocks: only pairs across them
            linked &= side[:, None] != side[None, :]
        links = linked @ copies
        root, last = rep.copy(), None
        while last is None or (root != last).any():
            last = root
            root = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1))
        return rep, links, root

    def run(batches):
        held = []

        def flush():
            rep, links, root = work(held)
            return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links.astype(np.int64)), pa.array(root)],
                                              ["rep", "links", "low"])
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and row[:3] != held[0][:3]:
                    yield flush()
                    held = []
                elif held and row[4] == held[-1][4]:
                    continue  # a repeated row
                held.append(row)
        if held:
            yield flush()
    return run


def _sets(batches):
    for b in slices(batches, 1, 1 << 20):
        h, heads = shingle_sets(b.column(1))
        raw, cut = h.astype("<u8").tobytes(), (heads * 8).tolist()
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 2, 3, 4)),
                                          pa.array([raw[a:e] for a, e in zip(cut, cut[1:])], pa.binary())],
                                         ["rep", "copies", "root", "blocks", "shingles"])


def join(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """``doc_id, class_id, n_links, copy_of`` of every document."""
    return _join(docs, threshold, target_recall).select("doc_id", "class_id", "n_links", "copy_of")


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"), _mark())


def _mark() -> Column:
    return F.xxhash64(text_or_empty()).alias("mark")


def _join(docs: DataFrame, threshold: float, target_recall: float) -> DataFrame:
    """As ``join``, with ``mark`` (hash of the text) and ``root`` (the class; null for a text without shingles)."""
    depth = final_depth(threshold, target_recall)
    d = _marked(docs)
    signed = materialise(d.where("doc_id IS NOT NULL").mapInArrow(
        _signatures(depth), "doc_id bigint, mark bigint, key binary, paths array<binary>"), "signatures", compression="zstd")
    # several rows of one id and text count once; copies are classes of equal sets
    reps = materialise(_classes(signed), "representatives", compression="zstd")
    # a set is known by the least id that has it; ids that are the least of several sets get numbers of their own
    clash = materialise(reps.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep"), "clashes")
    several = not clash.isEmpty()
    if several:
        own = F.shiftrightunsigned(F.xxhash64("rep", "key"), 2) + F.lit(1 << 62)
        reps = materialise(reps.join(clash.withColumn("clash", F.lit(True)), "rep", "left")
                           .withColumn("node", F.when(F.col("clash"), own).otherwise(F.col("rep"))).drop("clash"), "nodes", compression="zstd")
    else:
        reps = reps.withColumn("node", F.col("rep"))
    roots = components(_candidate_edges(reps.select(F.col("node").alias("rep"), "paths"), depth))
    sized = roots.join(roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")), "root")
    members = materialise(sized.join(reps.select("node", "copies", F.col("rep").alias("doc_id"), F.col("rep_mark").alias("mark")), "node"), "members")
    # texts are shuffled once, at every size alike
    texts = d.join(members.hint("merge"), ["doc_id", "mark"]).select("node", "text", "copies", "root", "blocks")
    units = (texts.mapInArrow(_sets, "rep bigint, copies bigint, root bigint, blocks int, shingles binary")
             .withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("root", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
                     "side", "rep", "copies", "shingles"))
    units = units.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "rep")
    verified = materialise(units.mapInArrow(_verify(threshold), "rep bigint, links bigint, low bigint"), "verified")
    links = verified.groupBy(F.col("rep").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(verified.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    per_rep = (reps.select("key", "rep", "node", "copies").join(links, "node", "left").join(classes, "node", "left")
               .withColumn("root", F.coalesce("root", "node")))
    if several:  # the least node of a class need not be that of its least id
        per_rep = materialise(per_rep, "class-nodes")
        per_rep = per_rep.join(per_rep.groupBy("root").agg(F.min("rep").alias("class_id")), "root")
    else:
        per_rep = per_rep.withColumn("class_id", F.col("root"))
    per_rep = materialise(per_rep.select("key", F.col("rep").alias("copy_of"), "class_id", "root",
                                         (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    keyed = signed.select("doc_id", "mark", "key").distinct()
    names = ["doc_id", "mark", "class_id", "n_links", "copy_of", "root"]
    linked = keyed.join(per_rep, "key").select(*names)
    alone = d.select("doc_id", "mark").distinct().join(keyed.select("doc_id", "mark"), ["doc_id", "mark"], "left_anti").select(
        "doc_id", "mark", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("doc_id").alias("copy_of"),
        F.lit(None).cast("bigint").alias("root"))
    return linked.unionByName(alone)


def _classes(signed: DataFrame) -> DataFrame:
    """One row per set of shingles: smallest id and its mark, number of documents, paths."""
    per_id = signed.groupBy("key", "doc_id").agg(F.first("paths").alias("paths"), F.min("mark").alias("mark"))
    return per_id.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min_by("mark", "doc_id").alias("rep_mark"),
                                     F.count(F.lit(1)).alias("copies"), F.first("paths").alias("paths"))


def keep(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One document of each class (that of the smallest ``doc_id``), with all columns
    of ``docs``; of repeated rows of an id and text one stays, rows without an id all stay."""
    number, mark, name = (fresh(docs, n) for n in ("_n", "_mark", "_keep"))
    rows = _join(docs, threshold, target_recall).where("class_id = doc_id")
    # of several texts of the least id in one class one stays; texts without shingles are no class with others
    first = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("mark").alias("mark"))
    chosen = first.select("doc_id", "mark").unionByName(rows.where("root IS NULL").select("doc_id", "mark")).toDF(name, mark)
    kept = docs.join(chosen, (F.col("doc_id").cast("bigint") == F.col(name)) & (_mark() == F.col(mark)), "left_semi")
    one = Window.partitionBy("doc_id", _mark()).orderBy(F.xxhash64("text"))
    kept = kept.withColumn(number, F.row_number().over(one)).where(F.col(number) == 1).drop(number)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
