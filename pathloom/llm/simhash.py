"""SimHash near-duplicates: fingerprints and a binary-trie self-join.

Fingerprint: 64 bits over the three-word shingles of a text, repeats included
(see ``fingerprint``).  Two documents are linked if their fingerprints differ in
at most ``BUDGET`` bits.

Join.  Of three blocks of bits, two fingerprints within two bits agree on one at
least.  With that block rotated to the front they lie under the same node of a
binary trie of the rotated fingerprints; so each of the three tries is cut at
that depth, its subtries are dealt to tasks, and each subtrie is joined with
itself.  The join walks pairs of nodes level by level in numpy, adds up the
differing bits and drops a pair once it is over budget; small nodes are compared
directly.  A subtrie with many fingerprints is cut deeper: its nodes some bits
further down are joined in pairs, leaving out pairs already over budget, so no
link is lost and no task holds all of it.

Only distinct fingerprints enter the join.  A task keeps the links it finds as a
forest (at most one link for each fingerprint and subtrie), which has the same
components; components are then joined up on the cluster.

Defined cases: a null or empty text, or one of white space, has the fingerprint
0, linked like any other; a bit set in just half of the hashes is 0; repeated rows
are rows of one document; rows with a null doc_id get a fingerprint and a
component, but are never its id (a component of such rows alone has a null id);
a very long text's hashes are added up in blocks; an empty table gives an empty
one; other columns, whatever their names, are ignored by ``near_duplicates`` and
kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components

BUDGET = 2
SEED = 42
#: First bit and number of bits of each block.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of a subtrie joined in one piece; further bits at most.
NODE_SIZE, MOST_BITS = 8192, 12
_PRODUCT = 16
_FRONTIER = 1 << 19
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each three-word shingle of a UTF-8 text (A-Z lower-cased, words parted by ASCII white space)."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) < 3:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    return np.array([h(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:], strict=False)], np.uint64)


def fingerprint(text: bytes) -> int:
    """Bit k is 1 if it is set in over half of the shingles' hashes; 0 without a word."""
    h = shingle_hashes(text)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]) if len(h) else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every whole text."""

    def run(batch):
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        fp = np.array([fingerprint(t) if t else 0 for t in texts], np.uint64).view(np.int64)
        return {"doc_id": batch.column(0), "fp": pa.array(fp)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_texts(docs, ["doc_id", "text"], run, f"doc_id {kind}, fp long")


class Forest:
    """Least member of each set of joined numbers, kept in numpy."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            odd = a != b
            if not odd.any():
                return
            i, j, a, b = i[odd], j[odd], a[odd], b[odd]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def trie_join(v: np.ndarray, pairs: np.ndarray, forest: Forest, budget: int = BUDGET) -> None:
    """Joins in ``forest`` the places of all values within ``budget`` bits under the given pairs of nodes.

    ``v``: unsigned 64-bit values, ascending within each node.  ``pairs``: rows
    of a0, a1, b0, b1 (places) of node pairs; equal nodes are joined with
    themselves.
    """
    ones: dict[int, np.ndarray] = {}
    stack = [(63, pairs.astype(np.int64), np.zeros(len(pairs), np.int64))]
    while stack:
        bit, p, err = stack.pop()
        if len(p) > _FRONTIER:
            half = len(p) // 2
            stack += [(bit, p[half:], err[half:]), (bit, p[:half], err[:half])]
            continue
        na, nb = p[:, 1] - p[:, 0], p[:, 3] - p[:, 2]
        leaf = (na * nb <= _PRODUCT) | (bit < 0)
        if leaf.any():
            _compare(v, p[leaf], forest, budget)
            p, err = p[~leaf], err[~leaf]
        if not len(p):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((v >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        c = ones[bit]
        a0, a1, b0, b1 = p.T
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = (a0 == b0) & (a1 == b1)
        nxt = [np.column_stack(x) for x in ((a0, am, b0, bm), (am, a1, bm, b1), (a0, am, bm, b1), (am, a1, b0, bm))]
        e = [err, err, err + 1, err + 1]
        q, w = np.concatenate(nxt), np.concatenate(e)
        keep = (q[:, 1] > q[:, 0]) & (q[:, 3] > q[:, 2]) & (w <= budget)
        keep[3 * len(p) :] &= ~same
        keep &= ~((q[:, 0] == q[:, 2]) & (q[:, 1] - q[:, 0] == 1) & (q[:, 3] - q[:, 2] == 1))
        if keep.any():
            stack.append((bit - 1, q[keep], w[keep]))


def _compare(v: np.ndarray, p: np.ndarray, forest: Forest, budget: int) -> None:
    na, nb = p[:, 1] - p[:, 0], p[:, 3] - p[:, 2]
    n = na * nb
    ends = np.cumsum(n)
    at = 0
    while at < len(p):  # nodes of equal values at the end of the trie may be large
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _FRONTIER, side="right")))
        k = np.repeat(np.arange(at, to), n[at:to])
        off = np.arange(len(k)) - np.repeat(ends[at:to] - n[at:to] - (ends[at - 1] if at else 0), n[at:to])
        i, j = p[k, 0] + off // nb[k], p[k, 2] + off % nb[k]
        near = np.bitwise_count(v[i] ^ v[j]) <= budget
        forest.join(i[near], j[near])
        at = to


def _masks(bits: int) -> list[int]:
    one = [1 << k for k in range(bits)]
    return [0, *one, *(x | y for k, x in enumerate(one) for y in one[k + 1 :])]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): a forest over the distinct fingerprints ``fp`` with the components of all links."""
    rotated = F.array(
        *[F.struct(F.lit(k).alias("r"), (F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", 64 - at)) if at else F.col("fp")).alias("rot"), F.lit(n).alias("depth")) for k, (at, n) in enumerate(BLOCKS)]
    )
    cells = distinct.select(F.explode(rotated).alias("x")).select("x.r", "x.rot", "x.depth").withColumn("block", F.expr("shiftrightunsigned(rot, 64 - depth)"))
    sizes = common.stored(cells.groupBy("r", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "subtries")
    masks = F.array(*[F.array(*[F.lit(m) for m in _masks(d)]) for d in range(MOST_BITS + 1)])
    joined = (
        cells.join(sizes, ["r", "block"])
        .withColumn("bits", F.expr(f"cast(least({MOST_BITS}, greatest(0, ceil(log2(n / {NODE_SIZE}))) ) as int)"))
        .withColumn("node", F.expr("cast(case when bits = 0 then 0 else shiftrightunsigned(shiftleft(rot, depth), 64 - bits) end as int)"))
        .withColumn("mask", F.explode(F.element_at(masks, F.col("bits") + 1)))
        .withColumn("other", F.col("node").bitwiseXOR(F.col("mask")))
        .select("r", "block", F.least("node", "other").alias("lo"), F.greatest("node", "other").alias("hi"), (F.col("node") > F.col("other")).alias("second"), "rot")
    )
    keys = ["r", "block", "lo", "hi"]
    # Unsigned order within a node: the sign bit is turned.
    dealt = joined.repartition(*keys).sortWithinPartitions(*keys, "second", F.col("rot").bitwiseXOR(F.lit(-(2**63))))

    def join_groups(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        r, block, lo, hi, second, rot = cols
        v = rot.view(np.uint64)
        change = np.zeros(len(v), bool)
        change[0] = True
        for c in (r, block, lo, hi):
            change[1:] |= c[1:] != c[:-1]
        g0 = np.flatnonzero(change)
        g1 = np.append(g0[1:], len(v))
        ahead = np.concatenate(([0], np.cumsum(~second)))
        mid = g0 + ahead[g1] - ahead[g0]
        own = lo[g0] == hi[g0]
        pairs = np.column_stack([g0, np.where(own, g1, mid), np.where(own, g0, mid), g1])
        pairs = pairs[(pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2])]
        forest = Forest(len(v))
        trie_join(v, pairs, forest)
        child = np.flatnonzero(forest.root != np.arange(len(v)))
        if not len(child):
            return None
        shift = np.array([at for at, _ in BLOCKS], np.uint64)[r[child]]
        back = [((x >> shift) | np.where(shift == 0, np.uint64(0), x << ((np.uint64(64) - shift) % np.uint64(64)))).view(np.int64) for x in (v[child], v[forest.root[child]])]
        return pa.RecordBatch.from_arrays([pa.array(back[0]), pa.array(back[1])], names=["a", "b"])

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            if len(held[0]) < 1 << 17:
                continue
            same = np.ones(len(held[0]), bool)
            for c in held[:4]:
                same &= c == c[-1]
            cut = int(np.argmax(same))  # the last group may go on
            if cut:
                out = join_groups([c[:cut] for c in held])
                held = [c[cut:] for c in held]
                if out is not None:
                    yield out
        if held and len(held[0]):
            out = join_groups(held)
            if out is not None:
                yield out

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (least doc_id that links lead to) of every row."""
    prints = common.stored(fingerprints(docs), "fingerprints")
    distinct = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components.components(links(distinct.select("fp")), "a", "b")
    rooted = common.stored(
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = common.stored(rooted.select("fp", "root").join(common.stored(named, "named"), "root").select("fp", "component_id"), "components")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the document with the least id stays, once.

    Rows with a null doc_id stay.  Of several rows of one id the one with the least
    text does (then: the least as JSON).
    """
    found = near_duplicates(docs)
    stay = common.stored(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).select(F.col("doc_id").alias("id"), "rows"), "survivors")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # its names are its own
    own = [F.col("row").getField(c).alias(c) for c in docs.columns]
    # A merge join at every size: the list of survivors grows with the documents, so it is never sent to all executors.
    kept = whole.join(stay.hint("merge"), F.col("row.doc_id") == F.col("id"), "inner")
    once = kept.where("rows = 1").select(*own)
    if not stay.where("rows > 1").isEmpty():
        first = F.min_by("row", F.struct("row.text", F.to_json("row"))).alias("row")
        once = once.unionByName(kept.where("rows > 1").groupBy("id").agg(first).select(*own))
    return once.unionByName(docs.where(F.col("doc_id").isNull()))
