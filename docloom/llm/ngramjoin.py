"""N-gram Jaccard join by partition signatures (PartEnum with subsets of size one): exact groups of near-duplicate texts.

A text's set is its distinct five-word shingles (the whole sequence if it has fewer words).
Two texts link when 100 |A & B| >= 80 |A | B|; the result is the connected components.

Signatures. Sizes fall into bands [l, floor(l / 0.8)]; a set takes part in its own band's
pairs and in the band's below, so that linked sets meet in the band of the smaller one. In
a band, linked sets differ in at most k shingles. The shingle domain is dealt into
n = k + slack partitions by hash; k differences spoil at most k of them, so with E empty
partitions a set agrees with every linked set in at least r = n - k - E partitions that are
not empty. A signature is (band, partition, content of the partition). A set with r <= 0
adds signatures under further hash functions, which two such sets then share.

Large buckets. Passages that many texts hold make buckets of sets that share little else. A
set with fewer large-bucket signatures than r still agrees with each linked set in a
signature of a small bucket, so large buckets only matter between sets that are not so
covered; nothing is dropped.

Links. Equal sets are one class from the start. In each bucket the members are joined with
one of them, in large buckets with the member of most large buckets (a star, not all pairs);
each member is verified against the candidate with which it shares most signatures, which
builds most components. Then every small bucket that still holds several components has its
remaining members compared with its members of other components, first by an upper bound
from small histograms of the sets, then exactly. Members of large buckets that are outside
the main component of their candidate group are counted against the whole group in blocks
of bounded size; a block emits links only.

Sets travel packed by hash range (one row per task and range), are grouped in numpy, and
verified sets are shipped once per member. All intermediate tables are written to the shared
folder; nothing about documents, links or components comes to the driver but counts, and tables
of bounded size that it broadcasts (LOOKUP_BYTES, BROADCAST_BYTES, a bitmap of MARKS bits).

Defined results: null or empty texts, and texts without words, have n_shingles 0 and are
their own component; rows without a doc_id have component_id null and link with nothing;
rows with equal doc_id count as one document for the component, each keeps its own size.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcasts_up_to, configure, discard, grams, input_bytes, materialize, mix, slices, table, text_bytes, trim, words

WORDS = 5
#: Jaccard threshold as a fraction.
NUM, DEN = 80, 100
#: Members beyond which a bucket is large.
LARGE = 12
LEVELS = 4
#: Input bytes for each hash range of signatures.
RANGE_BYTES = 16 << 20
#: Signatures that a task holds before it sends them.
HELD = 500_000


def bands(most: int) -> np.ndarray:
    """Lower ends of the size bands up to `most`."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * DEN // NUM + 1)
    return np.array(out, np.int64)


def differences(upper: np.ndarray) -> np.ndarray:
    """Most differing shingles of a linked pair whose smaller set has at most `upper`:
    |A ^ B| <= (|A| + |B|) (1 - t) / (1 + t), and |B| <= |A| / t."""
    return (upper + upper * DEN // NUM) * (DEN - NUM) // (DEN + NUM)


def shingle_sets(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after another; n + 1 offsets."""
    h, _, _, at = words(*text_bytes(column))
    n = np.diff(at)
    g = grams(h, WORDS)
    doc = np.repeat(np.arange(len(n)), n)[: len(g)]
    inside = np.arange(len(g)) + WORDS <= at[doc + 1]
    g, doc = g[inside], doc[inside]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        g = np.append(g, np.array([grams(h[at[i] : at[i + 1]], int(n[i]))[0] for i in short], np.uint64))
        doc = np.append(doc, short)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(n) + 1))


def set_keys(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    n = np.diff(at)
    out = np.zeros(len(n), np.uint64)
    if len(x):
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(x ^ np.uint64(0x51ED270B))))
        out = mix((sums[at[1:]] - sums[at[:-1]]) + n.astype(np.uint64))
    return out.view(np.int64)


def signatures(x: np.ndarray, at: np.ndarray):
    """Arrays (signature, set index, slot, r): slot is 8 * band + level, r the number of
    signatures of that slot that a set shares with every set it links with."""
    n = np.diff(at)
    low = bands(int(n.max(initial=1)))
    own = np.searchsorted(low, n, "right") - 1
    out = []
    for back in (0, 1):
        band = own - back
        live = np.flatnonzero((n > 0) & (band >= 0))
        k = differences(low[np.minimum(band + 1, len(low) - 1)] - 1)
        live = live[k[live] > 0]
        for level in range(LEVELS):
            if not len(live):
                break
            kk, bb = k[live], band[live]
            parts = kk + np.maximum(3, -(-7 * kk // 20))
            size = n[live]
            row = np.repeat(np.arange(len(live)), size)
            v = x[np.repeat(at[live] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())]
            seed = mix((bb * 8 + level + 1).astype(np.uint64))
            part = (mix(v ^ seed[row]) % parts[row].astype(np.uint64)).astype(np.int64)
            cell = np.append(0, np.cumsum(parts))[:-1][row] + part
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            content = np.add.reduceat(mix(v[order] + np.uint64(7)), head)
            row, part = row[order][head], part[order][head]
            sig = mix(content ^ (seed[row] + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            r = parts - kk - (parts - np.bincount(row, minlength=len(live)))
            out.append((sig, live[row], bb[row] * 8 + level, r[row]))
            live = live[r <= 0]
        if len(live):  # every hash function has failed such sets; they share one bucket
            bb = band[live] * 8 + LEVELS
            out.append((mix(bb.astype(np.uint64) + np.uint64(1 << 40)), live, bb, np.ones(len(live), np.int64)))
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    return tuple(np.concatenate(c) for c in zip(*out))


def sketch(x: np.ndarray) -> bytes:
    """Counts of a set over a power of two of bins, about four to a bin."""
    bits = max(0, int(len(x) // 4).bit_length())
    counts = np.bincount((mix(x + np.uint64(99)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64), minlength=1 << bits)
    wide = counts.max(initial=0) > 255
    return (b"2" if wide else b"1") + counts.astype("<u2" if wide else "u1").tobytes()


def _counts(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u2" if b[:1] == b"2" else "u1", offset=1).astype(np.int64)


def may_link(a: bytes, b: bytes, na: int, nb: int) -> bool:
    """False only if the two sets cannot link."""
    if DEN * min(na, nb) < NUM * max(na, nb):
        return False
    x, y = _counts(a), _counts(b)
    if len(x) > len(y):
        x = x.reshape(len(y), -1).sum(axis=1)
    elif len(y) > len(x):
        y = y.reshape(len(x), -1).sum(axis=1)
    return links(int(np.minimum(x, y).sum()), na, nb)


def links(both: int, na: int, nb: int) -> bool:
    return DEN * both >= NUM * (na + nb - both)


def pack(x: np.ndarray) -> bytes:
    """Six low bytes of each signature: their range holds the rest."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def body(x: np.ndarray) -> bytes:
    """A set as bytes: whole hashes, as exact counts need."""
    return x.astype("<u8").tobytes()


def unbody(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u8")


# --- worker functions -------------------------------------------------------------------

_ENTRY = np.dtype([("key", "<i8"), ("r", "<i4"), ("slot", "<i2"), ("n", "<u4")])


def _info(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            x, at = shingle_sets(part.column("text"))
            marks = [sketch(x[at[i] : at[i + 1]]) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(set_keys(x, at)), pa.array(marks, pa.binary())], ["doc_id", "n", "key", "sketch"])


def _packed(ranges: int):
    """Signatures by hash range: entries (class, r, slot, count) and the signatures' six low bytes."""

    def run(batches):
        seen: set[int] = set()
        held, total = [], 0

        def flush():
            key, slot, r, sig = (np.concatenate(c) for c in zip(*held))
            p = (sig >> np.uint64(48)).astype(np.int64) * ranges >> 16
            order = np.lexsort((slot, key, p))
            p, key, slot, r, sig = p[order], key[order], slot[order], r[order], sig[order]
            new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (key[1:] != key[:-1]) | (slot[1:] != slot[:-1])))
            size = np.diff(np.append(new, len(p)))
            e = np.zeros(len(new), _ENTRY)
            e["key"], e["r"], e["slot"], e["n"] = key[new], r[new], slot[new], size
            ps, first = np.unique(p[new], return_index=True)
            last = np.append(first[1:], len(new))
            bodies = []
            for a, b in zip(first, last):
                s = sig[new[a] : new[b] if b < len(new) else len(p)]
                bodies.append((e[a:b].tobytes(), pack(s)))
            return pa.RecordBatch.from_arrays([pa.array(ps, pa.int32()), pa.array([b[0] for b in bodies], pa.binary()), pa.array([b[1] for b in bodies], pa.binary())], ["p", "entries", "sigs"])

        for batch in batches:
            for part in slices(batch, "text"):
                x, at = shingle_sets(part.column("text"))
                keys = set_keys(x, at)
                fresh = []
                for i, k in enumerate(keys.tolist()):
                    if k not in seen and at[i + 1] > at[i]:
                        seen.add(k)
                        fresh.append(i)
                if not fresh:
                    continue
                n = np.diff(at)[fresh]
                idx = np.repeat(at[fresh] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                sig, who, slot, r = signatures(x[idx], np.append(0, np.cumsum(n)))
                held.append((keys[fresh][who], slot, r, sig))
                total += len(sig)
                if total >= HELD:
                    yield flush()
                    held, total = [], 0
        if total:
            yield flush()

    return run


_FOUND = "kind int, bucket long, slot int, a long, b long, n int"
#: kind of a found row: member of a small bucket list (a: member), of a large bucket (a: member,
#: n: r), star pair (a < b, n: signatures shared), large-bucket count of a set (a, n; b: r).
MEMBER, LARGE_MEMBER, STAR, COUNT = range(4)


def _buckets(batches):
    """Blobs sorted by hash range -> found rows, one range at a time."""
    now, entries, sigs = None, [], []
    for batch in batches:
        for p, e, s in zip(batch.column("p").to_pylist(), batch.column("entries"), batch.column("sigs")):
            if p != now and entries:
                yield from _range(entries, sigs)
                entries, sigs = [], []
                trim()
            now = p
            entries.append(np.frombuffer(e.as_py(), _ENTRY))
            sigs.append(s.as_py())
    if entries:
        yield from _range(entries, sigs)
    trim()


def _range(entries: list, sigs: list):
    e, sig = np.concatenate(entries), unpack(b"".join(sigs))
    entries.clear()
    sigs.clear()
    of = np.repeat(np.arange(len(e)), e["n"])
    order = np.lexsort((e["key"][of], sig))
    sig, of = sig[order], of[order]
    key = e["key"][of]
    new = np.append(True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]))
    sig, of, key = sig[new], of[new], key[new]
    head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    size = np.diff(np.append(head, len(sig)))
    kinds: list[tuple] = []

    def put(kind, bucket, slot, a, b, n):
        m = len(a)
        full = lambda v, t: pa.array(np.broadcast_to(np.asarray(v), m).astype(t))
        kinds.append(pa.RecordBatch.from_arrays([full(kind, np.int32), full(bucket, np.int64), full(slot, np.int32), pa.array(a), full(b, np.int64), full(n, np.int32)], ["kind", "bucket", "slot", "a", "b", "n"]))

    def members(which):
        """Flat positions of the given buckets' members, and the bucket of each."""
        s = size[which]
        return np.repeat(head[which] - np.append(0, np.cumsum(s)[:-1]), s) + np.arange(s.sum()), np.repeat(np.arange(len(which)), s)

    small = np.flatnonzero((size > 1) & (size <= LARGE))
    if len(small):
        at, b = members(small)
        # buckets with equal members need one list; their number counts for the star
        lists = np.add.reduceat(mix(key[at].view(np.uint64)), np.append(0, np.cumsum(size[small])[:-1]))
        ids, first, times = np.unique(lists, return_index=True, return_counts=True)
        at, b = members(small[first])
        lead = key[head[small[first]]][b]
        put(MEMBER, ids.view(np.int64)[b], 0, key[at], 0, 0)
        # the least member of a small bucket is its star's centre
        put(STAR, 0, 0, lead[lead != key[at]], key[at][lead != key[at]], times[b][lead != key[at]])
    large = np.flatnonzero(size > LARGE)
    if len(large):
        at, b = members(large)
        put(LARGE_MEMBER, sig[head[large]].view(np.int64)[b], e["slot"][of[at]], key[at], 0, e["r"][of[at]])
        who = np.stack([key[at], e["slot"][of[at]].astype(np.int64), e["r"][of[at]].astype(np.int64)], axis=1)
        who, times = np.unique(who, axis=0, return_counts=True)
        put(COUNT, 0, who[:, 1], who[:, 0].copy(), who[:, 2], times)
    yield from kinds


def _sets(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            x, at = shingle_sets(part.column("text"))
            # rows that share a doc_id may bring other texts
            own = np.flatnonzero(set_keys(x, at) == part.column("key").to_numpy())
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(own)), pa.array([body(x[at[i] : at[i + 1]]) for i in own], pa.binary())], ["key", "body"])


def _block(key, table):  # applyInArrow cannot read string annotations
    """Links between the remaining members (left) and all members (right) of a block, one for
    each pair of a left member and a component."""
    left = table.filter(table.column("left"))
    right = table.filter(pa.compute.invert(table.column("left")))
    bodies = [unbody(b.as_py()) for b in right.column("body")]
    a_out, b_out = [], []
    if bodies and left.num_rows:
        flat, size = np.concatenate(bodies), np.array([len(b) for b in bodies])
        known, code = np.unique(flat, return_inverse=True)
        begin = np.append(0, np.cumsum(size)[:-1])
        keys, comps = right.column("key").to_numpy(), right.column("comp").to_numpy()
        for k, c, raw in zip(left.column("key").to_pylist(), left.column("comp").to_pylist(), left.column("body")):
            x = unbody(raw.as_py())
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            mark = np.zeros(len(known), np.int32)
            mark[at[known[at] == x]] = 1
            both = np.add.reduceat(mark[code], begin)
            near = np.flatnonzero((DEN * both >= NUM * (len(x) + size - both)) & (comps != c))
            _, first = np.unique(comps[near], return_index=True)
            a_out += [k] * len(first)
            b_out += keys[near[first]].tolist()
    return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})


def _bounded(batches):
    for batch in batches:
        ok = [may_link(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b")))]
        yield batch.select(["a", "b", "shared"]).filter(pa.array(ok, pa.bool_()))


def _verified(batches):
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("body_a"), batch.column("body_b")):
            x, y = unbody(x.as_py()), unbody(y.as_py())
            both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            ok.append(links(both, len(x), len(y)))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


# --- plan -------------------------------------------------------------------------------


def _tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """(key, comp) of the vertices of edges (a, b). Each round points every vertex at its least
    neighbour, follows the pointers to their ends and contracts the edges to those; rounds
    and steps are written tables. Ends when no edge is left between two labels."""
    now, total = materialize(edges.where("a != b").select("a", "b").distinct(), "op5-edges"), None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy(F.col("a").alias("key")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "op5-labels")
        while True:
            far = up.select(F.col("key").alias("comp"), F.col("comp").alias("far"))
            step = materialize(up.join(far, "comp").select("key", F.col("far").alias("comp"), (F.col("far") != F.col("comp")).alias("moved")), "op5-labels")
            moved = step.where("moved").limit(1).count()
            discard(up)
            up = step.select("key", "comp")
            up._docloom_path = step._docloom_path
            if not moved:
                break
        if total is None:
            total = up
        else:
            new = total.join(up.select(F.col("key").alias("comp"), F.col("comp").alias("new")), "comp", "left")
            total = materialize(new.select("key", F.coalesce("new", "comp").alias("comp")), "op5-labels")
        for side in ("a", "b"):
            now = now.join(up.select(F.col("key").alias(side), F.col("comp").alias(f"{side}_comp")), side)
        now = materialize(now.where("a_comp != b_comp").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct(), "op5-edges")
        if not now.limit(1).count():
            return total


def _pairs_with(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b, ...) with the named columns of both sets, suffixed."""
    own = pairs.columns
    for side in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("key").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs.select(*own, *[f"{c}_{s}" for c in columns for s in "ab"])


def _possible(pairs: DataFrame, classes: DataFrame, tag: str) -> DataFrame:
    """The pairs (a, b, shared) that sizes and sketches leave."""
    return materialize(_pairs_with(pairs, classes, ["sketch", "n"]).mapInArrow(_bounded, "a long, b long, shared long"), tag)


def _links(pairs: DataFrame, sets: DataFrame, tag: str) -> DataFrame:
    return materialize(_pairs_with(pairs.select("a", "b"), sets, ["body"]).mapInArrow(_verified, "a long, b long"), tag)


#: Bytes of (key, doc_id) rows up to which they are broadcast to the scan of the documents: the
#: driver builds and holds what is broadcast, at several times that size.
LOOKUP_BYTES = 1 << 20
#: Bytes up to which Spark may broadcast a side of a join by itself.
BROADCAST_BYTES = 1 << 20
#: Bits of the bitmap of wanted documents, and of one of its rows (Spark's bitmaps).
MARKS, MARKS_ROW = 1 << 23, 1 << 15


def _marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of wanted documents and a few others: those whose hashed doc_id has a bit in a
    bitmap of one size for any input."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    row, bit = F.floor(at / MARKS_ROW).alias("_row"), (at % MARKS_ROW).alias("_bit")
    marks = wanted.select(row, bit).groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_marks"))
    byte = F.conv(F.hex(F.substring("_marks", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.select("*", row, bit).join(F.broadcast(marks), "_row").where(F.getbit(byte, F.col("_bit") % 8) == 1)
    return found.select(rows.columns)


def _fetch(keys: DataFrame, classes: DataFrame, rows: DataFrame, repeated: bool) -> DataFrame:
    """key, body of the wanted classes, read from one document of each."""
    wanted = materialize(keys.distinct().join(classes.select("key", "rep"), "key").select("key", F.col("rep").alias("doc_id")), "op5-wanted")
    small = wanted.count() * 16 <= LOOKUP_BYTES
    sets = rows.join(F.broadcast(wanted), "doc_id") if small else _marked(rows, wanted).join(wanted.hint("shuffle_hash"), "doc_id")
    sets = sets.select("key", "text").mapInArrow(_sets, "key long, body binary")
    # rows that share a doc_id may bring the same text again
    return materialize(sets.dropDuplicates(["key"]) if repeated else sets, "op5-sets")


def _both_keys(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    with broadcasts_up_to(configure(docs.sparkSession), BROADCAST_BYTES):
        return _near_duplicates(docs, id_col, text_col)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    info = materialize(rows.mapInArrow(_info, "doc_id long, n long, key long, sketch binary"), "op5-info")
    known = info.where("n > 0 and doc_id is not null")
    classes = known.groupBy("key").agg(F.min("doc_id").alias("rep"))
    classes = classes.join(known.select("key", F.col("doc_id").alias("rep"), "n", "sketch"), ["key", "rep"])
    repeated = _repeated(info)
    classes = materialize(classes.dropDuplicates(["key"]) if repeated else classes, "op5-classes")

    ranges = max(16, -(-input_bytes(docs) // RANGE_BYTES))
    packed = rows.where("doc_id is not null").select("text").mapInArrow(_packed(ranges), "p int, entries binary, sigs binary")
    found = materialize(packed.repartitionById(ranges, F.col("p")).sortWithinPartitions("p").mapInArrow(_buckets, _FOUND), "op5-found")
    _tidy(spark)

    # sets that small buckets do not cover, by slot; their members of large buckets
    count = found.where(f"kind = {COUNT}").groupBy("a", "slot").agg(F.sum("n").alias("large"), F.max("b").alias("r"))
    open_ = count.where("large >= r").select("a", "slot")
    hot = materialize(found.where(f"kind = {LARGE_MEMBER}").join(open_, ["a", "slot"]).select("bucket", F.col("a").alias("key")), "op5-large")
    degree = materialize(hot.groupBy("key").agg(F.count("*").alias("degree")), "op5-degrees")
    lead = hot.join(degree, "key").groupBy("bucket").agg(F.max_by("key", F.struct("degree", "key")).alias("a"), F.count("*").alias("m")).where("m > 1")
    lead = materialize(lead.select("bucket", "a"), "op5-leads")
    large = hot.join(lead, "bucket").where("key != a").groupBy("a", F.col("key").alias("b")).agg(F.count("*").alias("n"))
    large = materialize(large, "op5-large-star")
    star = found.where(f"kind = {STAR}").select("a", "b", "n").union(large).groupBy("a", "b").agg(F.sum("n").cast("long").alias("shared"))
    star = _possible(star, classes, "op5-star")
    best = materialize(star.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")), "op5-best")
    member = found.where(f"kind = {MEMBER}").select("bucket", F.col("a").alias("key")).distinct()
    member = materialize(member, "op5-members")
    discard(lead, star, found)

    sets = _fetch(_both_keys(best).union(degree.select("key")), classes, rows, repeated)
    link = _links(best, sets, "op5-links")
    comp = components(link)
    _tidy(spark)

    # small buckets that still hold several components
    mixed = member.join(comp, "key", "left").select("bucket", "key", F.coalesce("comp", "key").alias("comp"))
    mixed = materialize(mixed, "op5-labelled")
    several = mixed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("bucket")
    mixed = mixed.join(several, "bucket").join(classes.select("key", "n", "sketch"), "key")
    mixed = mixed.groupBy("bucket").agg(F.collect_list(F.struct("key", "comp", "n", "sketch")).alias("m"))  # at most LARGE
    cross = mixed.mapInArrow(_cross, "a long, b long").distinct()
    done = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = materialize(cross.join(done, ["a", "b"], "left_anti"), "op5-cross")  # verified already
    discard(member)
    more = _links(cross, _fetch(_both_keys(cross), classes, rows, repeated), "op5-more")
    _tidy(spark)
    if large.limit(1).count():
        more = materialize(more.union(_group_links(large, degree, comp, sets, classes)), "op5-more")
    if repeated:  # the texts of one doc_id are one document
        several = known.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a != z")
        more = materialize(more.union(known.join(several, "doc_id").where("key != a").select("a", F.col("key").alias("b"))), "op5-more")
    if more.limit(1).count():
        comp = components(link.union(more))

    # a component may hold a third of all classes: both sides of the join on it are plain tables
    least = materialize(comp.join(classes.select("key", "rep"), "key").groupBy("comp").agg(F.min("rep").alias("component_id")), "op5-least")
    named = comp.join(least, "comp").select("key", "component_id")
    final = classes.select("key", "rep").join(named, "key", "left").select("key", F.coalesce("component_id", "rep").alias("component_id"))
    final = materialize(final, "op5-final")
    # the caller's thresholds hold when this runs: no table of all classes is to be broadcast
    out = info.drop("sketch").join(final.hint("merge"), "key", "left")
    mine = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id"))
    if repeated:  # a text without words belongs to its document as well
        whole = out.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("component_id").alias("_whole"))
        out = out.join(whole.hint("merge"), F.col("doc_id") == F.col("_id"), "left").select("doc_id", "n_shingles", F.coalesce("_whole", "component_id").alias("component_id"))
    return out


def _cross(batches):
    """Pairs of members of different components in small buckets that sizes and sketches leave."""
    for batch in batches:
        pairs = set()
        for row in batch.column("m").to_pylist():
            row.sort(key=lambda m: m["key"])
            for i, x in enumerate(row):
                for y in row[i + 1 :]:
                    if x["comp"] != y["comp"] and (x["key"], y["key"]) not in pairs and may_link(x["sketch"], y["sketch"], x["n"], y["n"]):
                        pairs.add((x["key"], y["key"]))
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


#: Bytes of packed sets on each side of a block.
BLOCK_BYTES = 1 << 18


def _group_links(star: DataFrame, members: DataFrame, comp: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of members of large buckets that the star has left outside the main
    component of their candidate group (the stars' connected components)."""
    group = components(star).select("key", F.col("comp").alias("grp"))
    one = members.select("key").join(group, "key").join(comp, "key", "left").join(classes.select("key", "n"), "key")
    one = materialize(one.select("key", "grp", F.coalesce("comp", "key").alias("comp"), "n"), "op5-groups")
    sizes = one.groupBy("grp", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("size"))
    groups = sizes.groupBy("grp").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.sum("size").alias("size"), F.count("*").alias("comps"), F.max("m").alias("top"), F.sum("m").alias("all")).where("comps > 1")
    # block counts: bytes of all members, and of the remaining ones at the group's mean
    blocks = lambda share: F.ceil(F.col("size") * 8 * share / BLOCK_BYTES).cast("int")
    groups = groups.select("grp", "main", blocks(F.lit(1.0)).alias("right_blocks"), F.greatest(blocks(1 - F.col("top") / F.col("all")), F.lit(1)).alias("left_blocks"))
    one = materialize(one.join(groups, "grp"), "op5-grouped")
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = one.where("comp != main").select("key", "grp", "comp", F.lit(True).alias("left"), own("left_blocks").alias("l"), every("right_blocks").alias("r"))
    right = one.select("key", "grp", "comp", F.lit(False).alias("left"), every("left_blocks").alias("l"), own("right_blocks").alias("r"))
    both = left.union(right).join(sets.select("key", "body"), "key")
    return both.groupBy("grp", "l", "r").applyInArrow(_block, "a long, b long")


def _repeated(info: DataFrame) -> bool:
    return bool(info.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count())


def op5_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the least doc_id stays; rows
    without a doc_id stay."""
    keep = near_duplicates(docs).where("component_id = doc_id").select(F.col("doc_id").alias("_dl_id")).distinct()
    known = docs.where("doc_id is not null").join(keep.hint("merge"), F.col("doc_id") == F.col("_dl_id"), "left_semi")
    return known.unionByName(docs.where("doc_id is null"))
