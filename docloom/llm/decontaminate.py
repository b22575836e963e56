"""Benchmark decontamination by greedy string tiling.

Method: five-word seeds that a document shares with a benchmark item are joined; for each
pair with seeds enough to reach the threshold, running Karp-Rabin greedy string tiling
marks the longest common token runs that do not overlap, again and again, down to five
tokens. A document is contaminated when the tiles cover at least half of the item's tokens,
in whatever order they stand.

The benchmark's seeds go to the workers in blocks of at most BLOCK_BYTES of text (measured
first), one pass over the documents for each block; documents are not shuffled. The bound on
coverage from seeds alone is exact: every token of a tile lies in a shared seed.

Defined results: tokens are runs without ASCII white space, A-Z lower-cased; null or empty
texts and items with fewer than five tokens give no pair; a repeated item row gives the
pair once per row; rows with equal doc_id are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure, discard, grams, materialize, mix, powers, slices, table, text_bytes, words

SEED = 5
THRESHOLD = 0.5
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, n_tokens long, n_matched long, n_tiles long, coverage double, contaminated boolean"


def tiles(a: np.ndarray, b: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token arrays: (start in a, start in b, length), longest first."""
    free_a, free_b, out = np.ones(len(a), bool), np.ones(len(b), bool), []
    # running Karp-Rabin: prefix sums of token * base^i give any window's hash
    scale = powers(max(len(a), len(b)) + 1)
    sums = [np.append(np.zeros(1, np.uint64), np.cumsum(x * scale[: len(x)])) for x in (a, b)]

    def hashes(k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
        x, free = (a, free_a) if k == 0 else (b, free_b)
        n = len(x) - s + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.append(0, np.cumsum(~free))
        at = np.flatnonzero(taken[s:] == taken[:n])
        return at, (sums[k][at + s] - sums[k][at]) * scale[len(scale) - 1 - at]

    def longest(s: int) -> list[tuple[int, int, int]]:
        """Matches of s or more free tokens that cannot be extended to the left."""
        at_a, h_a = hashes(0, s)
        at_b, h_b = hashes(1, s)
        order = np.argsort(h_b, kind="stable")
        lo, hi = np.searchsorted(h_b[order], h_a, "left"), np.searchsorted(h_b[order], h_a, "right")
        found = []
        for i, x, y in zip(at_a[hi > lo], lo[hi > lo], hi[hi > lo]):
            for j in at_b[order[x:y]]:
                if i and j and a[i - 1] == b[j - 1] and free_a[i - 1] and free_b[j - 1]:
                    continue  # a part of the match that begins further left
                m = min(len(a) - i, len(b) - j)
                same = (a[i : i + m] == b[j : j + m]) & free_a[i : i + m] & free_b[j : j + m]
                n = m if same.all() else int(np.argmin(same))
                if n >= s:
                    found.append((n, int(i), int(j)))
        return found

    s = max(least, min(len(a), len(b)) // 2)
    while True:
        found = longest(s)
        top = max(found, default=(0, 0, 0))[0]
        if top > 2 * s:
            s = top
            continue
        marked = False
        for n, i, j in sorted(found, key=lambda t: (-t[0], t[1], t[2])):
            if free_a[i : i + n].all() and free_b[j : j + n].all():
                free_a[i : i + n] = free_b[j : j + n] = False
                out.append((i, j, n))
                marked = True
        if marked:
            continue  # what a longer tile has cut short may still hold a match
        if s == least:
            return out
        s = max(least, s // 2)


def _tokens(texts: list[str | None]):
    h, _, _, at = words(*text_bytes(pa.array(texts, pa.string())))
    return h, at


class Block:
    """Seeds of benchmark items, sorted by hash."""

    def __init__(self, ids: list, texts: list[str | None]):
        h, at = _tokens(texts)
        self.ids = ids
        self.items = [h[at[i] : at[i + 1]] for i in range(len(ids))]
        seed = [(grams(x, SEED), i) for i, x in enumerate(self.items) if len(x) >= SEED]
        g = np.concatenate([s for s, _ in seed]) if seed else np.zeros(0, np.uint64)
        item = np.concatenate([np.full(len(s), i) for s, i in seed]) if seed else np.zeros(0, np.int64)
        pos = np.concatenate([np.arange(len(s)) for s, _ in seed]) if seed else np.zeros(0, np.int64)
        order = np.argsort(g, kind="stable")
        self.seeds, self.item, self.pos = g[order], item[order], pos[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def pairs(self, column):
        """(row, item, tiles, tokens matched) of contaminated rows of a text column."""
        h, _, _, at = words(*text_bytes(column))
        g = grams(h, SEED)
        near = np.flatnonzero(self.bits[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        row = np.searchsorted(at, near, "right") - 1
        inside = near + SEED <= at[row + 1]
        near, row = near[inside], row[inside]
        lo, hi = np.searchsorted(self.seeds, g[near], "left"), np.searchsorted(self.seeds, g[near], "right")
        n = hi - lo
        if not n.sum():
            return
        # one entry per (document seed, equal item seed)
        flat = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        row, near, item, pos = np.repeat(row, n), np.repeat(near, n), self.item[flat], self.pos[flat]
        order = np.lexsort((near, item, row))
        row, near, item, pos = row[order], near[order], item[order], pos[order]
        cuts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])))
        for x, y in zip(cuts, np.append(cuts[1:], len(row))):
            a = self.items[item[x]]
            need = THRESHOLD * len(a)
            cover = np.zeros(len(a) + 1, np.int64)
            p = np.unique(pos[x:y])
            np.add.at(cover, p, 1)
            np.add.at(cover, p + SEED, -1)
            if (np.cumsum(cover[:-1]) > 0).sum() < need:
                continue
            got = tiles(a, self._near(h, np.unique(near[x:y])))
            matched = sum(t[2] for t in got)
            if matched >= need:
                yield int(row[x]), int(item[x]), len(got), matched

    @staticmethod
    def _near(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The document's tokens inside shared seeds; a token of its own at each gap."""
        at = np.unique((starts[:, None] + np.arange(SEED)).ravel())
        gaps = np.flatnonzero(np.diff(at) > 1) + 1
        return np.insert(h[at], gaps, mix(gaps.astype(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)))


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[Block, bool]]:
    """The benchmark in blocks of bounded size, each collected when its turn comes, and whether
    there are several."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).orderBy("id", "text").collect() if total else []
        if part:
            yield Block([r.id for r in part], [r.text for r in part]), n > 1


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per contaminated (document, item). Of several blocks each one's pairs are written
    before the next block comes to the driver."""
    spark = configure(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for block, several in blocks(benchmark):

        def find(batches, block=block):
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = part.column("doc_id").to_pylist()
                    got = [
                        (ids[r], block.ids[i], len(block.items[i]), m, t, m / len(block.items[i]), True)
                        for r, i, t, m in block.pairs(part.column("text"))
                    ]
                    if got:
                        kinds = [pa.int64()] * 5 + [pa.float64(), pa.bool_()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

        found = rows.mapInArrow(find, SCHEMA)
        out = out.unionByName(materialize(found, "op1-pairs") if several else found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without contaminated rows; one pass a block, no shuffle. What is left of several blocks is
    written before the next block comes to the driver."""
    configure(docs.sparkSession)
    before = None
    for block, several in blocks(benchmark):

        def keep(batches, block=block):
            for batch in batches:
                for part in slices(batch, text_col):
                    ok = np.ones(part.num_rows, bool)
                    for r, *_ in block.pairs(part.column(text_col)):
                        ok[r] = False
                    yield part.filter(pa.array(ok))

        docs = docs.mapInArrow(keep, docs.schema)
        if several:
            docs = materialize(docs, "op1-clean")
            if before is not None:
                discard(before)
            before = docs
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))
