"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are compared in buckets of a banding index. Within a bucket the fingerprints are stored vertically: plane b
holds bit b of 64 fingerprints per machine word. A query's differences to 64 fingerprints are added plane by plane into
carry-save counters, and a block is abandoned as soon as all its 64 counters exceed the radius.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm._common import chunks, durable, let_go, mix, text_or_empty
from residua.llm._components import components

#: Rows of a bucket that are compared in one group; larger buckets are split into pairs of blocks of about this size.
BLOCK_ROWS = 1024
#: Shingles of a block whose similarities are checked.
BLOCK_SHINGLES = 2 << 20
#: Masks whose buckets are compared in one pass: what is shuffled at once is so many rows for each fingerprint.
MASKS_AT_ONCE = 16
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `words` words of a text with A-Z in lower case, repeats included."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_digest
    if len(found) <= words:
        got = digest(joined, seed)
    else:
        ends = list(accumulate(map((1).__add__, map(len, found))))
        got = b"".join([digest(joined[s : e - 1], seed) for s, e in zip([0, *ends], ends[words - 1 :])])
    return np.frombuffer(got, dtype=">u8").astype(np.uint64)


def majority_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each of the runs of hashes between offsets, the bits that are set in over half of it; 0 for an empty run."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.uint64)
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return out
    # Byte lanes count up to 255, so runs are summed in pieces of 255 first.
    pieces = -(-sizes[rows] // 255)
    first = np.concatenate([[0], np.cumsum(pieces)])[:-1]
    at = np.repeat(offsets[:-1][rows], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = counts * 2 > sizes[rows, None]
        for byte in range(8):
            out[rows] |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, h, text): h is a hash of the text, so that rows that share an id but not their text are told apart."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _kind(docs: DataFrame, id_col: str) -> str:
    return docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, width: int = 1, distinct: bool = False) -> DataFrame:
    """Rows (id, h, w0, ... long) with the SimHash of each text, 64 bits for each of `width` words, and h, a hash of the text. A text without words has 0. distinct: a shingle counts once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            each = [shingle_hashes(t, words) for t in part.column("text").cast(pa.binary()).to_pylist()]
            if distinct:
                each = [np.unique(h) for h in each]
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in each])]).astype(np.int64)
            hashes, columns = np.concatenate(each), [part.column("id"), part.column("h")]
            for k in range(width):
                own = hashes if not k else mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
                columns.append(pa.array(majority_bits(own, offsets).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["id", "h", *[f"w{k}" for k in range(width)]])

    fields = ", ".join(f"w{k} long" for k in range(width))
    return _rows(docs, id_col, text_col).mapInArrow(run, f"id {_kind(docs, id_col)}, h long, {fields}")


def _bands(bits: int, radius: int, bands: int) -> list[int]:
    """Masks of all choices of bands - radius bands: fingerprints within the radius agree on one of them at least."""
    edges = [bits * i // bands for i in range(bands + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in itertools.combinations(parts, bands - radius)]


def _sampled(bits: int, rate: float, rows: int, recall: float) -> list[int]:
    """Masks of sampled bit positions, so that a pair whose bits differ at the given rate agrees on one mask with probability `recall`. Longer masks for more rows keep buckets at about BLOCK_ROWS rows; their number grows with about the fourth root of the rows."""
    length = max(8, math.ceil(math.log2(max(rows, 2) / BLOCK_ROWS)))
    number = math.ceil(math.log(1 - recall) / math.log(1 - (1 - rate) ** length))
    draw, masks = random.Random(7), []
    while len(masks) < number:  # masks of one shuffle share no bit, so a pair seldom misses all of them
        order = draw.sample(range(bits), bits)
        masks += [sum(1 << b for b in order[k : k + length]) for k in range(0, bits - length + 1, length)]
    return masks[:number]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges of a minimum spanning forest (Boruvka)."""
    order = np.argsort(d, kind="stable")
    a, b, d = a[order], b[order], d[order]
    root, chosen, left = np.arange(n), [], np.arange(len(a))
    while True:
        ra, rb = root[a[left]], root[b[left]]
        left, ra, rb = left[ra != rb], ra[ra != rb], rb[ra != rb]
        if not len(left):
            break
        best = np.full(n, len(a))
        np.minimum.at(best, ra, left)
        np.minimum.at(best, rb, left)
        taken = np.unique(best[best < len(a)])
        chosen.append(taken)
        while True:  # hook roots on smaller roots, then shorten
            ta, tb = root[a[taken]], root[b[taken]]
            if not (apart := ta != tb).any():
                break
            np.minimum.at(root, np.maximum(ta, tb)[apart], np.minimum(ta, tb)[apart])
            while not np.array_equal(root, short := root[root]):
                root = short
    keep = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
    return a[keep], b[keep], d[keep]


def bit_sliced_pairs(words: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int, slab: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (query row, other row, distance) within the radius, for each row against rows low[row] to high[row].

    words: n x width uint64. Blocks of 64 rows are compared at once for many queries; a block leaves when no row of it can stay within the radius.
    """
    n, width = words.shape
    pad = -n % 64
    planes = np.unpackbits(np.concatenate([words, np.zeros((pad, width), np.uint64)]).view(np.uint8), axis=1, bitorder="little").T
    planes = np.packbits(np.ascontiguousarray(planes), axis=1, bitorder="little").view(np.uint64)
    bits = radius.bit_length()
    begin = low >> 6
    count = np.where(low < high, ((high - 1) >> 6) - begin + 1, 0)
    total = np.cumsum(count)
    full, start = ~np.uint64(0), 0
    while start < n:
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + slab, side="right")))
        q = np.repeat(np.arange(start, end), count[start:end])
        w = begin[q] + np.arange(len(q)) - (np.cumsum(count[start:end]) - count[start:end])[q - start]
        start = end
        if not len(q):
            continue
        first, last = np.maximum(low[q] - 64 * w, 0), np.minimum(high[q] - 64 * w, 64)
        live = (full << first.astype(np.uint64)) & (full >> (64 - last).astype(np.uint64))
        sums = [np.zeros(len(q), np.uint64) for _ in range(max(bits, 2))]
        over = np.zeros(len(q), np.uint64)
        for p in range(0, 64 * width, 4):
            own = words[q, p >> 6]
            d = [planes[p + i, w] ^ -((own >> np.uint64((p + i) & 63)) & np.uint64(1)) for i in range(4)]
            # Two carry-save adders take four planes into the ones, a third takes their carries into the twos.
            x = sums[0] ^ d[0]
            c0 = (sums[0] & d[0]) | (x & d[1])
            x ^= d[1]
            y = x ^ d[2]
            c1 = (x & d[2]) | (y & d[3])
            sums[0] = y ^ d[3]
            x = sums[1] ^ c0
            carry = (sums[1] & c0) | (x & c1)
            sums[1] = x ^ c1
            for k in range(2, len(sums)):
                sums[k], carry = sums[k] ^ carry, sums[k] & carry
            over |= carry
            if p % 16 == 12 or p + 4 == 64 * width:
                more, same = over.copy(), ~over
                for k in reversed(range(len(sums))):
                    if radius >> k & 1:
                        same &= sums[k]
                    else:
                        more |= same & sums[k]
                        same &= ~sums[k]
                live &= ~more
                stay = live != 0
                if stay.mean() < 0.7:
                    q, w, live, over = q[stay], w[stay], live[stay], over[stay]
                    sums = [s[stay] for s in sums]
                if not len(q):
                    break
        if len(q) and (at := np.flatnonzero(live)).size:
            lanes = np.unpackbits(live[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(lanes)
            a, b = q[at][row], 64 * w[at][row] + lane
            yield a, b, np.bitwise_count(words[a] ^ words[b]).sum(axis=1)


def _linked(width: int, radius: int):
    """mapInArrow function: rows (group, side, id, w...) sorted by group and side to the spanning links of each group."""
    names = [f"w{k}" for k in range(width)]
    keys = ["group", "side", "id"]

    def compare(group: np.ndarray, side: np.ndarray, ids: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(group)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(starts, n))
        high = np.repeat(starts + sizes, sizes)
        low = np.arange(n) + 1
        two = np.repeat(np.maximum.reduceat(side, starts) == 2, sizes)  # a pair of blocks: the first one's rows against the second one's
        if two.any():
            ones = np.repeat(starts + np.add.reduceat((side == 1).astype(np.int64), starts), sizes)
            low = np.where(two, np.where(side == 1, ones, high), low)
        kept, held = [], 0
        for part in bit_sliced_pairs(words, low, high, radius):
            kept.append(part)
            held += len(part[0])
            if held > 1 << 20:
                kept = [_forest(n, *(np.concatenate(x) for x in zip(*kept)))]
                held = len(kept[0][0])
        if not kept:
            return
        a, b, _ = _forest(n, *(np.concatenate(x) for x in zip(*kept)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                now = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
                now.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in names], axis=1))
                rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
                cut = int(np.searchsorted(rest[0], rest[0][-1]))  # the last group may go on
            elif rest is None:
                return
            else:
                cut = len(rest[0])
            if cut:
                yield from compare(*(x[:cut] for x in rest))
                rest = [x[cut:] for x in rest]

    return run


def links(fps: DataFrame, masks: list[int], radius: int, width: int = 1, block: int = BLOCK_ROWS) -> DataFrame:
    """Rows (a, b): for each bucket of the masks, a spanning forest of the pairs of rows (id, w0, ...) within the radius.

    A bucket over `block` rows is split by a hash of the id into blocks, and each pair of blocks is a group of its own,
    so every pair of a bucket is compared, no group has over about two blocks, and a group gives at most as many links as rows.
    """
    names = [f"w{k}" for k in range(width)]
    keys = [F.xxhash64(F.lit(t), *[F.col(c).bitwiseAND(F.lit(_signed(m >> 64 * k & (1 << 64) - 1))) for k, c in enumerate(names)]) for t, m in enumerate(masks)]
    rows = fps.select("id", *names, F.explode(F.array(*keys)).alias("group")).withColumn("side", F.lit(0))
    hot = durable(rows.groupBy("group").count().where(F.col("count") > block).select("group", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    if n := hot.count():
        hot = F.broadcast(hot) if n <= 100_000 else hot
        rows = rows.join(hot, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        pair = F.when(F.col("blocks") == 1, F.col("group")).otherwise(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")))
        rows = rows.select("id", *names, pair.alias("group"), side.alias("side"))
    rows = rows.select("group", "side", "id", *names).repartition("group").sortWithinPartitions("group", "side")
    return rows.mapInArrow(_linked(width, radius), "a long, b long")


def found_links(fps: DataFrame, masks: list[int], radius: int, width: int = 1) -> DataFrame:
    """A durable table of the distinct links of all masks, the smaller id first. Masks are worked in groups of MASKS_AT_ONCE, whose shuffles don't lie on disk together."""
    parts = []
    for k in range(0, len(masks), MASKS_AT_ONCE):
        found = links(fps, masks[k : k + MASKS_AT_ONCE], radius, width)
        parts.append(durable(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    if len(parts) == 1:
        return parts[0]
    whole = durable(functools.reduce(DataFrame.unionByName, parts).distinct())
    let_go(*parts)
    return whole


def _by_group(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each group of batches that are sorted by their column `group`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        group = batch.column("group").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[0].column("group")[0].as_py() != int(group[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _joining(width: int, radius: int, similarity: float):
    """mapInArrow function: rows (group, side, id, component, main, w..., shingles) sorted by group and side to the links of each group that join two components.

    Rows of side 1 are compared with those of side 2: bit-sliced within the radius, then by their exact similarity, nearest
    first, for as long as the two components are still apart. So at most as many links come out as there are components.
    """

    def compare(rows: pa.Table) -> tuple[list[int], list[int]]:
        n, first = rows.num_rows, int((rows.column("side").to_numpy() == 1).sum())
        ids, component, main = (rows.column(c).to_numpy() for c in ("id", "component", "main"))
        words = np.stack([rows.column(f"w{k}").to_numpy().view(np.uint64) for k in range(width)], axis=1)
        shingles = rows.column("shingles").combine_chunks()
        values, at = shingles.values.to_numpy(zero_copy_only=False), shingles.offsets.to_numpy()
        sizes = np.diff(at)
        low, high = np.full(n, first), np.where(np.arange(n) < first, n, first)
        parts = []
        for a, b, d in bit_sliced_pairs(words, low, high, radius, slab=1 << 13):
            # Of two rows that both stand on both sides, one comparison is enough; sizes that differ too much can't be alike.
            keep = (component[a] != component[b]) & (main[b] | (ids[a] < ids[b])) & (np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]))
            parts.append((a[keep], b[keep], d[keep]))
        out: tuple[list[int], list[int]] = ([], [])
        if not parts:
            return out
        a, b, d = (np.concatenate(x) for x in zip(*parts))
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        for k in np.argsort(d, kind="stable").tolist():
            i, j = int(a[k]), int(b[k])
            x, y = top(int(component[i])), top(int(component[j]))
            if x == y:
                continue
            shared = np.intersect1d(values[at[i] : at[i + 1]], values[at[j] : at[j + 1]], assume_unique=True).size
            if shared >= similarity * (sizes[i] + sizes[j] - shared):
                root[x] = y
                out[0].append(int(ids[i]))
                out[1].append(int(ids[j]))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches):
            found = compare(rows)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return run


def joining_links(rows: DataFrame, width: int, radius: int, similarity: float, block: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Rows (a, b): links of rows (id, cluster, component, w0, ..., shingles) that are alike, in one cluster and in different components, as many as join all components that have such links.

    Within a cluster, rows outside its largest component are compared with all rows: the rows of one component aren't
    compared with each other. Both sides are dealt to blocks of bounded rows and shingles, and each pair of blocks is a
    group of its own. What comes out is verified, and as many links as there are components at most.
    """
    names = [f"w{k}" for k in range(width)]
    one = rows.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("s"))
    largest = F.max(F.struct("n", "s", "component"))
    blocks = lambda n, s: F.greatest(F.lit(1), F.ceil(n / block), F.ceil(s / block_shingles)).cast("int")
    of = one.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), largest.alias("top"))
    of = durable(of.select("cluster", F.col("top.component").alias("largest"), blocks(F.col("n"), F.col("s")).alias("all"), blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("others")))
    full = rows.join(of, "cluster").withColumn("main", F.col("component") == F.col("largest"))
    own = lambda number: F.pmod(F.xxhash64("id", F.lit(2)), F.col(number)).cast("int")
    kept = ["id", "component", "main", *names, "shingles"]
    asks = full.where("NOT main").select("cluster", F.lit(1).alias("side"), own("others").alias("i"), F.explode(F.expr("sequence(0, `all` - 1)")).alias("j"), *kept)
    asked = full.select("cluster", F.lit(2).alias("side"), F.explode(F.expr("sequence(0, others - 1)")).alias("i"), own("all").alias("j"), *kept)
    both = asks.unionByName(asked).select(F.xxhash64("cluster", "i", "j").alias("group"), "side", *kept)
    return both.repartition("group").sortWithinPartitions("group", "side").mapInArrow(_joining(width, radius, similarity), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, bands: int = 4) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of docs.

    Two fingerprints link if they differ in at most `radius` of 64 bits; all such links are found. component_id is the
    smallest doc_id reachable over links, its own included. Nulls: a null text is empty; a null doc_id takes part in
    links but is never a component_id unless none else is there (then null). Texts without words have fingerprint 0 and
    link like others; a text of any length is read whole. Repeated rows give repeated rows, and rows that share a doc_id
    but not their text have a fingerprint each. doc_id may be of any type with an order. Other columns are not read. An
    empty table gives no rows.
    """
    base = durable(fingerprints(docs, id_col, text_col, words).drop("h"))
    fps = durable(base.groupBy(F.col("w0").alias("id")).agg(F.min("id").alias("rep")))
    found = components(links(fps.select("id", F.col("id").alias("w0")), _bands(64, radius, bands), radius))
    of = fps.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "rep", F.coalesce("component", "id").alias("component"))
    least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = of.join(least, "component").select(F.col("id").alias("w0"), "component_id")
    return base.join(of, "w0").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Rows (node, shingles) of the texts that wanted (node, id, h) names."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            each = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in part.column("text").cast(pa.binary()).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in each])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(each)))], ["node", "shingles"])

    own = _rows(docs, id_col, text_col).join(wanted, ["id", "h"]).select("node", "text")
    return own.mapInArrow(run, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, recall: float = 0.998) -> DataFrame:
    """The rows of docs without near duplicates: of each group, the row with the smallest doc_id stays.

    Documents link if the Jaccard similarity of their sets of word shingles is `similarity` or more. Candidates come from
    SimHash fingerprints of 256 bits: an index of sampled bits that a pair at the threshold shares with probability
    `recall` (nearer pairs with more), bit-sliced comparison within a radius three standard deviations above the distance
    expected at the threshold, then the exact similarity: first of the links that span each bucket, then, in clusters of
    candidates where such links failed, of all pairs that could still join two groups. Texts with the same set of shingles have one fingerprint and are one document here.

    Nulls: a null text is empty, and all texts without words are copies of each other; rows without doc_id stay. A row is
    known by its doc_id and its text: of repeated rows one stays, and rows that share a doc_id but not their text are
    documents of their own, in the order of a hash of the text. Of rows that differ in other columns alone, the one with
    the smallest hash of those stays. Texts of any length are read whole. doc_id may be of any type with an order. All
    columns are kept, whatever their names. An empty table gives an empty table.
    """
    width, rate = 4, math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * width
    radius = round(bits * rate + 3 * math.sqrt(bits * rate * (1 - rate)))
    names = [f"w{k}" for k in range(width)]
    named = docs.where(F.col(id_col).isNotNull())
    one = F.min(F.struct("id", "h")).alias("rep")
    fps = durable(fingerprints(named, id_col, text_col, words, width, distinct=True).groupBy(*names).agg(one).withColumn("id", F.monotonically_increasing_id()))
    points = fps.select("id", *names)
    masks = _sampled(bits, rate, fps.count(), recall)
    near = found_links(points, masks, radius, width)
    wanted = near.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(fps, "id").select(F.col("id").alias("node"), "rep.id", "rep.h")
    sets = durable(_shingle_sets(named, wanted, id_col, text_col, words))
    shared = F.size(F.array_intersect("x", "y"))

    def checked(pairs: DataFrame) -> DataFrame:
        side = lambda end, name: sets.select(F.col("node").alias(end), F.col("shingles").alias(name))
        pairs = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
        return durable(pairs.select("a", "b", (shared >= similarity * (F.size("x") + F.size("y") - shared)).alias("alike")))

    tried = checked(near)
    found = durable(components(tried.where("alike").select("a", "b")))
    # A pair of a bucket that is alike but still apart has a rejected link on its path in the bucket's forest where the path
    # leaves its components. So only clusters of candidates with rejected links between components can have such pairs.
    lies = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    failed = tried.where("NOT alike").join(lies("a"), "a", "left").join(lies("b"), "b", "left")
    failed = durable(failed.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select(F.col("a").alias("node")).distinct())
    last = found
    if not failed.isEmpty():
        cluster = durable(components(near).withColumnRenamed("component", "cluster"))
        unsure = durable(cluster.join(failed, "node").select("cluster").distinct())
        rows = cluster.join(unsure, "cluster", "left_semi").join(found, "node", "left").select("cluster", F.col("node").alias("id"), F.coalesce("component", "node").alias("component"))
        rows = durable(rows.join(points, "id").join(sets.withColumnRenamed("node", "id"), "id"))
        more = durable(joining_links(rows, width, radius, similarity))
        if not more.isEmpty():
            last = durable(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
        let_go(rows, cluster, unsure, more)
    let_go(near, sets, tried, failed)
    of = fps.join(last.withColumnRenamed("node", "id"), "id", "left").groupBy(F.coalesce("component", "id")).agg(F.min("rep").alias("rep"))
    stay = durable(of.select(F.col("rep.id").alias("__residua_id"), F.col("rep.h").alias("__residua_h")))
    let_go(fps, last, found)
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != text_col and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    key = {"__residua_id": F.col(id_col), "__residua_h": F.xxhash64(text_or_empty(text_col))}
    unique = named.withColumns(key).groupBy(*key).agg(F.min_by(F.struct(*own), F.xxhash64(*others)).alias("row"))
    kept = unique.join(stay, list(key), "left_semi").select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
