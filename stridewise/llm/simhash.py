"""SimHash near-duplicate classes through pigeonhole blocks.

Fingerprints of 64 bits are computed from word shingles; the distinct ones are
split into blocks, as many as their number asks for. Two fingerprints that
differ in at most ``RADIUS`` bits agree in all but RADIUS blocks at least, so
they meet in a bucket keyed by those blocks. Buckets are verified by Hamming
distance and leave only a spanning forest of links, never all pairs.

Near copies begin with the links of their fingerprints. Those whose
fingerprints differ in too many bits for any blocks are found on the sets of
shingles themselves, on which every link is checked.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridewise.llm import textbytes as tb
from stridewise.llm.common import materialize, release
from stridewise.llm.components import components
from stridewise.shipping import partitions

#: Bits that linked fingerprints may differ in.
RADIUS = 3
#: Words of a shingle.
SHINGLE = 3
#: Blocks of a fingerprint, at least and at most; buckets are keyed by all but RADIUS of them.
BLOCKS, MOST_BLOCKS = 5, 9
#: Bits that a bucket's key has beyond those that number the fingerprints, so that buckets stay small at every size.
SPARE_BITS = 3
#: Members of a bucket that are compared in one go; a larger bucket is dealt out as pairs of parts.
PART = 4096

_SEED = 42
_IS_WORD = tb.byte_class((0x20, 0x20), (0x09, 0x0D))
_LANES = np.uint64(0x0101010101010101)
_STEP = 0x9E3779B97F4A7C15


def _fingerprints(column: pa.Array, shingle: int, lanes: int = 1) -> np.ndarray:
    """lanes x 64 fingerprint bits of each text; 0 for texts without words.

    The first lane is the majority of the shingles' XXH64; each further lane
    is that of another scrambling of the same hashes.
    """
    out = np.zeros((len(column), lanes), np.uint64)
    for first, raw, offsets in tb.text_slices(column):
        data = tb.LOWER[raw]
        starts, ends, rows = tb.word_bounds(data, offsets, _IS_WORD)
        if not len(starts):
            continue
        # words apart by exactly one space, so that a shingle is one run of bytes
        keep = np.zeros(len(data) + 1, bool)
        keep[:-1] = _IS_WORD[data]
        keep[ends] = True
        spaced = np.append(data, np.uint8(0x20))
        place = np.cumsum(keep) - 1
        spaced[ends[~_is_start(ends, starts)]] = 0x20
        begin, end = place[starts], place[ends - 1] + 1
        text = spaced[keep].tobytes()
        n_words = np.bincount(rows, minlength=len(offsets) - 1)
        head = np.concatenate([[0], np.cumsum(n_words)[:-1]])
        # shingle i starts at word i; a shorter text has one of all its words
        size = np.minimum(n_words, shingle)
        position = np.arange(len(starts)) - head[rows]
        is_head = position + size[rows] <= n_words[rows]
        is_head &= (n_words[rows] >= shingle) | (position == 0)
        at = np.flatnonzero(is_head)
        last = at + size[rows[at]] - 1
        digest = xxhash.xxh64_digest
        hashes = np.frombuffer(b"".join([digest(text[a:b], _SEED) for a, b in zip(begin[at].tolist(), end[last].tolist(), strict=True)]), ">u8").astype(np.uint64)
        for lane in range(lanes):
            scrambled = tb.mix(hashes + np.uint64(lane * _STEP % (1 << 64))) if lane else hashes
            out[first : first + len(offsets) - 1, lane] = _majority(scrambled, rows[at], len(offsets) - 1)
    return out


def _is_start(ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which ends are also the start of the next row's first word (no gap between rows)."""
    found = np.zeros(len(ends), bool)
    found[:-1] = ends[:-1] == starts[1:]
    return found


def _majority(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Per row, the bits that over half of its hashes have."""
    counts = np.bincount(rows, minlength=n)
    ones = np.zeros((n, 64), np.int64)
    full = counts > 0
    head = np.concatenate([[0], np.cumsum(counts)[:-1]])[full]
    # eight byte-wide counters in each 64-bit lane, emptied before they can overflow
    parts = -(-counts[full] // 255)
    cuts = np.repeat(head, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    first = np.cumsum(parts) - parts
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, cuts)
        wide = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones[full, bit::8] = np.add.reduceat(wide, first, axis=0)
    bits = ones * 2 > counts[:, None]
    return (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, lanes: int = 1) -> DataFrame:
    """Append the signed 64-bit SimHash lanes fp0, fp1, ... of a text column; null texts count as empty ones."""
    names = [f"fp{i}" for i in range(lanes)]
    kept = [c for c in docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in names])
    base = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            prints = _fingerprints(batch.column(len(kept)), shingle, lanes).view(np.int64)
            arrays = [batch.column(i).cast(target.field(i).type) for i in range(len(kept))]
            arrays += [pa.array(np.ascontiguousarray(prints[:, i])) for i in range(lanes)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return base.mapInArrow(run, schema)


def blocks_for(count: int, radius: int = RADIUS) -> int:
    """Blocks by which ``count`` fingerprints spread well: more blocks make longer keys, and more of them."""
    enough = lambda blocks: 64 * (blocks - radius) / blocks >= np.log2(max(1, count)) + SPARE_BITS
    return next((b for b in range(max(BLOCKS, radius + 2), MOST_BLOCKS) if enough(b)), MOST_BLOCKS)


def pigeonhole_keys(blocks: int, radius: int, fp: str = "fp0") -> list[Column]:
    """For each choice of all but ``radius`` blocks, the bits of a 64-bit fingerprint in them."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        keys.append(F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return keys


def _forest(prints: np.ndarray, split: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links that span the components of a bucket's graph.

    prints: a row of lanes for each member. With split > 0 only links between
    the first ``split`` members and the others count. A search in breadth
    visits each member once and compares it with those not reached so far.
    """
    n = len(prints)
    side = np.arange(n) < split
    todo = np.ones(n, bool)
    found_a, found_b = [], []
    for root in range(n):
        if not todo[root]:
            continue
        todo[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            near = todo & (np.bitwise_count(prints ^ prints[i]).sum(axis=1) <= radius)
            if split:
                near &= side != side[i]
            at = np.flatnonzero(near)
            if len(at):
                todo[at] = False
                queue.extend(at.tolist())
                found_a.append(np.full(len(at), i))
                found_b.append(at)
    if not found_a:
        empty = np.zeros(0, np.int64)
        return empty, empty
    return np.concatenate(found_a), np.concatenate(found_b)


def _link_buckets(radius: int, lanes: int):
    """mapInArrow over rows (bucket, pair, side, node, lanes), sorted by bucket and pair: src, dst of links."""

    def links(rows: np.ndarray, bounds: np.ndarray):
        node, side = rows[:, 3], rows[:, 2]
        prints = np.ascontiguousarray(rows[:, 4:]).view(np.uint64)  # bits are counted in unsigned numbers alone
        sizes = np.diff(np.append(bounds, len(rows)))
        two = bounds[sizes == 2]
        near = np.bitwise_count(prints[two] ^ prints[two + 1]).sum(axis=1) <= radius
        near &= (side[two] != side[two + 1]) | (side[two] < 0)
        src, dst = [node[two[near]]], [node[two[near] + 1]]
        for lo, size in zip(bounds[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            split = int((side[lo : lo + size] == 0).sum())
            if side[lo] >= 0 and split in (0, size):
                continue
            a, b = _forest(prints[lo : lo + size], split, radius)
            src.append(node[lo + a])
            dst.append(node[lo + b])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    def run(batches):
        held = np.zeros((0, 4 + lanes), np.int64)
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4 + lanes)], axis=1)
            rows = np.concatenate([held, rows])
            if len(rows):
                bounds = np.concatenate([[0], np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1])
                last = bounds[-1]
                if len(bounds) > 1:
                    yield links(rows[:last], bounds[:-1])
                held = rows[last:].copy()
        if len(held):
            yield links(held, np.zeros(1, np.int64))

    return run


def near_links(prints: DataFrame, keys: list[Column], radius: int, lanes: list[str]) -> DataFrame:
    """Links (src, dst) that span the graph of the nodes within ``radius`` bits over ``lanes``.

    prints: node (long, distinct) and lanes. keys: expressions whose values,
    one by one, name buckets in which close nodes meet. Buckets over PART
    members are cut into parts by a hash; each pair of parts is a group of its
    own, so that no group grows with the data.
    """
    bucket = F.explode(F.array(*[F.xxhash64(F.lit(i), key) for i, key in enumerate(keys)])).alias("bucket")
    spread = prints.select(bucket, "node", *[c for c in lanes if c != "node"])
    large = spread.groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > PART)
    large = materialize(large.select("bucket", F.ceil(F.col("members") / F.lit(PART // 2)).alias("parts")), "simhash-large")
    rows = spread.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(low == high, -1).when(F.col("part") == low, 0).otherwise(1).cast("long")
    rows = rows.select("bucket", (low * F.col("parts") + high).alias("pair"), side.alias("side"), "node", *[F.col(c).alias(f"lane{i}") for i, c in enumerate(lanes)])
    rows = rows.repartition(partitions(prints), "bucket", "pair").sortWithinPartitions("bucket", "pair", "side")
    return rows.mapInArrow(_link_buckets(radius, len(lanes)), "src long, dst long")


def classes(distinct: DataFrame, keys: list[Column], radius: int, lanes: list[str]) -> DataFrame:
    """(node, component_id) where distinct has node, lanes and least, the smallest id of each node's rows."""
    links = materialize(near_links(distinct, keys, radius, lanes), "simhash-links")
    found = components(links, "simhash-components")
    release(links)
    named = distinct.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(least, "component").select("node", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    fingerprint is 16 hex digits; component_id the smallest id in the row's
    class, where classes are the components of the graph that links
    fingerprints within ``radius`` bits. Equal fingerprints are one class.

    Null and empty texts have the fingerprint zero and link as any other; a
    null id stays in the result and never names a class unless its whole
    class has none; repeated rows stay repeated; an empty table gives none.
    Other columns of ``docs`` are not read, so their names do not matter.
    """
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    prints = materialize(with_fingerprints(base, "text", shingle).select("doc_id", F.col("fp0").alias("node")), "simhash-prints")
    distinct = materialize(prints.groupBy("node").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    named = classes(distinct, pigeonhole_keys(blocks or blocks_for(distinct.count(), radius), radius, "node"), radius, ["node"])
    return prints.join(named, "node").select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


#: Words of a near copy's shingle, and the least resemblance (shared of all distinct shingles, in fifths) of near copies.
COPY_SHINGLE, COPY_FIFTHS = 5, 4
#: Sets of up to PREFIX_UP_TO shingles meet by their prefixes; those of over BANDS_FROM by bands: the sizes of near copies
#: differ by a fifth at most, so that each pair has one of the two in common.
BANDS_FROM, PREFIX_UP_TO = 115, 144
#: Bands of a set, and shingles in one: a pair at the bound shares none of the bands once in 300,000 times.
BANDS, BAND_ROWS = 24, 4
#: One of so many texts is counted to learn which shingles are common, and bits of a shingle that the table of them tells apart.
SAMPLED, TABLE_BITS = 8, 20
#: Rows whose keys are sent to all tasks at most; more are joined by a shuffle.
SENT_ROWS = 1 << 18
#: Shingles of a set that let it weigh as much as one more set where sets are dealt into groups.
SET_UNIT = 1024
#: Bits of a set's mark: its shingles' parities, so two marks differ in no more bits than the sets in shingles.
MARK_BITS = 1024


def _shingle_sets(column: pa.Array):
    """(first row, bounds of the rows' sets, distinct shingles of each row, ascending) of each slice."""
    for first, raw, offsets in tb.text_slices(column):
        data = tb.LOWER[raw]
        starts, ends, rows = tb.word_bounds(data, offsets, _IS_WORD)
        n = len(offsets) - 1
        words = tb.word_hashes(data, starts, ends)
        n_words = np.bincount(rows, minlength=n)
        head = np.cumsum(n_words) - n_words
        grams = tb.gram_hashes(words, COPY_SHINGLE)
        inside = tb.same_row(rows, COPY_SHINGLE)
        found, owner = [grams[inside]], [rows[: len(grams)][inside]]
        for size in range(1, COPY_SHINGLE):  # a shorter text has one shingle of all its words
            short = np.flatnonzero(n_words == size)
            if len(short):
                found.append(tb.gram_hashes(words, size)[head[short]])
                owner.append(short)
        grams, owner = np.concatenate(found), np.concatenate(owner)
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), bool)
        new[1:] = (np.diff(owner) != 0) | (grams[1:] != grams[:-1])
        yield first, np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=n))]), grams[new]


def _set_keys(bounds: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row's set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(grams), dtype=np.uint64)])
    return tb.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def with_set_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append ``node``, the key of a text's set of shingles; null texts count as empty ones."""
    kept = [c for c in docs.columns if c != "node"]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("node", T.LongType())])
    base = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.int64)
            for first, bounds, grams in _shingle_sets(batch.column(len(kept))):
                keys[first : first + len(bounds) - 1] = _set_keys(bounds, grams)
            arrays = [batch.column(i).cast(target.field(i).type) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(keys)], schema=target)

    return base.mapInArrow(run, schema)


def _sampled_shingles(batches):
    """(text) -> the shingles of one of SAMPLED texts, of those that meet by prefixes."""
    for batch in batches:
        for _, bounds, grams in _shingle_sets(batch.column(0)):
            sizes = np.diff(bounds)
            chosen = np.repeat((_set_keys(bounds, grams).view(np.uint64) % np.uint64(SAMPLED) == 0) & (sizes <= PREFIX_UP_TO), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(grams[chosen].view(np.int64))], names=["hash"])


def _buckets(cells: np.ndarray, levels: np.ndarray):
    """mapInArrow (text) -> hash, node of the buckets in which near copies meet.

    A small set goes by its prefix: in an order that all sets have in common,
    the part without which too little is left to be shared. The order begins
    with the shingles that are not known as common; what is known decides the
    cost alone. A large set goes by bands: its shingles are dealt by their hashes
    to BANDS x BAND_ROWS bins, and the smallest ones of a band's bins are its key.
    """

    def run(batches):
        common = np.zeros(1 << TABLE_BITS, np.uint8)
        common[cells] = levels
        for batch in batches:
            for _, bounds, grams in _shingle_sets(batch.column(0)):
                sizes = np.diff(bounds)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                keys = _set_keys(bounds, grams)
                small = (sizes <= PREFIX_UP_TO)[owner]
                own, part = owner[small], grams[small]
                part = part[np.lexsort((part, common[part >> np.uint64(64 - TABLE_BITS)], own))]
                head = np.concatenate([[0], np.cumsum(np.where(sizes <= PREFIX_UP_TO, sizes, 0))])
                taken = sizes + (-COPY_FIFTHS * sizes // 5) + 1
                chosen = np.arange(len(part)) - head[own] < taken[own]
                hashes, nodes = [part[chosen]], [keys[own[chosen]]]
                large = np.flatnonzero(sizes > BANDS_FROM)
                if len(large):
                    of_bands, filled = _bands(bounds, grams, owner, sizes > BANDS_FROM)
                    hashes.append(of_bands[filled])
                    nodes.append(np.repeat(keys[large], BANDS).reshape(-1, BANDS)[filled])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(nodes))], names=["hash", "node"])

    return run


def _bands(bounds: np.ndarray, grams: np.ndarray, owner: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the large sets' bands, a row for each set, and which bands have a shingle; grams ascend in each set."""
    bins = BANDS * BAND_ROWS
    mine = large[owner]
    owner, grams = (np.cumsum(large) - 1)[owner[mine]], grams[mine]
    # bins by hashes of their own, so that they do not depend on the order that prefixes have
    mixed = tb.mix(grams)
    place = owner * bins + ((mixed >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    least = np.full(int(large.sum()) * bins, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least, place, mixed)
    rows = least.reshape(-1, BANDS, BAND_ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(BAND_ROWS):
        keys = tb.mix(keys * np.uint64(0xD6E8FEB86659FD93) + rows[:, :, k])
    return keys, (rows != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=2)


def _sets(batches):
    """(node, text) -> node, n, mark and shingles (as bytes) of each set."""
    for batch in batches:
        for first, bounds, grams in _shingle_sets(batch.column(1)):
            sizes = np.diff(bounds)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            place = (tb.mix(grams) % np.uint64(MARK_BITS)).astype(np.int64) + MARK_BITS * owner
            odd = (np.bincount(place, minlength=MARK_BITS * len(sizes)) & 1).astype(np.uint8).reshape(-1, MARK_BITS)
            marks = [m.tobytes() for m in np.packbits(odd, axis=1)]
            raw = grams.tobytes()
            cut = [raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(cut)), pa.array(sizes), pa.array(marks, pa.binary()), pa.array(cut, pa.binary())], names=["node", "n", "mark", "shingles"])


def _unpacked(marks: pa.Array) -> np.ndarray:
    """A row of 64-bit lanes for each mark."""
    return np.frombuffer(b"".join(marks.to_pylist()), np.int64).reshape(-1, MARK_BITS // 64)


def _may_resemble(n: np.ndarray, mark: np.ndarray, other_n: np.ndarray, other_mark: np.ndarray) -> np.ndarray:
    """Whether sizes and marks leave it open that sets resemble each other enough; never False for those that do."""
    good = COPY_FIFTHS * np.maximum(n, other_n) <= 5 * np.minimum(n, other_n)
    differ = np.bitwise_count((mark ^ other_mark).view(np.uint64)).sum(axis=-1, dtype=np.int64)
    return good & ((5 + COPY_FIFTHS) * differ <= (5 - COPY_FIFTHS) * (n + other_n))


def _open_links(batches):
    """(a, b, n, mark, other_n, other_mark) -> a, b of those that may resemble each other."""
    for batch in batches:
        n, other = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
        keep = pa.array(_may_resemble(n, _unpacked(batch.column(3)), other, _unpacked(batch.column(5))))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _resemble(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets resemble each other enough."""
    if COPY_FIFTHS * max(len(x), len(y)) > 5 * min(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= COPY_FIFTHS * (len(x) + len(y) - both)


def _resembling(batches):
    """(a, b, x, y) -> src, dst of the pairs whose sets resemble each other enough."""
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            good[i] = _resemble(*(np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y)))
        keep = pa.array(good)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["src", "dst"])


def _whole_groups(batches, width: int, rest):
    """(rows as numbers, rest of the rows) of whole groups: batches sorted by their first two columns; rest(batch): a list or matrix, a row each."""
    kept, held = np.zeros((0, width), np.int64), None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([kept, np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1)])
        more = rest(batch)
        more = more if held is None else held + more if isinstance(more, list) else np.concatenate([held, more])
        bounds = np.concatenate([[0], np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1])
        last = int(bounds[-1])
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield rows[lo:hi], more[lo:hi]
        kept, held = rows[last:].copy(), more[last:]
    if len(kept):
        yield kept, held


def _may_meet(i: int, first: int, component: np.ndarray) -> np.ndarray:
    """Places of a group that its i-th node is compared with: behind nodes of side 1 that had their turn; if there is a side 0, that alone."""
    return np.flatnonzero(component[:first] != component[i]) if first else i + 1 + np.flatnonzero(component[i + 1 :] != component[i])


def _open_nodes(batches):
    """(hash, group, side, node, component, n, mark), sorted -> the first five of the nodes that a node of their group, in another component, may resemble.

    side: 0 for nodes that are only compared with those of side 1.
    """
    for rows, mark in _whole_groups(batches, 6, lambda batch: _unpacked(batch.column(6))):
        side, component, n = rows[:, 2], rows[:, 4], rows[:, 5]
        first = int(np.searchsorted(side, 1))
        met = np.zeros(len(rows), bool)
        for i in range(first, len(rows)):
            at = _may_meet(i, first, component)
            at = at[_may_resemble(n[i], mark[i], n[at], mark[at])]
            met[at] = True
            met[i] |= len(at) > 0
        if met.any():
            yield pa.RecordBatch.from_arrays([pa.array(rows[met, k]) for k in range(5)], names=["hash", "group", "side", "node", "component"])


def _group_links(batches):
    """(hash, group, side, node, component, n, mark, shingles), sorted -> src, dst of links that span what a group's checked links join.

    What a link has joined is not compared again, so a group leaves fewer
    links than it has nodes, however many of them resemble each other.
    """
    rest = lambda batch: list(zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True))
    for rows, held in _whole_groups(batches, 6, rest):
        side, node, component, n = rows[:, 2], rows[:, 3], rows[:, 4].copy(), rows[:, 5]
        mark = np.frombuffer(b"".join(m for m, _ in held), np.int64).reshape(-1, MARK_BITS // 64)
        sets = [np.frombuffer(s, np.uint64) for _, s in held]
        first = int(np.searchsorted(side, 1))
        src, dst = [], []
        for i in range(first, len(rows)):
            at = _may_meet(i, first, component)
            for j in at[_may_resemble(n[i], mark[i], n[at], mark[at])].tolist():
                if component[j] != component[i] and _resemble(sets[i], sets[j]):
                    component[component == component[j]] = component[i]
                    src.append(node[i])
                    dst.append(node[j])
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def _dealt(placed: DataFrame, tag: str) -> DataFrame:
    """(hash, node, component, leader, n, mark) -> rows of _open_nodes: groups of at most about 2 x PART nodes, of large sets fewer.

    Nodes in the component of a bucket's leader need no comparison with each
    other: they are its body, the others its rest. Buckets without a rest are
    done. Parts of the body meet parts of the rest, and parts of the rest each
    other, each two in a group of its own.
    """
    rest = F.col("component") != F.col("leader")
    weight = 1 + F.call_function("div", F.col("n"), F.lit(SET_UNIT))
    sum_if = lambda c: F.coalesce(F.sum(F.when(c, weight)), F.lit(0))
    sizes = placed.groupBy("hash").agg(sum_if(rest).alias("n_rest"), sum_if(~rest).alias("n_body")).where("n_rest > 0")
    part = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(PART))).cast("long").alias(c.replace("n_", "") + "_parts")
    sizes = materialize(sizes.select("hash", part("n_rest"), part("n_body")), tag)
    rows = placed.join(sizes, "hash").withColumn("is_rest", rest)
    number = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    group = lambda kind, p, q: kind * (F.col("rest_parts") + F.col("body_parts")) * F.col("rest_parts") + p * F.col("rest_parts") + q
    one = lambda g, side: F.struct(g.alias("group"), F.lit(side).cast("long").alias("side"))
    q, p = number("rest_parts"), number("body_parts")
    with_rest = F.transform(upto("rest_parts"), lambda other: one(group(0, p, other), 0))
    with_body = F.transform(upto("body_parts"), lambda other: one(group(0, other, q), 1))
    among = F.transform(upto("rest_parts"), lambda other: one(group(1, F.least(q, other), F.greatest(q, other)), 1))
    spread = rows.withColumn("in", F.explode(F.when(F.col("is_rest"), F.concat(with_body, among)).otherwise(with_rest)))
    return spread.select("hash", "in.group", "in.side", "node", "component", "n", "mark")


def _fingerprint_links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b, of sets whose texts' fingerprints are equal or within RADIUS bits. prints: node, fp0.

    Fingerprints meet in the buckets of their blocks, as in near_duplicates;
    one set stands for each, and sets of one fingerprint are linked with it.
    """
    pairs = prints.select("node", "fp0").distinct()
    named = materialize(pairs.groupBy(F.col("fp0").alias("fp")).agg(F.min("node").alias("set")), "copies-prints")
    distinct = named.select(F.col("fp").alias("node"))
    close = near_links(distinct, pigeonhole_keys(blocks_for(named.count()), RADIUS, "node"), RADIUS, ["node"]).distinct()
    of = lambda fp, name: named.select(F.col("fp").alias(fp), F.col("set").alias(name))
    links = close.join(of("src", "a"), "src").join(of("dst", "b"), "dst").select("a", "b")
    links = links.unionByName(pairs.join(of("fp0", "a"), "fp0").select("a", F.col("node").alias("b")))
    found = materialize(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "copies-close")
    release(named)
    return found


def near_copy_components(rows: DataFrame) -> DataFrame:
    """(node, component) of the texts that resemble another one; others are not in it. rows: row_key (long), text.

    First come the texts whose SimHash fingerprints are within RADIUS bits.
    Resemblance at the bound moves more bits than any blocks can bear, so near
    copies meet in buckets of their shingles, too: always, if they are small,
    else but once in 300,000 times. Every link is checked on the whole sets.
    Of a bucket, the nodes are compared with its leader, the smallest of
    them; then those that are not yet in one component with each other.
    row_key should tell rows with equal texts apart: of each set the text with
    the smallest is read.
    """
    texts = rows.select("text")
    counted = texts.mapInArrow(_sampled_shingles, "hash long").groupBy("hash").count().where("count >= 4")
    level = F.least(F.lit(255), F.floor(F.log2("count"))).cast("int").alias("level")
    table = counted.select(F.shiftrightunsigned("hash", 64 - TABLE_BITS).alias("cell"), level).groupBy("cell").agg(F.max("level")).toPandas().to_numpy(np.int64)
    buckets = materialize(texts.mapInArrow(_buckets(table[:, 0].astype(np.int32), table[:, 1].astype(np.uint8)), "hash long, node long").distinct(), "copies-buckets")
    ends = materialize(buckets.groupBy("hash").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select("hash", "low"), "copies-ends")
    shared = materialize(buckets.join(ends, "hash"), "copies-shared")
    release(buckets, ends)
    keyed = with_set_keys(rows)
    prints = materialize(with_fingerprints(keyed).select("node", "row_key", "fp0"), "copies-fingerprints")
    close = _fingerprint_links(prints)
    # of each set that shares a bucket or is close to another: its mark, and its shingles, from one row
    some = shared.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    first = prints.groupBy("node").agg(F.min("row_key").alias("row_key")).join(some, "node")
    first = materialize(first, "copies-rows")
    wanted = F.broadcast(first) if first.count() <= SENT_ROWS else first
    chosen = keyed.join(wanted, ["node", "row_key"], "left_semi").dropDuplicates(["node", "row_key"]).select("node", "text")
    sets = materialize(chosen.mapInArrow(_sets, "node long, n long, mark binary, shingles binary"), "copies-sets")
    release(prints, first)
    marks = sets.select("node", "n", "mark")
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    stars = materialize(shared.where("node != low").select(F.col("low").alias("a"), F.col("node").alias("b")).unionByName(close).distinct(), "copies-stars")
    marked = stars.join(marks.withColumnRenamed("node", "a"), "a").join(marks.toDF("b", "other_n", "other_mark"), "b")
    open_stars = materialize(marked.select("a", "b", "n", "mark", "other_n", "other_mark").mapInArrow(_open_links, "a long, b long"), "copies-open")
    firsts = materialize(open_stars.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_resembling, "src long, dst long"), "copies-first")
    release(close, stars, open_stars)
    found = components(firsts, "copies-joined")
    state = materialize(marks.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "copies-state")
    leaders = state.select(F.col("node").alias("low"), F.col("component").alias("leader"))
    placed = shared.join(state, "node").join(leaders, "low").select("hash", "node", "component", "leader", "n", "mark")
    in_groups = lambda df: df.repartition(partitions(rows), "hash", "group").sortWithinPartitions("hash", "group", "side")
    nodes = in_groups(_dealt(placed, "copies-sizes")).mapInArrow(_open_nodes, "hash long, group long, side long, node long, component long")
    nodes = materialize(nodes, "copies-nodes-open")
    whole = nodes.join(sets, "node").select("hash", "group", "side", "node", "component", "n", "mark", "shingles")
    seconds = materialize(in_groups(whole).mapInArrow(_group_links, "src long, dst long"), "copies-second")
    release(shared, sets, state, nodes)
    return components(firsts.unionByName(seconds), "copies-components")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id): classes of documents whose 5-word shingles resemble each other by 0.8 or more.

    component_id is the smallest id in the row's class, where classes are the
    components of the graph that links texts whose sets of shingles share 0.8
    of all that either has. Texts without words are copies of each other.
    Nulls, ties and repeated rows: as in near_duplicates.
    """
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    keyed = materialize(with_set_keys(base).select("doc_id", "node"), "copies-nodes")
    found = near_copy_components(base.select(F.xxhash64("doc_id", "text").alias("row_key"), "text"))
    placed = keyed.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "component").select("doc_id", "component_id")
