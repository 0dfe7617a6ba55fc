"""Near-duplicates: SimHash links with Golay-code fuzzy hashing (`find`), and copies by shingle similarity (`keep_one`).

Fingerprints are majority bits of XXH64 hashes of word shingles. Two fingerprints link if they
differ in at most 4 bits. The 64 bits are dealt to segments of 22, 21 and 21 bits. Of at most 4
errors, either some segment has none, and then another has at most 2; or all three have at least
one, and then all have at most 2. Golay keys of a segment are shared within 2 errors. So the keys

  (segment as it is, another segment's Golay key), for the six ordered pairs, and
  (Golay keys of all three segments)

lose no link: 33 keys and 152 keys on average, of 33 and 36 bits. Equal fingerprints are made one
before that. Fingerprints are dealt by key and sorted; in each key's group pairs are compared, and
only links that join what the group hadn't joined yet are passed on, at most one fewer than members,
so no group puts out all its pairs. A group's search visits each member once and compares it with
those not reached yet: it takes 8 bytes a member, and a group of near copies needs few passes.

A key shared by many fingerprints is hot: its group is cut into blocks of about `MEMBERS` members by
hash, and each two blocks, and each block alone, are searched in a task's group of their own. All pairs
of a hot group thus meet in some task of bounded size. Which keys are hot is estimated; this decides
only where pairs meet, not which.

`keep_one` takes texts for copies whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more. SimHashes of the sets are linked by Golay keys as above, and the links' pairs are verified by the exact
similarity. But SimHashes of such texts differ in 9 bits on average and often in 15, a radius at which no
key is both shared and selective. So the pairs beyond 4 bits come from the sets themselves: in any one order of all
shingles, two sets of similarity s share l among the first n - ceil(s n) + l of each, so a join on these
loses no pair; l is 1 and a share `MORE` of n, of the lesser set for a pair. The order puts common
shingles (estimated from one text in 16) last, as they would make large groups; the estimate decides only
the order. Pairs that share l in groups of at most `SMALL` members, and by length and place can be
similar, are verified too. Larger groups are searched with their texts, in blocks as
above, so a pair with a shingle in one of them is found there, whatever it shares elsewhere. Within a block each set
is held against all not joined yet by parity bits, and member by member against those that these don't rule out.

Before texts are fetched for a verification, pairs are ruled out by the parity bits of their sets: two sets
differ in at least as many shingles as their parity bits differ, so no similar pair is lost.

Defined results: null and empty texts and texts without a word have fingerprint zero (and an empty set) and are linked
like others. Rows with null ids take part; a component's id is the least id that isn't null (null if
there is none). Repeated rows get the same component. An empty table gives no row. Texts of any length are taken whole.
Ids are of any type with an order. Only key and text are read, other columns are passed on by `keep_one` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontaminate, golay, ragged
from .components import components
from .joins import join_counted
from .storage import discard, map_batches, materialize

SHINGLE, SEED, DISTANCE = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of a block of a hot key's group, and one fingerprint in how many is counted to find hot keys.
MEMBERS, COUNTED = 1 << 15, 16
#: Of `keep_one`: words of a shingle, least similarity, members of a group that puts out its pairs, members of a block of others, most common shingles looked at, and share of a set's size that counts as l.
WORDS, SIMILARITY, SMALL, BLOCK, COMMON, MORE = 5, 0.8, 32, 2048, 1 << 20, 0.05


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints of an Arrow array of texts."""
    out = [np.empty(0, np.uint64)]
    digest = xxhash.xxh64_intdigest
    for _, _, buf, offsets in ragged.slices(texts):
        buf = ragged.LOWER[buf]
        starts, ends, first = ragged.words(buf, offsets)
        n = np.diff(first)
        lengths = ends - starts
        joined = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)  # each word with a space after it
        to = np.cumsum(lengths + 1) - (lengths + 1)
        where = np.repeat(to - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        joined[where] = ragged.gather(buf, starts, lengths)
        blob = joined.tobytes()
        per_row = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
        at = ragged.gather(np.arange(len(starts)), first[:-1], per_row)
        last = np.minimum(at + shingle, np.repeat(first[1:], per_row)) - 1
        hashes = np.fromiter((digest(blob[a:b], SEED) for a, b in zip(to[at].tolist(), (to[last] + lengths[last]).tolist(), strict=True)), np.uint64, len(at))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        head = np.r_[0, np.cumsum(per_row)]
        count = np.zeros((len(n), 64), np.int64)
        full = np.flatnonzero(per_row)
        if len(full):
            count[full] = np.add.reduceat(bits, head[full], axis=0, dtype=np.int32)
        out.append(np.packbits(2 * count > per_row[:, None], axis=1, bitorder="little").view("<u8").ravel())
    return np.concatenate(out)


def link_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (key, position of the fingerprint), keys as signed 64-bit numbers."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    codes, six = zip(*(golay.keys(p) for p in parts), strict=True)
    codes = [c.astype(np.int64) for c in codes]
    found, owners, every = [], [], np.arange(len(prints))
    for i in range(3):
        for j in range(3):
            if i != j:
                for column in range(6):
                    at = every if column == 0 else np.flatnonzero(six[j])
                    found.append((np.int64(i * 3 + j) << 48) | (parts[i][at] << 12) | codes[j][at, column])
                    owners.append(at)
    for a in range(6):
        for b in range(6):
            for c in range(6):
                at = np.flatnonzero((six[0] | (a == 0)) & (six[1] | (b == 0)) & (six[2] | (c == 0)))
                found.append((np.int64(15) << 48) | (codes[0][at, a] << 24) | (codes[1][at, b] << 12) | codes[2][at, c])
                owners.append(at)
    return np.concatenate(found), np.concatenate(owners)


def _explode(batches):
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for lo in range(0, len(prints), 1024):
            key, owner = link_keys(prints[lo : lo + 1024])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[lo : lo + 1024][owner].view(np.int64))], names=["key", "print"])


def group_links(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within DISTANCE, directly or by steps, in one group of distinct fingerprints: a forest."""
    left, ends_a, ends_b = members, [], []
    while len(left) > 1:
        frontier, left = [left[:1]], left[1:]
        while frontier and len(left):
            batch = frontier.pop()
            for x in batch:
                near = np.bitwise_count(left ^ x) <= DISTANCE
                if near.any():
                    reached = left[near]
                    ends_a.append(np.full(len(reached), x))
                    ends_b.append(reached)
                    frontier.append(reached)
                    left = left[~near]
                    if not len(left):
                        break
    empty = [np.empty(0, np.uint64)]
    return np.concatenate(ends_a or empty), np.concatenate(ends_b or empty)


def _link(batches):
    """Links from rows sorted by key; a group may go over many batches."""
    held_key, held = None, []

    def finish(key, prints):
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts = np.diff(np.r_[heads, len(key)])
        a, b = [], []
        for n in range(2, 5):  # groups of two to four: all pairs at once
            at = heads[counts == n]
            for i in range(n):
                for j in range(i + 1, n):
                    near = np.bitwise_count(prints[at + i] ^ prints[at + j]) <= DISTANCE
                    a.append(prints[at + i][near])
                    b.append(prints[at + j][near])
        for at, n in zip(heads[counts > 4], counts[counts > 4], strict=True):
            x, y = group_links(np.unique(prints[at : at + n]))
            a.append(x)
            b.append(y)
        pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if sum(map(len, a)) else np.empty((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, k]).view(np.int64)) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        key, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1], "left"))  # the last group may go on
        if held_key == key[-1] and cut == 0:
            held.append(prints)
            continue
        if held:
            key, prints, cut = np.r_[np.full(sum(map(len, held)), held_key), key], np.concatenate([*held, prints]), cut + sum(map(len, held))
        if cut:
            yield finish(key[:cut], prints[:cut])
        held_key, held = key[-1], [prints[cut:]]
    if held:
        prints = np.concatenate(held)
        yield finish(np.full(len(prints), held_key), prints)


def fingerprint_table(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key and print (the fingerprint's bits as a signed number)."""
    rows = docs.select(F.col(key), F.col(text).alias("__text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)).view(np.int64))], names=[key, "print"])

    return map_batches(rows, run, f"`{key}` {rows.schema[0].dataType.simpleString()}, print long")


def hot_keys(distinct: DataFrame, members: int = MEMBERS, counted: int = COUNTED) -> DataFrame:
    """Keys of about more than `members` fingerprints, and the number of blocks to cut each group into."""
    some = distinct.select("print").where(F.pmod(F.xxhash64("print"), F.lit(counted)) == 0)
    counts = map_batches(some, _explode, "key long, print long").groupBy("key").agg((F.count("*") * counted).alias("n"))
    return counts.where(F.col("n") > members).select("key", F.ceil(F.col("n") / members).alias("blocks"))


def deal(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    """The keyed fingerprints, those of hot keys once for each block that theirs must meet, under a key of the two blocks."""
    blocks = F.col("blocks")
    own = F.pmod(F.xxhash64("print"), blocks)
    meetings = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.xxhash64("key", F.least(own, other), F.greatest(own, other)))
    to = F.when(blocks.isNull(), F.array("key")).otherwise(meetings)
    return keyed.join(hot, "key", "left").select(F.explode(to).alias("key"), "print")


def print_links(distinct: DataFrame, members: int = MEMBERS, counted: int = COUNTED) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join the distinct fingerprints within DISTANCE, directly or by steps, and the written table of hot keys."""
    keyed = map_batches(distinct.select("print"), _explode, "key long, print long")
    hot = materialize(hot_keys(distinct, members, counted), "hot-keys")
    repeats = hot.agg(F.sum(F.col("blocks") * F.col("blocks")).alias("n")).first().n or 0
    if repeats:
        keyed = deal(keyed, hot)  # Spark broadcasts `hot` or not by the size of its files
    # 185 keys a fingerprint, and the members of hot groups once a block: enough partitions that a task sorts about a million rows
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + (distinct.count() * 185 + repeats * members) // 1_000_000)
    return map_batches(keyed.repartition(parts, "key").sortWithinPartitions("key"), _link, "a long, b long"), hot


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text", members: int = MEMBERS, counted: int = COUNTED) -> DataFrame:
    """One row per input row: key, fingerprint (16 hex digits) and component_id."""
    table = materialize(fingerprint_table(docs, key=key, text=text), "fingerprints")
    distinct = materialize(table.groupBy("print").agg(F.min(key).alias("least"), F.count("*").alias("n")), "distinct")
    links, hot = print_links(distinct, members, counted)
    roots = components(links)
    least = materialize(distinct.join(roots, distinct.print == roots.node, "left").select("print", F.coalesce("root", "print").alias("root"), "least", "n"), "rooted")
    by_root = materialize(least.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints")), "roots")
    named = materialize(join_counted(least, by_root, "root", "prints").select("print", "component_id", "n"), "components")
    discard(distinct, hot, least, by_root)
    return join_counted(table, named, "print", "n").select(key, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(texts: pa.Array, shingle: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the texts' first indices. A text of fewer words is one shingle."""
    found, sizes = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, _, buf, offsets in ragged.slices(texts):
        buf = ragged.LOWER[buf]
        starts, ends, first = ragged.words(buf, offsets)
        words = ragged.span_hashes(buf, starts, ends)
        hashes, start = decontaminate.shingle_hashes(words, first, shingle)
        row = ragged.row_of(start)
        for k in range(1, shingle):
            short = np.flatnonzero(np.diff(first) == k)
            if len(short):
                own = np.arange(len(short) + 1) * k
                hashes = np.r_[hashes, decontaminate.shingle_hashes(ragged.gather(words, first[short], np.full(len(short), k)), own, k)[0]]
                row = np.r_[row, short]
        if len(row) > start[-1]:
            order = np.argsort(row, kind="stable")
            hashes, row = hashes[order], row[order]
        ends = np.flatnonzero(np.r_[row[1:] != row[:-1], True][: len(row)]) + 1
        for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False):
            hashes[a:b].sort()
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])][: len(row)]
        found.append(hashes[new])
        sizes.append(np.bincount(row[new], minlength=len(first) - 1))
    return np.concatenate(found), np.cumsum(np.concatenate(sizes))


def set_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each set."""
    blob, ends = hashes.tobytes(), (first * 8).tolist()
    return np.fromiter((xxhash.xxh3_64_intdigest(blob[a:b]) for a, b in zip(ends, ends[1:], strict=False)), np.uint64, len(first) - 1).view(np.int64)


#: The eight bits of an octet, each in a byte of its own.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def set_prints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The SimHash of each set: a bit is set if it is in over half of its hashes; zero for an empty set."""
    size, out = np.diff(first), np.zeros(len(first) - 1, np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        pieces = -(-size[full] // 255)  # a byte counts so many
        head = np.r_[0, np.cumsum(pieces)]
        start = np.repeat(first[full], pieces) + 255 * (np.arange(head[-1]) - np.repeat(head[:-1], pieces))
        octets = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8).T)
        count = np.stack([np.add.reduceat(_LANES[o], start) for o in octets], 1).astype("<u8").view(np.uint8)
        count = np.add.reduceat(count, head[:-1], axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * count > size[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def parities(hashes: np.ndarray, first: np.ndarray) -> pa.Array:
    """For each set one bit or more a member (a power of two, 64 at least): whether an odd number of members falls on it."""
    size = np.diff(first)
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    start = np.r_[0, np.cumsum(bits)]
    at = start[:-1].repeat(size) + (hashes & (bits - 1).astype(np.uint64).repeat(size)).astype(np.int64)
    odd = np.packbits(np.bincount(at, minlength=int(start[-1])).astype(np.uint8) & 1, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((start // 8).astype(np.int32)), pa.py_buffer(odd)])


def can_be_similar(a: pa.Array, b: pa.Array, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m members with these parities can be similar. The bits of a larger set are folded to those of the lesser."""
    sizes = [np.array(pc.binary_length(x)) for x in (a, b)]
    needed = np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
    out = np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9
    for x, y in np.unique(np.stack(sizes, 1), axis=0).tolist():
        at = np.flatnonzero((sizes[0] == x) & (sizes[1] == y))
        rows = [np.frombuffer(b"".join(side.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1) for side in (a, b)]
        width = min(x, y)
        rows = [np.bitwise_xor.reduce(r.reshape(len(at), -1, width), axis=1) for r in rows]
        apart = np.bitwise_count(rows[0] ^ rows[1]).sum(1, dtype=np.int64)
        out[at] &= n[at] + m[at] - apart >= 2 * needed[at]
    return out


def least_common(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """The least whole number that is `similarity` of each size."""
    return np.ceil(similarity * sizes - 1e-9).astype(np.int64)


def shared_least(sizes: np.ndarray) -> np.ndarray:
    """The number of shingles (l) that prefixes of similar sets share."""
    return 1 + (MORE * sizes).astype(np.int64)


def prefixes(hashes: np.ndarray, first: np.ndarray, common: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of each set's prefix, common ones last; their rows and their places in the set."""
    row, size = ragged.row_of(first), np.diff(first)
    late = np.zeros(len(hashes), bool)
    if len(common):
        seen = np.zeros(1 << 22, bool)  # most are told apart by their highest bits
        seen[common >> np.uint64(42)] = True
        some = np.flatnonzero(seen[hashes >> np.uint64(42)])
        late[some] = common[np.minimum(np.searchsorted(common, hashes[some]), len(common) - 1)] == hashes[some]
    early = np.r_[0, np.cumsum(~late)]  # before each shingle, and in all
    mine, before = np.arange(len(hashes)) - first[row], early[:-1] - early[first[row]]
    place = np.where(late, (early[first[1:]] - early[first[:-1]])[row] + mine - before, before)
    ordered = np.empty_like(hashes)
    ordered[first[row] + place] = hashes
    place = mine
    kept = place < (size - least_common(size, similarity) + shared_least(size))[row]
    return ordered[kept], row[kept], place[kept]


def _whole_groups(batches):
    """Columns of rows sorted by their first column, cut only between groups."""
    held = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1], "left"))
        if held and cut == 0 and held[-1][0][-1] == columns[0][-1]:
            held.append(columns)
            continue
        if ready := [*held, [c[:cut] for c in columns]]:
            yield [np.concatenate(c) for c in zip(*ready, strict=True)]
        held = [[c[cut:] for c in columns]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _candidates(similarity: float, small: int):
    """From (key, node, size, place): pairs of small groups that can be similar, how many groups they share and must
    share; and the members of large groups, with 0 for both."""

    def run(batches):
        for key, node, size, place in _whole_groups(batches):
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            members = np.diff(np.r_[heads, len(key)])
            large = np.repeat(members > small, members)
            pairs = [np.empty((0, 3), np.int64)]
            for d in range(1, min(int(members.max(initial=1)), small)):
                at = np.flatnonzero((key[d:] == key[:-d]) & ~large[d:])
                n, m = size[at], size[at + d]
                needed = np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
                can = (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (1 + np.minimum(place[at], place[at + d]) + np.minimum(n - place[at], m - place[at + d]) - 1 >= needed)
                a, b = node[at[can]], node[at[can] + d]
                pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b), shared_least(np.minimum(n, m)[can])], 1))
            pair, times = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
            none = np.zeros(int(large.sum()), np.int64)
            columns = [np.r_[pair[:, 0], key[large]], np.r_[pair[:, 1], node[large]], np.r_[times, none], np.r_[pair[:, 2], none]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "n", "least"])

    return run


def local_parities(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one group's sets: how many members of each are in another set too, and parity bits of these members (a row of words a set)."""
    _, at, times = np.unique(hashes, return_inverse=True, return_counts=True)
    shared, sets = times[at] > 1, len(first) - 1
    known = ragged.sums(shared, first)
    distinct = int((times > 1).sum())
    bits = 1 << max(6, (min(distinct, 8 * int(known.sum()) // max(sets, 1)) - 1).bit_length())
    place = ((np.cumsum(times > 1) - 1) & (bits - 1))[at]
    odd = np.zeros((sets, bits // 8), np.uint8)
    step = max(1, (1 << 20) // bits)
    for lo in range(0, sets, step):
        hi = min(lo + step, sets)
        part = slice(first[lo], first[hi])
        cell = (np.repeat(np.arange(hi - lo), np.diff(first[lo : hi + 1])) * bits + place[part])[shared[part]]
        odd[lo:hi] = np.packbits((np.bincount(cell, minlength=(hi - lo) * bits) & 1).astype(np.uint8)).reshape(hi - lo, -1)
    return known, odd.view(np.uint64)


def similar_links(nodes: np.ndarray, hashes: np.ndarray, first: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the similar sets of one group of distinct nodes, directly or by steps: a forest. Only pairs that their parities don't rule out are compared member by member."""
    size, left, ends_a, ends_b = np.diff(first), np.arange(len(nodes)), [], []
    known, odd = local_parities(hashes, first)
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            own = hashes[first[x] : first[x + 1]]
            near = left[np.minimum(size[left], size[x]) >= similarity * np.maximum(size[left], size[x]) - 1e-9]
            apart = np.concatenate([np.bitwise_count(odd[near[lo : lo + 256]] ^ odd[x]).sum(1, dtype=np.int64) for lo in range(0, len(near), 256)] or [near])
            most = (known[near] + known[x] - apart) // 2  # members shared, at most
            near = near[most >= similarity * (size[near] + size[x] - most) - 1e-9]
            flat = ragged.gather(hashes, first[near], size[near])
            shared = ragged.sums(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat if len(own) else np.zeros(len(flat), bool), np.r_[0, np.cumsum(size[near])])
            near = near[shared >= similarity * (size[near] + size[x] - shared) - 1e-9]
            if len(near):
                ends_a.append(np.full(len(near), nodes[x]))
                ends_b.append(nodes[near])
                frontier += near.tolist()
                left = left[~np.isin(left, near)]
    empty = [np.empty(0, np.int64)]
    return np.concatenate(ends_a or empty), np.concatenate(ends_b or empty)


def _search(similarity: float, shingle: int):
    """Links of large groups, from (key, node, text) sorted by key."""

    def run(batches):
        for key, node, text in _whole_groups(batches):
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for lo, hi in zip(heads, np.r_[heads[1:], len(key)], strict=True):
                nodes, at = np.unique(node[lo:hi], return_index=True)
                hashes, first = shingle_sets(pa.array(text[lo:hi][at], pa.large_string()), shingle)
                a, b = similar_links(nodes, hashes, first, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _verify(similarity: float, shingle: int):
    """The pairs (a, b, text_a, text_b) whose sets are similar."""

    def run(batches):
        for batch in (whole.slice(lo, 256) for whole in batches for lo in range(0, whole.num_rows, 256)):
            (x, i), (y, j) = shingle_sets(batch.column(2), shingle), shingle_sets(batch.column(3), shingle)
            row, hashes = np.r_[ragged.row_of(i), ragged.row_of(j)], np.r_[x, y]
            order = np.lexsort((hashes, row))
            row, hashes = row[order], hashes[order]
            shared = np.bincount(row[1:][(row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])], minlength=batch.num_rows)
            alike = shared >= similarity * (np.diff(i) + np.diff(j) - shared) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(alike))

    return run


def simhash_pairs(distinct: DataFrame, members: int = MEMBERS, counted: int = COUNTED) -> DataFrame:
    """Pairs (a, b), a < b, of nodes whose fingerprints join: each node with the least one of its fingerprint, and these by the links; a written table."""
    least = materialize(distinct.groupBy("print").agg(F.min("node").alias("least"), F.count("*").alias("n")), "prints")
    links, hot = print_links(least, members, counted)
    own = join_counted(distinct.select("node", "print"), least, "print", "n").select(F.col("node").alias("x"), F.col("least").alias("y"))
    one, other = (least.select(F.col("print").alias(c), F.col("least").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    between = links.distinct().join(one, "a").join(other, "b").select("x", "y")
    out = materialize(own.union(between).where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "simhash-pairs")
    discard(least, hot)
    return out


def possible(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that their sizes and parities don't rule out."""
    sets = lambda x: distinct.select(F.col("node").alias(x), F.col("odd").alias(f"odd_{x}"), F.col("size").alias(f"size_{x}"))

    def run(batches):
        for batch in batches:
            n, m = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            yield batch.select([0, 1]).filter(pa.array(can_be_similar(batch.column(2), batch.column(3), n, m, similarity)))

    return map_batches(pairs.join(sets("a"), "a").join(sets("b"), "b").select("a", "b", "odd_a", "odd_b", "size_a", "size_b"), run, "a long, b long")


def copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = WORDS, similarity: float = SIMILARITY, small: int = SMALL, block: int = BLOCK, members: int = MEMBERS, counted: int = COUNTED) -> DataFrame:
    """One row for each component of texts whose shingle sets are similar: the least key, in the column component_id,
    the least hash of a set that has it (node), and how many rows have that set (n)."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()

    def sign(batches):
        for batch in (whole.slice(lo, 1024) for whole in batches for lo in range(0, whole.num_rows, 1024)):
            hashes, first = shingle_sets(batch.column(1), shingle)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(set_hashes(hashes, first)), pa.array(np.diff(first)), pa.array(set_prints(hashes, first).view(np.int64)), parities(hashes, first)], names=["least", "text", "node", "size", "print", "odd"])

    signed = map_batches(docs.select(F.col(key).alias("least"), F.col(text).alias("text")), sign, f"least {kind}, text string, node long, size long, print long, odd binary")
    distinct = materialize(signed.groupBy("node").agg(F.min("least").alias("least"), *(F.first(c).alias(c) for c in ("size", "text", "print", "odd")), F.count("*").alias("n")), "distinct")

    def spread(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(batch.column(0), shingle)[0].view(np.int64))], names=["key"])

    some = distinct.where(F.pmod(F.xxhash64("node"), F.lit(counted)) == 0).select("text")
    often = map_batches(some, spread, "key long").groupBy("key").count().where("count > 1").orderBy(F.desc("count")).limit(COMMON).select("key").toArrow()
    common = spark.sparkContext.broadcast(np.sort(often.column(0).to_numpy().view(np.uint64)))

    def deal_out(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                hashes, row, place = prefixes(*shingle_sets(part.column(1), shingle), common.value, similarity)
                node, size = part.column(0).to_numpy(), part.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(node[row]), pa.array(size[row].astype(np.int32)), pa.array(place.astype(np.int32))], names=["key", "node", "size", "place"])

    keyed = map_batches(distinct.select("node", "text", "size"), deal_out, "key long, node long, size int, place int")
    rows = distinct.agg(F.sum(F.ceil(F.col("size") * (1 - similarity + MORE)) + 1).alias("n")).first().n or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows // 1_000_000)
    found = materialize(map_batches(keyed.repartition(parts, "key").sortWithinPartitions("key"), _candidates(similarity, small), "a long, b long, n long, least long"), "candidates")
    texts, texts_b = distinct.select(F.col("node").alias("a"), F.col("text").alias("text_a")), distinct.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    linked = simhash_pairs(distinct, members, counted)
    shared = found.where("least > 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("least").alias("least")).where("n >= least").select("a", "b")
    enough = materialize(possible(linked.union(shared).distinct(), distinct, similarity), "pairs")
    pairs = enough.join(texts, "a").join(texts_b, "b").select("a", "b", "text_a", "text_b")
    links = map_batches(pairs, _verify(similarity, shingle), "a long, b long")
    large = found.where("least = 0").select(F.col("a").alias("key"), F.col("b").alias("print"))
    if not large.isEmpty():
        counts = large.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).alias("blocks"))
        dealt = deal(large, materialize(counts, "hot-keys")).join(texts.withColumnRenamed("a", "print"), "print").select("key", "print", "text_a")
        links = links.union(map_batches(dealt.repartition(parts, "key").sortWithinPartitions("key"), _search(similarity, shingle), "a long, b long"))
    roots = components(links)
    discard(found, linked, enough)
    one = F.struct("least", "node", "n")
    named = distinct.select("node", "least", "n").join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.coalesce(F.min(F.when(F.col("least").isNotNull(), one)), F.min(one)).alias("x"))
    return named.select(F.col("x.least").alias("component_id"), "x.node", "x.n")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of similar texts, with all columns: that with the component's id, and of several rows
    with it that of the least hash of a shingle set (any of rows alike in both). A row with a null id stands for its
    group only if no row of it has an id; its text's hash then serves as one."""
    name, wanted, times = (_unused(x, docs.columns) for x in ("component", "set", "times"))
    stand_in = F.when(F.col(key).isNull(), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = docs.withColumn(name, F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), stand_in.alias("hash")))  # rows with ids sort first
    found = materialize(copies(rows, key=name, text=text).select(F.col("component_id").alias(name), F.col("node").alias(wanted), F.col("n").alias(times)), "kept")
    joined = rows.join(found, name)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if docs.groupBy(key).count().where("count > 1").isEmpty():  # an id tells the row
        return joined.select(*columns)
    at, to = joined.columns.index(text), joined.columns.index(wanted)

    def same_set(batches):
        for batch in batches:
            yield batch.filter(pa.array(set_hashes(*shingle_sets(batch.column(at))) == batch.column(to).to_numpy()))

    kept = map_batches(joined, same_set, joined.schema)
    once, often = kept.where(F.col(times) == 1), kept.where(F.col(times) > 1).dropDuplicates([name, wanted])
    return once.select(*columns).union(often.select(*columns))


def _unused(name: str, names: list[str]) -> str:
    """A column name that isn't taken."""
    while name in names:
        name = "_" + name
    return name
