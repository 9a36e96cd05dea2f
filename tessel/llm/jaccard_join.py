"""Exact n-gram Jaccard join by PartEnum signatures, and the classes of its links.

A document is the set of its word shingles. Sizes fall into bands, a power of two each; a set also
takes part in the next band if a partner there is in reach. In a band of sets that differ in at most
k elements the hash domain is cut into more than k parts, and the subsets enumerated are those of
one part, the fewest signatures that PartEnum allows: k differences touch at most k parts, so in any
order of the signatures that all sets share, similar sets have a common one among their first k + 1.
The order puts signatures first that a sample of the sets finds in few of them, so passages that
many documents share seldom bring those documents together; it has no say in the result.

Work per step:
1. sets, sizes, set hashes and sketches per document; equal sets are one class from here on;
2. signatures, dealt out and sorted; buckets of two classes or more are streamed out of the sort,
   equal buckets become one;
3. each class meets one other, that with which it shares most buckets among the buckets' middles
   (the members with most company), and links are contracted to components;
4. buckets that still hold several components compare sketches within the bucket: a sketch has two
   bits for each cell of the hash domain, at least one element and at least two, and the bits in
   which two sketches differ are no more than the elements in which the sets differ. Pairs in reach
   go on, first the likeliest few of each pair of components, in the last of `ROUNDS` rounds all of them;
   no pair within a component is ever given out;
5. what is given out is verified on its whole sets.

Results for odd input: null texts and texts without words have no set, no links and are their own
component; fewer words than a shingle make one shingle of all; repeated rows are linked, each
returned; null doc_ids take part, but a component is named by its smallest doc_id that isn't null.
Class numbers and shingles are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import checkpoint, compact, few, lean, small_batches, table
from tessel.llm.components import components
from tessel.llm.words import batches_by_bytes, mix, words

#: Words of a shingle; a link has 100 x intersection >= PERCENT x union.
SHINGLE, PERCENT = 4, 85
#: Pairs that a round gives out for two components of a bucket; None: all that are in reach.
ROUNDS = (8, None)
#: A signature is common if one in SAMPLE of all sets has it at least COMMON times; at most so many are told to all tasks.
SAMPLE, COMMON, MOST_COMMON = 8, 6, 1_000_000
#: Bytes of sketches of a bucket that one task compares with each other; larger buckets are compared in blocks.
BLOCK_BYTES = 8 << 20
#: Classes in question up to which their names (24 bytes each) are broadcast to the documents.
BROADCAST_CLASSES = 1_000_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_ABSENT = -(1 << 63)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts one after another, ascending within a text; how many each text has."""
    n_texts = len(texts)
    buffer = b"\n".join(texts)
    start, _, key = words(buffer)
    if not len(key):
        return np.zeros(0, np.uint64), np.zeros(n_texts, np.int64)
    lengths = np.array([len(t) + 1 for t in texts])
    of = np.searchsorted(np.cumsum(lengths), start, side="right")
    n_words = np.bincount(of, minlength=n_texts)
    with np.errstate(over="ignore"):
        n = len(key)
        total = key.copy()
        for j in range(1, min(size, n)):
            total[: n - j] = total[: n - j] * _A + key[j:]
        first = np.cumsum(n_words) - n_words
        here = np.arange(n) - first[of]
        whole = here <= n_words[of] - size
        short = (n_words[of] < size) & (here == 0)
        value = mix(total)
        for i in np.flatnonzero(short):  # few: texts of fewer words than a shingle
            h = np.uint64(n_words[of[i]])
            for k in key[i : i + n_words[of[i]]]:
                h = h * _B + k
            value[i] = mix(np.array([h]))[0]
    keep = whole | short
    value, of = value[keep], of[keep]
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[fresh], np.bincount(of[fresh], minlength=n_texts)


def class_numbers(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    total = np.zeros(len(counts), np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(total, np.repeat(np.arange(len(counts)), counts), mix(values ^ _B))
        return mix(total + counts.astype(np.uint64) * _A).astype(np.int64)


def band_of(sizes: np.ndarray) -> np.ndarray:
    """Band b has the sizes from 2**b to 2**(b + 1) - 1; 0 for empty sets."""
    return np.frexp(np.maximum(sizes, 1).astype(np.float64))[1] - 1


def most_differences(sizes, percent: int):
    """In how many elements a set of so many differs at most from a similar one that is no smaller."""
    return (100 - percent) * (sizes + 100 * sizes // percent) // (100 + percent)


def parts_of(band: int, percent: int) -> int:
    """Parts of a band: more than the most differences in it, and some in reserve for empty ones."""
    k = int(most_differences((2 << band) - 1, percent))
    return k + 3 + k // 16


def cells_of(band: int) -> int:
    return max(128, 2 << band)


def memberships(counts: np.ndarray, percent: int):
    """(band, sets) for each band that has some: own sets, and those of the band below with partners in reach."""
    own = band_of(counts)
    up = (counts > 0) & (100 * counts // percent >= 2 << own)
    able = most_differences(counts, percent) > 0
    for band in np.unique(np.concatenate([own[able], own[able & up] + 1])):
        yield int(band), np.flatnonzero(able & ((own == band) | (up & (own + 1 == band))))


def members_at(values: np.ndarray, counts: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements of some of the sets, and the number of the set among them for each."""
    n, first = counts[some], np.cumsum(counts) - counts
    at = np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return values[at], np.repeat(np.arange(len(some)), n)


def sketch(values: np.ndarray, row: np.ndarray, n_rows: int, band: int) -> list[bytes]:
    """For each set, a bit for each cell that has an element of it, and one for each that has two."""
    cells = cells_of(band)
    held = np.bincount(row * cells + (mix(values + _A) & np.uint64(cells - 1)).astype(np.int64), minlength=n_rows * cells).reshape(n_rows, cells)
    return [r.tobytes() for r in np.packbits(np.concatenate([held > 0, held > 1], axis=1), axis=1)]


def sketches(values: np.ndarray, counts: np.ndarray, percent: int) -> tuple[list, list]:
    """Sketch of each set in its own band, and in the next one where it takes part in that; None elsewhere."""
    own, up, bands = [None] * len(counts), [None] * len(counts), band_of(counts)
    for band, members in memberships(counts, percent):
        step = max(1, (1 << 20) // cells_of(band))
        for lo in range(0, len(members), step):
            some = members[lo : lo + step]
            for i, s in zip(some.tolist(), sketch(*members_at(values, counts, some), len(some), band), strict=True):
                (own if bands[i] == band else up)[i] = s
    return own, up


#: Bits of a signature that name its band.
_BAND_BITS = 6


class Common:
    """Signatures that many sets have, and on which level: one more for each doubling."""

    def __init__(self, sig: np.ndarray, count: np.ndarray):
        order = np.argsort(sig)
        self.sig = sig[order]
        self.level = np.minimum(band_of(count[order]) + 1, 250).astype(np.uint8)

    def of(self, sig: np.ndarray) -> np.ndarray:
        if not len(self.sig):
            return np.zeros(sig.shape, np.uint8)
        at = np.minimum(np.searchsorted(self.sig, sig), len(self.sig) - 1)
        return np.where(self.sig[at] == sig, self.level[at], np.uint8(0))


def signatures(values: np.ndarray, counts: np.ndarray, percent: int = PERCENT, common: Common | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of all sets: the first k + 1 of each, all of them if `common` is None."""
    which, out = [], []
    for band, members in memberships(counts, percent):
        parts = parts_of(band, percent)
        with np.errstate(over="ignore"):
            name = mix(np.uint64(band) * _A + np.arange(parts, dtype=np.uint64) * _B)
        step = max(1, (1 << 19) // parts)
        for lo in range(0, len(members), step):
            some = members[lo : lo + step]
            v, row = members_at(values, counts, some)
            with np.errstate(over="ignore"):
                place = row * parts + (mix(v + _C) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                place, h = place[order], mix(v ^ _C)[order]
                head = np.flatnonzero(np.diff(place, prepend=-1))
                total = np.zeros(len(some) * parts, np.uint64)
                if len(head):
                    total[place[head]] = np.add.reduceat(h, head)
                held = np.zeros(len(total), bool)
                held[place[head]] = True
                sig = mix(total.reshape(len(some), parts) + name)
                sig = ((sig & ~np.uint64((1 << _BAND_BITS) - 1)) | np.uint64(band)).astype(np.int64)
            held = held.reshape(sig.shape)
            if common is None:
                give = held
            else:
                # Parts without elements say least, so they come last.
                level = np.where(held, common.of(sig), np.uint8(255))
                order = np.argsort(level, axis=1, kind="stable")
                first = np.arange(parts) < most_differences(counts[some], percent)[:, None] + 1
                give = np.zeros(sig.shape, bool)
                np.put_along_axis(give, order, first, axis=1)
            which.append(some[np.nonzero(give)[0]])
            out.append(sig[give])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(which), np.concatenate(out)


def document_sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, id, own, up, t: the number of the set's class (null without a set), its sketches, and a hash of the text."""

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for lo, hi in batches_by_bytes(texts):
                values, counts = shingle_sets(texts[lo:hi], size)
                own, up = sketches(values, counts, percent)
                ids = pa.array(class_numbers(values, counts), mask=counts == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(counts), ids, pa.array(own, pa.binary()), pa.array(up, pa.binary()), batch.column(2)[lo:hi]], ["doc_id", "n_shingles", "id", "own", "up", "t"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(lean(run), f"doc_id {kind}, n_shingles long, id long, own binary, up binary, t long")


def signature_rows(docs: DataFrame, size: int, percent: int, common: Common | None = None) -> DataFrame:
    """(sig, id) of every class, given once per task that holds it; without `common` all of one class in SAMPLE."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            for lo, hi in batches_by_bytes(texts):
                values, counts = shingle_sets(texts[lo:hi], size)
                ids = class_numbers(values, counts)
                asked = counts > 0 if common is not None else (counts > 0) & (mix(ids.astype(np.uint64)) % np.uint64(SAMPLE) == 0)
                keep = np.zeros(len(counts), bool)
                for i in np.flatnonzero(asked).tolist():
                    if (k := int(ids[i])) not in seen:
                        keep[i] = True
                        seen.add(k)
                if len(seen) > 1 << 20:
                    seen.clear()
                values, counts = values[np.repeat(keep, counts)], counts[keep]
                who, sig = signatures(values, counts, percent, common)
                for at in range(0, len(sig), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(sig[at : at + (1 << 18)]), pa.array(ids[keep][who[at : at + (1 << 18)]])], ["sig", "id"])

    return docs.select("text").where("text is not null").mapInArrow(lean(run), "sig long, id long")


def common_signatures(docs: DataFrame, size: int, percent: int) -> Common:
    """The signatures that one in SAMPLE of the classes finds most often, at most MOST_COMMON of them."""
    counts = signature_rows(docs, size, percent).distinct().groupBy("sig").count().where(F.col("count") >= COMMON)
    counts = compact(counts, "sig")
    # Levels are doublings; those that don't fit into the bound all share the lowest place, as if rare.
    levels = {r.level: r["count"] for r in counts.groupBy(F.floor(F.log2("count")).alias("level")).count().collect()}
    least, have = 64, 0
    for level in sorted(levels, reverse=True):
        have += levels[level]
        if have > MOST_COMMON:
            break
        least = level
    got = counts.where(F.floor(F.log2("count")) >= least).toArrow()
    return Common(got.column("sig").to_numpy().copy(), got.column("count").to_numpy().copy())


def buckets(rows: DataFrame) -> DataFrame:
    """(bucket, id): members of signatures that several classes share.

    A bucket's number comes from its members, and its lowest bits name the band; so buckets with the
    same members have the same number. A bucket too large to hold keeps its signature as number.
    """
    band_bits = np.uint64((1 << _BAND_BITS) - 1)

    def run(batches):
        held_s, held_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        open_sig = None  # of a bucket too large to hold, given out in pieces

        def give(sig, ids, last_is_open):
            """Members of whole runs in sorted arrays."""
            nonlocal open_sig
            if not len(sig):
                return None
            fresh = np.ones(len(sig), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
            sig, ids = sig[fresh], ids[fresh]
            start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            length = np.diff(np.append(start, len(sig)))
            with np.errstate(over="ignore"):
                total = np.add.reduceat(mix(ids.astype(np.uint64)), start)
                name = mix(total + length.astype(np.uint64))
                name = ((name & ~band_bits) | (sig[start].astype(np.uint64) & band_bits)).astype(np.int64)
            of = np.repeat(np.arange(len(start)), length)
            several = length >= 2
            if open_sig is not None and sig[0] == open_sig:
                name[0], several[0] = open_sig, True
            if last_is_open:
                name[-1], several[-1], open_sig = sig[-1], True, sig[-1]
            keep = several[of]
            return pa.RecordBatch.from_arrays([pa.array(name[of[keep]]), pa.array(ids[keep])], ["bucket", "id"])

        for batch in batches:
            s = np.concatenate([held_s, batch.column(0).to_numpy()])
            i = np.concatenate([held_i, batch.column(1).to_numpy()])
            if not len(s):
                continue
            cut = np.searchsorted(s, s[-1], side="left")
            large = len(s) - cut > 1 << 20
            got = give(s[: len(s) if large else cut], i[: len(s) if large else cut], large)
            held_s, held_i = (s[:0], i[:0]) if large else (s[cut:], i[cut:])
            if got is not None and got.num_rows:
                yield got
        got = give(held_s, held_i, False)
        if got is not None and got.num_rows:
            yield got

    return rows.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(lean(run), "bucket long, id long")


def _bits(column) -> np.ndarray:
    """Sketches of one length as rows of 64-bit words."""
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), np.uint64).reshape(len(held), -1)


def in_reach(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in at least so many elements can be similar."""
    most = n_a + n_b - 2 * -(-percent * (n_a + n_b) // (100 + percent))
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (differ <= most)


def _band(column: str) -> Column:
    return F.col(column).bitwiseAND((1 << _BAND_BITS) - 1).cast("int")


def sketch_rows(classes: DataFrame) -> DataFrame:
    """(id, band, n, sketch) of the classes (id, n, own, up) in each band in which they take part."""
    band = F.floor(F.log2("n")).cast("int")
    rows = F.array(F.struct(band.alias("band"), F.col("own").alias("sketch")), F.struct((band + 1).alias("band"), F.col("up").alias("sketch")))
    return classes.select("id", "n", F.inline(rows)).where("sketch is not null").select("id", "band", "n", "sketch")


def plausible(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) among (a, b, band) whose sizes and sketches don't rule out a link."""
    side = lambda x: sketched.select(F.col("id").alias(x), "band", F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.join(side("b"), ["b", "band"]).join(side("a"), ["a", "band"]).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    def run(batches):
        for batch in batches:
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            differ = np.array([np.bitwise_count(np.frombuffer(p, np.uint64) ^ np.frombuffer(q, np.uint64)).sum() for p, q in zip(x, y, strict=True)], np.int64)
            keep = in_reach(batch.column(2).to_numpy(), batch.column(3).to_numpy(), differ, percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(lean(run), "a long, b long")


def best_partners(shared: DataFrame) -> DataFrame:
    """(a, b, band): for each class b its likeliest partner a among the middles of its buckets.

    A bucket's middle is its member with most company over all its buckets; in a group of copies with
    changes that is the text that the others were changed from, or close to it.
    """
    sized = shared.join(shared.groupBy("bucket").agg(F.count("*").alias("members")), "bucket")
    score = sized.groupBy("id").agg(F.sum(F.col("times") * F.log2("members")).alias("score"))
    scored = shared.join(score, "id")
    middles = scored.groupBy("bucket").agg(F.max(F.struct("score", "id")).alias("m")).select("bucket", F.col("m.id").alias("a"))
    met = shared.join(middles, "bucket").where("a <> id").groupBy("a", F.col("id").alias("b")).agg(F.sum("times").alias("times"), F.max(_band("bucket")).alias("band"))
    return met.groupBy("b").agg(F.max(F.struct("times", "a", "band")).alias("m")).select("m.a", "b", "m.band")


def likely_pairs(live: DataFrame, sketched: DataFrame, percent: int, most: int | None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(bucket, a, b): pairs of classes of one bucket, in different components and in reach by their sketches.

    live: (bucket, id, root). For two components of a bucket the `most` pairs that differ least, all if
    None. Sketches are compared where the bucket's members meet; those of a large bucket are dealt to
    blocks, and each two blocks meet in a task of their own.
    """
    rows = live.withColumn("band", _band("bucket")).join(sketched, ["id", "band"])
    sizes = live.groupBy("bucket").agg(F.count("*").alias("members"), F.max(_band("bucket")).alias("band"))
    blocks = sizes.select("bucket", F.ceil(F.col("members") * F.greatest(F.lit(32.0), F.pow(2.0, F.col("band") - 1)) / block_bytes).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = rows.join(blocks, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "root", "n", "sketch")

    def best(found):
        """Of the pairs (a, b, root, root, differ) found, those to be kept."""
        a, b, r, s, d = (np.concatenate(x) for x in zip(*found, strict=True))
        if most is not None:
            order = np.lexsort((b, a, d, s, r))
            a, b, r, s, d = a[order], b[order], r[order], s[order], d[order]
            head = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (s[1:] != s[:-1])))
            rank = np.arange(len(a)) - np.repeat(head, np.diff(np.append(head, len(a))))
            a, b, r, s, d = (x[rank < most] for x in (a, b, r, s, d))
        return a, b, r, s, d

    def compare(across, own, ids, root, n, bits):
        """Record batches of the pairs of one group."""
        _, of, size = np.unique(root, return_inverse=True, return_counts=True)
        order = np.lexsort((ids, root, size[of]))  # the largest component last, as it isn't compared with itself
        own, ids, root, n, bits = own[order], ids[order], root[order], n[order], bits[order]
        found, have = [], 0
        step = max(1, (1 << 19) // (len(ids) * bits.shape[1]))
        for lo in range(0, len(ids), step):
            if root[lo] == root[-1]:
                break
            hi = min(lo + step, len(ids))
            differ = np.bitwise_count(bits[lo:hi, None, :] ^ bits[None, lo:, :]).sum(axis=2, dtype=np.int64)
            ok = in_reach(n[lo:hi, None], n[None, lo:], differ, percent) & (root[lo:hi, None] != root[None, lo:])
            ok &= np.arange(lo, len(ids))[None, :] > np.arange(lo, hi)[:, None]
            if across:
                ok &= own[lo:hi, None] != own[None, lo:]
            x, y = np.nonzero(ok)
            if not len(x):
                continue
            d, x, y = differ[x, y], x + lo, y + lo
            flip = root[x] > root[y]
            x, y = np.where(flip, y, x), np.where(flip, x, y)
            found.append((ids[x], ids[y], root[x], root[y], d))
            have += len(x)
            if have > 1 << 20:
                found = [best(found)]
                if most is None:
                    yield found.pop()
                have = len(found[0][0]) if found else 0
        if found:
            yield best(found)

    def run(batches):
        key, held = None, []

        def close():
            if len(held) == 0 or key is None:
                return
            own, ids, root, n = (np.concatenate([h[k] for h in held]) for k in range(4))
            bits = np.concatenate([h[4] for h in held])
            for a, b, *_ in compare(key[1] != key[2], own, ids, root, n, bits):
                for at in range(0, len(a), 1 << 17):
                    x, y = a[at : at + (1 << 17)], b[at : at + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), key[0])), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["bucket", "a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            own, ids, root, n = (batch.column(k).to_numpy().astype(np.int64) for k in range(3, 7))
            head = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            for lo, hi in zip(head, np.append(head[1:], len(keys)), strict=True):
                if key != (now := tuple(keys[lo].tolist())):
                    yield from close()
                    key, held = now, []
                held.append((own[lo:hi], ids[lo:hi], root[lo:hi], n[lo:hi], _bits(batch.column(7)[int(lo) : int(hi)])))
        yield from close()

    return dealt.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInArrow(lean(run), "bucket long, a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, link) of candidate pairs (a, b): whether their whole sets are similar. texts: (id, text)."""
    right = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        last, kept = None, None
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            link = np.zeros(len(a), bool)
            raw = [t.encode() for t in tb]
            for lo, hi in batches_by_bytes(raw):
                values, counts = shingle_sets(raw[lo:hi], size)
                ends = np.cumsum(counts)
                for k in range(lo, hi):
                    if a[k] != last:
                        last, kept = a[k], shingle_sets([ta[k].encode()], size)[0]
                    other = values[ends[k - lo] - counts[k - lo] : ends[k - lo]]
                    if 100 * min(len(kept), len(other)) < percent * max(len(kept), len(other)):
                        continue
                    at = np.searchsorted(kept, other)
                    at[at == len(kept)] = 0
                    common = int((kept[at] == other).sum()) if len(kept) else 0
                    link[k] = 100 * common >= percent * (len(kept) + len(other) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(link)], ["a", "b", "link"])

    return both.mapInArrow(lean(run), "a long, b long, link boolean")


def named(docs: DataFrame) -> Column:
    """The doc_id, a number or a string, with a value of its own for null."""
    return F.coalesce("doc_id", F.lit(_ABSENT).cast(docs.schema["doc_id"].dataType))


def class_texts(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, text): one text of each class in `wanted` (id, key, t), found by a doc_id that has it and the text's hash.

    A row meets the class of its own text alone, also where many rows have no doc_id or share one; of
    equal rows each task passes on one.
    """
    if wanted.count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    found = docs.select(named(docs).alias("key"), F.xxhash64("text").alias("t"), "text").join(wanted, ["key", "t"]).groupBy("id", "t").agg(F.first("text").alias("text")).select("id", "text")

    def run(batches):
        # Different texts may share a hash, so the class is computed again.
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), [(t or "").encode() for t in batch.column(1).to_pylist()]
            for lo, hi in batches_by_bytes(texts):
                values, counts = shingle_sets(texts[lo:hi], size)
                same = pa.array((class_numbers(values, counts) == ids[lo:hi]) & (counts > 0))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi]], ["id", "text"]).filter(same)

    return found.mapInArrow(lean(run), "id long, text string").dropDuplicates(["id"])


def similar_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id, text); doc_id is a number or a string."""
    small_batches(docs.sparkSession)
    sets = checkpoint(document_sets(docs, size, percent))
    common = common_signatures(docs, size, percent)
    shared = checkpoint(few(buckets(signature_rows(docs, size, percent, common)).groupBy("bucket", "id").agg(F.count("*").alias("times"))))
    # Classes in question: size, sketches, and a doc_id that has the text.
    asked = sets.where("id is not null").join(shared.select("id").distinct(), "id")
    one = F.first(F.struct("n_shingles", "own", "up"))
    at = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), named(docs).alias("key"), "t"))
    classes = asked.groupBy("id").agg(one.alias("s"), at.alias("at"))
    classes = checkpoint(few(classes.select("id", "at.key", "at.t", F.col("s.n_shingles").alias("n"), "s.own", "s.up")))
    sketched = sketch_rows(classes)

    def linked(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        texts = class_texts(docs, classes.select("id", "key", "t").join(ids, "id"), size)
        return compact(verify(pairs, texts, size, percent), "a", "b")

    tested = linked(compact(plausible(best_partners(shared), sketched, percent), "a", "b"))
    roots = components(tested.where("link").select("a", "b"))
    live = shared.select("bucket", "id")
    for most in ROUNDS:
        rooted = live.join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
        split = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
        live = checkpoint(few(rooted.join(split, "bucket")))
        found = compact(likely_pairs(live, sketched, percent, most), "a", "b")
        # A bucket without a pair in reach has none later either.
        live = live.select("bucket", "id").join(found.select("bucket").distinct(), "bucket", "left_semi")
        seen = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        fresh = checkpoint(few(found.select("a", "b").distinct().join(seen, ["a", "b"], "left_anti")))
        if not fresh.isEmpty():
            fresh = linked(fresh)
            tested = tested.unionByName(fresh)
            if not fresh.where("link").isEmpty():
                roots = components(tested.where("link").select("a", "b"))
    # The smallest doc_id of each class, then of each component, then back to the rows by class.
    least = sets.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("least")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    per_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    per_class = least.select("id", "root").join(per_root, "root").select("id", "component_id")
    return sets.select("doc_id", "n_shingles", "id").join(per_class, "id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id
"""
