"""SimHash near-duplicates, candidates by pigeonring filtering.

The 64 bits are cut into ``most + 1`` segments around a ring. If two fingerprints differ in at most ``most`` bits then
some segment starts a chain of which every prefix of k segments differs in at most ``k * most / (most + 1)`` bits, so
0 in the first, 1 in the first two, and so on round the ring. The first segment is the key under which fingerprints
meet (chains of two or three, where there are so many fingerprints that chance meetings would outnumber the keys: the
first segment as it is, the others with every change that the budget allows). The longer prefixes, of which the last is
the full distance, are checked on those that meet.

Equal fingerprints count once. No pairs are made as rows: the members of a bucket are searched where they lie sorted,
each against those not yet reached, and a bucket gives one link at most for each member. A crowded bucket is dealt to
several tasks, in blocks of bounded size; its blocks are tied by a hub (the member nearest to the bucket's bitwise
majority), and then only the members that are not of the bucket's commonest root meet all its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import at_positions, byte_column, join_hot, position_bits, positioned, space_words, staged
from newsloom.llm.components import connected_components

BITS = 64
#: Shingles hashed at once.
_BLOCK = 200_000
#: Buckets of as many fingerprints look for a hub near their middle.
_CROWD = 32
#: Fingerprints that meet in one piece: a bucket of more is dealt in blocks.
_ROOM = 4096
#: Pairs compared at once.
_AT_ONCE = 1 << 18
#: For each byte, its bits spread over the bytes of a 64-bit word.
_SPREAD = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], dtype=np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    spread, total = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)], np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255):
        total += spread[at : at + 255].sum(axis=0).view(np.uint8)
    return total


def fingerprint(raw: bytes, width: int = 4, seed: int = 42) -> int:
    """Fingerprint of a text (UTF-8) as an unsigned integer."""
    words = space_words(raw)
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    total = np.zeros(BITS, np.int64)
    for at in range(0, count, _BLOCK):
        part = words[at : min(at + _BLOCK, count) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
        total += _bit_counts(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64))
    return int.from_bytes(np.packbits(total * 2 > count, bitorder="little").tobytes(), "little")


def fingerprints(rows: DataFrame, text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """``rows`` with ``fp long`` in the place of their text; a null or wordless text has fingerprint zero."""
    names = [c for c in rows.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(raw or b"", width, seed) for raw in byte_column(batch, "__text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*names, "fp"])

    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("fp", T.LongType())])
    return rows.select(*names, F.col(text_col).alias("__text")).mapInArrow(run, schema)


class Ring:
    """Segments of a fingerprint round a ring, for distances up to ``most``; keys are chains of ``links`` segments."""

    def __init__(self, most: int = 4, links: int = 2):
        self.most, self.parts = most, most + 1
        edges = [BITS * i // self.parts for i in range(self.parts + 1)]
        self.at, self.width = edges[:-1], [b - a for a, b in zip(edges, edges[1:])]
        # a key has 48 bits, below the number of its first segment
        self.links = max(k for k in range(1, min(links, self.parts) + 1) if k == 1 or k * max(self.width) <= 48)

    def budget(self, k: int) -> int:
        """How many bits may differ in the first ``k`` segments of a chain."""
        return k * self.most // self.parts

    def segment(self, fp: Column, i: int) -> Column:
        i %= self.parts
        return F.shiftrightunsigned(fp, self.at[i]).bitwiseAND(F.lit((1 << self.width[i]) - 1))

    def key(self, fp: Column, i: int) -> Column:
        """Chain of segments from i, with i in front."""
        chain = self.segment(fp, i).cast("long")
        for k in range(1, self.links):
            chain = F.shiftleft(chain, self.width[(i + k) % self.parts]).bitwiseOR(self.segment(fp, i + k).cast("long"))
        return chain.bitwiseOR(F.lit(i << 48))

    def keys(self, fp: Column) -> Column:
        return F.array(*(self.key(fp, i) for i in range(self.parts)))

    def changes(self, i: int) -> list[int]:
        """What may differ between the keys of a chain from i, within the budget at every length."""
        found = [(0, 0)]
        for k in range(1, self.links):
            size = self.width[(i + k) % self.parts]
            room = self.budget(k + 1)
            found = [
                (mask << size | sum(1 << b for b in bits), spent + n)
                for mask, spent in found
                for n in range(room - spent + 1)
                for bits in combinations(range(size), n)
            ]
        return [mask for mask, _ in found]

    def near_keys(self, fp: Column) -> Column:
        """Every key that a fingerprint within the chain's budget may have."""
        def changed(i: int) -> Column:
            return F.transform(F.array(*(F.lit(m).cast("long") for m in self.changes(i))), lambda m: self.key(fp, i).bitwiseXOR(m))

        return F.flatten(F.array(*(changed(i) for i in range(self.parts))))

    def chain(self, i: int) -> list[tuple[np.uint64, int]]:
        """The prefixes of the chain from segment i: their bits and how many of these may differ."""
        out, mask = [], 0
        for k in range(1, self.parts + 1):
            at = (i + k - 1) % self.parts
            mask |= ((1 << self.width[at]) - 1) << self.at[at]
            out.append((np.uint64(mask), self.budget(k)))
        return out


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _hubs(keyed: DataFrame, rows: int) -> DataFrame:
    """``keyed(fp, key)`` -> ``(key, n, hub)`` for keys of two fingerprints or more."""
    sizes = staged(keyed.groupBy("key").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1"), "buckets")
    crowds = sizes.where(F.col("n") >= _CROWD)
    if crowds.isEmpty():
        return sizes
    members = staged(join_hot(keyed, crowds.select("key", "n"), "key", rows), "crowds")
    ones = members.groupBy("key").agg(F.count("*").alias("n"), *(F.sum(F.getbit("fp", F.lit(i)).cast("long")).alias(f"b{i}") for i in range(BITS)))
    middle = F.lit(0).cast("long")
    for i in range(BITS):
        bit = (1 << i) - (1 << BITS if i == BITS - 1 else 0)
        middle = middle.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("n"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    middles = staged(ones.select("key", "n", middle.alias("middle")), "middles")
    nearest = join_hot(members.select("key", "fp"), middles, "key", rows).groupBy("key").agg(F.min(F.struct(_distance("fp", "middle").alias("far"), "fp")).alias("near"), F.count("*").alias("n"))
    return staged(nearest.select("key", "n", F.col("near.fp").alias("hub")).unionByName(sizes.where(F.col("n") < _CROWD)), "hubs")


def _near(chain: list[tuple[np.uint64, int]], some: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``some``, in ``others``) of the pairs whose chain keeps its budget at every length."""
    diff = some[:, None] ^ others[None, :]
    mask, most = chain[min(1, len(chain) - 1)]  # the prefix of two segments turns away most at once
    at, to = np.nonzero(np.bitwise_count(diff & mask) <= most)
    diff = diff[at, to]
    for mask, most in chain:
        good = np.bitwise_count(diff & mask) <= most
        at, to, diff = at[good], to[good], diff[good]
    return at, to


def _spanning(chain: list[tuple[np.uint64, int]], fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``fps`` connect by near pairs, as (member, first member reached): one link at most for each member."""
    none = np.empty(0, np.uint64)
    if len(fps) * len(fps) <= _AT_ONCE:  # most buckets have nothing near
        at, to = _near(chain, fps, fps)
        fps = fps[np.unique(at[at != to])]
    members, firsts, left = [none], [none], fps
    while len(left) > 1:
        first, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, _AT_ONCE // len(left))
            reached = np.zeros(len(left), bool)
            reached[_near(chain, front[:step], left)[1]] = True
            found, left, front = left[reached], left[~reached], front[step:]
            members.append(found)
            firsts.append(np.full(len(found), first))
            front = np.concatenate([front, found])
    return np.concatenate(members), np.concatenate(firsts)


def _joined(chain: list[tuple[np.uint64, int]], some: np.ndarray, roots: np.ndarray, others: np.ndarray, their: np.ndarray) -> list[tuple[int, int]]:
    """Roots that near pairs of ``some`` with ``others`` connect, as a forest: fewer links than roots."""
    top: dict[int, int] = {}

    def find(r: int) -> int:
        while (up := top.get(r, r)) != r:
            top[r] = r = top.get(up, up)
        return r

    out, step = [], max(1, _AT_ONCE // max(1, len(others)))
    for at in range(0, len(some), step):
        a, b = _near(chain, some[at : at + step], others)
        met = np.stack([roots[at : at + step][a], their[b]], axis=1)
        for u, v in np.unique(met[met[:, 0] != met[:, 1]], axis=0).tolist():
            if (x := find(u)) != (y := find(v)):
                top[x] = y
                out.append((u, v))
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of each group, of rows sorted by ``keys``; one group is held at a time, beside a batch."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        own = [columns[batch.schema.get_field_index(k)] for k in keys]
        if not batch.num_rows:
            continue
        if held and any(held[-1][batch.schema.get_field_index(k)][-1] != c[0] for k, c in zip(keys, own)):
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in own], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            held.append([c[start:end] for c in columns])
            if end < batch.num_rows:
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _links(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
    signed = [pa.array(np.concatenate([np.empty(0, np.int64), *(x.view(np.int64) for x in part)])) for part in (u, v)]
    return pa.RecordBatch.from_arrays(signed, names=["u", "v"])


def _bucket_links(dealt: DataFrame, ring: Ring) -> DataFrame:
    """``dealt(key, block, fp)`` -> ``(u, v)``: what the members of a block connect."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains, u, v, n = [ring.chain(i) for i in range(ring.parts)], [], [], 0
        for key, _, fp in _groups(batches, ["key", "block"]):
            if len(fp) < 2:
                continue
            members, firsts = _spanning(chains[int(key[0]) >> 48], fp.view(np.uint64))
            if len(members):
                u.append(members)
                v.append(firsts)
                n += len(members)
            if n > 1 << 16:
                yield _links(u, v)
                u, v, n = [], [], 0
        yield _links(u, v)

    by = ["key", "block"]
    return dealt.select(*by, "fp").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "u long, v long")


def _cross_links(dealt: DataFrame, ring: Ring) -> DataFrame:
    """``dealt(key, i, j, other, fp, root)`` -> ``(u, v)`` roots that a block of others and a block of all connect."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = [ring.chain(i) for i in range(ring.parts)]
        for key, _, _, other, fp, root in _groups(batches, ["key", "i", "j"]):
            fp, other = fp.view(np.uint64), other.astype(bool)
            found = _joined(chains[int(key[0]) >> 48], fp[other], root[other], fp[~other], root[~other])
            if found:
                yield _links(*([np.array(side, np.int64)] for side in zip(*found)))

    by = ["key", "i", "j"]
    return dealt.select(*by, "other", "fp", "root").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "u long, v long")


def _block(size: Column, room: int, *of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.ceil(size / room)).cast("int")


def near_components(values: DataFrame, most: int = 4, links: int | None = None, room: int | None = None) -> DataFrame:
    """``values(fp)`` distinct -> ``(fp, root)``: root is one fingerprint for all that are linked, directly or not.

    ``links`` and ``room`` only move work; the result is the same. By default keys are single segments up to 2^26
    fingerprints, chains of two up to 2^30, beyond which chance meetings would cost more than chains of three. A bucket
    of more than ``room`` is crowded; as ``room`` grows with all rows, fewer than 2^17 keys are, and those are broadcast.
    """
    if not most:
        return values.select("fp", F.col("fp").alias("root"))
    count = values.count()
    ring = Ring(most, links or (1 if count <= 1 << 26 else 2 if count <= 1 << 30 else 3))
    rows = count * sum(len(ring.changes(i)) for i in range(ring.parts))
    room = room or max(_ROOM, rows >> 17, count >> 11)
    keyed = values.select("fp", F.explode(ring.near_keys(F.col("fp"))).alias("key"))
    sizes = staged(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > room), "crowded")
    if sizes.isEmpty():
        first = connected_components(_bucket_links(keyed.withColumn("block", F.lit(0)), ring))
        return _rooted(values, first)
    dealt = keyed.join(F.broadcast(sizes), "key", "left").withColumn("block", F.coalesce(_block(F.col("n"), room, "fp"), F.lit(0)))
    some = keyed.join(F.broadcast(sizes.select("key")), "key", "left_semi")
    tied = join_hot(some, _hubs(some, rows), "key", rows).where("fp <> hub").where(_distance("fp", "hub") <= most)
    first = connected_components(_bucket_links(dealt, ring).unionByName(tied.select(F.col("fp").alias("u"), F.col("hub").alias("v"))))
    rooted = staged(_rooted(values, first), "rooted")
    members = staged(rooted.select("fp", "root", F.explode(ring.near_keys(F.col("fp"))).alias("key")).join(F.broadcast(sizes.select("key")), "key", "left_semi"), "members")
    by_root = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    mains = by_root.groupBy("key").agg(F.max_by("root", "n").alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    marked = members.join(F.broadcast(staged(mains, "mains")), "key")
    # every other member meets every block of its bucket; those of the commonest root need not meet each other
    i, j = _block(F.col("others"), room, "fp"), _block(F.col("n"), room, "fp")
    each = lambda size: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(size) / room) - 1).cast("int")))
    others = marked.where("root <> main").select("key", i.alias("i"), each("n").alias("j"), F.lit(True).alias("other"), "fp", "root")
    everyone = marked.select("key", each("others").alias("i"), j.alias("j"), F.lit(False).alias("other"), "fp", "root")
    second = connected_components(_cross_links(others.unionByName(everyone), ring))
    tops = second.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = tops.join(rooted.groupBy("root").agg(F.count("*").alias("n")).hint("merge"), "root")
    still = rooted.join(tops.select("root").hint("merge"), "root", "left_anti")
    return still.unionByName(join_hot(rooted, staged(moved, "moved"), "root", count).select("fp", F.col("top").alias("root")))


def _rooted(values: DataFrame, roots: DataFrame) -> DataFrame:
    """``values(fp)`` with the ``root`` of each, itself where it has no link."""
    return values.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def _roots(rows: DataFrame, low: Column, most: int) -> DataFrame:
    """``rows(fp, ...)`` -> staged ``(fp, root, low, n)``: the least ``low`` and the number of rows of each fingerprint."""
    values = staged(rows.groupBy("fp").agg(F.min(low).alias("low"), F.count("*").alias("n")), "values")
    return staged(near_components(values.select("fp"), most).join(values.hint("merge"), "fp"), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, most: int = 4) -> DataFrame:
    """``(id, fp long, component_id)`` for every row of ``docs``.

    Fingerprints link at ``most`` or fewer differing bits; ``component_id`` is the smallest id reachable through links,
    the row's own included. A null or wordless text has fingerprint zero and is linked like any other; rows with a null
    id take part, their component's id is null only if all its ids are; repeated rows are returned each; an empty
    table gives an empty result; other columns are not read.
    """
    rows = staged(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", width, seed), "fingerprints")
    roots = _roots(rows, F.col("id"), most)
    lows = staged(roots.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "components")
    named = join_hot(roots.select("root", "fp", F.col("n").alias("rows")), lows, "root", roots.count()).select("fp", F.col("rows").alias("n"), "component_id")
    return join_hot(rows, staged(named, "named"), "fp", rows.count()).select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4) -> DataFrame:
    """The rows of ``docs``, unchanged, of which one stays for each component: that with the smallest id.

    Ties of the id go to the smaller digest of the text, then to the first place; a null id stays only where a
    component has no other. The rows that stay are found again by position: no text is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = positioned(docs, "texts", id=F.col(id_col), sha=F.unhex(F.sha2(text, 256)))
    rows = staged(fingerprints(placed.select("slot", "ord", "id", "sha", F.col("row").getField(text_col).alias("text"))), "fingerprints")
    least = F.struct(F.col("id").isNull().alias("none"), "id", "sha", "slot", "ord")
    keep = _roots(rows, least, most).groupBy("root").agg(F.min("low").alias("keep"))
    return at_positions(placed, position_bits(keep.select("keep.slot", "keep.ord"))).select("row.*")
