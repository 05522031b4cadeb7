"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles. Documents with equal sets are one node
from the start. For different sets with Jaccard similarity t or more, a node of n shingles
shares at least o = ceil(t*n) of them; with all shingles in one global order, rare first, two
such nodes share a shingle among their first n-o+1, and l of them among their first n-o+l.

Counting. Shingles are dealt to shards by hash, as packed blocks of truncated hashes in the
order of documents; a shard finds which occur in several nodes. Beyond ``fan_out`` shards, blocks
go to groups of shards first. Shingles of a single node come
first in the order and can't be shared, so nodes that hold n-o+1 of those drop out, as nearly
all prose does. Shingles in a large share of the documents are found beforehand from local
counts, come last in the order and never meet in a shard.

Candidates. Each remaining node lengthens its prefix by its estimated candidate cost and asks
for as many more shared prefix shingles. Only components are wanted, so within a prefix
shingle's group everyone is first compared with the group's most central node; what one
component holds already is not compared again. What is left, pairs across components, is
generated with size, position and multi-match filters, and verified on whole sets.

Texts without words are empty and linked with nothing; fewer than ``k`` words make one shingle
of the whole sequence; a null text is empty. Rows are documents even if identifiers repeat.
A null identifier gives no name to a component unless all its identifiers are null. Sets are
told apart by 64-bit hashes. Two shingles of one node that are cut to the same token are told
apart by their number, so a node never counts fewer shared shingles than it has.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import FAN_OUT, group_size, narrow, pack, shard_of, unpack
from .common import U64, give_back_memory, gram_hashes, materialize, mix, small_batches, text_bytes, word_hashes
from .components import connected_components

LOW32 = U64(0xFFFFFFFF)
HEAVY_CLASS = 255
#: A shingle in so small a part of all documents is heavy; a chunk reports those in half as large a part of its own, so that
#: one that is spread evenly is reported by nearly all chunks, with nearly all its documents.
HEAVY_SHARE, LOCAL_SHARE = 256, 512


@dataclass(frozen=True)
class Settings:
    """``shard_shingles`` bounds what one counting task gathers; the rest as in the module's text."""

    k: int = 5
    percent: int = 80
    shard_shingles: int = 4_000_000
    chunk_documents: int = 4000
    heavy_documents: int = 10_000
    longest_extension: int = 4
    rounds: int = 2
    most_broadcast: int = 2_000_000
    fan_out: int = FAN_OUT


def shingle_sets(counts: np.ndarray, words: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    grams = gram_hashes(words, k)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(grams[at : at + n - k + 1]))
        else:
            out.append(gram_hashes(words[at : at + n], n) if n else np.empty(0, U64))
        at += n
    return out


def set_hash(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def overlap_needed(n: np.ndarray | int, percent: int):
    return -(-n * percent // 100)


# ------------------------------------------------------------------ documents and heavy shingles


def _describe(s: Settings):
    """Rows (0, id, n, set hash, text hash) for documents and (1, shingle, local count, chunk size, 0) for locally heavy shingles."""
    names = ["kind", "id", "n", "mark", "tag"]

    def heavy(held):
        kinds, count = np.unique(np.concatenate(held), return_counts=True)
        often = count >= max(4, len(held) // LOCAL_SHARE)
        kinds, count = kinds[often].view(np.int64), count[often].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(kinds), np.int8)), pa.array(kinds), pa.array(count), pa.array(np.full(len(kinds), len(held))), pa.array(np.zeros(len(kinds), np.int64))], names=names)

    def run(batches):
        held = []
        for batch in batches:
            sets = shingle_sets(*word_hashes(batch.column(1)), s.k)
            sizes = np.array([len(x) for x in sets], np.int64)
            marks = np.array([set_hash(x) for x in sets], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int8)), batch.column(0), pa.array(sizes), pa.array(marks), batch.column(2)], names=names)
            held += [x for x in sets if len(x)]
            if len(held) >= s.chunk_documents:
                yield heavy(held)
                held = []
                give_back_memory()
        if held:
            yield heavy(held)
            held = []
        give_back_memory()

    return run


def _heavy_shingles(described: DataFrame, documents: int, s: Settings) -> np.ndarray:
    """Shingles in a large share of all documents; at most ``HEAVY_SHARE`` times as many as a document has on average.

    Counts are those of the chunks that report a shingle, so it is heavy from nine tenths of the bound on.
    """
    least = max(s.heavy_documents, documents * 9 // (10 * HEAVY_SHARE))
    rows = described.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["id"] for r in rows.select("id").collect()], np.int64).view(U64))


# ------------------------------------------------------------------ counting


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def _blocks(nodes: np.ndarray, sizes: np.ndarray, owner: np.ndarray, flat: np.ndarray, h_owner: np.ndarray, h_token: np.ndarray, n_shards: int, per_group: int) -> pa.RecordBatch:
    """A block for each shard, or group of shards, that gets anything: nodes, their sizes, how many shingles of each, the
    shingles (whole for groups, cut for shards); then nodes, sizes and tokens of heavy shingles, all of a node in one shard.
    """
    shard, home = (shard_of(x, n_shards) // per_group for x in (flat, mix(nodes[h_owner])))
    order, h_order = np.argsort(shard, kind="stable"), np.argsort(home, kind="stable")
    flat = flat if per_group > 1 else (flat & LOW32).astype(np.uint32)
    owner, flat, shard = owner[order], flat[order], shard[order]
    h_owner, h_token, home = h_owner[h_order], h_token[h_order], home[h_order]
    del order
    shards = np.union1d(shard, home)
    at, h_at = (np.append(np.searchsorted(x, shards), len(x)) for x in (shard, home))
    out = []
    for a, b, c, d in zip(at[:-1], at[1:], h_at[:-1], h_at[1:], strict=True):
        there, per = np.unique(owner[a:b], return_counts=True)
        in_order = np.argsort(owner[a:b], kind="stable")
        extra = h_owner[c:d]
        out.append(pack(nodes[there], narrow(sizes[there]), narrow(per), flat[a:b][in_order], nodes[extra], narrow(sizes[extra]), h_token[c:d]))
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(out, pa.binary())], names=["shard", "block"])


def _deal(s: Settings, n_shards: int, per_group: int, heavy):
    """The nodes of each chunk, dealt to shards or groups; heavy shingles apart."""

    def blocks(held: dict[int, np.ndarray]):
        nodes = np.fromiter(held, U64, len(held))
        sizes = np.array([len(x) for x in held.values()], np.int64)
        owner, flat = np.repeat(np.arange(len(nodes), dtype=np.int32), sizes), np.concatenate(list(held.values()))
        held.clear()
        common = _member(heavy.value, flat)
        h_owner, h_token = owner[common], mix(flat[common])
        if len(h_owner):
            np.logical_not(common, out=common)
            owner, flat = owner[common], flat[common]
        del common
        return _blocks(nodes, sizes, owner, flat, h_owner, h_token, n_shards, per_group)

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in shingle_sets(*word_hashes(batch.column(0)), s.k):
                if len(x):
                    held[set_hash(x)] = x
            if len(held) >= s.chunk_documents:
                yield blocks(held)
                give_back_memory()
        if held:
            yield blocks(held)
        give_back_memory()

    return run


def _gathered(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """What several blocks hold: nodes, sizes, shingles of each, shingles; nodes, sizes and tokens of heavy shingles.

    Copies bring the same node in several blocks, each with all that it has here; its first block counts.
    """
    nodes, per, flat = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3))
    sizes, heavy = np.concatenate([p[1].astype(np.uint32) for p in parts]), [np.concatenate([p[k] for p in parts]) for k in (4, 5, 6)]
    block = np.repeat(np.arange(len(parts)), [len(p[4]) for p in parts])
    parts.clear()
    first = np.unique(nodes, return_index=True)[1]
    if len(first) < len(nodes):
        own = np.zeros(len(nodes), bool)
        own[first] = True
        flat = flat[np.repeat(own, per)]
        nodes, per, sizes = nodes[own], per[own], sizes[own]
    _, first, at = np.unique(heavy[0], return_index=True, return_inverse=True)
    return nodes, sizes, per, flat, *(x[block == block[first][at]] for x in heavy)


def _regroup(s: Settings, n_shards: int):
    """Second step of the scatter: the blocks of some groups, taken together up to a shard's size, to their shards."""

    def dealt(parts):
        nodes, sizes, per, flat, h_nodes, h_sizes, h_token = _gathered(parts)
        every, at = np.unique(np.concatenate([nodes, h_nodes]), return_inverse=True)
        size = np.zeros(len(every), np.int64)
        size[at] = np.concatenate([sizes, h_sizes])
        return _blocks(every, size, np.repeat(at[: len(nodes)], per), flat, at[len(nodes) :], h_token, n_shards, 1)

    def run(batches):
        held, size = defaultdict(list), 0  # by group: a node may be in several, with other shingles in each
        for batch in batches:
            for group, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = unpack(block.as_py())
                held[group].append(part)
                size += len(part[3]) + len(part[6])
                if size >= s.shard_shingles:
                    yield from map(dealt, held.values())
                    held, size = defaultdict(list), 0
        yield from map(dealt, held.values())

    return run


def _shared(n_shards: int, n_buckets: int):
    """In one shard: the shingles that occur in several nodes, with a class of frequency, on to the nodes' buckets."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        nodes, node_sizes, per, tokens, h_marks, h_sizes, h_tokens = _gathered([unpack(b.as_py()) for b in table.column("block")])
        owner = np.repeat(np.arange(len(nodes), dtype=np.int32), per)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        # nearly all tokens stand alone and go at once
        again = tokens[1:] == tokens[:-1]
        keep = np.zeros(len(tokens), bool)
        keep[1:] = again
        keep[:-1] |= again
        tokens, owner = tokens[keep], owner[order[keep]]
        del order, again, keep
        kind = np.empty(0, np.uint8)
        if len(tokens):
            starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            count = np.diff(np.append(starts, len(tokens)))
            several = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
            keep = np.repeat(several, count)
            tokens, owner, count = tokens[keep], owner[keep], count[several]
            kind = np.repeat(np.where(count < 16, count, 12 + np.log2(count).astype(np.int64)).astype(np.uint8), count)
        full = np.concatenate([U64(shard) << U64(32) | tokens.astype(U64), h_tokens])
        marks = np.concatenate([nodes[owner], h_marks])
        sizes = np.concatenate([node_sizes[owner], h_sizes.astype(np.uint32)])
        kind = np.concatenate([kind, np.full(len(full) - len(kind), HEAVY_CLASS, np.uint8)])
        bucket = shard_of(mix(marks), n_buckets)
        order = np.lexsort((marks, bucket))
        buckets, at = np.unique(bucket[order], return_index=True)
        at, out = np.append(at, len(order)), []
        for i, a, b in zip(buckets.tolist(), at[:-1], at[1:], strict=True):  # none where no shingle is shared
            rows = order[a:b]
            m = marks[rows]
            first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
            out.append((i, pack(m[first], sizes[rows[first]], narrow(np.diff(np.append(first, len(m)))), full[rows] if len(rows) and (full[rows] >> U64(32)).max() != (full[rows] >> U64(32)).min() else np.append((full[rows] & LOW32).astype(np.uint32), np.uint32(full[rows[0]] >> U64(32))), kind[rows])))
        give_back_memory()
        return pa.table({"bucket": pa.array([i for i, _ in out], pa.int32()), "block": pa.array([b for _, b in out], pa.binary())})

    return run


PREFIX = "id long, n int, shared int, matches int, token long, place int"


def _prefixes(s: Settings):
    """In one bucket of nodes: each node's prefix among its shared shingles, if it can have a partner at all."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(b.as_py()) for b in table.column("block")]
        nodes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.zeros(len(nodes), np.int64)
        n[at] = np.concatenate([p[1] for p in parts])
        owner = np.repeat(at.astype(np.int32), np.concatenate([p[2] for p in parts]))
        tokens = np.concatenate([p[3] if p[3].dtype == U64 else U64(p[3][-1]) << U64(32) | p[3][:-1].astype(U64) for p in parts])
        kinds = np.concatenate([p[4] for p in parts])
        del parts
        order = np.lexsort((tokens, kinds, owner))
        owner, tokens, kinds = owner[order], tokens[order], kinds[order]
        del order
        # different shingles of one node with the same token are numbered
        again = np.flatnonzero((owner[1:] == owner[:-1]) & (kinds[1:] == kinds[:-1]) & (tokens[1:] == tokens[:-1])) + 1
        if len(again):
            number = np.arange(len(again)) - np.maximum.accumulate(np.where(np.diff(again, prepend=-1) > 1, np.arange(len(again)), 0)) + 1
            tokens[again] = mix(tokens[again] + number.astype(U64))
        shared = np.bincount(owner, minlength=len(nodes))
        starts = np.cumsum(shared) - shared
        shortest = shared - overlap_needed(n, s.percent) + 1
        place = np.arange(len(owner), dtype=np.int32) - starts.astype(np.int32)[owner]
        weight = np.where(kinds < 16, kinds, np.float32(2.0) ** (np.minimum(kinds, 60).astype(np.float32) - 12))
        weight[place >= shortest[owner]] = 0
        cost = np.bincount(owner, weight, len(nodes)) / np.maximum(shortest, 1)
        matches = np.clip(1 + np.log2(1 + cost / 16).astype(np.int64), 1, s.longest_extension)
        matches = np.minimum(matches, overlap_needed(n, s.percent))
        keep = ((shortest > 0)[owner]) & (place < (shortest + matches - 1)[owner])
        owner, place, tokens = owner[keep], place[keep], tokens[keep]
        narrow = lambda v: v[owner].astype(np.int32)
        return pa.table({"id": nodes[owner].view(np.int64), "n": narrow(n), "shared": narrow(shared), "matches": narrow(matches), "token": tokens.view(np.int64), "place": place})

    return run


# ------------------------------------------------------------------ verification


def _sets_of(rows: DataFrame, described: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """(id, set) of the nodes in ``wanted``, made anew from the texts that have one of their text hashes."""
    tags = described.where("kind = 0").select("mark", "tag").join(wanted.select(F.col("id").alias("mark")), "mark", "left_semi")
    tags = materialize(tags.select("tag").distinct(), "join-tags")
    if tags.count() <= s.most_broadcast:  # 8 bytes each
        tags = F.broadcast(tags)

    def run(batches):
        for batch in batches:
            sets = [x for x in shingle_sets(*word_hashes(batch.column(0)), s.k) if len(x)]
            marks = np.array([set_hash(x) for x in sets], U64)
            yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "set"])

    sets = rows.join(tags, "tag", "left_semi").select("text").mapInArrow(run, "id long, set binary")
    return materialize(sets.groupBy("id").agg(F.first("set").alias("set")), "join-sets")


def _verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = int(_member(x, y).sum())
                good.append(100 * both >= s.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _similar_size(s: Settings, x: str, y: str):
    return (100 * F.least(x, y) >= s.percent * F.greatest(x, y))


def link_components(groups: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(node, root) of the nodes that are linked with another, from their prefixes and whole sets."""
    members = groups.withColumn("comp", F.col("id"))
    links, done = None, None
    for _ in range(s.rounds):
        # everyone against the most central node of each group: the one with the smallest share of shingles of its own
        centre = members.groupBy("token").agg(F.min(F.struct(((F.col("n") - F.col("shared")) / F.col("n")).alias("own"), "id", "n", "comp")).alias("c"))
        pairs = members.join(centre, "token").where((F.col("comp") != F.col("c.comp")) & _similar_size(s, "n", "c.n"))
        pairs = pairs.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "join-pairs")
        done = pairs if done is None else done.union(pairs)
        found = materialize(_verified(pairs, sets, s), "join-links")
        links = found if links is None else links.union(found)
        members, links = _relabel(groups, links)
    # across components: a pair is made once, at its first common prefix shingle, and only if it shares as
    # many of them as the less extended of the two asks for
    order = groups.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "token")))["token"].alias("prefix"))
    order = materialize(order.join(members.select("id").distinct(), "id", "left_semi"), "join-orders")
    members = members.join(order, "id")
    left, right = members.alias("x"), members.alias("y")
    fits = _similar_size(s, "x.n", "y.n") & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.id") < F.col("y.id"))
    need = F.ceil(F.lit(s.percent) * (F.col("x.n") + F.col("y.n")) / (100 + s.percent))
    possible = F.least("x.place", "y.place") + F.least(F.col("x.shared") - F.col("x.place"), F.col("y.shared") - F.col("y.place")) >= need
    common = F.array_intersect("x.prefix", "y.prefix")
    enough = (F.size(common) >= F.least("x.matches", "y.matches")) & (F.get(common, F.lit(0)) == F.col("x.token"))
    pairs = left.join(right, (F.col("x.token") == F.col("y.token")) & fits & possible & enough).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    if done is not None:
        pairs = pairs.join(done, ["a", "b"], "left_anti")
    found = materialize(_verified(materialize(pairs, "join-pairs"), sets, s), "join-links")
    return connected_components(found if links is None else links.union(found))


def _relabel(groups: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their components, without the groups that one component fills; the components' stars, to go on from."""
    comps = materialize(connected_components(links), "join-components")
    members = groups.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
    mixed = members.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
    return materialize(members.join(mixed, "token", "left_semi"), "join-members"), comps.select(F.col("node").alias("a"), F.col("root").alias("b"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of every document."""
    s = settings or Settings()
    small_batches(docs.sparkSession)
    body = F.col(text).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("text"), F.xxhash64(body).alias("tag"))
    described = materialize(rows.mapInArrow(_describe(s), "kind byte, id long, n long, mark long, tag long"), "join-documents")
    documents = described.where("kind = 0").drop("kind", "tag")
    count = documents.count()
    heavy = docs.sparkSession.sparkContext.broadcast(_heavy_shingles(described, count, s))
    n_shards = max(1, -(-text_bytes(docs, text) // (6 * s.shard_shingles)))
    per_group = group_size(n_shards, s.fan_out)
    dealt = rows.select("text").mapInArrow(_deal(s, n_shards, per_group, heavy), "shard int, block binary")
    if per_group > 1:
        dealt = dealt.repartition(-(-n_shards // per_group), "shard").mapInArrow(_regroup(s, n_shards), "shard int, block binary")
    shared = dealt.groupBy("shard").applyInArrow(_shared(n_shards, n_shards), "bucket int, block binary")
    prefixes = materialize(shared.groupBy("bucket").applyInArrow(_prefixes(s), PREFIX), "join-prefixes")
    several = prefixes.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token")
    groups = materialize(prefixes.join(several, "token", "left_semi"), "join-groups")
    sets = _sets_of(rows, described, groups.select("id").distinct(), s)
    roots = materialize(link_components(groups, sets, s), "join-roots")
    hint = (lambda df: F.broadcast(df)) if roots.count() <= s.most_broadcast // 2 else (lambda df: df)
    named = documents.join(hint(roots.withColumnRenamed("node", "mark")), "mark", "left").withColumn("comp", F.coalesce("root", "mark"))
    several = named.where("n > 0").groupBy("comp").agg(F.count("*").alias("c"), F.min("id").alias("component_id")).where("c > 1")
    several = materialize(several.select("comp", "component_id"), "join-named")
    hint = (lambda df: F.broadcast(df)) if several.count() <= s.most_broadcast // 2 else (lambda df: df)
    final = named.join(hint(several), "comp", "left")
    return final.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"))
