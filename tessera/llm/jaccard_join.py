"""N-gram Jaccard join by grouped prefixes.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with equal sets (128-bit fingerprint) are
one member. Members with the same size and the same prefix, the first n - ceil(t n) + 1 hashes in one global order, are one
group. Two sets that are similar enough share a hash of their prefixes, so groups meet in the buckets of their prefix hashes,
pairs of groups are filtered by size and by position, then expanded to members, filtered by a lower bound of their
difference and verified on the whole sets.

The order puts frequent hashes last. All hashes of all texts are counted by their upper 30 bits (one more for each doubling of
the input beyond a TB, so that buckets don't fill with unrelated hashes), in a shuffle of two bytes a hash; the most frequent (at most ``max_heavy``, whatever the input) are broadcast. Any such order is exact; it decides how many
candidates there are, not which links are found.

Groups of copies aren't expanded into all pairs. First every bucket links its members to one hub, the entry with the fewest
rarer hashes before it, which is the least edited of a family; these links give components. Then pairs are formed only between
different components of a bucket: places meet by their hash and by the size bands that size and position allow, all such pairs
are verified too. So no link between components is lost, pairs inside a component need no look, and sets that share a passage
but can't be similar don't meet. Frequent buckets are dealt over salts by their counted size, each with a hub, and the hubs
meet again.

Defined results: a null or empty text has an empty set, links with nothing and is its own component, as is each such row with
a null id. Null ids take part; a component's id is the smallest id in it. Repeated rows are equal sets. Only the named columns
are read. Texts may be of any length. An empty table gives an empty table. Hashes stand for shingles: two different shingles of a pair of documents are
taken for one with a chance of about 1e-13.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime
from .bpe import segment_sums
from .components import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Entries of a frequent hash that share a salt, about.
SALTED = 20_000
#: Rows of ids that may be broadcast.
FEW = 250_000
#: Size bands between the smallest and the largest set that one can be similar to.
BANDS = 3
#: Buckets of so many entries meet whole in the second look; bands would save nothing there.
WHOLE = 64
#: Entries of a bucket that share a deal in the second look, about.
DEALT = 100_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of fewer words than width, the one hash of them all."""
    hash_of = runtime.worker_cache("words", _Words).__getitem__
    found = [np.array(list(map(hash_of, piece.encode().translate(_LOWER).split())), np.uint64) for piece in runtime.pieces(text or "")]
    h = found[0] if len(found) == 1 else np.concatenate(found)
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(width, len(h))))
    for k in range(min(width, len(h))):
        out = (out ^ h[k : k + n]) * _A
        out ^= out >> np.uint64(29)
    out *= _B
    out ^= out >> np.uint64(32)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def parity(hashes: np.ndarray) -> bytes:
    """For each place of a table of at least as many bits as hashes, whether an odd number of them falls there."""
    bits = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the size of two sets' symmetric difference, from their parities; the larger table is folded."""
    x, y, nx, ny = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(a) * 8, len(b) * 8
    if nx < ny:
        x, y, nx, ny = y, x, ny, nx
    while nx > ny:
        nx //= 2
        x = (x & ((1 << nx) - 1)) ^ (x >> nx)
    return (x ^ y).bit_count()


def bucket_bits(shares: int) -> int:
    """Upper bits of a hash that name its bucket, by the input in shares of 16 MB: 30, and more beyond a TB."""
    return 30 + min(8, max(0, (shares >> 16).bit_length()))


def add_counts(total: np.ndarray, places: np.ndarray) -> None:
    """One more for each place; counts have 64 bits, so that the most frequent hash of any input stays the most frequent."""
    np.add.at(total, places, np.uint64(1))


def _count_hashes(docs: DataFrame, width: int, least: int) -> DataFrame:
    """bucket (the upper bits of hashes), count: those that at least ``least`` documents have.

    The first bits of a bucket are its range (256 ranges at least, more where there are over 1,024 partitions, so that a
    task's stream stays bounded, and at most 4 million buckets in one), the last 16 an array; between them, counts say how many
    of the array are whose."""
    all_bits = bucket_bits(runtime.shares(docs))
    top_of = np.uint64(64 - all_bits)
    bits = min(18, all_bits - 16, max(8, all_bits - 22, docs.rdd.getNumPartitions().bit_length() - 2))
    ranges, between, span = 1 << bits, 1 << (all_bits - 16 - bits), all_bits - bits

    def deal(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            top = np.sort(np.concatenate(held) >> top_of)
            counts = np.bincount((top >> np.uint64(16)).astype(np.int64), minlength=ranges * between).astype(np.uint32).reshape(ranges, between)
            low, ends = (top & np.uint64(0xFFFF)).astype(np.uint16), np.cumsum(counts.sum(1))
            return pa.RecordBatch.from_pydict({"range": pa.array(np.arange(ranges, dtype=np.int32)), "counts": [c.tobytes() for c in counts], "low": [low[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]})

        for batch in runtime.slices(batches, "text"):
            for text in batch.column(0).to_pylist():
                held.append(shingles(text, width))
                size += len(held[-1])
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def count(batches):
        at, total = None, np.zeros(1 << span, np.uint64)

        def flush():
            found = np.flatnonzero(total >= least)
            return pa.RecordBatch.from_arrays([pa.array((found + (at << span)).astype(np.int64)), pa.array(total[found].astype(np.int64))], ["bucket", "count"])

        for batch in batches:
            for r, counts, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != at:
                    if at is not None:
                        yield flush()
                        total[:] = 0
                    at = r
                add_counts(total, np.repeat(np.arange(between) << 16, np.frombuffer(counts, np.uint32)) + np.frombuffer(low, np.uint16))
        if at is not None:
            yield flush()

    dealt = docs.mapInArrow(deal, "range int, counts binary, low binary")
    return dealt.repartition(ranges // 4, "range").sortWithinPartitions("range").mapInArrow(count, "bucket long, count long")


def _heavy(docs: DataFrame, width: int, least: int, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many bits buckets have, the most frequent buckets, sorted, and their counts: those over ``least``, or over as much more
    as leaves ``most``."""
    counted = runtime.materialize(_count_hashes(docs, width, least), "heavy", docs, runtime.NARROW)
    steps = {r[0]: r[1] for r in counted.groupBy(F.floor(F.log2("count") * 4).alias("s")).count().collect()}  # a few hundred rows
    kept = from_ = 0
    for s in sorted(steps, reverse=True):
        if kept + steps[s] > most:
            from_ = s + 1
            break
        kept += steps[s]
    rows = counted.where(F.floor(F.log2("count") * 4) >= from_).toArrow()  # at most ``most`` rows
    runtime.discard(counted)
    bucket, count = rows.column("bucket").to_numpy().astype(np.uint64), rows.column("count").to_numpy()
    order = np.argsort(bucket)
    return bucket_bits(runtime.shares(docs)), bucket[order], count[order]


def _sets(docs: DataFrame, width: int, num: int, den: int, heavy, salted: int) -> DataFrame:
    """id, n, fp, gid, prefix (binary, hashes in order), salts (binary, how many salts each hash has), parity of every document."""
    kind = dict(docs.dtypes)["id"]

    def run(batches):
        bits, bucket, count = heavy.value
        some = np.zeros(1 << 24, bool)  # whether any heavy bucket starts with these 24 bits
        some[bucket >> np.uint64(bits - 24)] = True
        for batch in runtime.slices(batches, "text"):
            found = [shingles(t, width) for t in batch.column(1).to_pylist()]
            ns = np.array([len(s) for s in found])
            flat = np.concatenate(found)
            weight = np.zeros(len(flat), np.int64)
            top = flat >> np.uint64(64 - bits)
            near = np.flatnonzero(some[flat >> np.uint64(40)])
            if len(near):
                at = np.minimum(np.searchsorted(bucket, top[near]), len(bucket) - 1)
                weight[near] = np.where(bucket[at] == top[near], count[at], 0)
            heavy_in = segment_sums(weight, ns)
            fps, gids, prefixes, salts, parities, end = [], [], [], [], [], 0
            for s, n, any_heavy in zip(found, ns.tolist(), heavy_in.tolist(), strict=True):
                p = n - -(-num * n // den) + 1 if n else 0
                w = weight[end : end + n]
                end += n
                if any_heavy:
                    order = np.lexsort((s, w))[:p]
                    prefix, w = s[order], w[order]
                else:
                    prefix, w = s[:p], w[:p]
                prefixes.append(prefix.tobytes())
                salts.append((w // salted + 1).astype(np.int32).tobytes())
                fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                gids.append(int.from_bytes(hashlib.blake2b(prefixes[-1], digest_size=8).digest(), "little", signed=True))
                parities.append(parity(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns.astype(np.int32)), pa.array(fps, pa.binary()), pa.array(gids, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(salts, pa.binary()), pa.array(parities, pa.binary())],
                ["id", "n", "fp", "gid", "prefix", "salts", "parity"],
            )

    return docs.mapInArrow(run, f"id {kind}, n int, fp binary, gid long, prefix binary, salts binary, parity binary")


def _entries(groups: DataFrame) -> DataFrame:
    """token, salt (-1: the hash isn't salted), gid, n and pos of every prefix hash of every group."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                gid, n, prefix = part.column(0), part.column(1).to_numpy(), part.column(2).to_pylist()
                if not prefix:
                    continue
                sizes = np.array([len(p) // 8 for p in prefix])
                token = np.frombuffer(b"".join(prefix), np.int64)
                salts = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int32)
                row = np.repeat(np.arange(len(sizes)), sizes)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                own = (gid.to_numpy() & 0x7FFFFFFF)[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token), pa.array(np.where(salts > 1, own % salts, -1).astype(np.int32)), gid.take(pa.array(row)), pa.array(n[row]), pa.array(pos.astype(np.int32))],
                    ["token", "salt", "gid", "n", "pos"],
                )

    return groups.select("gid", "n", "prefix", "salts").mapInArrow(run, "token long, salt int, gid long, n int, pos int")


_SHARED = ["token", "salt", "gid", "n", "pos", "hub", "hub_n", "hub_pos"]


def _shared(entries: DataFrame) -> DataFrame:
    """Entries of buckets with more than one, each with the hub of its bucket: the entry of the smallest pos. Rows stream by."""

    def run(batches):
        kinds = (np.int64, np.int32, np.int64, np.int32, np.int32)
        wait, last = [np.zeros(0, k) for k in kinds], None  # a row that may be alone in its bucket; the bucket and hub given out last
        for batch in batches:
            rows = [np.concatenate([w, c.to_numpy()]) for w, c in zip(wait, batch.columns, strict=True)]
            if not len(rows[0]):
                continue
            token, salt = rows[0], rows[1]
            new = np.append(True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
            head = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
            hub = [rows[k][head] for k in (2, 3, 4)]
            on = last is not None and last[0] == (token[0], salt[0])  # the bucket given out last goes on
            if on:
                for column, value in zip(hub, last[1], strict=True):
                    column[head == 0] = value
            keep = ~(new & np.append(new[1:], True)) | (salt >= 0)
            keep[0] |= on
            end = len(token) - 1
            alone = not keep[end]
            wait = [r[end:] if alone else r[:0] for r in rows]
            if not alone:
                last = (token[end], salt[end]), [column[end] for column in hub]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (*rows, *hub)], _SHARED)

    sorted_ = entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "pos", "gid")
    return sorted_.mapInArrow(run, "token long, salt int, gid long, n int, pos int, hub long, hub_n int, hub_pos int")


def _can_link(n1, pos1, n2, pos2, num: int, den: int):
    """Whether sizes, and the hashes that can still follow the shared one in both, allow the similarity."""
    n1, n2 = n1.cast("bigint"), n2.cast("bigint")
    return (F.least(n1, n2) * den >= F.greatest(n1, n2) * num) & (F.least(n1 - pos1, n2 - pos2) * (num + den) >= (n1 + n2) * num)


def _likely(pairs: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sets may differ by little enough, by their parities: exact bounds at a hundredth of the sets' size."""
    side = lambda c: members.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))

    def run(batches):
        for batch in batches:
            a, b, na, nb, x, y = (c.to_pylist() for c in batch.columns)
            keep = [least_difference(p, q) * (num + den) <= (i + j) * (den - num) for p, q, i, j in zip(x, y, na, nb, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a binary, b binary")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of fingerprints whose whole sets are similar enough."""
    left = sets.select(F.col("fp").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("fp").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(left, "a").join(right, "b")
    same = F.size(F.array_intersect("ha", "hb")).cast("bigint")
    return both.where(same * den >= (F.size("ha") + F.size("hb") - same) * num).select("a", "b")


def _whole_sets(texts: DataFrame, members: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """fp and hashes (array<bigint>) of the members in pairs, from their texts. A table; ids are broadcast if they are few."""
    ends = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp")))
    there = runtime.materialize(members.join(ends, "fp", "left_semi").select("fp", "low"), "there", pairs, runtime.NARROW)
    few = there.count() <= FEW
    nulls = there.where("low IS NULL").limit(1).count() > 0
    held = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    ids = there.select("low").distinct()
    wanted = texts.join(held(ids), texts["id"].eqNullSafe(ids["low"]) if nulls else texts["id"] == ids["low"], "left_semi").select("text")

    def whole(batches):
        for batch in runtime.slices(batches, "text"):
            found = [shingles(t, width) for t in batch.column(0).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary()), lists], ["fp", "hashes"])

    found = wanted.mapInArrow(whole, "fp binary, hashes array<bigint>").join(held(there.select("fp")), "fp", "left_semi")
    out = runtime.materialize(found.dropDuplicates(["fp"]), "whole", texts, runtime.NARROW)
    runtime.discard(there)
    return out


def _crossing(places: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (p, q) of units (gid, n, root) in different components that share a token and may be similar.

    places: token, gid, n, pos, root, main (the token's largest component) and all (its places) of every place of a unit. Pairs inside the
    largest component need no look, so one side lacks it. Places meet by token and by the size bands of both sets: each is
    given to all bands of partners that its size and position allow, as the larger set of a pair and as the smaller. So places
    whose sets share too little beside the token don't meet at all. Tokens with very many places are dealt, one side copied."""
    step = float(np.log(den / num) / BANDS)
    band = lambda n: F.floor(F.log(n) / step).cast("int")
    n, slack = F.col("n").cast("double"), 1e-6
    most = (n - F.col("pos")) * ((num + den) / num) - n + slack  # the largest partner that what follows the token allows
    spans = {"larger": (n * (num / den) - slack, F.least(n + slack, most)), "smaller": (n, F.least(n * (den / num) + slack, most))}

    def keys(role: str, turn: int) -> Column:
        low, high = spans[role]
        own = band(n)
        bands = F.when(high >= low, F.sequence(band(low), band(high))).otherwise(F.array().cast("array<int>"))
        return F.transform(bands, lambda b: F.struct(F.lit(turn).alias("turn"), *((own.alias("big"), b.alias("small")) if role == "larger" else (b.alias("big"), own.alias("small")))))

    def both(first: str, second: str) -> Column:
        meet = F.array(F.struct(*[F.lit(0).alias(c) for c in ("turn", "big", "small")]))
        return F.explode(F.when(F.col("all") <= WHOLE, meet).otherwise(F.concat(keys(first, 0), keys(second, 1)))).alias("key")

    unit, deals = F.struct("gid", "n", "root").alias("unit"), (F.floor(F.col("all") / DEALT) + 1).cast("bigint")
    one = places.where("root <> main").select("token", unit, "n", "pos", F.pmod(F.col("gid"), deals).alias("deal"), both("larger", "smaller"))
    two = places.select("token", unit, "n", "pos", deals.alias("deals"), both("smaller", "larger"))
    two = two.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deals") - 1)))
    flat = lambda df, s: df.select("token", "deal", "key.turn", "key.big", "key.small", *[F.col(c).alias(f"{c}_{s}") for c in ("unit", "n", "pos")])
    met = flat(one, "x").join(flat(two, "y"), ["token", "deal", "turn", "big", "small"])
    met = met.where((F.col("unit_x.root") != F.col("unit_y.root")) & _can_link(F.col("n_x"), F.col("pos_x"), F.col("n_y"), F.col("pos_y"), num, den))
    return met.select(F.least("unit_x", "unit_y").alias("p"), F.greatest("unit_x", "unit_y").alias("q")).distinct()


def similar(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", least_heavy: int = 24, max_heavy: int = 1_000_000, salted: int = SALTED) -> DataFrame:
    """``id_col``, n_shingles, component_id of every document; two documents link if den * |intersection| >= num * |union|.

    least_heavy, max_heavy: from how many documents on a hash is frequent, and how many such are broadcast at most; salted:
    entries of a frequent hash in one salt. They change the work, not the result."""
    spark = docs.sparkSession
    runtime.ship(spark)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    heavy = spark.sparkContext.broadcast(_heavy(texts.select("text"), width, least_heavy, max_heavy))
    sets = runtime.materialize(_sets(texts, width, num, den, heavy, salted), "sets")
    # members: one for each distinct set; groups: same size and prefix
    members = runtime.materialize(sets.where("n > 0").groupBy("fp", "gid", "n").agg(F.min("id").alias("low"), F.first("parity").alias("parity")), "members", sets, runtime.NARROW)
    by_member = members.select("fp", "gid", "n")
    groups = runtime.materialize(members.groupBy("gid", "n").agg(F.min("fp").alias("head"), F.count("*").alias("size")), "groups", members, runtime.NARROW)
    prefixes = sets.where("n > 0").groupBy("gid", "n").agg(F.first("prefix").alias("prefix"), F.first("salts").alias("salts"))
    shared = runtime.materialize(_shared(_entries(prefixes)), "shared", sets, runtime.NARROW)
    heads = groups.select("gid", "n", "head")

    def verify(pairs: DataFrame) -> DataFrame | None:
        pairs = runtime.materialize(_likely(pairs.where("a <> b").distinct(), members, num, den), "pairs", members, runtime.NARROW)
        if not pairs.limit(1).count():
            return None
        whole = _whole_sets(texts, members, pairs, width)
        links = runtime.materialize(_verify(pairs, whole, num, den), "links", members, runtime.NARROW)
        runtime.discard(pairs, whole)
        return links

    # first look: every bucket's entries with its hub, salted buckets' hubs with the bucket's, groups' members with their head
    first = shared.where("gid <> hub OR n <> hub_n").select("hub", "hub_n", "hub_pos", "gid", "n", "pos")
    tops = shared.where("salt >= 0 AND gid = hub AND n = hub_n").select("token", "gid", "n", "pos")
    top = tops.groupBy("token").agg(F.min(F.struct("pos", "gid", "n")).alias("t"))
    second = tops.join(top, "token").where((F.col("gid") != F.col("t.gid")) | (F.col("n") != F.col("t.n"))).select(F.col("t.gid").alias("hub"), F.col("t.n").alias("hub_n"), F.col("t.pos").alias("hub_pos"), "gid", "n", "pos")
    near = first.unionByName(second).where(_can_link(F.col("hub_n"), F.col("hub_pos"), F.col("n"), F.col("pos"), num, den)).select("hub", "hub_n", "gid", "n").distinct()
    hubs = heads.select(F.col("gid").alias("hub"), F.col("n").alias("hub_n"), F.col("head").alias("a"))
    outer = near.join(hubs, ["hub", "hub_n"]).join(by_member.select("gid", "n", F.col("fp").alias("b")), ["gid", "n"]).select("a", "b")
    inner = by_member.join(groups.where("size > 1").select("gid", "n", F.col("head").alias("a")), ["gid", "n"]).select("a", F.col("fp").alias("b"))
    links = verify(outer.unionByName(inner))
    roots = components(links if links is not None else members.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0), members)
    # second look: pairs between different components of a bucket
    rooted = runtime.materialize(by_member.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "gid", "n", F.coalesce("root", "fp").alias("root")), "rooted", members, runtime.NARROW)
    units = rooted.select("gid", "n", "root").distinct()
    own = units.join(groups.where("size > 1").select("gid", "n"), ["gid", "n"], "left_semi").select("gid", "n", F.xxhash64("gid", "n").alias("token"), F.lit(0).alias("pos"), "root")
    places = shared.select("token", "gid", "n", "pos").join(units, ["gid", "n"]).unionByName(own)
    sizes = places.groupBy("token", "root").count()
    mixed = sizes.groupBy("token").agg(F.max(F.struct("count", "root")).alias("m"), F.count("*").alias("roots"), F.sum("count").alias("all")).where("roots > 1")
    mixed = mixed.select("token", F.col("m.root").alias("main"), "all")
    mixed = runtime.materialize(places.join(mixed, "token"), "mixed", shared, runtime.NARROW)
    crossing = _crossing(mixed, num, den)
    flat = crossing.select(*[F.col(f"{p}.{c}").alias(f"{c}_{t}") for p, t in (("p", "a"), ("q", "b")) for c in ("gid", "n", "root")])
    side = lambda t: rooted.select(*[F.col(c).alias(f"{c}_{t}") for c in ("gid", "n", "root")], F.col("fp").alias(t))
    more = verify(flat.join(side("a"), ["gid_a", "n_a", "root_a"]).join(side("b"), ["gid_b", "n_b", "root_b"]).select("a", "b"))
    if more is not None:
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), members)
    runtime.discard(shared, groups, rooted, mixed)  # what follows reads sets, members and roots
    # ids of components, by member and then by document
    by_root = members.select("fp", "low").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    linked = roots.select("root").distinct()
    lows = by_root.join(linked, "root", "left_semi").groupBy("root").agg(F.min("low").alias("component"))
    found = by_root.join(lows, "root", "left").select(F.col("fp").alias("fp_"), F.coalesce("component", "low").alias("component_id"))
    out = sets.select("id", "n", "fp").join(found, F.col("fp") == F.col("fp_"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that stay, all columns as they were: of each component the row with the smallest id (null ids come
    last), and every row without a shingle. Rows of one id are told apart by a number, and any one of them stays."""
    rows, row = runtime.numbered(docs)
    keyed = rows.select(F.struct(rows[id_col].isNull().alias("none"), rows[id_col].alias("id"), rows[row].alias("row")).alias("key"), rows[text_col].alias("text"))
    kept = similar(keyed, id_col="key", text_col="text", **settings).where("key = component_id").select(F.col("key.row").alias("_kept_row"))
    return runtime.compact(rows.join(kept, rows[row] == kept["_kept_row"], "left_semi").drop(row), rows)
