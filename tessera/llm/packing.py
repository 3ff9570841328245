"""Best-fit packing by exact complements.

Documents become token pieces of at most ``size`` tokens. The plan works on the histogram of piece lengths, which has ``size``
entries at most whatever the input: lengths look up the gap that they leave among single lengths, pair sums and triple sums, and
consume such combinations, the most available first, as often as the counts allow; what finds no exact complement is packed
best-fit, and so are the last combinations if that takes fewer sequences. The plan is a table of slots (a few thousand rows,
bounded by ``size``); pieces find their slot by their rank among pieces of their length. Ranks come from counts per (length, salt), so no length is ever gathered in a
task, however many pieces share it.

Defined results: a null text counts as empty, its document is the end id alone. Texts may be as long as a worker can hold with
their ids; one of n tokens becomes n / size pieces, rounded up. Ids may be null or repeat: each row is packed
on its own. Only the id and text columns are read, so other columns can't clash. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import encoding, runtime

#: Pieces of one length and salt at least, about; more where the square root of their number is larger, so that neither the
#: ranks inside a salt nor the sums over the salts of a length take a long sort.
GROUP = 1_000
#: Starts of the list of exact combinations that the plan looks at.
TRIED = 64


def cut(docs: DataFrame, path: str, pattern: str, end_id: int = 2, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id_col``, piece, start, length, ids_crc32, salt (and ids) of every piece of every whole text. Only longer documents
    are cut, into pieces of ``size``; the first may be shorter."""
    runtime.ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        own = encoding.encoder(path, pattern)
        count, part = 0, TaskContext.get().partitionId()
        for batch in runtime.slices(batches, "text"):
            ids, counts = encoding.encode_texts(own, [x or "" for x in batch.column(1).to_pylist()])
            ends, row, piece, start, length, crc, lists = np.cumsum(counts), [], [], [], [], [], []
            for i, (b, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                own_ids = np.append(ids[b - n : b], end_id).astype("<u4")
                stops = list(range(len(own_ids), 0, -size))[::-1]
                for k, (s, e) in enumerate(zip([0, *stops[:-1]], stops, strict=True)):
                    row.append(i), piece.append(k), start.append(s), length.append(e - s)
                    crc.append(zlib.crc32(own_ids[s:e].tobytes()))
                    if with_ids:
                        lists.append(own_ids[s:e].astype(np.int32))
            salt = ((np.arange(count, count + len(row)) * 48271 + part * 69621) % 2147483647).astype(np.int32)
            count += len(row)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(salt)]
            names = ["id", "piece", "start", "length", "ids_crc32", "salt"]
            if with_ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, salt int" + ", ids array<int>" * with_ids
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


Plan = list[tuple[tuple[int, ...], int]]


class Sums:
    """Which lengths left add up to a gap: singles, pair sums, triple sums; of several the one that can be used most often.

    The index holds, for each pair sum, the pair that could be used most often when it was last looked at. Counts only
    fall, so what it says is an upper bound, and is looked at anew before it is used."""

    def __init__(self, left: np.ndarray) -> None:
        self.left = left
        self.times, self.small = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        for total in range(2, len(left)):
            self._look(total)

    def _look(self, total: int) -> None:
        small = np.arange(1, total // 2 + 1)
        times = np.minimum(self.left[small], self.left[total - small])
        if total % 2 == 0:
            times[-1] = self.left[total // 2] // 2
        k = int(times.argmax())
        self.times[total], self.small[total] = times[k], small[k]

    def _pair(self, total: int) -> tuple[int, int]:
        return total - int(self.small[total]), int(self.small[total])

    def uses(self, parts: tuple[int, ...]) -> int:
        return min(int(self.left[p]) // parts.count(p) for p in set(parts))

    def find(self, gap: int, reach: int) -> tuple[int, ...] | None:
        """Parts, one for a reach of 1 and so on, that add up to the gap."""
        if reach == 1:
            return (gap,) if self.left[gap] else None
        if reach == 2:
            if gap < 2:
                return None
            self._look(gap)
            return self._pair(gap) if self.times[gap] else None
        first = np.arange(1, gap - 1)
        best = np.minimum(self.left[first], self.times[gap - first])
        while len(best) and best[k := int(best.argmax())]:
            one, rest = int(first[k]), gap - int(first[k])
            self._look(rest)
            now = min(int(self.left[one]), int(self.times[rest]))
            if now < best[k]:
                best[k] = now
            elif self.uses(parts := (one, *self._pair(rest))):
                return parts
            else:  # one length in two places
                best[k] = 0
        return None


def by_complements(lengths: np.ndarray) -> Plan:
    """Combinations that fill a sequence exactly: from the longest length down those with a single complement, then with a pair,
    then with a triple, each used as often as counts allow."""
    index, size, out = Sums(lengths.copy()), len(lengths) - 1, []
    left = index.left
    out += [((size,), int(left[size]))] * bool(left[size])
    left[size] = 0
    for reach in (1, 2, 3):
        for n in range(size - 1, 0, -1):
            while left[n]:
                left[n] -= 1
                found = index.find(size - n, reach)
                left[n] += 1
                if not found:
                    break
                parts = (n, *found)
                times = index.uses(parts)
                for p in set(parts):
                    left[p] -= times * parts.count(p)
                out.append((parts, times))
    return out


def by_best_fit(lengths: np.ndarray) -> Plan:
    """Every length from the longest on goes where it leaves the smallest gap, a new sequence where it fits into none."""
    size = len(lengths) - 1
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]  # by gap: combinations, and how many
    there = np.zeros(size + 1, bool)
    for n in range(size, 0, -1):
        count = int(lengths[n])
        while count:
            fits = np.flatnonzero(there[n:])
            gap = n + int(fits[0]) if len(fits) else size
            parts, times = open_[gap].pop() if len(fits) else ((), count)
            there[gap] = bool(open_[gap])
            each = gap // n
            if count >= each:
                used = min(times, count // each)
            else:
                each, used = count, 1
            count -= each * used
            open_[gap - each * n].append((parts + (n,) * each, used))
            there[gap - each * n] = True
            if parts and times > used:
                open_[gap].append((parts, times - used))
                there[gap] = True
    return [x for held in open_ for x in held]


def plan(lengths: dict[int, int], size: int) -> Plan:
    """Combinations of lengths and how many sequences hold each: exact combinations, then best-fit for what they leave.

    The last exact combinations take short pieces that best-fit needs to fill other gaps; in small inputs that costs more than
    they gain. So of the list of exact combinations, as consumed, the longest start (of ``TRIED`` evenly spaced ones) is kept
    after which best-fit needs the fewest sequences; the others are given back."""
    left = np.zeros(size + 1, np.int64)
    for n, count in lengths.items():
        left[n] = count
    exact = by_complements(left)
    best: Plan | None = None
    for k in sorted({round(len(exact) * i / TRIED) for i in range(TRIED + 1)}, reverse=True):
        rest = left.copy()
        for parts, times in exact[:k]:
            for p in parts:
                rest[p] -= times
        found = exact[:k] + by_best_fit(rest)
        if best is None or sequences(found) < sequences(best):
            best = found
        if sequences(best) == -(-int(left @ np.arange(size + 1)) // size):
            break
    return best


def sequences(plan_: Plan) -> int:
    return sum(times for _, times in plan_)


def slots(plan_: Plan) -> np.ndarray:
    """Rows length, first rank, ranks, places of that length in a sequence, first sequence, offset; sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for parts, times in plan_:
        offset = 0
        for p in dict.fromkeys(parts):
            many = parts.count(p)
            rows.append((p, used.get(p, 0), times * many, many, sequence, offset))
            used[p] = used.get(p, 0) + times * many
            offset += p * many
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, size: int = 1024, order: tuple[str, ...] = ("doc_id", "piece"), planner: Callable[[dict[int, int], int], list] = plan) -> DataFrame:
    """pieces with sequence_id and offset (gapless from 0 in each sequence) in place of salt.

    pieces: a stored table (it is read more than once and must not change) with columns length (1 to size) and salt.
    """
    spark = pieces.sparkSession
    runtime.ship(spark)
    counts = pieces.groupBy("length").count().collect()  # at most ``size`` rows
    salts = [1] * (size + 1)
    for r in counts:
        salts[r["length"]] = -(-r["count"] // max(GROUP, math.isqrt(r["count"])))
    held = spark.sparkContext.broadcast(slots(planner({r["length"]: r["count"] for r in counts}, size)))
    salted = pieces.withColumn("_b", F.col("salt") % F.get(F.lit(salts), F.col("length").cast("int")))
    by_bucket = salted.groupBy("length", "_b").count()
    before = by_bucket.select("length", "_b", (F.sum("count").over(Window.partitionBy("length").orderBy("_b")) - F.col("count")).alias("_before"))  # for each length the root of its count at most, or a thousandth
    inside = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_b").orderBy(*order, "salt")).cast("bigint") - 1)
    ranked = inside.join(before, ["length", "_b"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    keep = [c for c in pieces.columns if c != "salt"]

    def run(batches):
        table = held.value
        key = table[:, 0] << np.int64(48) | table[:, 1]
        for batch in batches:
            length, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            row = table[np.searchsorted(key, length << np.int64(48) | rank, "right") - 1]
            at = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(row[:, 4] + at // row[:, 3]), pa.array(row[:, 5] + at % row[:, 3] * length)],
                [*batch.schema.names[2:], "sequence_id", "offset"],
            )

    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", sequence_id long, offset long"
    rows = ranked.select(F.col("length").alias("_length"), "_rank", *[F.col(c) for c in keep])
    return runtime.compact(rows.mapInArrow(run, schema), pieces)


def pack_documents(docs: DataFrame, path: str, pattern: str, end_id: int = 2, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut and pack: ``id_col``, piece, start, length, ids_crc32 (ids), sequence_id and offset of every piece."""
    pieces = runtime.materialize(cut(docs, path, pattern, end_id, size, id_col, text_col, with_ids), "pieces")
    return pack(pieces, size, (id_col, "piece"))
