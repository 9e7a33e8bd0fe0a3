"""Best-fit packing by bin completion.

Sequences are packed over the histogram of piece lengths, which has at most `capacity` entries however large the
corpus is, so the driver plans on it alone. Branch and bound: around the longest remaining piece, enumerate the
fillings that no other filling dominates, repeat each as often as the counts allow, and prune by the waste that a
better solution may still have. Best-fit decreasing gives the first incumbent. Pieces then take the slots of their
length by rank; ranks come from counts of each input partition, so no length is gathered in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.llm.common import documents, small_batches, tidy, written

Runs = list[tuple[tuple[int, ...], int]]  # lengths of one sequence, and how many sequences are filled alike


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and the bound by pieces of which no two, or only limited filling, share a sequence."""
    import numpy as np

    n = np.arange(capacity + 1)
    c = np.array([counts.get(k, 0) for k in range(capacity + 1)], object)  # Python integers: no sum is too large
    number, volume = (np.concatenate([[0], np.cumsum(x)]) for x in (c, n * c))  # of lengths below an index
    best, half, end = -(-volume[-1] // capacity), capacity // 2 + 1, capacity + 1
    for k in {0, *(x for x in counts if x < half)}:
        above = capacity - k + 1  # the first length that leaves no room for k
        room = capacity * (number[above] - number[half]) - (volume[above] - volume[half])
        best = max(best, number[end] - number[half] + max(0, -(-(volume[half] - volume[k] - room) // capacity)))
    return int(best)


def best_fit(counts: dict[int, int], capacity: int) -> Runs:
    """Best-fit decreasing over counts: sequences that are filled alike are moved together."""
    open_: dict[int, list[list]] = {}  # room left -> [[filling, number of sequences], ...]
    rooms: list[int] = []

    def put(room: int, filling: tuple[int, ...], n: int) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append([filling, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                put(capacity - fit * length, (length,) * fit, left // fit)
                rest = left % fit
                put(capacity - rest * length, (length,) * rest, int(rest > 0))
                break
            room = rooms[at]
            filling, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            fit = room // length
            whole = min(n, left // fit)
            put(room - fit * length, filling + (length,) * fit, whole)
            left -= whole * fit
            rest = left if n > whole and left < fit else 0
            if rest:
                put(room - rest * length, filling + (length,) * rest, 1)
                left = 0
            put(room, filling, n - whole - (rest > 0))
    return [(filling, n) for groups in open_.values() for filling, n in groups]


#: Nodes of the search, fillings tried at a node, and steps of their enumeration for each filling wanted.
NODES, WIDTH, STEPS = 4000, 24, 50


def completions(left: dict[int, int], lengths: list[int], first: int, capacity: int, most: int) -> list[tuple[int, ...]]:
    """Undominated fillings around one piece of length `first`, least waste first, at most `most` of those met in order of decreasing pieces.

    A filling is dominated if a piece that is left still fits, if one of its pieces can be exchanged for a longer one that is left and
    fits, or if two of its pieces, or all, can be exchanged for a single one of at least their sum: what replaces them leaves smaller pieces over."""
    rest = capacity - first
    if left.get(rest, 0) - (rest == first) > 0:
        return [(rest,)]  # it could stand for all pieces of any other filling
    found: list[tuple[int, tuple[int, ...]]] = []
    steps, smallest = 0, lengths[0]

    def undominated(chosen: list[int], room: int) -> bool:
        used = Counter(chosen)
        used[first] += 1
        free = lambda lo, hi: any(left[n] - used[n] > 0 for n in lengths[bisect.bisect_left(lengths, lo) : bisect.bisect_right(lengths, hi)])
        if free(1, room):
            return False
        if room and any(free(x + 1, x + room) for x in set(chosen)):
            return False
        return not any(free(a + b, a + b + room) for i, a in enumerate(chosen) for b in chosen[i + 1 :])

    def extend(chosen: list[int], room: int, top: int) -> None:
        nonlocal steps
        steps += 1
        at = bisect.bisect_right(lengths, min(room, top)) - 1
        grew = False
        while at >= 0 and len(found) < most and steps < STEPS * most:
            n = lengths[at]
            at -= 1
            if left[n] - chosen.count(n) - (n == first) > 0:
                grew = True
                if any(left.get(a + n, 0) - chosen.count(a + n) - (a + n == first) > 0 for a in chosen):
                    steps += 1
                    continue  # whatever follows, one piece that is left could stand for these two
                extend([*chosen, n], room - n, n)
                if room - n < smallest:  # any shorter last piece that leaves room for nothing could be exchanged for this one
                    at = min(at, bisect.bisect_right(lengths, room - smallest) - 1)
        if (not grew or steps >= STEPS * most) and undominated(chosen, room):
            found.append((room, tuple(chosen)))

    extend([], capacity - first, capacity)
    return [x for _, x in sorted(set(found))] or [()]


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES, width: int = WIDTH) -> tuple[Runs, int]:
    """Sequences and the proven lower bound of their number. `nodes` and `width` bound the search, never the pieces: at the end of the budget the best
    solution found stands, and its distance to the bound is known."""
    counts = {n: c for n, c in counts.items() if c}
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    total, spent = sum(n * c for n, c in counts.items()), 0
    number = sum(n for _, n in best)

    left, lengths, runs = dict(counts), sorted(counts), []  # one state for the whole search: a node takes from it and gives back

    def search(used: int, waste: int) -> bool:
        """True when the bound is met or the budget is spent."""
        nonlocal best, number, spent
        if not lengths:
            if used < number:
                best, number = list(runs), used
            return number == bound
        spent += 1
        if spent > nodes:
            return True
        first = lengths[-1]
        for rest in completions(left, lengths, first, capacity, width):
            filling = (first, *rest)
            need = Counter(filling)
            times = min(left[n] // k for n, k in need.items())
            lost = waste + times * (capacity - sum(filling))
            if lost > (number - 1) * capacity - total:
                continue
            runs.append((filling, times))
            for n, k in need.items():
                left[n] -= k * times
                if not left[n]:
                    lengths.pop(bisect.bisect_left(lengths, n))
            done = search(used + times, lost)
            runs.pop()
            for n, k in need.items():
                if not left[n]:
                    bisect.insort(lengths, n)
                left[n] += k * times
            if done:
                return True
        return False

    if number > bound:
        import sys

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        search(0, 0)
    return best, bound


def slots(runs: Runs) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """For each length, runs of its slots: (length, first slot, first sequence, pieces a sequence, offset of the first), ascending; and the number of sequences."""
    out, taken, sequence = [], Counter(), 0
    for filling, times in sorted(runs, key=lambda x: (-x[0][0], x)):
        at = 0
        for n, k in sorted(Counter(filling).items(), reverse=True):
            out.append((n, taken[n], sequence, k, at))
            taken[n] += k * times
            at += n * k
        sequence += times
    return sorted(out), sequence


def cut(ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces. Only the first may be shorter than the capacity."""
    first = ids % capacity or min(ids, capacity)
    return [(0, first), *((at, capacity) for at in range(first, ids, capacity))]


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of each document, with the input partition and the rank among its pieces of the same length."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from matchloom.llm.tokens import Encoder

        encoder, end, part = Encoder.of(vocabulary), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist())):
                ids += end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its sequence and place there; and, the same in each row, the number of sequences and the proven lower bound of it.

    A null text is empty and gives one piece, the end id. Rows that repeat are packed each for itself; other columns are left out.
    An empty table gives an empty result."""
    pieces = written(tokenized_pieces(docs, vocabulary, capacity, end_id), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, bound = complete(counts, capacity)
    plan, number = slots(runs)
    before = per_part.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    ranked = pieces.join(before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before")), ["length", "part"])

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        runs = np.array(plan, np.int64).reshape(-1, 5)
        first = {n: i for i, n in reversed(list(enumerate(runs[:, 0].tolist())))}
        last = {n: i + 1 for i, n in enumerate(runs[:, 0].tolist())}
        for batch in batches:
            lengths, slot = batch["length"].to_numpy(), batch["slot"].to_numpy()
            at = np.empty(len(slot), np.int64)
            for n in np.unique(lengths).tolist():
                own = lengths == n
                at[own] = first[n] + np.searchsorted(runs[first[n] : last[n], 1], slot[own], side="right") - 1
            _, begin, sequence, each, offset = runs[at].T
            k = slot - begin
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence + k // each), pa.array(offset + k % each * lengths), *(pa.array(np.full(len(slot), x, np.int64)) for x in (number, bound))], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "sequences", "lower_bound"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("slot")).mapInArrow(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, sequences long, lower_bound long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
