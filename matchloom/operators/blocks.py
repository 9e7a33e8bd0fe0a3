"""A stated query set against all rows, in blocks.

Rows are dealt into parts and queries into blocks of bounded size by hashes of their keys; each pair of a part and a block is one bounded group, worked on in numpy, and gives only
the best few rows of each of its queries. No pair of a row and a query ever is a row of a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.similarity import lcs_length, sorted_tokens

#: Rows of a part and queries of a block, on average.
PART_ROWS, BLOCK_QUERIES = 8192, 256
#: Kinds of characters in the histograms that bound a common subsequence; kinds that fall together only loosen the bound.
KINDS = 64


def against(rows: DataFrame, row_key: str, queries: DataFrame, query_key: str, work: Callable, schema: str, pairs: DataFrame | None = None, counts: tuple[int, int] | None = None, part_rows: int = PART_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """work(part, block) of every pair of a part of rows and a block of queries, both Arrow tables that aren't empty; it returns an Arrow table of schema or None.

    pairs, rows that have both keys, go to the one part and block of their keys: work(part, block, pairs). counts: how many rows and queries there are, where that is known."""
    from pyspark.sql.types import StructType

    spark = rows.sparkSession
    n_rows, n_queries = counts or (rows.count(), queries.count())
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // part_rows))
    blocks = max(1, -(-n_queries // block_queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = rows.withColumn("_part", dealt(row_key, parts)).withColumn("_block", every(blocks))
    right = queries.withColumn("_block", dealt(query_key, blocks)).withColumn("_part", every(parts))
    if pairs is not None:
        placed = pairs.withColumn("_part", dealt(row_key, parts)).withColumn("_block", dealt(query_key, blocks))
        right = right.withColumn("_pair", F.lit(False)).unionByName(placed.withColumn("_pair", F.lit(True)), allowMissingColumns=True)
    with_pairs = pairs is not None
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(part, block):
        import pyarrow as pa
        import pyarrow.compute as pc

        more = ()
        if with_pairs:
            more, block = (block.filter(block["_pair"]),), block.filter(pc.invert(block["_pair"]))
        found = work(part, block, *more) if part.num_rows and block.num_rows else None
        return found if found is not None else pa.table({n: pa.array([], pa.null()) for n in names}).cast(_arrow(schema))

    return left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(run, schema)


def _arrow(schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])


def made(schema: str, columns: list):
    """An Arrow table of numpy columns or lists."""
    import pyarrow as pa

    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _arrow(schema))], schema=_arrow(schema))


def _lists(table, column: str):
    """The flat values of a list column and each row's number of them."""
    import numpy as np

    lists = table[column].combine_chunks()
    return np.asarray(lists.flatten()), np.asarray(lists.value_lengths().fill_null(0), np.int64)


def _unit(weights, lengths):
    """weights of each list divided by their length as a vector."""
    import numpy as np

    row = np.repeat(np.arange(len(lengths)), lengths)
    norm = np.sqrt(np.bincount(row, weights * weights, len(lengths)))
    return weights / np.where(norm > 0, norm, 1)[row]


def sparse_products(part, block):
    """Cosines of the sparse vectors `g` (keys) and `w` (weights): a row for each row of part, a column for each of block. Keys that no query has add to a row's length alone."""
    import numpy as np

    (keys, n), (asked, asked_n) = _lists(part, "g"), _lists(block, "g")
    weights, asked_w = _unit(_lists(part, "w")[0], n), _unit(_lists(block, "w")[0], asked_n)
    vocabulary, place = np.unique(asked, return_inverse=True)
    out = np.zeros((len(n), len(asked_n)))
    if not len(vocabulary) or not len(keys):
        return out
    dense = np.zeros((len(vocabulary), len(asked_n)))
    dense[place, np.repeat(np.arange(len(asked_n)), asked_n)] = asked_w
    at = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == keys)
    row, at, weights = np.repeat(np.arange(len(n)), n)[hit], at[hit], weights[hit]
    edges = np.searchsorted(row, np.arange(0, len(n) + 64, 64))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):  # products of 64 rows at a time
        if a < b:
            first = np.flatnonzero(np.diff(row[a:b], prepend=-1))
            out[row[a:b][first]] = np.add.reduceat(dense[at[a:b]] * weights[a:b, None], first)
    return out


def best_rows(scores, ids, k: int):
    """Places of the best k by score to nine places, then by id."""
    import numpy as np

    rounded = np.round(scores, 9)
    some = np.arange(len(ids))
    if len(ids) > k:
        some = np.flatnonzero(rounded >= np.partition(rounded, len(ids) - k)[len(ids) - k])
    return some[np.lexsort((ids[some], -rounded[some]))[:k]]


class Texts:
    """Texts as sorted tokens, with what bounds their similarity."""

    def __init__(self, texts: list[str | None]):
        import numpy as np

        self.tokens = [sorted_tokens(t) for t in texts]
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        points = np.frombuffer("".join(self.tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % KINDS
        row = np.repeat(np.arange(len(texts)), self.length)
        self.kinds = np.bincount(row * KINDS + points, minlength=len(texts) * KINDS).reshape(-1, KINDS).astype(np.int32)

    def bounds(self, other: Texts, j: int):
        """No text here is more similar to other's j-th than this."""
        import numpy as np

        total = self.length + other.length[j]
        return np.where(total > 0, 2 * np.minimum(self.kinds, other.kinds[j]).sum(axis=1) / np.maximum(total, 1), 1.0)

    def similarity(self, i: int, other: Texts, j: int) -> float:
        total = int(self.length[i] + other.length[j])
        return 2 * lcs_length(self.tokens[i], other.tokens[j]) / total if total else 1.0


def _by_length(codes: list[str]) -> dict:
    """Of each length the places of its codes, and their letters, a row for each position."""
    import numpy as np

    lengths, out = np.array([len(c) for c in codes], np.int64), {}
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        letters = np.frombuffer("".join(codes[i] for i in at.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        out[n] = at, np.ascontiguousarray(letters.reshape(len(at), n).T)
    return out


#: An odd base of hashes modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _without(letters, times: int) -> Iterator:
    """Hashes of what is left of each code, for every choice of `times` letters, 2 at most, to leave out."""
    import numpy as np

    n, count = letters.shape
    before = np.zeros((n + 1, count), np.uint64)
    for i in range(n):
        before[i + 1] = before[i] + (letters[i].astype(np.uint64) + np.uint64(1)) * np.uint64(pow(BASE, i + 1, 1 << 64))
    once, twice = np.uint64(INVERSE), np.uint64(INVERSE * INVERSE % (1 << 64))
    if times == 0:
        yield before[n]
    elif times == 1:
        for i in range(n):
            yield before[i] + (before[n] - before[i + 1]) * once
    else:
        for j in range(n):
            after = (before[n] - before[j + 1]) * twice
            for i in range(j):
                yield before[i] + (before[j] - before[i + 1]) * once + after


def _edits(a, b):
    """Edit distances of the columns of two matrices of letters."""
    import numpy as np

    before = [np.full(a.shape[1], j, np.int32) for j in range(len(b) + 1)]
    for i in range(len(a)):
        now = [np.full(a.shape[1], i + 1, np.int32)]
        for j in range(len(b)):
            now.append(np.minimum(np.minimum(before[j + 1], now[j]) + 1, before[j] + (a[i] != b[j])))
        before = now
    return before[-1]


def near_codes(codes: list[str], asked: list[str], within: int = 2):
    """Places in codes and in asked of all pairs at an edit distance of `within`, 2 at most, or less, and their distances.

    Such a pair has equal rests when no more letters than that are left out on either side, so only pairs with a rest of equal hash are compared; all those are."""
    import numpy as np

    known, wanted, out = _by_length(codes), _by_length(asked), []
    for n, (places, letters) in known.items():
        for m, (asked_places, asked_letters) in wanted.items():
            if abs(n - m) > within:
                continue
            drop = within - max(0, m - n)
            over = max(0, drop - n)
            drop, asked_drop = drop - over, within - max(0, n - m) - over
            rests = list(_without(asked_letters, asked_drop))
            owner = np.tile(np.arange(len(asked_places)), len(rests))
            rests = np.concatenate(rests)
            order = np.argsort(rests, kind="stable")
            rests, owner = rests[order], owner[order]
            slot = lambda h: (h * np.uint64(BASE) >> np.uint64(42)).astype(np.int64)
            some = np.zeros(1 << 22, bool)  # most rests have no equal, and that is quick to see
            some[slot(rests)] = True
            met = []
            for rest in _without(letters, drop):
                at = np.flatnonzero(some[slot(rest)])
                low, high = np.searchsorted(rests, rest[at], "left"), np.searchsorted(rests, rest[at], "right")
                n_met = high - low
                first = np.repeat(low - (np.cumsum(n_met) - n_met), n_met)
                met.append(np.unique(np.repeat(at, n_met) * len(asked_places) + owner[first + np.arange(len(first))]))
            met = np.unique(np.concatenate(met))
            for start in range(0, len(met), 1 << 16):
                i, j = np.divmod(met[start : start + (1 << 16)], len(asked_places))
                distance = _edits(letters[:, i], asked_letters[:, j])
                kept = distance <= within
                out.append((places[i[kept]], asked_places[j[kept]], distance[kept].astype(np.int64)))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def descending(bounds) -> Iterator[tuple[int, float]]:
    """Places by falling bound, with the bound."""
    import numpy as np

    order = np.argsort(-bounds, kind="stable")
    return zip(order.tolist(), bounds[order].tolist())
