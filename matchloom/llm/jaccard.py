"""An exact n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Equal sets are one row of the matrix. Grams are ordered by a count of the documents that may hold them, rare ones first, so two similar
sets share a gram within a short prefix of each; only such entries of the product are wanted. Rows of the matrix that have any partner
are stored as sorted arrays in files. Tasks map them, make compressed blocks of rows, and accumulate the overlaps of all wanted entries of a pair of blocks stretch of
grams by stretch of grams; an entry is dropped as soon as what is left cannot lift it to the bound that both sizes set.

Every set is first multiplied by the first one that shares a prefix gram. What these links join needs no further product inside. Of what is left across
components, a gram of few sets gives its pairs, and the sets of a frequent one are dealt to blocks by size, whose pairs are multiplied whole: only the links that come
out become rows. So no group of copies is expanded into its pairs, and no link between sets that are not joined otherwise is missed.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import Scratch, documents, kept, map_flat, small_batches, tidy, write_flat, written
from matchloom.llm.components import connected_components

#: Counters of the document-frequency sketch (a power of two); a collision only changes the order of grams, never a result.
SKETCH = 1 << 20


#: Bytes of a word that is hashed along with all others; a longer one is hashed by itself.
LONG_WORD = 64
_SPACES = bytes(x in b" \t\n\v\f\r" for x in range(256))


def _mix(x):
    """Of 64-bit numbers, in place: different ones stay different."""
    import numpy as np

    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(data: bytes):
    """(starts, 64-bit hashes) of the words of data, whose first byte and last 16 are spaces and whose length is a multiple of 8."""
    import numpy as np
    import xxhash

    space = np.frombuffer(_SPACES, bool)[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    eights = np.frombuffer(data, "<u8")
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def eight(at, left):
        """The bytes from each place on, at most 8 and no more than are left of the word, as a number."""
        k, shift = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
        return (eights[k] >> shift | eights[k + 1] << np.uint64(64) - shift) & masks[np.minimum(left, 8)]  # a shift by 64 gives 0

    out = _mix(_mix(lengths.astype(np.uint64)) ^ eight(starts, lengths))
    for k in range(8, LONG_WORD, 8):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        out[more] = _mix(out[more] ^ eight(starts[more] + k, lengths[more] - k))
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    return starts, out


def shingle_hashes(texts: list[bytes | None], width: int) -> list:
    """Of each text the distinct 64-bit hashes of its shingles, ascending; of all its words if they are fewer. All words of the texts are hashed at once."""
    import numpy as np
    import xxhash

    data = b" ".join([b"", *(x or b"" for x in texts), b""]).lower()
    starts, ids = word_hashes(data + b" " * (16 + -len(data) % 8))
    ends = np.cumsum([1 + len(x or b"") for x in texts], dtype=np.int64)
    last = np.searchsorted(starts, ends, side="right").tolist()  # a text is followed by a space, so no word begins there
    n = max(0, len(ids) - width + 1)
    out = ids[:n].copy()
    for k in range(1, width):
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += ids[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    sets = []
    for text, a, b in zip(texts, [0, *last], last):
        if b - a >= width:
            own = out[a : b - width + 1]
            own.sort()
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            sets.append(own[keep])
        elif b > a:
            sets.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(_words(text)), b - a)], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


#: Words that a worker keeps with their hashes, for op1.
KEPT_WORDS = 300_000
_WORDS = kept(_Hashes())


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("raw"))


def _words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()


def _sketch(docs: DataFrame, width: int, path: str, slices: int = 16) -> None:
    """Stores, for each of SKETCH values of a gram's hash, how many documents' sets have it."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, n, total = [], 0, np.zeros(SKETCH, np.int64)
        for batch in batches:
            for grams in shingle_hashes(batch["raw"].to_pylist(), width):
                held.append(grams & np.uint64(SKETCH - 1))
                n += len(grams)
                if n > 500_000:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=SKETCH)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held).astype(np.int64), minlength=SKETCH)
        if total.any():
            parts = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in np.split(total, slices)]
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def add(key, table):
        import numpy as np
        import pyarrow as pa

        out = np.zeros(SKETCH // slices, np.int64)
        for blob in table["counts"].to_pylist():
            out += np.frombuffer(zlib.decompress(blob), "<u4")
        write_flat(f"{path}/sketch-{key[0].as_py()}", out.astype("<u8").tobytes())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32())})

    done = {r["slice"] for r in _raw(docs).mapInArrow(tidy(count), "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int").collect()}  # a row a slice
    for k in set(range(slices)) - done:
        write_flat(f"{path}/sketch-{k}", bytes(8 * SKETCH // slices))


_sketches: dict = kept({})


def _mapped_sketch(path: str, slices: int = 16):
    import numpy as np

    if path not in _sketches:
        _sketches.clear()
        _sketches[path] = np.concatenate([np.minimum(map_flat(f"{path}/sketch-{k}", "<u8"), 0xFFFFFFFF).astype(np.uint32) for k in range(slices)])
    return _sketches[path]


def _sets(docs: DataFrame, width: int, percent: int, path: str) -> DataFrame:
    """Each document's set: its size, a 128-bit signature and its prefix, rare grams first."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        counts = _mapped_sketch(path)
        for batch in batches:
            rows = []
            for doc_id, grams in zip(batch["doc_id"].to_pylist(), shingle_hashes(batch["raw"].to_pylist(), width)):
                n = len(grams)
                least = -(-percent * n // 100)  # overlap with any partner, which has percent of its grams at least
                keep = n - least + 1 if n else 0
                rarest = np.argsort(counts[(grams & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")[:keep]  # grams ascend, and so do those of one count
                digest = xxhash.xxh3_128_digest(grams.tobytes())
                rows.append((doc_id, n, digest, grams[rarest].view(np.int64)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.list_(pa.int64()))], names=["doc_id", "n", "signature", "prefix"])

    return _raw(docs).mapInArrow(tidy(run), "doc_id long, n long, signature binary, prefix array<long>")


def _shared_postings(one: DataFrame, path: str, buckets: int, scratch: Scratch) -> DataFrame:
    """(id, n, pos, gram) of the prefix grams that more than one set has.

    Which these are is told by counts alone; the workers then map them as sorted arrays and look their own grams up, so the many grams of one set are exchanged
    once and without their places."""
    counts = one.select(F.explode("prefix").alias("gram")).groupBy("gram").agg(F.count("*").alias("holders")).filter("holders > 1")

    def sort_grams(key, table):
        import numpy as np
        import pyarrow as pa

        write_flat(f"{path}/shared-{key[0].as_py()}", np.sort(table["gram"].to_numpy()).astype("<i8").tobytes())
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32())})

    bucketed = counts.select(F.pmod("gram", F.lit(buckets)).cast("int").alias("bucket"), "gram")
    found = {r["bucket"] for r in bucketed.groupBy("bucket").applyInArrow(sort_grams, "bucket int").collect()}  # a row a bucket

    def look_up(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        lists: dict = {}
        for batch in batches:
            prefix = batch["prefix"]
            grams = np.asarray(prefix.flatten(), np.int64)
            counted = np.asarray(prefix.value_lengths(), np.int64)
            row = np.repeat(np.arange(len(counted)), counted)
            pos = np.arange(len(grams)) - np.repeat(np.cumsum(counted) - counted, counted)
            keep = np.zeros(len(grams), bool)
            bucket = grams % buckets
            order = np.argsort(bucket, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                b = int(bucket[own[0]])
                if b in found:
                    if b not in lists:
                        lists[b] = map_flat(f"{path}/shared-{b}", "<i8")
                    at = np.minimum(np.searchsorted(lists[b], grams[own]), len(lists[b]) - 1)
                    keep[own] = lists[b][at] == grams[own]
            ids, n = batch["doc_id"].to_numpy(), batch["n"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[keep]]), pa.array(n[row[keep]]), pa.array(pos[keep].astype(np.int32)), pa.array(grams[keep])], names=["id", "n", "pos", "gram"])

    return written(one.select("doc_id", "n", "prefix").mapInArrow(tidy(look_up), "id long, n long, pos int, gram long"), "postings", scratch)


def _store_rows(docs: DataFrame, wanted: DataFrame, width: int, path: str, buckets: int, scratch: Scratch) -> DataFrame:
    """Stores the incidence rows of the wanted documents, a file for each input partition, and returns where each lies.

    The wanted ids go to the workers as sorted arrays in files, so no text is exchanged."""

    def sort_ids(key, table):
        import numpy as np
        import pyarrow as pa

        write_flat(f"{path}/wanted-{key[0].as_py()}", np.unique(table["id"].to_numpy()).astype("<i8").tobytes())
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32())})

    bucketed = wanted.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), "id")
    found = {r["bucket"] for r in bucketed.groupBy("bucket").applyInArrow(sort_ids, "bucket int").collect()}  # a row a bucket

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        lists = {}
        name, at, blobs, rows = uuid.uuid4().hex, 0, [], []

        def is_wanted(ids, bucket):
            out = np.zeros(len(ids), bool)
            for b in np.unique(bucket).tolist():
                if b in found:
                    if b not in lists:
                        lists[b] = map_flat(f"{path}/wanted-{b}", "<i8")
                    own = bucket == b
                    k = np.minimum(np.searchsorted(lists[b], ids[own]), len(lists[b]) - 1)
                    out[own] = lists[b][k] == ids[own]
            return out

        def flush():
            nonlocal name, at
            write_flat(f"{path}/rows-{name}", b"".join(blobs))
            columns = list(zip(*rows))
            out = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array([name] * len(rows)), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["id", "file", "at", "n"])
            blobs.clear()
            rows.clear()
            name, at = uuid.uuid4().hex, 0
            return out

        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            some = np.flatnonzero(is_wanted(ids, batch["bucket"].to_numpy()))
            for i, grams in zip(some.tolist(), shingle_hashes(batch["raw"].take(pa.array(some)).to_pylist(), width)):
                rows.append((int(ids[i]), at, len(grams)))
                blobs.append(grams.tobytes())
                at += len(grams)
                if at > 2_000_000:
                    yield flush()
        if rows:
            yield flush()

    with_bucket = _raw(docs).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    stored = with_bucket.mapInArrow(tidy(run), "id long, file string, at long, n long")
    return written(stored, "incidence", scratch)


class Block:
    """Rows of the incidence matrix in compressed form: the columns (ranks of grams) of each row, ascending, after each other."""

    def __init__(self, rows: list):
        import numpy as np

        self.n = np.array([len(r) for r in rows], np.int64)
        self.grams = np.concatenate(rows) if rows else np.empty(0, np.uint64)
        self.row = np.repeat(np.arange(len(rows)), self.n)


def products(x: Block, y: Block, i, j, percent: int, stretches: int = 8):
    """Of the entries (i, j) of the product of x and y transposed, which reach the Jaccard bound: 100 * |both| >= percent * |either|.

    Both blocks are cut into stretches of grams. Overlaps of all entries that are left are accumulated stretch by stretch, and an entry goes as soon as what its
    rows have left can't lift it to the overlap that their sizes ask for."""
    import numpy as np

    need = -(-percent * (x.n[i] + y.n[j]) // (100 + percent))
    have = np.zeros(len(i), np.int64)
    alive = np.flatnonzero((need <= np.minimum(x.n[i], y.n[j])) & (need > 0))
    _, rank = np.unique(np.concatenate([x.grams, y.grams]), return_inverse=True)
    v = int(rank.max()) + 1 if len(rank) else 1
    left, right = x.row * v + rank[: len(x.grams)], y.row * v + rank[len(x.grams) :]  # (row, gram) as one number, ascending
    for s in range(stretches):
        if not len(alive):
            break
        low, high = v * s // stretches, v * (s + 1) // stretches
        a, b = np.searchsorted(left, i[alive] * v + low), np.searchsorted(left, i[alive] * v + high)
        n = b - a
        of = np.repeat(np.arange(len(alive)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + a[of]
        want = (j[alive][of] - i[alive][of]) * v + left[at]
        place = np.minimum(np.searchsorted(right, want), max(0, len(right) - 1))
        have[alive] += np.bincount(of, right[place] == want, len(alive)).astype(np.int64)
        rest = np.minimum(np.searchsorted(left, (i[alive] + 1) * v) - b, np.searchsorted(right, (j[alive] + 1) * v) - np.searchsorted(right, j[alive] * v + high))
        alive = alive[have[alive] + rest >= need[alive]]
    out = np.zeros(len(i), bool)
    out[alive] = True
    return out


#: Entries of both blocks of one product, unless two rows alone have more.
BLOCK_ENTRIES = 1 << 20


def _multiply(pairs: DataFrame, rows: DataFrame, percent: int, path: str, tasks: int) -> DataFrame:
    """Those of the pairs (a, b) that reach the bound. Pairs are put together by the files of their rows, and make the blocks and the entries of a product as they come."""
    left, right = (rows.select(F.col("id").alias(c), F.struct("file", "at", "n").alias(f"{c}_row")) for c in "ab")
    placed = pairs.join(left, "a").join(right, "b").select("a", "b", "a_row.file", F.col("b_row.file").alias("file2"), F.col("a_row.at"), F.col("a_row.n"), F.col("b_row.at").alias("at2"), F.col("b_row.n").alias("n2"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        arrays: dict = {}

        def of(name: str):
            if name not in arrays:
                if len(arrays) > 256:
                    arrays.clear()
                arrays[name] = map_flat(f"{path}/rows-{name}", "<u8")
            return arrays[name]

        def multiply(entries: list, x: dict, y: dict):
            i, j = (np.array([e[k] for e in entries], np.int64) for k in (2, 3))
            linked = products(*(Block([of(name)[at : at + n] for name, at, n in side]) for side in (x, y)), i, j, percent)
            kept = [e for e, good in zip(entries, linked.tolist()) if good]
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in kept], pa.int64()) for k in (0, 1)], names=["a", "b"])

        entries, x, y, size = [], {}, {}, 0
        for batch in batches:
            for a, b, f, f2, at, n, at2, n2 in zip(*(c.to_pylist() for c in batch.columns)):
                one, two = (f, at, n), (f2, at2, n2)
                more = n * (one not in x) + n2 * (two not in y)
                if entries and (size + more > BLOCK_ENTRIES or len(entries) >= 4096):
                    yield multiply(entries, x, y)
                    entries, x, y, size, more = [], {}, {}, 0, n + n2
                entries.append((a, b, x.setdefault(one, len(x)), y.setdefault(two, len(y))))
                size += more
        if entries:
            yield multiply(entries, x, y)

    return placed.repartition(tasks, "file", F.pmod(F.xxhash64("a", "b"), F.lit(64))).sortWithinPartitions("file", "file2", "at").mapInArrow(tidy(run), "a long, b long")


#: Sets of a gram whose pairs are listed one by one; the sets of a more frequent gram are multiplied in blocks of BLOCK_ROWS.
LISTED, BLOCK_ROWS = 16, 64


def whole_product(rows: list, others: list, wanted, percent: int, width: int = 1 << 15):
    """Which entries of rows times others transposed are wanted (a matrix of truths) and reach the bound. Sets are ascending arrays.

    Overlaps of all entries are accumulated stretch of grams by stretch, each a product of two dense matrices, until no entry can reach its bound any more."""
    import numpy as np

    wanted = wanted.copy()
    i, j = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
    if not len(i):
        return wanted
    x, y = Block([rows[k] for k in i]), Block([others[k] for k in j])
    need = -(-percent * (x.n[:, None] + y.n[None, :]) // (100 + percent))
    alive = wanted[np.ix_(i, j)] & (need > 0) & (need <= np.minimum(x.n[:, None], y.n[None, :]))
    _, rank = np.unique(np.concatenate([x.grams, y.grams]), return_inverse=True)
    v = int(rank.max()) + 1 if len(rank) else 0
    sides = [(x, rank[: len(x.grams)]), (y, rank[len(x.grams) :])]
    left = [x.n.copy(), y.n.copy()]
    have = np.zeros(alive.shape, np.int64)
    step = max(1, min(width, -(-v // 4)))
    for low in range(0, v, step):
        if not alive.any():
            break
        parts = []
        for k, (block, column) in enumerate(sides):
            own = np.flatnonzero((column >= low) & (column < low + step))
            part = np.zeros((len(block.n), step), np.float32)
            part[block.row[own], column[own] - low] = 1
            left[k] -= np.bincount(block.row[own], minlength=len(block.n))
            parts.append(part)
        have += np.rint(parts[0] @ parts[1].T).astype(np.int64)
        alive &= have + np.minimum(left[0][:, None], left[1][None, :]) >= need
    wanted[np.ix_(i, j)] = alive
    return wanted


def _blocks(mixed: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(gram, size, own, part, rows) of the sets of each frequent gram: sets of one class of sizes together, in blocks of about BLOCK_ROWS.

    Linked sets are in one class or in classes next to each other. A component that fills half a block has blocks of its own."""
    base = f"(ln({100 / percent}D) + 1e-9D)"  # a little more than the greatest ratio of linked sizes, so that rounding parts none
    classed = mixed.withColumn("size", F.expr(f"cast(floor(ln(n) / {base}) as long)"))
    counted = classed.groupBy("gram", "size", "c").agg(F.count("*").alias("m"))
    counted = counted.withColumn("own", F.col("m") >= BLOCK_ROWS // 2).withColumn("of", F.when(F.col("own"), F.col("c")).otherwise(F.lit(0)))
    parts = counted.groupBy("gram", "size", "own", "of").agg(F.ceil(F.sum("m") / BLOCK_ROWS).cast("long").alias("parts"))
    placed = classed.join(counted.join(parts, ["gram", "size", "own", "of"]).drop("m"), ["gram", "size", "c"]).join(rows.select("id", "file", "at"), "id")
    block = F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")
    return placed.groupBy("gram", "size", "own", "of", block).agg(F.collect_list(F.struct("id", "n", "pos", "c", "file", "at")).alias("rows"))


def _multiply_blocks(blocks: DataFrame, percent: int, path: str, tasks: int) -> DataFrame:
    """Links (a, b) between sets of different components in the blocks of a gram, those of one block included."""
    name = F.struct("own", "of", "part")
    left = blocks.select("gram", F.col("size").alias("size1"), name.alias("b1"), F.col("rows").alias("rows1"))
    right = blocks.select("gram", F.col("size").alias("size2"), name.alias("b2"), F.col("rows").alias("rows2"), F.explode(F.array("size", F.col("size") - 1)).alias("size1"))
    pairs = left.join(right, ["gram", "size1"]).filter("(size1 < size2 or b1 <= b2) and not (b1.own and b2.own and b1.of = b2.of)")
    pairs = pairs.select("rows1", "rows2", F.expr("size1 = size2 and b1 = b2").alias("same"), F.xxhash64("gram", "size1", "size2", "b1", "b2").alias("k"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        arrays: dict = {}

        def of(name: str):
            if name not in arrays:
                if len(arrays) > 256:
                    arrays.clear()
                arrays[name] = map_flat(f"{path}/rows-{name}", "<u8")
            return arrays[name]

        for batch in batches:
            for one, two, same in zip(*(batch[c] for c in ("rows1", "rows2", "same"))):
                one, two = one.as_py(), two.as_py()
                (id1, n1, pos1, c1), (id2, n2, pos2, c2) = ([np.array([r[k] for r in side], np.int64) for k in ("id", "n", "pos", "c")] for side in (one, two))
                n1, pos1, c1 = n1[:, None], pos1[:, None], c1[:, None]
                need = -(-percent * (n1 + n2) // (100 + percent))
                wanted = (c1 != c2) & (100 * n1 >= percent * n2) & (100 * n2 >= percent * n1) & (np.minimum(n1 - pos1, n2 - pos2) >= need)
                if same.as_py():
                    wanted = np.triu(wanted, 1)
                if wanted.any():
                    sets = ([of(r["file"])[r["at"] : r["at"] + r["n"]] for r in side] for side in (one, two))
                    a, b = np.nonzero(whole_product(*sets, wanted, percent))
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(id1[a]), pa.array(id2[b])], names=["a", "b"])

    return pairs.repartition(tasks, "k").select("rows1", "rows2", "same").mapInArrow(tidy(run), "a long, b long")


#: Parts of a group of equal sets, so that no task has to join a large one.
SALTS = 64


def _equal_sets(some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives, links) of equal sets: the least id of each, and stars that join the others to it through the least of a hashed part."""
    salted = some.select("doc_id", "signature", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    parts = salted.groupBy("signature", "salt").agg(F.min("doc_id").alias("own"), F.count("*").alias("copies"))
    classes = parts.groupBy("signature").agg(F.min("own").alias("rep"), F.sum("copies").alias("copies"))
    inside = salted.join(parts.filter("copies > 1"), ["signature", "salt"]).select(F.col("doc_id").alias("a"), F.col("own").alias("b"))
    outside = parts.join(classes.filter("copies > 1"), "signature").select(F.col("own").alias("a"), F.col("rep").alias("b"))
    return classes.select(F.col("rep").alias("doc_id")), inside.unionByName(outside).filter("a <> b")


def jaccard_classes(docs: DataFrame, width: int, percent: int, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents whose sets reach percent/100 of Jaccard similarity are linked.

    A null text is empty; an empty set is linked with nothing, not even another empty one, so its component is its own doc_id. Rows that repeat a doc_id are
    one document with the links of all its texts. A null doc_id is a document like any other, and the least. Other columns are left out. An empty table gives an empty
    result."""
    nobody = -(1 << 63)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(nobody)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    null = lambda c: F.when(F.col(c) != nobody, F.col(c)).alias(c)
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _classes(docs, width, percent, buckets).select(null("doc_id"), "n_shingles", null("component_id"))
    # Texts are compared under hashes of id and text, and joined by id after that.
    key = F.xxhash64("doc_id", F.col("text").isNull(), "text")
    scratch = Scratch(docs.sparkSession)
    ids = written(docs.select(key.alias("key"), "doc_id"), "ids", scratch)
    keyed = docs.select(key.alias("doc_id"), "text").dropDuplicates(["doc_id"])
    found = _classes(keyed, width, percent, buckets).withColumnRenamed("doc_id", "key")
    placed = written(ids.join(found, "key"), "placed", scratch)
    least = placed.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    joined = connected_components(placed.join(least, "component_id").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct(), scratch)
    out = placed.join(joined, placed["doc_id"] == joined["id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    result = written(out.select(null("doc_id"), "n_shingles", null("component_id")), "classes")
    scratch.clear()
    return result


def _classes(docs: DataFrame, width: int, percent: int, buckets: int | None) -> DataFrame:
    """jaccard_classes of ids that are neither null nor repeated."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = Scratch(spark)
    path = scratch.dir("jaccard")
    _sketch(docs, width, path)
    sets = written(_sets(docs, width, percent, path), "sets", scratch)
    some = sets.filter("n > 0")
    representatives, members = _equal_sets(some)
    one = some.join(representatives, "doc_id")  # one row a class
    hot = _shared_postings(one, path, buckets, scratch)
    hot = hot.join(hot.groupBy("gram").agg(F.min("id").alias("first")), "gram")
    rows = _store_rows(docs, hot.select("id").distinct(), width, path, buckets, scratch)
    fits = lambda n1, n2: f"100 * {n1} >= {percent} * {n2}"
    stars = hot.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    joined = connected_components(_multiply(stars, rows, percent, path, buckets), scratch)
    # Taken as the first gram that a pair shares, a gram leaves no more overlap than what follows it in either set; at the one that really is the first, no linked pair fails.
    need = lambda n1, n2: f"ceil({percent} * ({n1} + {n2}) / {100 + percent})"
    able = lambda df: df.filter(fits("n1", "n2")).filter(fits("n2", "n1")).filter(f"least(n1 - pos1, n2 - pos2) >= {need('n1', 'n2')}")
    # What is left: prefix grams that sets of different components share.
    known = hot.select("gram", "id", "n", "pos").join(joined, "id", "left").select("gram", "id", "n", "pos", F.coalesce("component", "id").alias("c"))
    across = known.groupBy("gram").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("m")).filter("c1 < c2").select("gram", "m")
    mixed = written(known.join(across, "gram"), "mixed", scratch)
    x, y = (mixed.filter(F.col("m") <= LISTED).select("gram", *(F.col(c).alias(f"{c}{k}") for c in ("id", "n", "pos", "c"))) for k in "12")
    rest = able(x.join(y, "gram").filter("id1 < id2 and c1 <> c2")).select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct()
    more = _multiply(rest, rows, percent, path, buckets)
    blocks = written(_blocks(mixed.filter(F.col("m") > LISTED), rows, percent), "blocks", scratch)
    more = more.unionByName(_multiply_blocks(blocks, percent, path, buckets))
    final = connected_components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(members), scratch)
    out = sets.join(final, sets["doc_id"] == final["id"], "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component_id"))
    result = written(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id"), "classes")
    scratch.clear()
    return result


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir), 3, 90)


#: The same by a plain self-join and reachability, for tables of a few thousand documents.
OP8_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from w
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 90 * (x.n + y.n - o)
), e as (
  select a, b from l union all select b, a from l
), c as (
  select doc_id as id, doc_id as comp from documents union select e.b, c.comp from c join e on e.a = c.id
), m as (
  select id, min(comp) as comp from c group by id
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.comp as component_id from documents d join m on m.id = d.doc_id left join n on n.doc_id = d.doc_id
"""
