"""An interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped sorted arrays.

Three passes count: words by 64-bit hash, whose place in the sorted hash arrays becomes their id; pairs of ids, each in one bucket by a
mix of both; and, for each id, what follows it and what precedes it. Every count travels as sorted, delta-coded arrays of a
task and bucket, merged by bucket, so no word's pairs meet in one task. Workers map the files and look up sorted
batches of keys. Files grow with the distinct words and pairs of the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import documents, fresh_dir, kept, map_flat, small_batches, tidy, write_flat

#: Distinct words that a worker keeps by id, and words of a batch of texts.
KEPT_WORDS, BATCH_WORDS = 400_000, 400_000
#: The end of a text as a word; no word holds a space.
END = b" end"
BEGIN_ID, UNKNOWN_ID = 0xFFFFFFFE, 0xFFFFFFFF


def _hash_words(words: list[bytes]):
    import numpy as np
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _mix(keys):
    """High bits that depend on all bits of a key."""
    import numpy as np

    x = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _packed(keys, *columns) -> bytes:
    """Sorted keys as byte-shuffled differences, and counts, compressed."""
    import numpy as np
    import zstandard

    delta = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    parts = [np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8).T).tobytes()]
    parts += [np.ascontiguousarray(np.asarray(c, "<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(blob: bytes, n: int, columns: int) -> list:
    import numpy as np
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=8 * n * (1 + columns)), np.uint8).reshape(1 + columns, 8, n)
    delta, *rest = (np.ascontiguousarray(x.T).view("<u8").ravel() for x in raw)
    return [np.cumsum(delta, dtype=np.uint64), *rest]


def _merged(parts: list[list]) -> list:
    """Sorted distinct keys of several parts, with sums of their columns."""
    import numpy as np

    if not parts:
        return [np.empty(0, np.uint64)]
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return [keys, *(np.bincount(at, np.concatenate([p[k] for p in parts]), len(keys)).astype(np.uint64) for k in range(1, len(parts[0])))]


def _by_bucket(keys, bucket, *columns) -> Iterator[tuple]:
    """(bucket, count, blob) of sorted keys."""
    import numpy as np

    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, edges):
        if len(rows):
            yield int(bucket[rows[0]]), len(rows), _packed(keys[rows], *(c[rows] for c in columns))


BLOBS = "bucket int, n long, blob binary"


def _blob_batch(rows: list[tuple]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([int(r[0]) for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "n", "blob"])


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("raw"))


def training(doc_id) -> F.Column:
    """Whether a document is learned from; one without an id isn't."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 7 != 2


def _slices(batches: Iterator) -> Iterator[list[tuple]]:
    """(doc_id, words) in groups of about BATCH_WORDS words."""
    held, n = [], 0
    for batch in batches:
        for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["raw"].to_pylist()):
            words = (raw or b"").lower().split()
            held.append((doc_id, words))
            n += len(words) + 1
            if n >= BATCH_WORDS:
                yield held
                held, n = [], 0
    if held:
        yield held


@dataclass(frozen=True)
class Model:
    path: str
    buckets: int
    vocabulary: int
    tokens: int
    base: tuple[int, ...]  # the id of each word bucket's first word
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    pair_types: int
    continuation_types: tuple[int, int, int]  # words of one, two and more predecessors


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of entries counted 1, 2, 3 and 4 times; a plain 0.5 share where too few say anything."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


class Files:
    """A worker's view of a model's files, and its dictionary of words. Words and pairs lie in sorted arrays of a bucket; per-word figures lie by id."""

    _open: dict[str, Files] = kept({})

    def __init__(self, path: str, buckets: int, base: tuple[int, ...]):
        self.path, self.buckets, self.base = path, buckets, base
        self.arrays: dict[str, object] = {}
        self.ids: dict[bytes, int] = {}

    @classmethod
    def of(cls, path: str, buckets: int, base: tuple[int, ...]) -> Files:
        if path not in cls._open:
            cls._open.clear()
            cls._open[path] = cls(path, buckets, base)
        return cls._open[path]

    def array(self, name: str, dtype: str):
        if name not in self.arrays:
            self.arrays[name] = map_flat(f"{self.path}/{name}", dtype)
        return self.arrays[name]

    def find(self, kind: str, keys, bucket):
        """Places of sorted-by-bucket keys in the arrays of their buckets, -1 where absent."""
        import numpy as np

        out = np.full(len(keys), -1, np.int64)
        order = np.argsort(bucket, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            stored = self.array(f"{kind}-{int(bucket[rows[0]])}.keys", "<u8")
            if not len(stored):
                continue
            at = np.minimum(np.searchsorted(stored, keys[rows]), len(stored) - 1)
            out[rows] = np.where(stored[at] == keys[rows], at, -1)
        return out

    def _learn(self, new: list[bytes]) -> None:
        import numpy as np

        hashes = _hash_words(new)
        bucket = _bucket(hashes, self.buckets)
        at = self.find("words", hashes, bucket)
        ids = np.where(at < 0, UNKNOWN_ID, at + np.array(self.base, np.int64)[bucket])
        self.ids.update(zip(new, ids.tolist()))

    def word_ids(self, words: list[bytes]):
        import numpy as np

        if len(self.ids) > KEPT_WORDS:
            self.ids.clear()
        if new := list(set(words) - self.ids.keys()):
            self._learn(new)
        return np.fromiter(map(self.ids.__getitem__, words), np.uint64, len(words))


def _bucket(keys, buckets: int):
    import numpy as np

    return (_mix(keys) >> np.uint64(40)).astype(np.int64) % buckets


def _sequence(docs: list[tuple], files: Files):
    """Ids of all words and ends of some documents in a row, the id before each, and each document's count."""
    import numpy as np

    counts = np.array([len(w) + 1 for _, w in docs], np.int64)
    ids = files.word_ids([x for _, words in docs for x in (*words, END)])
    before = np.concatenate([[BEGIN_ID], ids[:-1]]).astype(np.uint64)
    before[np.cumsum(counts)[:-1]] = BEGIN_ID
    return ids, before, counts


def _count_words(docs: DataFrame, path: str, buckets: int) -> tuple[tuple[int, ...], int, int]:
    def count(batches: Iterator) -> Iterator:
        import numpy as np

        total: Counter = Counter()
        held: list[list] = []

        def fold() -> None:
            words = list(total)
            hashes, n = _hash_words(words), np.fromiter(total.values(), np.uint64, len(words))
            order = np.argsort(hashes)
            held[:] = [_merged([*held, [hashes[order], n[order]]])]
            total.clear()

        for some in _slices(batches):
            for _, words in some:
                total.update(words)
            total[END] += len(some)
            if len(total) > KEPT_WORDS:
                fold()
        if total:
            fold()
        for keys, n in held:
            yield _blob_batch(list(_by_bucket(keys, _bucket(keys, buckets), n)))

    def store(key, table):
        import pyarrow as pa

        parts = [_unpacked(b, n, 1) for n, b in zip(table["n"].to_pylist(), table["blob"].to_pylist())]
        keys, n = _merged(parts)
        bucket = key[0].as_py()
        write_flat(f"{path}/words-{bucket}.keys", keys.tobytes())
        write_flat(f"{path}/words-{bucket}.counts", n.tobytes())
        return pa.Table.from_pydict({"bucket": pa.array([bucket], pa.int32()), "n": [len(keys)], "tokens": pa.array([int(n.sum())], pa.int64())})

    found = {r["bucket"]: r for r in _raw(docs).mapInArrow(tidy(count), BLOBS).groupBy("bucket").applyInArrow(store, "bucket int, n long, tokens long").collect()}  # a row a bucket
    base, at = [], 0
    for b in range(buckets):
        base.append(at)
        if b in found:
            at += found[b]["n"]
        else:
            write_flat(f"{path}/words-{b}.keys", b"")
            write_flat(f"{path}/words-{b}.counts", b"")
    assert at < BEGIN_ID, "more words than 32-bit ids"
    return tuple(base), at, sum(r["tokens"] for r in found.values())


def _count_pairs(docs: DataFrame, path: str, buckets: int, base: tuple[int, ...]) -> tuple[list[int], int, DataFrame]:
    """Stores the pairs; returns the numbers of pairs counted 1 to 4 times, of pairs, and blobs of per-word partial figures."""
    spark = docs.sparkSession

    def count(batches: Iterator) -> Iterator:
        import numpy as np

        files = Files.of(path, buckets, base)
        held: list[list] = []
        fresh: list = []
        n_fresh = 0

        def fold() -> None:
            nonlocal n_fresh
            keys, n = np.unique(np.concatenate(fresh), return_counts=True)
            held.append([keys, n.astype(np.uint64)])
            fresh.clear()
            n_fresh = 0

        def flush() -> Iterator:
            if held:
                keys, n = _merged(held) if len(held) > 1 else held[0]
                held.clear()
                yield _blob_batch(list(_by_bucket(keys, _bucket(keys, buckets), n)))

        for some in _slices(batches):
            ids, before, _ = _sequence(some, files)
            fresh.append(before << np.uint64(32) | ids)
            n_fresh += len(ids)
            if n_fresh >= 2_000_000:
                fold()
                if sum(len(x[0]) for x in held) > 3_000_000:
                    yield from flush()
        if fresh:
            fold()
        yield from flush()

    def store(key, table):
        import numpy as np
        import pyarrow as pa

        parts = [_unpacked(b, n, 1) for n, b in zip(table["n"].to_pylist(), table["blob"].to_pylist())]
        keys, n = _merged(parts)
        del parts
        bucket = key[0].as_py()
        write_flat(f"{path}/pairs-{bucket}.keys", keys.tobytes())
        write_flat(f"{path}/pairs-{bucket}.counts", n.tobytes())
        of = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        # What each first word is followed by, and how many words precede each second one, as far as this bucket knows.
        first, at = np.unique(keys >> np.uint64(32), return_inverse=True)
        sums = [np.bincount(at, w, len(first)).astype(np.uint64) for w in (n, n == 1, n == 2, n >= 3)]
        second, preceded = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        zero = lambda k: np.zeros(k, np.uint64)
        both = _merged([[first, *sums, zero(len(first))], [second, *[zero(len(second))] * 4, preceded.astype(np.uint64)]])
        return pa.Table.from_pydict({"of": pa.array([of], pa.list_(pa.int64())), "n": pa.array([len(keys)], pa.int64()), "words": pa.array([len(both[0])], pa.int64()), "blob": pa.array([_packed(*both)], pa.binary())})

    partial_path = f"{path}/partial"
    counted = _raw(docs).mapInArrow(tidy(count), BLOBS).groupBy("bucket").applyInArrow(store, "of array<long>, n long, words long, blob binary")
    counted.write.parquet(partial_path)
    partial = spark.read.schema("of array<long>, n long, words long, blob binary").parquet(partial_path)
    sums = partial.agg(*(F.coalesce(F.sum(F.col("of")[k]), F.lit(0)).alias(f"n{k + 1}") for k in range(4)), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    return [sums[f"n{k}"] for k in (1, 2, 3, 4)], sums["n"], partial.select("words", "blob")


def _word_figures(partial: DataFrame, path: str, buckets: int, vocabulary: int) -> list[int]:
    """Stores, by id, each word's followers (count, and pairs counted 1, 2, 3 or more times) and predecessors; returns the numbers of words of 1 to 4 predecessors.

    BEGIN stands after the last word."""
    span = max(1, -(-(vocabulary + 1) // buckets))

    def split(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            for n, blob in zip(batch["words"].to_pylist(), batch["blob"].to_pylist()):
                ids, *figures = _unpacked(blob, n, 5)
                ids = np.where(ids == BEGIN_ID, np.uint64(vocabulary), ids)
                order = np.argsort(ids)
                ids = ids[order]
                yield _blob_batch(list(_by_bucket(ids, (ids // np.uint64(span)).astype(np.int64), *(f[order] for f in figures))))

    def store(key, table):
        import numpy as np
        import pyarrow as pa

        bucket = key[0].as_py()
        dense = np.zeros((span, 5), "<u8")
        for n, blob in zip(table["n"].to_pylist(), table["blob"].to_pylist()):
            ids, *figures = _unpacked(blob, n, 5)
            dense[(ids - np.uint64(bucket * span)).astype(np.int64)] += np.stack(figures, 1)
        write_flat(f"{path}/figures-{bucket}", dense.tobytes())
        return pa.Table.from_pydict({"bucket": pa.array([bucket], pa.int32()), "of": pa.array([[int((dense[:, 4] == k).sum()) for k in (1, 2, 3, 4)] + [int((dense[:, 4] > 0).sum())]], pa.list_(pa.int64()))})

    found = partial.mapInArrow(tidy(split), BLOBS).groupBy("bucket").applyInArrow(store, "bucket int, of array<long>").collect()  # a row a bucket
    seen = {r["bucket"] for r in found}
    for b in range(-(-(vocabulary + 1) // span)):
        if b not in seen:
            write_flat(f"{path}/figures-{b}", bytes(40 * span))
    return [sum(r["of"][k] for r in found) for k in range(5)]


def train(docs: DataFrame, buckets: int | None = None) -> Model:
    """Counts a model over all rows of docs. A null text is empty and counts as an end; rows that repeat count each; an empty table gives a model of no words.

    buckets is the number of files of each kind: one task merges one bucket, so by default it follows the shuffle partitions, 64 at least."""
    buckets = buckets or max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    small_batches(docs.sparkSession)
    path = fresh_dir(docs.sparkSession, "language-model")
    base, vocabulary, tokens = _count_words(docs, path, buckets)
    of_pairs, pairs, partial = _count_pairs(docs, path, buckets, base)
    for b in range(buckets):
        _touch(path, b)
    of_words = _word_figures(partial, path, buckets, vocabulary)
    n1, n2, _, _, n = of_words
    return Model(path, buckets, vocabulary, tokens, base, discounts(of_pairs), discounts(of_words[:4]), pairs, (n1, n2, n - n1 - n2))


def _touch(path: str, bucket: int) -> None:
    """An empty file for a bucket that got no pairs."""
    from pyarrow import fs

    from matchloom.llm.common import _filesystem

    files, at = _filesystem(f"{path}/pairs-{bucket}.keys")
    if files.get_file_info(at).type == fs.FileType.NotFound:
        write_flat(f"{path}/pairs-{bucket}.keys", b"")
        write_flat(f"{path}/pairs-{bucket}.counts", b"")


def _log_probabilities(model: Model, files: Files, ids, before):
    """log10 of each id's probability after the one before it, by interpolation: pairs, then predecessors, then one in V + 1."""
    import numpy as np

    v, span = model.vocabulary, max(1, -(-(model.vocabulary + 1) // model.buckets))

    def figures(of):
        """Rows of per-word figures; nothing for the unknown."""
        out = np.zeros((len(of), 5))
        of = np.where(of == BEGIN_ID, np.uint64(v), of)
        known = np.flatnonzero(of <= v)
        place = of[known].astype(np.int64)
        bucket = place // span
        order = np.argsort(bucket, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            dense = files.array(f"figures-{int(bucket[rows[0]])}", "<u8").reshape(-1, 5)
            out[known[rows]] = dense[place[rows] - bucket[rows[0]] * span]
        return out

    def discounted(counts, by):
        return np.maximum(counts - np.array([0.0, *by])[np.minimum(counts, 3).astype(np.int64)], 0)

    unique, at = np.unique(before << np.uint64(32) | ids, return_inverse=True)
    first, second = unique >> np.uint64(32), unique & np.uint64(0xFFFFFFFF)
    words, place = np.unique(np.concatenate([first, second]), return_inverse=True)
    per_word = figures(words)
    before_row, own_row = per_word[place[: len(unique)]], per_word[place[len(unique) :]]
    counts = np.zeros(len(unique))
    asked = np.flatnonzero((first != UNKNOWN_ID) & (second != UNKNOWN_ID))
    bucket = _bucket(unique[asked], model.buckets)
    found = files.find("pairs", unique[asked], bucket)
    for b in np.unique(bucket[found >= 0]).tolist():
        rows = np.flatnonzero((bucket == b) & (found >= 0))
        counts[asked[rows]] = files.array(f"pairs-{b}.counts", "<u8")[found[rows]]
    low = np.array([1, 1, 1]) @ (np.array(model.word_discounts) * model.continuation_types) / max(1, model.pair_types)
    word_p = (discounted(own_row[:, 4], model.word_discounts) / max(1, model.pair_types)) + (low if model.pair_types else 1.0) / (v + 1)
    total = before_row[:, 0]
    spare = before_row[:, 1:4] @ np.array(model.pair_discounts)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(total > 0, (discounted(counts, model.pair_discounts) + spare * word_p) / np.maximum(total, 1), word_p)
    return np.log10(p)[at]


def score(model: Model, docs: DataFrame) -> DataFrame:
    """Each text under the model and under add-one counts of single words. perplexity is 10 to minus the mean log10 probability of its tokens.

    A null text is empty and has its end alone; rows that repeat are scored each; other columns are left out."""
    small_batches(docs.sparkSession)
    n, v = model.tokens, model.vocabulary

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        files = Files.of(model.path, model.buckets, model.base)
        edges = np.array(model.base, np.uint64)

        def word_counts(ids):
            out = np.zeros(len(ids))
            known = np.flatnonzero(ids != UNKNOWN_ID)
            bucket = np.searchsorted(edges, ids[known], side="right") - 1
            for b in np.unique(bucket).tolist():
                rows = known[bucket == b]
                out[rows] = files.array(f"words-{b}.counts", "<u8")[(ids[rows] - edges[b]).astype(np.int64)]
            return out

        for some in _slices(batches):
            ids, before, counts = _sequence(some, files)
            at = np.concatenate([[0], np.cumsum(counts)[:-1]])
            words, place = np.unique(ids, return_inverse=True)
            c = word_counts(words)[place]
            base = np.add.reduceat(np.log10((c + 1) / (n + v + 1)), at)
            known = np.add.reduceat((c > 0).astype(np.int64), at)
            logs = np.add.reduceat(_log_probabilities(model, files, ids, before), at)
            doc_ids = [d for d, _ in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array([zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else None for d in doc_ids], pa.bool_()), pa.array(counts), pa.array(known), pa.array([n] * len(some), pa.int64()), pa.array(base), pa.array(logs), pa.array(np.power(10.0, np.minimum(300, -logs / counts)))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return _raw(docs).mapInArrow(tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.filter(training(F.col("doc_id"))))
    return score(model, docs)
