"""Repeated lines and passages, by hashes of units.

Units are lines, and windows of consecutive pieces. A piece of a line ends where a pair of words says so: a passage gives the same pieces wherever in a line it stands.
A window is the shortest run of whole pieces from a piece on, or up to a piece, that has `min_run` words; it may go on over ends of lines. Units are
normalised (A-Z lower-cased, white space between words made one), their digests are grouped over the corpus, the earliest occurrence by
doc_id and place is kept, and all others are cut from the texts, with their original offsets in code points. A line has to have `min_line` words to count.

So all that is cut stands in an earlier line, or in an earlier place of `min_run` words or more in a row. Of a repeated passage the whole pieces are cut if they have
`min_run` words together. The words before its first whole piece and after its last stay; pieces have four words on average and no bound.

Digests travel as sorted arrays of a task and bucket. A task keeps one occurrence of each digest to compare with other tasks, so a line that every
document has is no large group. What is to be cut lies in files by document, which workers map: no text is exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import Scratch, documents, free_name, fresh_dir, map_flat, small_batches, tidy, write_flat, written
from matchloom.llm.jaccard import _WORDS, KEPT_WORDS, _raw
from matchloom.llm.language_model import _blob_batch, _by_bucket, _mix, _unpacked

MIN_LINE, MIN_RUN = 5, 20
#: Units of a task that are held before they are sent on. Telling them apart takes some 100 bytes each beside what is held.
HELD = 500_000
SIGN = 1 << 63
BASE = 0xD1342543DE82EF95
BASE_BACK = pow(BASE, -1, 1 << 64)


class Units:
    """Words of a text and the digests of its lines and windows of pieces. A unit's place is four times its first word's index, and one more for lines; for windows up to a piece, four
    times its end and two more."""

    def __init__(self, raw: bytes, min_line: int, min_run: int):
        import numpy as np

        words = raw.lower().split()
        self.n = n = len(words)
        self.raw = raw
        if not n:
            self.place = self.digest = np.empty(0, np.uint64)
            self.first = self.length = self.starts = np.empty(0, np.int64)
            return
        ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
        if len(_WORDS) > KEPT_WORDS:
            _WORDS.clear()
        data = np.frombuffer(raw, np.uint8)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        self.starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        line = np.cumsum(data == 10)[self.starts]
        new_line = np.concatenate([[True], line[1:] != line[:-1]])
        pair = _mix(ids[1:] * np.uint64(3) + ids[:-1] * np.uint64(5))
        new_piece = new_line.copy()
        new_piece[2:] |= (pair[:-1] >> np.uint64(60) & np.uint64(3)) == 0
        pieces, lines = np.flatnonzero(new_piece), np.flatnonzero(new_line)
        piece_length, line_length = (np.diff(np.append(x, n)) for x in (pieces, lines))
        long_enough = line_length >= min_line
        lines, line_length, line_digest = lines[long_enough], line_length[long_enough], self._digests(ids, lines, line_length, 2)[long_enough]
        # Windows from each piece on, and those up to a piece where none of the former ends. Which there are is told by a window's own words alone.
        ends = np.append(pieces[1:], n)
        last = np.searchsorted(ends, pieces + min_run)
        first = np.flatnonzero(last < len(ends))
        last = last[first]
        unmet = np.ones(len(ends), bool)
        unmet[last] = False
        last2 = np.flatnonzero(unmet & (ends >= min_run))
        first2 = np.searchsorted(pieces, ends[last2] - min_run, "right") - 1
        begin, end = pieces[np.append(first, first2)], ends[np.append(last, last2)]
        digest = self._windows(self._digests(ids, pieces, piece_length, 1), np.append(first, first2), np.append(last, last2), end - begin)
        self.place = np.concatenate([4 * pieces[first], 4 * ends[last2] + 2, 4 * lines + 1]).astype(np.uint64)
        self.first = np.concatenate([begin, lines])
        self.length = np.concatenate([end - begin, line_length])
        self.digest = np.concatenate([digest, line_digest])

    @staticmethod
    def _digests(ids, first, length, kind: int):
        import numpy as np

        k = np.arange(len(ids)) - np.repeat(first, length)
        mixed = _mix(ids + (k.astype(np.uint64) + np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93))
        return _mix(np.add.reduceat(mixed, first) + length.astype(np.uint64))

    @staticmethod
    def _windows(pieces, first, last, length):
        """Digests of runs of pieces: differences of a prefix polynomial modulo 2^64, shifted to the same power."""
        import numpy as np

        power, back = (np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(len(pieces), x, np.uint64))]) for x in (BASE, BASE_BACK))
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(pieces * power[:-1], dtype=np.uint64)])
        return _mix(_mix((prefix[last + 1] - prefix[first]) * back[first]) + length.astype(np.uint64))


def _key(doc_ids):
    """Ids as unsigned numbers in the same order."""
    import numpy as np

    return doc_ids.view(np.uint64) ^ np.uint64(SIGN)


def _doc_bucket(keys, buckets: int):
    import numpy as np

    return (_mix(keys) >> np.uint64(40)).astype(np.int64) % buckets


def _losers(digest, doc, place):
    """Of occurrences in any order, the index of each digest's earliest, and those of the later ones. A repeated row's own occurrence is none."""
    import numpy as np

    order = np.lexsort((place, doc, digest))
    d, o, p = digest[order], doc[order], place[order]
    first = np.concatenate([[True], d[1:] != d[:-1]])
    at = np.maximum.accumulate(np.where(first, np.arange(len(d)), 0))
    later = (o != o[at]) | (p != p[at])
    return order[first], order[later]


def _lost(digest, doc, place, buckets: int) -> Iterator[tuple]:
    """Rows of blobs by document."""
    import numpy as np

    order = np.argsort(doc, kind="stable")
    doc, place, digest = doc[order], place[order], digest[order]
    return _by_bucket(doc, _doc_bucket(doc, buckets), place, digest)


def _told_apart(held: list[tuple], buckets: int):
    """Of what is held, which it empties: the earliest of each digest by digest, to be compared with other tasks, and by document those that are surely later."""
    import numpy as np
    import pyarrow as pa

    digest, doc, place = (np.concatenate(x) for x in zip(*held))
    held.clear()
    first, later = _losers(digest, doc, place)
    keys = digest[first]  # ascending
    open_rows = list(_by_bucket(keys, (_mix(keys) >> np.uint64(40)).astype(np.int64) % buckets, doc[first], place[first]))
    sure = list(_lost(digest[later], doc[later], place[later], buckets)) if len(later) else []
    batch = _blob_batch(open_rows + sure)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([False] * len(open_rows) + [True] * len(sure))], names=["bucket", "n", "blob", "sure"])


def _find(docs: DataFrame, path: str, buckets: int, min_line: int, min_run: int) -> set[int]:
    """Stores what is to be cut by bucket of documents; returns the buckets that have anything."""

    def scan(batches: Iterator) -> Iterator:
        import numpy as np

        held: list[tuple] = []
        n = 0

        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["raw"].to_pylist()):
                units = Units(raw or b"", min_line, min_run)
                if len(units.digest):
                    held.append((units.digest, np.full(len(units.digest), doc_id + SIGN, np.uint64), units.place))
                    n += len(units.digest)
                if n > HELD:
                    yield _told_apart(held, buckets)
                    n = 0
        if held:
            yield _told_apart(held, buckets)

    def compare(key, table):
        import numpy as np
        import pyarrow as pa

        parts = [_unpacked(b, n, 2) for n, b in zip(table["n"].to_pylist(), table["blob"].to_pylist())]
        digest, doc, place = (np.concatenate(x) for x in zip(*parts))
        _, later = _losers(digest, doc, place)
        rows = list(_lost(digest[later], doc[later], place[later], buckets)) if len(later) else []
        return pa.Table.from_batches([_blob_batch(rows)])

    def store(key, table):
        import numpy as np
        import pyarrow as pa

        bucket = key[0].as_py()
        parts = [_unpacked(b, n, 2) for n, b in zip(table["n"].to_pylist(), table["blob"].to_pylist())]
        doc, place, digest = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((place, doc))
        for name, column in (("doc", doc), ("place", place), ("digest", digest)):
            write_flat(f"{path}/cut-{bucket}.{name}", column[order].astype("<u8").tobytes())
        return pa.table({"bucket": pa.array([bucket], pa.int32())})

    scratch = Scratch(docs.sparkSession)
    scanned = written(docs.transform(_raw).mapInArrow(tidy(scan), "bucket int, n long, blob binary, sure boolean"), "units", scratch)
    compared = scanned.filter("not sure").select("bucket", "n", "blob").groupBy("bucket").applyInArrow(compare, "bucket int, n long, blob binary")
    everything = compared.unionByName(scanned.filter("sure").select("bucket", "n", "blob"))
    found = {r["bucket"] for r in everything.groupBy("bucket").applyInArrow(store, "bucket int").collect()}  # a row a bucket
    scratch.clear()
    return found


def cut_spans(units: Units, lost: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words to cut, ascending and apart. lost: place and digest of each later unit."""
    import numpy as np

    gone = np.zeros(units.n + 1, bool)
    for place, digest, first, length in zip(units.place.tolist(), units.digest.tolist(), units.first.tolist(), units.length.tolist()):
        if (place, digest) in lost:
            gone[first : first + length] = True
    return [tuple(x) for x in np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8))).reshape(-1, 2).tolist()]


def drop_repeats(docs: DataFrame, min_line: int = MIN_LINE, min_run: int = MIN_RUN, buckets: int | None = None) -> DataFrame:
    """docs with `text` less its repeated units, n_words and n_removed (words before, and cut), and `removed`: "start-end" of each cut in code points of the
    original, with commas between. A cut goes to the start of the next word that stays, or to the end.

    A null text stays null and has no words. The earliest occurrence is that of the least doc_id (null is less than any), then of the first place. Rows that repeat both
    doc_id and text are one document and keep the same; of different texts under one doc_id, a unit at the same place counts once. Other columns stay as they
    are; existing columns of the names n_words, n_removed and removed are replaced. An empty table gives an empty result."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_dir(spark, "repeats")
    docs = docs.drop("n_words", "n_removed", "removed")
    own = free_name(docs, "_key")
    keyed = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(-SIGN)))
    found = _find(keyed.select(F.col(own).alias("doc_id"), "text"), path, buckets, min_line, min_run)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        files: dict[int, tuple] = {}
        for batch in batches:
            texts, rows = batch["text"].to_pylist(), []
            keys = _key(np.ascontiguousarray(batch[own].to_numpy()))
            for i, (key, bucket) in enumerate(zip(keys, _doc_bucket(keys, buckets).tolist())):
                units = Units((texts[i] or "").encode(), min_line, min_run)
                spans = []
                if bucket in found and units.n:
                    if bucket not in files:
                        files[bucket] = tuple(map_flat(f"{path}/cut-{bucket}.{name}", "<u8") for name in ("doc", "place", "digest"))
                    doc, place, digest = files[bucket]
                    a, b = np.searchsorted(doc, key, "left"), np.searchsorted(doc, key, "right")
                    if a < b:
                        spans = cut_spans(units, set(zip(place[a:b].tolist(), digest[a:b].tolist())))
                if spans:
                    data = np.frombuffer(units.raw, np.uint8)
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    bounds = [int(points[x]) for x in units.starts] + [len(texts[i])]
                    at, kept = 0, []
                    for a, b in spans:
                        kept.append(texts[i][at : bounds[a]])
                        at = bounds[b]
                    texts[i] = "".join(kept) + texts[i][at:]
                    rows.append((units.n, sum(b - a for a, b in spans), ",".join(f"{bounds[a]}-{bounds[b]}" for a, b in spans)))
                else:
                    rows.append((units.n, 0, ""))
            columns = list(zip(*rows)) or [()] * 3
            arrays = {name: batch[name] for name in batch.schema.names if name != own} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([*arrays.values(), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string())))], names=[*arrays, "n_words", "n_removed", "removed"])

    from pyspark.sql import types as T

    schema = T.StructType([*(T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema), *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("removed", T.StringType())))])
    return keyed.withColumn("text", F.col("text").cast("string")).mapInArrow(tidy(run), schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(documents(spark, sf_dir).select("doc_id", "text"))
