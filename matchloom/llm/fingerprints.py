"""Document fingerprints by prefix polynomial hashes.

Two modular prefix arrays of a text answer whether any two spans are equal, and locate longest common extensions by binary
search. A fingerprint keeps, in each of 64 bins, the least hash of the text's windows that falls there: equal texts have equal
fingerprints, and the share of equal bins estimates the share of common windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import documents, kept, small_batches, tidy

#: Two prime moduli below 2^31 and a base for each.
MODULI, BASES = (2147483647, 2147483629), (911382323, 972663749)
#: Code points of a window, bins of a fingerprint.
WINDOW, BINS = 24, 64

_tables: list = kept([])


def _power_tables(n: int) -> list:
    """Powers of the bases and of their inverses, as far as any text of this worker needed them."""
    import numpy as np

    if not _tables or len(_tables[0][0]) <= n:
        size = max(1 << 14, 1 << (n + 1).bit_length())
        made = []
        for p, b in zip(MODULI, BASES):
            pair = []
            for factor in (b, pow(b, -1, p)):
                table, have = np.ones(size, np.int64), 1
                while have < size:  # doubling: the next `have` powers are those so far times base^have
                    table[have : 2 * have] = table[:have] * factor % p
                    factor = factor * factor % p
                    have *= 2
                pair.append(table)
            made.append(pair)
        _tables[:] = made
    return _tables


class PrefixHashes:
    """Prefix arrays of one text's code points."""

    def __init__(self, text: str):
        import numpy as np

        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        self.n = len(points)
        self.tables = _power_tables(self.n)
        # The sum of n products below 2^31 stays below 2^63 for n < 2^32; a text is far shorter.
        self.prefix = [np.concatenate([[0], np.cumsum(points * w[: self.n] % p) % p]) for (w, _), p in zip(self.tables, MODULI)]

    def span(self, i: int, length: int) -> tuple[int, int]:
        """The hash of a span, alike wherever it stands."""
        return tuple((int(h[i + length]) - int(h[i])) * int(inverse[i]) % p for h, (_, inverse), p in zip(self.prefix, self.tables, MODULI))

    def equal(self, i: int, other: PrefixHashes, j: int, length: int) -> bool:
        """Whether text[i : i + length] is other's span of that length from j, up to a hash collision."""
        return self.span(i, length) == other.span(j, length)

    def common_extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """The longest length for which both spans are equal."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(i, other, j, middle) else (low, middle - 1)
        return low

    def windows(self, width: int):
        """A 62-bit hash of each window, alike wherever it stands; a shorter text is its only window."""
        import numpy as np

        width = min(width, self.n)
        if not width:
            return np.empty(0, np.uint64)
        out = np.zeros(self.n - width + 1, np.uint64)
        for k, p in enumerate(MODULI):
            spans = (self.prefix[k][width:] - self.prefix[k][:-width]) % p * self.tables[k][1][: self.n - width + 1] % p
            out = out << np.uint64(31) | spans.astype(np.uint64)
        return out

    def fingerprint(self, width: int = WINDOW, bins: int = BINS) -> str:
        """Hex of 16 bits a bin; 0 stands for a bin without a window."""
        import numpy as np

        mixed = self.windows(width) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        where, rank = ((mixed >> np.uint64(58)) % np.uint64(bins)).astype(np.int64), mixed & np.uint64((1 << 58) - 1)
        none = np.iinfo(np.uint64).max
        least = np.full(bins, none, np.uint64)
        np.minimum.at(least, where, rank)
        return np.where(least == none, 0, least % np.uint64(65535) + np.uint64(1)).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of equal bins among those that either fills; 1 if neither has any."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    pairs = [(x[i : i + 2], y[i : i + 2]) for i in range(0, len(x), 2)]
    filled = [p for p in pairs if p != (b"\0\0", b"\0\0")]
    return sum(p == q for p, q in filled) / len(filled) if filled else 1.0


def edited(text: str, following: str) -> str:
    """text with its last half replaced by the first as many code points of the next, or all of them."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _ranges(docs: DataFrame, partitions: int) -> DataFrame:
    """docs with `_range`, and each range's first document once more at the end of the range before it (`_tail`); the first of all follows the last.

    Bounds come from the ids alone, one for each partition; texts are exchanged once."""
    ids = docs.filter("doc_id is not null").agg(F.percentile_approx("doc_id", [i / partitions for i in range(1, partitions)] or [0.5], 10_000).alias("q")).first()["q"]
    bounds = sorted(set(ids or []))
    own = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("doc_id"))) + 1 if bounds else F.lit(1)
    ranged = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(own).cast("int"))
    firsts = ranged.groupBy("_range").agg(F.min("doc_id").alias("first")).orderBy("_range").collect()  # one row a range
    if not firsts:
        return ranged.withColumn("_tail", F.lit(False))
    used = [r["_range"] for r in firsts]
    before = {r: used[i - 1] for i, r in enumerate(used)}
    lowest = F.element_at(F.create_map(*(F.lit(x) for r in firsts if r["first"] is not None for x in (r["_range"], r["first"]))), F.col("_range")) if any(r["first"] is not None for r in firsts) else F.lit(None)
    previous = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("_range"))
    is_first = (F.col("doc_id") == lowest) | (F.col("doc_id").isNull() & (F.col("_range") == 0))
    here, there = F.struct(F.col("_range").alias("r"), F.lit(False).alias("t")), F.struct(previous.alias("r"), F.lit(True).alias("t"))
    places = F.explode(F.when(F.coalesce(is_first, F.lit(False)), F.array(here, there)).otherwise(F.array(here)))
    return ranged.withColumn("_place", places).select("doc_id", "text", F.col("_place.r").alias("_range"), F.col("_place.t").alias("_tail"))


def fingerprint_documents(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Each text's fingerprint, that of its edited text, their likeness and that to the next document's, and how far text and edited text agree.

    Documents follow each other by doc_id, null first, then by text; after the last comes the first, so a single document follows itself. A null text
    is empty. Rows that repeat follow each other; other columns are left out. An empty table gives an empty result."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), n)
    ordered = rows.repartitionById(n, F.pmod("_range", F.lit(n)).cast("int")).sortWithinPartitions("_range", "_tail", "doc_id", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        held = None  # the document that waits for its next one
        closed = None  # the range whose first tail row has come: any further one is a repeat of it

        def finish(doc: tuple, following: tuple) -> tuple:
            doc_id, text, hashes, own, _ = doc
            changed = edited(text, following[1])
            other = PrefixHashes(changed)
            theirs = other.fingerprint()
            return doc_id, hashes.n, hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, theirs, likeness(own, theirs), likeness(own, following[3]), hashes.common_extension(0, other, 0)

        for batch in batches:
            rows = []
            for doc_id, text, where, tail in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "_range", "_tail"))):
                if tail and closed == where:
                    continue
                hashes = PrefixHashes(text)
                doc = (doc_id, text, hashes, hashes.fingerprint(), where)
                if held is not None and held[4] == where:
                    rows.append(finish(held, doc))
                held = None if tail else doc
                closed = where if tail else closed
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, types)], names=names)

    return ordered.mapInArrow(tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))
