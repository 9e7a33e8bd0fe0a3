"""A quality classifier without labels.

Overlapping heuristic labellers vote bad, good or nothing on each document. Expectation-maximisation over the counts of vote patterns, a table whose
size doesn't grow with the corpus, estimates how each labeller votes on good and on bad documents. The posterior of a
document's pattern is its training label for a linear scorer over hashed word shapes and binned figures, fitted on a bounded
sample; the scorer then judges every document.
"""

from __future__ import annotations

import codecs
import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import documents, kept, small_batches, tidy

#: Slots of the hashed weights, and documents of the training sample at most.
SLOTS, SAMPLE = 1 << 15, 20_000
#: What a vote pattern's letters say.
BAD, GOOD, NONE = "b", "g", "-"
SYMBOLS = b"#$%&*@^~<>{}[]=+\\_/`"

# For counts of kinds of characters, texts are taken as one byte a code point: Latin-1 by its own, any other by one of the same Unicode class. Words and lines are compared as they are.
_UPPER = bytes(c for c in range(256) if chr(c).isupper())
_LOWER = bytes(c for c in range(256) if chr(c).isalpha() and not chr(c).isupper())
_CLASSES = bytes(ord("a") if c in _UPPER + _LOWER else ord("#") if c in SYMBOLS else ord(".") if c in b".!?:" else ord(" ") if c in b" \t\n\x0b\x0c\r" else ord("-") for c in range(256))
_SHAPES = bytes(ord("A") if c in _UPPER else ord("a") if c in _LOWER else ord("0") if c in b"0123456789" else c for c in range(256))
SENTENCE_ENDS = frozenset("。！？．：｡؟۔।॥…‼⁇⁈⁉։።")


class _StandIns(dict):
    def __missing__(self, c: str) -> str:
        """Marks go with the letters they stand on."""
        kind = unicodedata.category(c)
        out = "X" if c.isupper() or kind == "Lt" else "x" if kind[0] in "LM" else "0" if kind[0] == "N" else "." if c in SENTENCE_ENDS else "#" if kind[0] in "SC" else "-"
        self[c] = out
        return out


_STAND_INS = _StandIns()  # code points at most
codecs.register_error("same_class", lambda e: ("".join(map(_STAND_INS.__getitem__, e.object[e.start : e.end])), e.end))


def _bytes(text: str) -> bytes:
    return text.encode("latin-1", "same_class")


def figures(text: str) -> dict[str, float]:
    """Figures of a whole text, each a share or a mean."""
    data = _bytes(text)
    whole = data if text.isascii() else text.encode("utf-8", "surrogatepass")
    words = whole.split()
    n = len(words)
    count = lambda what: len(data) - len(data.translate(None, what))
    upper = count(_UPPER)
    letters = upper + count(_LOWER)
    classes = data.translate(_CLASSES) + b" "
    kinds = classes.split()
    bars = words.count(b"|") + words.count(b"-") + words.count(b"*")
    lines = [x for x in map(bytes.strip, whole.split(b"\n")) if x]
    return {
        "n": n,
        "upper": upper / letters if letters else 0.0,
        "alpha": letters / max(1, len(data)),
        "bangs": data.count(b"!!") / n if n else 0.0,
        "symbols": count(SYMBOLS) / n if n else 0.0,
        "odd_ends": classes.count(b"# ") / n if n else 0.0,
        "bars": bars / n if n else 0.0,
        "ends": classes.count(b". ") / n if n else 0.0,
        "distinct": len(set(words)) / n if n else 1.0,
        "again": 1 - len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 0.0,
        "line_again": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "length": letters / n if n else 0.0,
        "short": (kinds.count(b"a") + kinds.count(b"aa") + kinds.count(b"aaa")) / max(1, n - bars),
    }


def _vote(value: float, bad_from: float, good_to: float) -> str:
    return BAD if value >= bad_from else GOOD if value <= good_to else NONE


#: Each labeller by name. A text too short for a fault is good in that respect. Several look at the same fault from different sides, so that their agreement tells how far each may be trusted.
LABELLERS = {
    "shouting": lambda f: GOOD if f["n"] < 5 else _vote(f["upper"], 0.5, 0.15),
    "exclaiming": lambda f: BAD if f["n"] >= 5 and f["bangs"] >= 0.2 else NONE,
    "symbols": lambda f: GOOD if f["n"] < 5 else _vote(f["symbols"], 0.5, 0.1),
    "odd_ends": lambda f: BAD if f["n"] >= 5 and f["odd_ends"] >= 0.25 else NONE,
    "bars": lambda f: BAD if f["bars"] >= 0.15 else NONE,
    "no_short_words": lambda f: GOOD if f["n"] < 20 else BAD if f["short"] <= 0.1 else GOOD if f["short"] >= 0.2 else NONE,
    "letters": lambda f: GOOD if f["n"] < 40 else BAD if f["alpha"] < 0.6 else GOOD if f["alpha"] >= 0.75 else NONE,
    "few_words": lambda f: GOOD if f["n"] < 60 else BAD if f["distinct"] <= min(0.3, 6 / math.sqrt(f["n"])) and f["again"] >= 0.2 else GOOD if f["distinct"] >= 0.35 else NONE,
    "same_runs": lambda f: GOOD if f["n"] < 40 else _vote(f["again"], 0.3, 0.08),
    "looped": lambda f: BAD if f["n"] >= 40 and f["again"] >= 0.5 else NONE,
    "same_lines": lambda f: BAD if f["line_again"] >= 0.4 else NONE,
}


def votes(f: dict[str, float]) -> str:
    return "".join(vote(f) for vote in LABELLERS.values())


def estimate(patterns: dict[str, int], rounds: int = 200, anchor: float = 0.05) -> tuple[dict[str, float], list[dict[str, tuple[float, float]]], float]:
    """Expectation-maximisation over counted vote patterns. Returns each pattern's probability of good, each labeller's vote shares on (good, bad), and the share of good.

    Votes are taken as independent given the class; to have no vote is one of three. It starts from labellers that are right more often than not, which also names the classes;
    they stay in as pseudo-counts of `anchor` times all rows, so that a fault which only two labellers see isn't taken for their mistake."""
    import numpy as np

    keys = sorted(patterns)
    counts = np.array([patterns[k] for k in keys], float)
    letters = (BAD, GOOD, NONE)
    codes = np.array([[letters.index(c) for c in k] for k in keys], int).reshape(len(keys), len(LABELLERS))
    share = np.empty((2, len(LABELLERS), 3))
    share[0], share[1] = (0.01, 0.59, 0.4), (0.35, 0.25, 0.4)
    start, held = share.copy(), anchor * counts.sum() + 1
    prior = 0.85
    good = np.full(len(keys), prior)
    for _ in range(rounds):
        log = np.log(share)
        at = np.arange(len(LABELLERS))
        like = [log[c][at, codes].sum(axis=1) + math.log(p) for c, p in ((0, prior), (1, 1 - prior))]
        before, good = good, 1 / (1 + np.exp(np.clip(like[1] - like[0], -500, 500)))
        for c, weight in ((0, good * counts), (1, (1 - good) * counts)):
            for v in range(3):
                share[c, :, v] = held * start[c, :, v] + ((codes == v) * weight[:, None]).sum(axis=0)
            share[c] /= share[c].sum(axis=1, keepdims=True)
        prior = min(max((good * counts).sum() + 1, 1) / (counts.sum() + 2), 1 - 1e-6)
        if len(keys) and np.abs(good - before).max() < 1e-9:
            break
    tables = [{v: (float(share[0, j, k]), float(share[1, j, k])) for k, v in enumerate(letters)} for j in range(len(LABELLERS))]
    return dict(zip(keys, good.tolist())), tables, float(prior)


_shapes: dict[bytes, int] = kept({})


def _shape(word: bytes) -> int:
    """The slot of a word's shape: kinds of characters with repeats joined, and about how long it is."""
    out = b"".join(word[i : i + 1] for i in range(len(word)) if i == 0 or word[i] != word[i - 1])[:8]
    return zlib.crc32(out + b":%d" % (min(len(word), 16) // 4)) % SLOTS


def features(text: str, f: dict[str, float]) -> tuple[list[int], list[float]]:
    """Slots and values of a document: shares of word shapes and bins of all figures."""
    if len(_shapes) > 300_000:
        _shapes.clear()
    counts: Counter = Counter()
    for word, k in Counter(_bytes(text).translate(_SHAPES).split()).items():
        slot = _shapes.get(word)
        if slot is None:
            slot = _shapes[word] = _shape(word)
        counts[slot] += k
    n = max(1, f["n"])
    out: Counter = Counter({slot: math.sqrt(c / n) for slot, c in counts.items()})
    for name, value in f.items():
        step = int(math.log2(value + 1) * 2) if name == "n" else int(math.log2(value + 1) * 4) if name == "length" else min(20, int(value * 20))
        out[zlib.crc32(f"{name}={step}".encode()) % SLOTS] += 1.0
    out[zlib.crc32(b"bias") % SLOTS] += 1.0
    return list(out), list(out.values())


def fit(rows: list[tuple[bytes, bytes, float]], rounds: int = 200, rate: float = 0.2, decay: float = 1e-4):
    """Weights of a logistic scorer for soft labels, by full-batch adaptive gradient steps; the same rows give the same weights. rows: slots (32-bit integers), values (32-bit
    floats) and label."""
    import numpy as np

    weights = np.zeros(SLOTS)
    if not rows:
        return weights
    slot = np.frombuffer(b"".join(r[0] for r in rows), "<i4").astype(np.int64)
    value = np.frombuffer(b"".join(r[1] for r in rows), "<f4").astype(np.float64)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) // 4 for r in rows])
    label = np.array([r[2] for r in rows])
    # Either class has the same say, unless it is all but absent.
    mass = np.array([max((1 - label).sum(), 0.01 * len(rows)), max(label.sum(), 0.01 * len(rows))])
    weight = (label / mass[1] + (1 - label) / mass[0]) / 2
    first, second = np.zeros(SLOTS), np.zeros(SLOTS)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * weights[slot], len(rows)), -30, 30)))
        gradient = np.bincount(slot, value * ((p - label) * weight)[row], SLOTS) + decay * weights
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        weights = weights - rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return weights


def judge(docs: DataFrame, keep_from: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """docs with `votes`, `weak_good` (the posterior of the votes), `quality_score` (the scorer's probability of good) and `keep`.

    sample bounds the rows that the scorer is fitted on: those of the smallest hashes of text and doc_id, so a rerun takes the same ones. Votes and
    their counts cover all rows. A null text is empty; an empty one has few votes and is judged like any other. Rows that repeat are judged
    alike. Other columns stay as they are; existing columns of the four names are replaced. An empty table gives an empty result."""
    import numpy as np

    small_batches(docs.sparkSession)
    docs = docs.drop("votes", "weak_good", "quality_score", "keep")

    def vote(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            seen.update(votes(figures(t or "")) for t in batch["text"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["pattern", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    patterns = {r["pattern"]: r["n"] for r in texts.mapInArrow(tidy(vote), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}  # 3^labellers rows at most
    posterior, _, _ = estimate(patterns)
    total = sum(patterns.values())

    def describe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                f = figures(text or "")
                slots, values = features(text or "", f)
                rows.append((np.array(slots, "<i4").tobytes(), np.array(values, "<f4").tobytes(), posterior[votes(f)]))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.float64())], names=["slots", "values", "label"])

    hashed = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("text", "doc_id").alias("h"))
    if total > sample:
        share = sample / total * 0.97  # a hash threshold: its sample stays below the bound, and a plain limit would not repeat
        hashed = hashed.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    described = hashed.select("text").mapInArrow(tidy(describe), "slots binary, values binary, label double")
    rows = sorted(map(tuple, described.limit(sample).toLocalIterator()))  # hashed features as byte strings, of `sample` documents at most
    weights = fit(rows).astype(np.float32)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                f = figures(text or "")
                slots, values = features(text or "", f)
                pattern = votes(f)
                z = float((weights[slots] * np.array(values, np.float32)).sum())
                score = 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))
                rows.append((pattern, posterior.get(pattern, score), score, score >= keep_from))
            columns = list(zip(*rows)) or [()] * 4
            types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types))], names=[*batch.schema.names, "votes", "weak_good", "quality_score", "keep"])

    from pyspark.sql import types as T

    added = (("votes", T.StringType()), ("weak_good", T.DoubleType()), ("quality_score", T.DoubleType()), ("keep", T.BooleanType()))
    schema = T.StructType([*(T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema), *(T.StructField(n, t) for n, t in added)])
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(tidy(run), schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "votes", "weak_good", "quality_score", "keep")
