"""Token ids, their store, packing, sharding and mixing."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchloom.llm.common import fresh_dir
from matchloom.llm.mixing import mix, mixed_documents, permuted, water_fill
from matchloom.llm.packing import best_fit, complete, cut, lower_bound, pack
from matchloom.llm.sharding import communication_matrix, hypergeometric, shard_documents, write_shards
from matchloom.llm.token_store import read_digests, read_tokens, write_tokens
from matchloom.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, shard int, part int, rank int, n_chars long"
ODD = [None, "", " ", "  a", "a   b", "a  \n b", "   ", "x    y  ", "a \n\n  c d\n", "a\n b", "a\xa0 b \u2003c", "\n", "a b ", "a b  ", "a b\n", "a b \n", "<|endoftext|> <|endoftext|>x", "a  b \n c", "don't stop", "x<|endoftext|> y", "a b é 12ab! ab12!? ,;", "\t tab", "naïve-", "日本語 テキスト!", "ab's it's. I'll!", "a 's b's's ...", "x ‘y’. z", "𝒳y! ²³. ab² !", "a. \n\n b.\r\n c", "word! " * 3000]


def docs(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma,", "delta.", "x" * 30, "Ünd", "12"]
    rows = [(i, t, f"s{i % 3}", 0, 0, 0, 1) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 900))), None if i % 7 == 0 else f"s{i % 4}", 0, 0, 0, 1) for i in range(60)]
    rows += [(105, "alpha beta", "s1", 0, 0, 0, 1), (105, "alpha beta", "s1", 0, 0, 0, 1), (None, "null id", "s2", 0, 0, 0, 1)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def plain(text):
    return list(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_is_the_tokenizer():
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(PATH).encode(ODD)] == [plain(t) for t in ODD]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_store_round_trip(spark, encoding):
    rows, df = docs(spark)
    path = fresh_dir(spark, "tokens")
    files = write_tokens(df, PATH, path, encoding=encoding, group_tokens=3000)
    got = sorted(map(tuple, read_digests(spark, path, files).collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = plain(t) + [2]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    some = read_tokens(spark, path, files, 100, 103).collect()
    assert sorted(r["doc_id"] for r in some) == [100, 101, 102, 103] and {r["doc_id"]: list(r["ids"]) for r in some}[100] == plain(dict((r[0], r[1]) for r in rows)[100]) + [2]
    assert "ids" not in read_tokens(spark, path, files, ids=False).columns
    assert write_tokens(df.limit(0), PATH, fresh_dir(spark, "none")) == [] and read_digests(spark, path, []).collect() == []


def test_packing_places_every_piece(spark):
    rows, df = docs(spark)
    got = pack(df, PATH, 256).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = plain(t) + [0]
        for k, (a, n) in enumerate(cut(len(ids), 256)):
            want[(i, k, a, n, crc(ids[a : a + n]))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 256
    counts = Counter(r["length"] for r in got)
    assert len(sequences) - lower_bound(counts, 256) <= 1
    assert {(r["sequences"], r["lower_bound"]) for r in got} == {(len(sequences), lower_bound(counts, 256))}
    assert pack(df.limit(0), PATH).collect() == []


def fewest(items, capacity):
    best = [len(items)]

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for j in {room: i for i, room in enumerate(bins)}.values():
            if bins[j] >= items[k]:
                put(k + 1, bins[:j] + [bins[j] - items[k]] + bins[j + 1 :])
        put(k + 1, bins + [capacity - items[k]])

    put(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_bin_completion_is_optimal_on_small_sets(seed):
    rng = random.Random(seed)
    items = sorted((rng.randint(8, 70) for _ in range(9)), reverse=True)
    runs, bound = complete(Counter(items), 100)
    assert Counter(x for f, n in runs for x in f for _ in range(n)) == Counter(items) and all(sum(f) <= 100 for f, _ in runs)
    number = sum(n for _, n in runs)
    assert bound <= fewest(items, 100) == number <= sum(n for _, n in best_fit(Counter(items), 100))


def test_search_beats_best_fit_where_short_pieces_lack():
    for seed in range(3):
        rng = random.Random(seed)
        counts = Counter(min(2048, max(500, int(rng.lognormvariate(6.3, 0.9)))) for _ in range(3000))
        runs, bound = complete(counts, 2048)
        number, first = (sum(n for _, n in r) for r in (runs, best_fit(counts, 2048)))
        assert bound <= number < first and (number - bound) * 2 < first - bound
        got = Counter()
        for filling, n in runs:
            for x in filling:
                got[x] += n
        assert got == counts


def plain_bound(counts, capacity):
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for k in range(capacity // 2 + 1):
        large = [n for n, c in counts.items() for _ in range(c) if n > capacity // 2]
        small = sum(n * c for n, c in counts.items() if k <= n <= capacity // 2)
        room = sum(capacity - n for n in large if n <= capacity - k)
        best = max(best, len(large) + max(0, -(-(small - room) // capacity)))
    return best


def test_lower_bound_by_plain_sums():
    for seed in range(20):
        rng = random.Random(seed)
        counts = Counter(rng.randint(1, 60) for _ in range(rng.randint(1, 40)))
        assert lower_bound(counts, 60) == plain_bound(counts, 60)


def test_hypergeometric_law():
    rng = random.Random(2)
    seen = Counter(hypergeometric(rng, 5, 7, 6) for _ in range(20000))
    from math import comb

    for k in range(6):
        assert abs(seen[k] / 20000 - comb(5, k) * comb(7, 6 - k) / comb(12, 6)) < 0.015
    assert abs(hypergeometric(rng, 10**10, 10**10, 10**9) - 5 * 10**8) < 10**6
    m = communication_matrix([5, 0, 9, 3], [6, 6, 5], 1)
    assert [sum(r) for r in m] == [5, 0, 9, 3] and [sum(c) for c in zip(*m)] == [6, 6, 5]


def test_shards_are_even_and_slots_gapless(spark):
    rows, df = docs(spark)
    got = shard_documents(df, 7).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
    text = {r[0]: r[1] for r in rows if r[0] not in (105, None)}
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in got if r["doc_id"] in text)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, shard_documents(df.repartition(5), 7).collect()), key=repr)
    assert shard_documents(df.limit(0), 7).collect() == []


def test_shuffle_is_uniform(spark):
    where = np.zeros((4, 4))
    df = spark.range(400).selectExpr("id as doc_id", "'t' as text")
    for seed in range(3):
        for r in shard_documents(df, 4, seed=seed).collect():
            where[r["doc_id"] // 100, r["shard"]] += 1
    assert abs(where - 75).max() < 30


def test_water_fill():
    assert water_fill([10, 10], [3, 1]) == [20.0, 10.0]
    assert water_fill([100, 100, 100], [3, 1, 2]) == [200.0, 250 / 3, 500 / 3]
    assert water_fill([0, 10], [1, 1]) == [0.0, 15.0] and water_fill([], []) == []


def words(text):
    return (text or "").encode().split()


def test_mix_meets_targets(spark):
    rows, df = docs(spark)
    got = mix(df, block=8)[0].collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = water_fill([size[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))])
    for s, t in zip(order, want):
        assert abs(target[s] - t) < 1e-6 and abs(taken[s] - t) <= 8 + 0.01 * t
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix(df.repartition(6), block=8)[0].collect()), key=repr)
    assert mix(df.limit(0))[0].collect() == []


def test_permutation_of_blocks_is_uniform(spark):
    """Each index goes to each place about equally often over keys, neighbours to any two places, and no place is taken twice."""
    n, keys = 7, 6000
    got = spark.range(keys * n).select((F.col("id") / n).cast("long").alias("key"), (F.col("id") % n).alias("i")).select("key", "i", permuted(F.col("i"), F.lit(n), F.col("key")).alias("to"))
    table = defaultdict(dict)
    for key, i, to in got.collect():
        table[key][i] = to
    assert all(sorted(t.values()) == list(range(n)) for t in table.values())
    for i in range(n):
        seen = Counter(t[i] for t in table.values())
        assert sum((seen[k] - keys / n) ** 2 / (keys / n) for k in range(n)) < 25  # chi-square of 6 degrees; one in 3000 is above 24
    pairs = Counter((t[2], t[3]) for t in table.values())
    each = keys / (n * (n - 1))
    assert sum((pairs[a, b] - each) ** 2 / each for a in range(n) for b in range(n) if a != b) < 85  # of 41 degrees


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, None), (None, ""), (2, "c"), (3, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("own"))
    write_shards(df, shard_documents(df, 3), f"{tmp_path}/shards")
    got = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted({(r["shard"], r["slot"]) for r in got}) and Counter(r["shard"] for r in got) in (Counter({0: 3, 1: 2, 2: 2}),)


def test_blocks_are_drawn_evenly(spark):
    _, df = docs(spark)
    _, slots, pieces = mix(df, block=8)
    times = Counter((r["_s"], r["block"]) for r in slots.collect())
    by = defaultdict(list)
    for (s, _), n in times.items():
        by[s].append(n)
    assert all(max(v) <= 2 for v in by.values())
    words_of = Counter()
    for r in pieces.collect():
        words_of[(r["_s"], r["block"])] += r["_words"]
    assert max(words_of.values()) == 8 and set(times) <= set(words_of)


def test_mixed_documents_hold_what_was_taken(spark):
    rows, df = docs(spark)
    unique = df.dropDuplicates(["doc_id", "text"]).selectExpr("*", "9 as pass", "'x' as _t", "1 as _n")
    taken = {r["doc_id"]: r["taken"] for r in mix(unique, block=8)[0].collect()}
    out = mixed_documents(unique, block=8)
    assert out.columns == unique.columns
    got, text = Counter(), {r[0]: r[1] for r in rows if r[0] != 105}
    for r in out.collect():
        got[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
        if r["doc_id"] in text and len(words(r["text"])) == len(words(text[r["doc_id"]])):
            assert r["text"] == text[r["doc_id"]]
    assert all(got[i] == n for i, n in taken.items() if i != 105) and got[105] >= taken[105] > 0
    assert mixed_documents(df.limit(0)).collect() == []


def test_encoder_keeps_a_piece_once():
    """A word that nothing ends is looked up where the words made of it are, so it takes one entry."""
    encoder = Encoder(PATH)
    texts = ["x alpha beta, alpha. gamma;", "gamma x beta (alpha) b\nc"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [plain(t) for t in texts]
    assert set(encoder.pieces) == {"alpha", "alpha.", "beta", "beta,", "gamma", "gamma;", "x", "(alpha)", "b\nc"}
    assert not any(isinstance(x, dict) and "alpha" in x for name, x in vars(encoder).items() if name != "pieces")


def test_lines_of_a_word_are_pieces():
    """For op4 and op5: no word of several lines is encoded whole, and what is made of such pieces goes with the next texts."""
    encoder, asked = Encoder(PATH), []
    joined, one = encoder._encode_joined, encoder._encode
    encoder._encode_joined = lambda texts, before: asked.extend(before + x for x in texts) or joined(texts, before)
    encoder._encode = lambda texts: asked.extend(texts) or one(texts)
    for some in (["x alpha.\nBeta gamma\nDelta"], ["x gamma\nBeta, alpha.\nDelta alpha."], ["x alpha\nDelta. gamma alpha."]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(some)] == [plain(t) for t in some]
    assert asked and not any("\n" in x[1:] for x in asked) and max(map(asked.count, asked)) <= 3
    assert "gamma\nDelta" not in encoder.pieces and "alpha." in encoder.pieces


def test_encoder_is_the_tokenizer_when_it_forgets(monkeypatch):
    from matchloom.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_PIECES", 60)
    rng, encoder = random.Random(5), Encoder(PATH)
    words = ["the", "of", "ab.", "c\nd", "e.\n'll", "<|endoftext|>\nx", "f\n<|endoftext|>", "é!\n日本", "g\n\nh", "i\n.j\n", "k\r\nl", "1\n2", "m\xa0\nn", "\u2028\no", "-\n-", "p\n\x1cq"]
    texts = ODD + [" ".join(rng.choice([*words, f"w{rng.randint(0, 200)}", f"v{rng.choice('abcdefgh')}x.\nW{rng.choice('abcdefgh')}y"]) for _ in range(40)) for _ in range(60)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts, 3)] == [plain(t) for t in texts]
    assert len(encoder.pieces) + len(encoder.lines) < 60 + 400
