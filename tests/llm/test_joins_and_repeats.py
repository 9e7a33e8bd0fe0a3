"""The n-gram Jaccard join, components and substring dedup against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm.components import connected_components
from matchloom.llm.jaccard import Block, jaccard_classes, products, shingle_hashes, whole_product, word_hashes
from matchloom.llm.substring_dedup import drop_repeats

SCHEMA = "doc_id long, text string, source string, bucket int, id long"


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 90))) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(40):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((100 + k, " ".join(w).upper() if k % 5 == 0 else " ".join(w)))
    rows += [(200, None), (201, ""), (202, "one"), (203, "one"), (204, "two words"), (205, " \t\n "), (206, "É é ſ K"), (None, base[0]), (7, base[7]), (300, " ".join(words * 30))]
    return [(i, t, None, 1, 2) for i, t in rows]


def classes(rows, width, percent):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())))
    least = -(1 << 63)
    parent = {least if i is None else i: least if i is None else i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(least if a is None else a), root(least if b is None else b)))
                parent[y] = x
    back = lambda x: None if x == least else x
    return sorted(((i, len(s), back(root(least if i is None else i))) for i, s in sets), key=repr)


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_matches_brute_force(spark, width, percent):
    rows = corpus()
    got = jaccard_classes(spark.createDataFrame(rows, SCHEMA), width, percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == classes(rows, width, percent)


def test_jaccard_of_nothing(spark):
    assert jaccard_classes(spark.createDataFrame([], SCHEMA), 3, 90).collect() == []


def test_ids_that_repeat_with_other_texts_have_the_links_of_all(spark):
    rows = [r for r in corpus() if r[0] is not None] + [(7, corpus()[3][1], "x", 0, 0), (201, corpus()[5][1], "x", 0, 0), (3, None, "x", 0, 0), (None, "a b c d e f", "x", 0, 0), (None, corpus()[9][1], "x", 0, 0)]
    got = jaccard_classes(spark.createDataFrame(rows, SCHEMA).repartition(5), 3, 90).collect()
    assert sorted((tuple(r) for r in got), key=repr) == classes(rows, 3, 90)


def test_large_groups_of_copies_are_joined_in_parts(spark):
    rows = [(i, "the same few words again and again in every copy", None, 0, 0) for i in range(500, 0, -1)] + [(600 + i, f"text number {i} has its own words", None, 0, 0) for i in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_classes(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()}
    assert all(got[i] == 1 for i in range(1, 501)) and all(got[i] == i for i in range(600, 605))


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (2, 60)])
def test_near_copies_of_one_text_in_many_blocks(spark, width, percent):
    """Sets around one text, near enough to share its rare grams and often too far to be linked."""
    import random

    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        words = base[: rng.choice((60, 80, 100, 120))]
        for _ in range(rng.choice((0, 1, 2, 4, 9))):
            words[rng.randrange(6, len(words))] = f"x{i}"
        rows.append((i, " ".join(words), None, 0, 0))
    got = jaccard_classes(spark.createDataFrame(rows, SCHEMA).repartition(5), width, percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == classes(rows, width, percent)


def test_whole_products_are_exact():
    import numpy as np

    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (3, 40, 300)]
    rows = [np.sort(rng.choice(x, max(1, len(x) - k), replace=False)) for x in base for k in (0, 1, 5, 20)]
    wanted = rng.random((len(rows), len(rows))) < 0.8
    for percent in (1, 50, 80, 90, 100):
        for width in (7, 1 << 15):
            got = whole_product(rows, rows, wanted, percent, width)
            for p, x in enumerate(rows):
                for q, y in enumerate(rows):
                    both = len(np.intersect1d(x, y))
                    assert got[p, q] == (wanted[p, q] and 100 * both >= percent * (len(x) + len(y) - both))
    assert not whole_product(rows, rows, np.zeros_like(wanted), 80).any()


def test_products_of_blocks_are_exact():
    import numpy as np

    a, b = np.arange(0, 190, dtype=np.uint64), np.arange(10, 200, dtype=np.uint64)
    one = np.array([0])
    assert products(Block([a]), Block([b]), one, one, 90)[0] and not products(Block([a]), Block([np.arange(11, 201, dtype=np.uint64)]), one, one, 90)[0]
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 3, 40, 41, 300)]
    rows = [np.sort(rng.choice(x, max(1, len(x) - k), replace=False)) for x in base for k in (0, 1, 2, 5)]
    left, right = rows[:], [r for r in reversed(rows)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(left)), np.arange(len(right))))
    for percent in (1, 50, 80, 90, 100):
        for stretches in (1, 3, 8):
            got = products(Block(left), Block(right), i, j, percent, stretches)
            for p, q, linked in zip(i.tolist(), j.tolist(), got.tolist()):
                x, y = set(left[p].tolist()), set(right[q].tolist())
                assert linked == (100 * len(x & y) >= percent * len(x | y))


def test_components_of_a_chain_a_star_and_a_cycle(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}


PASSAGE = " ".join(f"p{i}" for i in range(60))


def repeats():
    rng = random.Random(5)
    own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    line = "this very line stands in many documents"
    rows = [(3, f"{own(9)} {PASSAGE} {own(9)}\n{line}\n{own(12)}"), (1, f"{own(6)}\n{line}"), (2, f"{own(30)} {PASSAGE.upper()} {own(4)}\n{line}\n{own(8)}"), (9, f"É {PASSAGE}\n{line}"), (4, own(40)), (5, None), (6, ""), (7, "short line\nshort line"), (None, f"{line}\n{own(5)}")]
    return [(i, t, "x", 1, 2) for i, t in rows]


def test_repeated_passages_stay_once_and_the_rest_is_whole(spark):
    rows = repeats()
    got = {r["doc_id"]: r for r in drop_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {r[0] for r in rows} and set(got[1].asDict()) == {*SCHEMA.replace(",", "").split()[::2], "n_words", "n_removed", "removed"}
    assert got[4]["text"] == rows[4][1] and got[4]["removed"] == "" and got[5]["text"] is None and got[7]["text"] == "short line\nshort line"
    assert "this very line" in got[None]["text"] and all("this very line" not in got[i]["text"] for i in (1, 2, 3, 9))
    middle = " ".join(f"p{i}" for i in range(20, 40))
    assert middle in got[2]["text"].lower() and all(middle not in got[i]["text"].lower() for i in (3, 9))
    for i, text, *_ in rows:
        if text:
            spans = [tuple(map(int, x.split("-"))) for x in got[i]["removed"].split(",") if x]
            at, kept = 0, ""
            for a, b in spans:
                kept, at = kept + text[at:a], b
            assert got[i]["text"] == kept + text[at:]
            assert got[i]["n_removed"] == sum(len(text[a:b].split()) for a, b in spans) and got[i]["n_words"] == len(text.split())


def test_prose_of_pieces_met_apart_is_whole(spark):
    rng = random.Random(17)
    words = [f"v{i}" for i in range(6)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(400))) for i in range(30)]
    met, wrong = set(), 0
    for r in sorted(drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r["doc_id"]):
        w = rows[r["doc_id"]][1].split()
        runs = [tuple(w[i : i + 20]) for i in range(len(w) - 19)]
        wrong += 0 if met & set(runs) or len(set(runs)) < len(runs) else r["n_removed"]
        met |= set(runs)
    assert wrong == 0


@pytest.mark.parametrize("n", [40, 60, 120])
def test_whole_pieces_of_a_repeat_are_cut(spark, n):
    rng = random.Random(n)
    own = lambda k: " ".join(f"u{rng.randrange(10**9)}" for _ in range(k))
    passages = [own(n) for _ in range(30)]
    rows = [(i, f"{own(15)} {p} {own(15)}") for i, p in enumerate(passages)] + [(100 + i, f"{own(7)} {p} {own(25)}") for i, p in enumerate(passages)]
    got = {r["doc_id"]: r["n_removed"] for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(30)) and all(got[100 + i] <= n for i in range(30))
    assert sum(got[100 + i] for i in range(30)) >= 30 * (n - 10)


def test_same_result_over_many_partitions(spark):
    df = spark.createDataFrame(repeats(), SCHEMA)
    one = sorted(map(tuple, drop_repeats(df.coalesce(1)).collect()), key=repr)
    assert sorted(map(tuple, drop_repeats(df.repartition(7), buckets=3).collect()), key=repr) == one
    assert drop_repeats(df.limit(0)).collect() == []


def test_rows_that_repeat_keep_the_same(spark):
    line = "a line of more than five words here"
    got = drop_repeats(spark.createDataFrame([(1, line, "", 1, 1), (1, line, "", 1, 1), (2, line, "", 1, 1)], SCHEMA)).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [line, line, ""]
    assert F is not None


def test_units_held_are_told_apart_in_little_memory():
    import tracemalloc

    import numpy as np

    from matchloom.llm import substring_dedup as S

    rng = np.random.default_rng(1)
    held = [(rng.integers(0, 1 << 62, 1000).astype(np.uint64), np.full(1000, i, np.uint64), np.arange(1000).astype(np.uint64)) for i in range(S.HELD // 1000)]
    tracemalloc.start()
    S._told_apart(held, 32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_words_are_told_apart_at_every_place_and_length():
    words = [b"a" * n for n in range(1, 140)] + [b"a" * n + b"\0" for n in range(140)] + [b"a" * n + b"b" + b"a" * (70 - n) for n in range(71)] + ["é\xa0ü".encode(), "日本語".encode(), b"\x1c", b"\x85"]
    assert len(set(words)) == len(words)
    hashes = {}
    for shift in range(9):  # words begin at every place of eight bytes
        for some in (words, words[::-1]):
            data = b" " * (1 + shift) + b"\r\n ".join(some)
            starts, found = word_hashes(data + b" " * (16 + -len(data) % 8))
            assert [data[a : a + len(w)] for a, w in zip(starts.tolist(), some)] == some and len(found) == len(some)
            for w, h in zip(some, found.tolist()):
                assert hashes.setdefault(w, h) == h
    assert len(set(hashes.values())) == len(words)


@pytest.mark.parametrize("width", [1, 3, 5])
def test_sets_of_texts_hashed_together_are_those_of_each(width):
    rng = random.Random(width)
    texts = [None, b"", b" \n\t\v\f\r", b"a", b"A b", b"a b c", b" a  B\nc ", "É é\xa0É".encode(), b"x" * 200 + b" y " + b"X" * 200, b"\0 \0\0 \0"]
    texts += [b" ".join(rng.choice([b"the", b"of", b"Quite-a-long-word" * 3, b"d" * 70]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    want = []
    for t in texts:
        w = (t or b"").lower().split()
        want.append({b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {b" ".join(w)} if w else set())
    got = shingle_hashes(texts, width)
    assert [len(s) for s in got] == [len(s) for s in want] and all((s[1:] > s[:-1]).all() for s in got)
    for i, s in enumerate(got):
        assert np.array_equal(s, shingle_hashes([texts[i]], width)[0])
        assert [len(np.intersect1d(s, t)) for t in got[:i]] == [len(want[i] & want[j]) for j in range(i)]
    assert shingle_hashes([], width) == []
