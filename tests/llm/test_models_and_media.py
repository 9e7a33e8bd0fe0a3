"""The language model, the quality classifier, GIF media and fingerprints."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest

from matchloom.llm.fingerprints import PrefixHashes, edited, fingerprint_documents, likeness
from matchloom.llm.language_model import discounts, score, train
from matchloom.llm.media import colour_histogram, decode_frames, decode_gif, encode_gif, lzw_decode, lzw_encode, media_digests
from matchloom.llm.quality import LABELLERS, estimate, figures, judge, votes

SCHEMA = "doc_id long, text string, bucket int, keep string, raw int"


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[min(59, int(rng.expovariate(0.1)))] for _ in range(rng.randint(1, 60))), 1, "k", 2) for i in range(80)]
    return rows + [(90, None, 1, "k", 2), (91, "", 1, "k", 2), (92, "W1\tw2\x0bUNSEEN", 1, "k", 2), (93, rows[3][1], 1, "k", 2), (93, rows[3][1], 1, "k", 2)]


def plain_model(texts):
    """Interpolated modified Kneser-Ney over dictionaries."""
    pairs, one = Counter(), Counter()
    for t in texts:
        w = [*(t or "").lower().split(), "</s>"]
        one.update(w)
        pairs.update(zip(["<s>", *w], w))
    before, after = defaultdict(set), defaultdict(list)
    for (a, b), n in pairs.items():
        before[b].add(a)
        after[a].append(n)
    d2 = discounts([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)])
    d1 = discounts([sum(len(s) == k for s in before.values()) for k in (1, 2, 3, 4)])
    take = lambda n, d: max(0, n - (0, *d)[min(n, 3)])
    low = sum(d1[min(len(s), 3) - 1] for s in before.values()) / len(pairs)

    def p(a, b):
        q = take(len(before[b]) if b in before else 0, d1) / len(pairs) + low / (len(one) + 1)
        if a not in after:
            return q
        spare = sum(d2[min(n, 3) - 1] for n in after[a])
        return (take(pairs.get((a, b), 0), d2) + spare * q) / sum(after[a])

    return one, p


@pytest.mark.parametrize("buckets", [1, 5])
def test_model_matches_plain_counts(spark, buckets):
    rows = corpus()
    learned = rows[:60]
    model = train(spark.createDataFrame(learned, SCHEMA).repartition(3), buckets)
    one, p = plain_model([r[1] for r in learned])
    n, v = sum(one.values()), len(one)
    assert (model.tokens, model.vocabulary) == (n, v)
    got = score(model, spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        w = [*(text[r["doc_id"]] or "").lower().split(), "</s>"]
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(x in one for x in w) and r["train_tokens"] == n
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert math.isclose(r["base_score"], sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], w)), rel_tol=1e-9)
    known = list(one) + ["never"]
    for a in ("<s>", "w1", "w3", "never"):
        assert math.isclose(sum(p(a, b) for b in known), 1, rel_tol=1e-9)


def test_model_of_nothing(spark):
    model = train(spark.createDataFrame([], SCHEMA), 2)
    got = score(model, spark.createDataFrame([(1, "a b", 1, "", 1), (2, None, 1, "", 1)], SCHEMA)).collect()
    assert [r["n_known"] for r in got] == [0, 0] and all(r["score"] <= 0 for r in got)


CLEAN = "The garden was quiet in the morning and the old gate stood open. Nobody had come by since the rain, which fell for two days over the hills and the town below."


def junk(rng, kind):
    w = [rng.choice("alpha beta gamma delta kappa sigma omega theta lambda epsilon".split()) + rng.choice("abcdefgh") * 3 for _ in range(60)]
    return {"shout": "!! ".join(w).upper() + "!!", "bars": " | ".join(w), "symbols": " ".join(x + rng.choice(["###", "$$$", "%%%"]) for x in w), "again": " ".join(w[:6] * 20)}[kind]


def test_classifier_keeps_clean_and_drops_junk(spark):
    rng = random.Random(6)
    parts = CLEAN.replace(".", "").split()
    rows = [(i, ". ".join(" ".join(rng.choice(parts) + rng.choice(["", "s", "ly", "er", "ing"]) for _ in range(9)) for _ in range(6)), 1, "old", 1) for i in range(200)]
    bad = [(1000 + i, junk(rng, k), 1, "old", 1) for i, k in enumerate(["shout", "bars", "symbols", "again"] * 12)]
    odd = [(2000, None, 1, "", 1), (2001, "", 1, "", 1), (2002, rows[0][1], 1, "", 1), (None, CLEAN, 1, "", 1)]
    got = {r["doc_id"]: r for r in judge(spark.createDataFrame(rows + bad + odd, SCHEMA)).collect()}
    assert len(got) == len(rows) + len(bad) + len(odd) and all(0 <= r["quality_score"] <= 1 for r in got.values())
    assert sum(got[i]["keep"] for i, *_ in rows) == len(rows)
    assert sum(not got[i]["keep"] for i, *_ in bad) >= 0.9 * len(bad)
    assert got[2002]["quality_score"] == got[0]["quality_score"] and got[0]["text"] == rows[0][1]
    assert judge(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("syllables", ["ко ра ми вед ный ста по ли не гу", "κα το μις λε ρος θη να σω φι ξε", "가 나무 바다 하늘 에서 는 을 고 다 사람"], ids=["Cyrillic", "Greek", "Korean"])
def test_long_clean_texts_of_other_scripts_are_no_loops(spark, syllables):
    rng = random.Random(21)
    parts = syllables.split()
    # As in prose, most words are short and many repeat; few lengths, many words.
    stems = sorted({"".join(rng.choice(parts) for _ in range(rng.choice([1, 1, 2, 2, 3]))) for _ in range(900)})
    write = lambda n: " ".join(rng.choice(stems) + rng.choice(["", "", "", "", ",", "."]) for _ in range(n)) + "."
    clean = [(i, write(rng.randint(500, 1200))) for i in range(60)]
    looped = [(100 + i, " ".join([write(6)] * 90)) for i in range(8)]
    got = {r["doc_id"]: r for r in judge(spark.createDataFrame(clean + looped, "doc_id long, text string")).collect()}
    at = [list(LABELLERS).index(n) for n in ("few_words", "same_runs", "looped")]
    assert all("b" not in [got[i]["votes"][k] for k in at] and got[i]["keep"] for i, _ in clean)
    assert all([got[i]["votes"][k] for k in at] == ["b"] * 3 and not got[i]["keep"] for i, _ in looped)
    assert figures(f"{parts[0]}\n{parts[1]}\n{parts[2]}")["line_again"] == 0


def test_kinds_of_characters_are_those_of_unicode():
    import unicodedata

    from matchloom.llm.quality import figures, votes

    for shout in ("BUY IT NOW CHEAP " * 10, "КУПИ ЭТО СЕЙЧАС ДЁШЕВО " * 10, "ΑΓΟΡΑΣΕ ΤΟ ΤΩΡΑ ΦΤΗΝΑ " * 10):
        assert figures(shout)["upper"] == 1.0 and votes(figures(shout))[0] == "b"
    stars = figures("★ → ■ ☆ ← □ ★ " * 8)
    assert stars["alpha"] == 0 and stars["symbols"] == 1.0 and votes(stars)[2] == "b" and votes(stars)[6] == "b"
    plain = "क ख घर में पानी है और हम सब साथ चलते हैं। " * 3
    f = figures(plain)
    assert f["alpha"] == sum(unicodedata.category(c)[0] in "LM" for c in plain) / len(plain) and f["upper"] == 0 and f["ends"] > 0
    mixed = "Ünïcode ÉCOLE школа ШКОЛА 12 ３４ €5"
    letters = [c for c in mixed if c.isalpha()]
    assert abs(figures(mixed)["upper"] - sum(c.isupper() for c in letters) / len(letters)) < 1e-12


def test_expectation_maximisation_finds_the_better_labeller():
    rng, n = random.Random(8), len(LABELLERS)
    seen = Counter()
    for _ in range(5000):
        good = rng.random() < 0.8
        letters = []
        for j in range(n):
            right = rng.random() < (0.95 if j < n // 2 else 0.7)
            letters.append("-" if rng.random() < 0.2 else "g" if right == good else "b")
        seen["".join(letters)] += 1
    posterior, tables, prior = estimate(dict(seen))
    assert abs(prior - 0.8) < 0.05 and min(t["b"][1] for t in tables[: n // 2]) > max(t["b"][1] for t in tables[n // 2 :])
    assert posterior.get("g" * n, 1) > 0.99
    assert estimate({})[0] == {} and len(votes(figures(""))) == n


@pytest.mark.parametrize("data", [b"", b"a", b"\0" * 64, b"ab" * 5000, bytes(range(256)) * 40, random.Random(1).randbytes(20000), b"x" * 70000])
def test_lzw_round_trip(data):
    assert lzw_decode(lzw_encode(data), 8, len(data)) == data


def test_lzw_of_small_codes_and_damage():
    assert lzw_decode(bytes([0x8C, 0x2D, 0x99, 0x87, 0x2A, 0x1C, 0xDC, 0x33, 0xA0, 0x02, 0x75, 0xEC, 0x95, 0xFA, 0xA8, 0xDE, 0x60, 0x8C, 0x04, 0x91, 0x4C, 0x01]), 2, 100) == bytes(map(int, "".join(["1111122222", "1111122222", "1111122222", "1110000222", "1110000222", "2220000111", "2220000111", "2222211111", "2222211111", "2222211111"])))
    assert len(lzw_decode(b"\xff\xff\xff", 8, 10)) <= 10 and lzw_decode(b"", 8, 10) == b""


def gif(frames, width=4, height=2):
    """A two-colour-table GIF of (indexes, disposal, transparent, left, top, w, h, delay)."""
    out = [b"GIF89a" + struct.pack("<HHBBB", width, height, 0x91, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])]
    for data, disposal, transparent, left, top, w, h, delay in frames:
        flags = disposal << 2 | (transparent is not None)
        out.append(b"\x21\xfe\x03abc\0\x21\xf9\x04" + struct.pack("<BHBB", flags, delay, transparent or 0, 0) + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0) + b"\x02")
        stream = lzw_encode(bytes(data), 2)
        out.append(bytes([len(stream)]) + stream + b"\0")
    return b"".join(out) + b"\x3b"


def test_disposal_transparency_and_time():
    full = [1] * 8
    frames = decode_gif(gif([(full, 1, None, 0, 0, 4, 2, 5), ([2, 3, 2, 3], 2, 3, 1, 0, 2, 2, 7), ([3], 3, None, 0, 0, 1, 1, 1), ([2], 1, None, 3, 1, 1, 1, 2)]))
    colour = lambda f, y, x: tuple(int(c) for c in f["canvas"][y, x])
    red, green, blue, clear = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    assert [f["start"] for f in frames] == [0, 5, 12, 13] and [f["delay"] for f in frames] == [5, 7, 1, 2]
    assert colour(frames[0], 0, 0) == red
    assert colour(frames[1], 0, 1) == green and colour(frames[1], 0, 2) == red
    assert colour(frames[2], 0, 1) == clear and colour(frames[2], 0, 2) == clear and colour(frames[2], 0, 0) == blue
    assert colour(frames[3], 0, 0) == red and colour(frames[3], 1, 3) == green
    assert colour_histogram(frames[0]["canvas"]) == [0] * 7 + [8] + [8] + [0] * 7 + [8] + [0] * 7
    assert decode_gif(b"") == [] and decode_gif(b"not a gif at all") == []


def test_interlaced_rows_are_put_in_order():
    rows = bytes(range(10))
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    stream = lzw_encode(bytes(rows[i] for i in order))
    data = b"GIF87a" + struct.pack("<HHBBB", 1, 10, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 10, 0xC7) + bytes(x for i in range(256) for x in (i, i, i)) + b"\x08" + bytes([len(stream)]) + stream + b"\0\x3b"
    assert decode_gif(data)[0]["canvas"][:, 0, 0].tolist() == list(rows)


def test_media_digests(spark):
    long = "wörter " * 60000
    rows = [(1, "abc", 1, "", 1), (2, None, 1, "", 1), (3, "", 1, "", 1), (4, "é" * 32, 1, "", 1), (5, long, 1, "", 1), (6, "abc", 1, "", 1), (None, "x", 1, "", 1)]
    got = {r["doc_id"]: r for r in media_digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = encode_gif(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert tuple(got[1])[1:] == tuple(got[6])[1:] and got[5]["feature"].startswith("frames=2;") and media_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_frames_table(spark):
    df = spark.createDataFrame([(1, bytearray(encode_gif(b"abcd" * 64, 64, 2))), (2, None), (3, bytearray(b"junk"))], "id long, media binary")
    got = decode_frames(df, "id", "media").orderBy("frame").collect()
    assert [(r["id"], r["frame"], r["start_cs"], r["height"]) for r in got] == [(1, 0, 0, 2), (1, 1, 4, 2)]
    assert bytes(got[0]["rgba"])[::4] == b"abcd" * 32 and sum(got[0]["histogram"]) == 3 * 128


def test_spans_and_extensions():
    a, b = "the quick brown fox jumps", "a quick brown fax"
    x, y = PrefixHashes(a), PrefixHashes(b)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            assert x.common_extension(i, y, j) == n
    assert x.equal(4, y, 2, 11) and not x.equal(4, y, 2, 15)
    assert PrefixHashes("").fingerprint() == "0" * 256 and likeness("0" * 256, "0" * 256) == 1.0
    assert PrefixHashes("ab").fingerprint() != PrefixHashes("ba").fingerprint()


def test_likeness_follows_shared_windows():
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    other = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    near = text[:2000] + "ZZ" + text[2001:]
    f = lambda t: PrefixHashes(t).fingerprint()
    assert likeness(f(text), f(text)) == 1 and likeness(f(text), f(near)) > 0.8 and likeness(f(text), f(other)) < 0.05
    assert 0.15 < likeness(f(text), f(edited(text, other))) < 0.55


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_documents_follow_each_other(spark, partitions):
    rng = random.Random(11)
    texts = {i * 3: "".join(rng.choice("abcdé 𝒳") for _ in range(rng.randint(0, 90))) for i in range(30)} | {500: "", 501: None}
    rows = [(i, t, 1, "", 1) for i, t in texts.items()]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in fingerprint_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), partitions).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for i, j in zip(ids, ids[1:] + ids[:1]):
        t, following = texts[i] or "", texts[j] or ""
        changed = edited(t, following)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (PrefixHashes(t).fingerprint(), PrefixHashes(changed).fingerprint())
        assert r["near_next"] == likeness(r["fingerprint"], PrefixHashes(following).fingerprint()) and r["near_edited"] == likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["common_prefix"] >= len(t) - len(t) // 2 or len(changed) < len(t)


def test_odd_tables_of_fingerprints(spark):
    one = fingerprint_documents(spark.createDataFrame([(1, "abcdef", 1, "", 1)], SCHEMA)).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    twice = fingerprint_documents(spark.createDataFrame([(1, "ab", 1, "", 1), (1, "ab", 1, "", 1), (None, "x", 1, "", 1), (None, None, 1, "", 1)], SCHEMA)).collect()
    assert len(twice) == 4
    assert fingerprint_documents(spark.createDataFrame([], SCHEMA)).collect() == []
