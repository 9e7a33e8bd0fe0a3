"""The pipeline's stages one after the other, each on all that the one before it kept."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "They met at the old mill by the river and spoke of the harvest for an hour or two while rain fell on the roof and a dog slept by the door until the lamp went out and all of them walked home in the dark along the wet road past the church and over the low stone bridge to town"


def corpus():
    rng = random.Random(12)
    stems = "the garden was quiet in a morning old gate stood open nobody had come by since rain which fell for two days over hills and town below".split()
    write = lambda n: ". ".join(" ".join(rng.choice(stems) + rng.choice(["", "", "s", "ly", "er", "ing", "ed", "o", "u"]) for _ in range(9)) for _ in range(n)) + "."
    rows = [(i, write(8)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(110 + i, rows[i][1].replace("garden", "gardens", 1) + " End") for i in range(5, 9)]
    rows += [(200 + i, write(3) + " " + PASSAGE + " " + write(3)) for i in range(4)]
    junk = [" | ".join(rng.choice(["alphabet", "betabeta", "gammaray"]) + rng.choice("abcdefgh") for _ in range(60)) for _ in range(4)] + ["!! ".join(write(6).upper().split()) for _ in range(6)]
    rows += [(300 + i, t) for i, t in enumerate(junk)] + [(400, None), (401, "")]
    return [(i, t, "en", None if i % 9 == 0 else f"src{i % 3}", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{at}/documents.parquet")
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(at)).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        out.append((name, docs))
    return str(at), dict(out)


def test_stages_keep_the_columns(steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_passages", "mixing", "packing"]
    assert all(steps[1][n].columns == [c.split()[0] for c in SCHEMA.split(", ")] for n in names[:-1])


def test_quality_drops_junk_only(steps):
    kept = {r["doc_id"] for r in steps[1]["quality"].collect()}
    assert {i for i, *_ in corpus() if i < 300} <= kept and sum(300 <= i < 400 for i in kept) <= 1


def test_one_of_each_group_stays(steps):
    before, after = ({r["doc_id"]: r["text"] for r in steps[1][n].collect()} for n in ("quality", "near_duplicates"))
    sets = {}
    for i, t in before.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets.items():
        for b, t in sets.items():
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert set(after) == {i for i in parent if root(i) == i} and all(after[i] == before[i] for i in after) and len(after) < len(before)


def test_texts_without_an_own_id_are_lost_to_near_duplicates_only(spark):
    rng = random.Random(31)
    write = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    texts = [write() for _ in range(12)]
    near = texts[9] + " end"
    rows = [(None, t) for t in texts[:6]] + [(None, texts[0]), (3, texts[1])] + [(5, t) for t in texts[6:10]] + [(5, near), (6, texts[6]), (7, texts[10]), (None, None), (None, ""), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(4), "").collect()]
    assert sum((5, t) in out for t in (texts[9], near)) == 1
    want = [(None, t) for t in texts[:6]] + [(5, t) for t in texts[6:9]] + [(7, texts[10]), (None, None), (None, ""), (8, None)]
    assert sorted((x for x in out if x[1] not in (texts[9], near)), key=repr) == sorted(want, key=repr)


def test_passages_stay_once(steps):
    rows = steps[1]["repeated_passages"].collect()
    middle = " ".join(PASSAGE.split()[15:40])
    assert sum(middle in (r["text"] or "") for r in rows) == 1 and len(rows) == steps[1]["near_duplicates"].count()
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in rows)


def test_mix_and_packing_hold_the_words(steps):
    docs = {r["doc_id"]: len((r["text"] or "").split()) for r in steps[1]["repeated_passages"].collect()}
    total = {}
    for r in steps[1]["mixing"].collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + len(r["text"].split())
    assert all(n <= 2 * docs[i] for i, n in total.items()) and 1.2 * sum(docs.values()) < sum(total.values()) < 1.6 * sum(docs.values())
    packed = steps[1]["packing"]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert packed.filter("piece = 0").count() == steps[1]["mixing"].count()


def test_run_is_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, steps[0]).select("doc_id", "piece", "length", "ids_crc32").collect()
    want = steps[1]["packing"].select("doc_id", "piece", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))


def test_near_duplicates_exchange_no_text(spark):
    """Texts stay where they are: only keys are joined, and rows that repeat id and text still are one."""
    import corpus_pipeline

    words = [" ".join(f"w{(7 * i + j) % 97}{i % 5}" for j in range(40)) for i in range(5)]
    rows = [(i, words[i % 5] if i else None, "en") for i in range(12)] + [(3, words[3], "en"), (3, words[3], "de"), (None, "one more text", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    once = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows[:12] + rows[14:], docs.schema), "")
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Window", "Join"))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in once.collect()) == [(False, 0), (True, 0), (True, 1), (True, 2), (True, 3), (True, 4), (True, 5)]
    assert sorted((r["doc_id"], r["lang"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect() if r["doc_id"] == 3) == [(3, "de")]
