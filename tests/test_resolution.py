"""Golden values of the resolution operators, and properties that must hold for any data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions import barcode as B
from matchloom.functions import similarity as X
from matchloom.functions import text as T
from matchloom.operators import agreement as A
from matchloom.operators import calibration as C
from matchloom.operators import decisions as D
from matchloom.operators import evaluation as E
from matchloom.operators import retrieval as V
from matchloom.operators import routing as R
from matchloom.operators import state as S
from matchloom.sources import records as IO

CODE_A, CODE_B, CODE_C = "5000000000012", "5000000000029", "5000000000036"


def of(spark, column, *values):
    """The column's value for each text."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.select(column(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_quantities(spark):
    got = of(spark, T.normalize_quantity, "0.030kg", "2x51g", "330ml", "1.43L", "8x100g", "4X115G", "9 rolls", None, "", "1.2.3g", " 5 KG ", "1234567g", "0.00001kg", "0g", "1000kg")
    assert got == ["30g", "102g", "330ml", "1430ml", "800g", "115g", "9 rolls", "", "", None, "5000g", "1.23457e+06g", "0.01g", "0g", "1e+06g"]


def test_texts(spark):
    assert of(spark, T.normalize_text, "Cadbury's DAIRY-MILK!", None, "", " Été  _x ", "a - b") == ["cadburys dairymilk", "", "", "été _x", "a b"]
    assert of(spark, T.truncate_name, "a b c", "a b", "", "a  b  c d") == ["a b", "a b", "", "a b c"]
    assert of(spark, T.reformat_quantity, "30g", "2kg", "2x30g", "330ml", "9 rolls") == ["0.030kg", "2kg", "2x30g", "0.33L", "9 rolls"]
    df = spark.createDataFrame([("MRS", "Mars  Bar"), ("  mrs ", "mars bar")], "b string, n string")
    assert len({r[0] for r in df.select(T.alias_key("b", "n")).collect()}) == 1
    pairs = [("Sainsbury's", "SAINSBURYS THE…", True), ("Green & Black's", "GREEN  BLACKS…", True), ("M&S", "SOMETHING MASSIVE", False), ("Ben & Jerry's", "BEN AND JERRYS…", False)]
    df = spark.createDataFrame(pairs, "b string, t string, want boolean")
    assert all(r[0] == r[1] for r in df.select(T.found_in("b", "t"), "want").collect())


def test_codes(spark):
    made = [r[0] for r in spark.range(1).select(F.explode(F.array(*(B.make_gtin("500", F.lit(n)) for n in (1, 42, 999))))).collect()]
    assert made[0] == CODE_A and of(spark, B.is_valid_ean13, *made, "5000000000302", "500000000030", None) == [True, True, True, True, False, False]
    assert of(spark, B.is_valid_gtin, "96385074", "96385075", "50000000000", "50000000000X", "036000291452", "0036000291452", "") == [True, False, False, False, True, True, False]
    assert of(spark, B.gtin14, "036000291452", "12a", "123456789012345") == ["00036000291452", "12a", "123456789012345"]
    assert of(spark, B.gtin_format, "96385074", "1" * 12, "1" * 13, "1" * 14, "12", "x") == ["ean8", "upc12", "ean13", "gtin14", "len2", "non_numeric"]
    assert of(spark, B.barcode_status, CODE_A, "5000000000011", "1" * 12, "1" * 8, "12", "") == ["ean13", "ean13_bad_check", "upc12", "ean8", "other_length", "non_numeric"]
    assert of(spark, B.pick_barcode, "500000000030\n5000000000302\n", "5000 0000 00302", "500000000030", "123", None) == ["5000000000302", "5000000000302", "500000000030", "", ""]
    like = lambda q, c: spark.range(1).select(B.gtin_similarity(F.lit(q), F.lit(c))).first()[0]
    assert like(CODE_A, CODE_A) == 1 and like(CODE_B, CODE_A) == 0 and 0 < like("5000000000099", "5000000000098") <= 0.5 and like("", CODE_A) == 0
    assert abs(like("5000000000013", CODE_A) - 1 / 3) < 1e-12


def test_scanned_label(spark):
    got = of(spark, B.extract_fields, " Mars \nMars Bar\nnet weight 51g\n5000 0000 00302", "", None)
    assert tuple(got[0]) == ("Mars", "Mars Bar", "51G", "5000000000302") and tuple(got[1]) == tuple(got[2]) == ("", "", "", "")
    both = F.struct(F.lit("").alias("brand"), F.lit("n").alias("product_name"), F.lit("q").alias("quantity"), F.lit("500000000030").alias("gtin")), F.struct(F.lit("B").alias("brand"), F.lit("m").alias("product_name"), F.lit("").alias("quantity"), F.lit("5000000000302").alias("gtin"))
    assert tuple(spark.range(1).select(B.arbitrate_fields(*both)).first()[0]) == ("B", "n", "q", "5000000000302")


def test_similarities():
    assert X.metaphone("MRS") == X.metaphone("Mars") == "MRS" and X.metaphone("KLGS") == X.metaphone("Kelloggs") and X.metaphone("Warburton's") == X.metaphone("Warburtons") and X.metaphone("") == X.metaphone(None) == ""
    assert X.metaphone("Knight") == "NFT" or X.metaphone("Knight") == "NT"
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd é") for _ in range(rng.randint(0, 70))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for c in a:
            row = _next(row, c, b)
        assert X.lcs_length(a, b) == row[-1]
    assert X.token_sort_similarity("b a", "A  B") == 1 and X.token_sort_similarity("", None) == 1 and X.token_sort_similarity("a", "") == 0


def _next(row, c, b):
    out = [0]
    for j, d in enumerate(b, 1):
        out.append(row[j - 1] + 1 if c == d else max(row[j], out[-1]))
    return out


@pytest.mark.parametrize(
    "codes, verdict, agreeing, corrupt",
    [
        ((CODE_A, CODE_A, CODE_A), "all_three_agree", ["artwork", "master", "supplier"], []),
        ((CODE_A, CODE_B, CODE_A), "two_of_three", ["artwork", "master"], []),
        ((CODE_A, CODE_B, CODE_C), "full_mismatch", [], []),
        (("5000000000011", CODE_A, CODE_A), "two_of_three", ["master", "supplier"], ["artwork"]),
        ((CODE_A, CODE_B, ""), "full_mismatch", [], []),
        (("", None, CODE_A), "insufficient_data", [], []),
        (("036000291452", "0036000291452", "0036000291452"), "all_three_agree", ["artwork", "master", "supplier"], []),
    ],
)
def test_three_way(spark, codes, verdict, agreeing, corrupt):
    got = spark.range(1).select(A.verify_three_way(*(F.lit(c).cast("string") for c in codes)).alias("b")).first()["b"]
    assert (got["verdict"], list(got["agreeing"]), list(got["corrupt_sources"])) == (verdict, agreeing, corrupt)
    assert got["score"] == A.VERDICT_SCORE[verdict]


def routed(spark, agreement, top, nxt, codes, second=True, alias=False, calibrator=None, llm=None):
    code = A.verify_three_way(*(F.lit(c) for c in codes))
    d = R.route(F.lit(float(agreement)), F.lit(top), F.lit(nxt), code, F.lit(second), F.lit(alias), None if llm is None else F.lit(True), None if llm is None else F.lit(llm), calibrator)
    return spark.range(1).select(d.alias("d")).first()["d"]


def test_routes(spark):
    same, split, all_differ = (CODE_A,) * 3, (CODE_A, CODE_B, CODE_A), (CODE_A, CODE_B, CODE_C)
    assert routed(spark, 1, 0.95, 0.20, same)["route"] == "auto_merge"
    assert routed(spark, 0, 0.30, 0.28, ("", "", CODE_A))["route"] == "reject"
    veto = routed(spark, 1, 1.0, 0.0, all_differ)
    assert veto["route"] == "hold_for_review" and "barcode_three_way_mismatch" in veto["overrides"] and veto["confidence"] == 0.6
    assert "retrieval_ambiguous" in routed(spark, 1, 0.96, 0.95, same)["overrides"]
    assert routed(spark, 2 / 3, 0.95, 0.20, same)["route"] == "auto_merge"
    conflict = routed(spark, 2 / 3, 0.95, 0.20, split)
    assert conflict["route"] != "auto_merge" and "artwork_supplier_barcode_conflict" in conflict["overrides"]
    held, lifted = routed(spark, 1 / 3, 0.95, 0.20, same), routed(spark, 1 / 3, 0.95, 0.20, same, alias=True)
    assert (held["route"], lifted["route"]) == ("hold_for_review", "auto_merge") and abs(held["confidence"] - 0.83333) < 1e-4 and abs(lifted["confidence"] - 0.93333) < 1e-4
    absent = routed(spark, 0, 0.95, 0.20, ("", "", ""), second=False)
    assert absent["confidence"] > routed(spark, 0, 0.95, 0.20, all_differ)["confidence"] and absent["overrides"][0] == "signals_unavailable:barcode,source_agreement"
    alone = routed(spark, 0, 1.0, 0.0, ("", "", ""), second=False, calibrator=lambda m: F.lit(0.999))
    assert alone["route"] != "auto_merge" and "single_signal_no_corroboration" in alone["overrides"]
    assert routed(spark, 1, 0.95, 0.20, same, llm=0.5)["route"] == "reject"
    signal = lambda c: spark.range(1).select(R.text_signal(F.lit(0.7), F.lit(0.5), c)).first()[0]
    assert abs(signal(None) - 0.5) < 1e-9 and signal(lambda m: F.lit(1.7)) == 1 and signal(lambda m: F.lit(-0.4)) == 0
    name = lambda a, r, s=True: spark.range(1).select(R.problem_class(F.lit(float(a)), F.lit(r), F.lit(s))).first()[0]
    assert [name(1, "auto_merge"), name(0.5, "auto_merge"), name(1, "hold_for_review"), name(0.5, "hold_for_review"), name(1, "reject"), name(0, "hold_for_review", False)] == ["clean", "supplier_data_entry_error", "resolution_ambiguity", "both", "unresolved", "resolution_ambiguity"]


def test_ambiguity_and_guardrail(spark):
    ranked = lambda *rows: F.array(*(F.struct(F.lit(i).cast("long").alias("master_id"), F.lit(s).alias("score")) for i, s in rows))
    ask = lambda c, a, b: spark.range(1).select(R.needs_disambiguation(F.lit(c), a, b).alias("n")).first()["n"]
    sure = ranked((1, 0.95), (2, 0.40)), ranked((1, 0.93), (2, 0.38))
    assert ask(True, *sure)["invoke"] and not ask(False, *sure)["invoke"] and ask(False, *sure)["reason"] == "one record is clearly best"
    assert ask(False, ranked((1, 0.9)), ranked((2, 0.9)))["reason"] == "best record differs: 1 by supplier, 2 by artwork"
    assert ask(False, ranked((1, 0.80), (2, 0.77)), sure[1])["reason"].startswith("supplier: best two only 0.030 apart")
    answer = lambda ids, i, c: spark.range(1).select(R.llm_guardrail(F.array(*map(F.lit, ids)).cast("array<long>"), F.lit(i).cast("long"), F.lit(c)).alias("a")).first()["a"]
    assert tuple(answer([1, 2], 1, 0.99))[:3] == (1, 0.75, True) and answer([1, 2], 999, 0.5)["master_id"] is None and answer([1, 2], 999, 0.5)["error"] and answer([], 1, 0.5)["error"] == "empty shortlist"


CATALOG = [(101, CODE_B, "Acme", "Oat Bar"), (102, CODE_A, "Acme", "Oat Bar"), (1, CODE_C, "Mars", "Mars Bar"), (2, "5000000000043", "Kelloggs", "Corn Flakes"), (3, "", "", "")]


def test_retrieval(spark):
    catalog = spark.createDataFrame(CATALOG, "master_id long, gtin string, brand string, product_name string")
    asked = spark.createDataFrame([(7, "Acme", "Oat Bar", CODE_A), (8, "MRS", "MARS BAR", ""), (9, "", "", ""), (10, None, None, None)], "query_id long, brand string, name string, gtin string")
    ranked = V.rank_candidates(asked, catalog, k=3)
    best = {r["query_id"]: (r["master_id"], r["vector"]) for r in ranked.filter("rank = 1").collect()}
    assert best[7][0] == 102 and best[8][0] == 1 and best[8][1] > 0 and {r["query_id"] for r in ranked.collect()} == {7, 8, 9, 10}
    # The bound loses nothing: every pair scored in full ranks alike.
    full = V.rank_candidates(asked, catalog, k=len(CATALOG)).filter("rank <= 3")
    key = lambda df: sorted((r["query_id"], r["rank"], r["master_id"], round(r["combined"], 9)) for r in df.collect())
    assert key(ranked) == key(full)
    signals = V.blocked_signals(asked.limit(2), catalog, 2)
    assert signals.groupBy("query_id").count().filter("count > 2").count() == 0
    conflict = V.signal_conflicts(spark.createDataFrame([(1, "Mars", "Mars Bar", CODE_B), (2, "Mars", "Mars Bar", CODE_C), (3, "Mars", "Mars Bar", "5000000000099")], "query_id long, brand string, name string, gtin string"), catalog).collect()
    assert [(r["query_id"], r["text_pick"], r["gtin_pick"]) for r in conflict] == [(1, 1, 101)]


def plain_ranking(asked, catalog):
    """Scores of all pairs by plain sums: (query_id, [(-combined, master_id, text, phonetic, vector, barcode), ...])."""
    from collections import Counter

    from matchloom.functions.similarity import metaphone, token_sort_similarity

    blob = lambda b, n: " ".join(x.strip() for x in (b or "", n or "") if x.strip()).lower().strip()
    grams = lambda t: Counter(p[i : i + n] for w in t.split() for p in (f" {w} ",) for n in range(2, min(4, len(p)) + 1) for i in range(len(p) - n + 1))
    having = Counter(g for _, _, b, n in catalog for g in grams(blob(b, n)))
    idf = {g: math.log((1 + len(catalog)) / (1 + d)) + 1 for g, d in having.items()}

    def vector(t):
        w = {g: (1 + math.log(n)) * idf[g] for g, n in grams(t).items() if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()}

    def distance(a, b):
        before = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            now = [i]
            for j, d in enumerate(b, 1):
                now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
            before = now
        return before[-1]

    valid = lambda c: len(c) == 13 and c.isdigit() and sum(int(d) * (1, 3)[i % 2] for i, d in enumerate(c)) % 10 == 0
    out = {}
    for query, b, n, code in asked:
        q, rows = vector(blob(b, n)), []
        for master, c, cb, cn in catalog:
            text = token_sort_similarity(f"{b or ''} {n or ''}".lower(), f"{cb or ''} {cn or ''}".lower())
            sound = float(bool(b) and bool(cb) and metaphone(b) == metaphone(cb))
            near = vector(blob(cb, cn))
            cosine = sum(x * near.get(g, 0) for g, x in q.items())
            same = 0.0 if not code or not c else 1.0 if code == c else 0.0 if valid(code) else max(0.0, 0.5 * (1 - distance(code, c) / 3))
            rows.append((-round(0.2 * text + 0.15 * sound + 0.35 * cosine + 0.3 * same, 9), master, text, sound, cosine, same))
        out[query] = sorted(rows)
    return out


def test_ranking_matches_all_pairs(spark):
    rng = random.Random(11)
    words, brands = "oat bar corn flakes milk choc dark rice puff honey nut crisp".split(), ["Acme", "Akme", "Mars", "Marz Ltd.", "", None, "Kelloggs"]
    code = lambda: "".join(rng.choice("019") for _ in range(13))
    catalog = [(i, rng.choice([code(), "", None, CODE_A]), rng.choice(brands), " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) or None) for i in range(150)]
    asked = [(1000 + i, rng.choice(brands), " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), rng.choice([code()[:12], catalog[i][1], CODE_A, "", None])) for i in range(40)]
    want = plain_ranking(asked, catalog)
    frames = spark.createDataFrame(asked, "query_id long, brand string, name string, gtin string"), spark.createDataFrame(catalog, "master_id long, gtin string, brand string, product_name string").repartition(7)
    got = V.rank_candidates(*frames, k=5).collect()
    assert len(got) == 5 * len(asked)
    for r in got:
        w = want[r["query_id"]][r["rank"] - 1]
        assert r["master_id"] == w[1] and all(abs(r[n] - x) < 1e-9 for n, x in zip(("combined", "text", "phonetic", "vector", "barcode"), (-w[0], *w[2:])))
    near = V.blocked_signals(*frames, 20).collect()  # a block is filled in order of ids where too few rows share a gram
    for query, rows in want.items():
        order = sorted(rows, key=lambda w: (-round(w[4], 9), w[1]))[:20]
        assert [r["cand_id"] for r in sorted((r for r in near if r["query_id"] == query), key=lambda r: r["pos"])] == [w[1] for w in order]
    assert V.rank_candidates(frames[0].limit(0), frames[1]).count() == 0 and V.rank_candidates(frames[0], frames[1].limit(0)).count() == 0


def test_near_codes():
    """Against the distance of every pair, with letters of any kind and codes as short as they can be."""
    from matchloom.operators import blocks as K

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    rng = random.Random(5)
    for most in (2, 5, 9):
        some = lambda n: sorted({"".join(rng.choice("01é") for _ in range(rng.randint(1, most))) for _ in range(n)})
        codes, asked = some(60), some(40)
        got = sorted(zip(*(x.tolist() for x in K.near_codes(codes, asked))))
        assert got == [(i, j, d) for i, c in enumerate(codes) for j, a in enumerate(asked) if (d := distance(a, c)) <= 2]
    assert [len(x) for x in K.near_codes([], ["1"])] == [0, 0, 0]


def test_ranking_takes_each_text_once(spark, monkeypatch):
    """Rows and queries that share brand and name meet as one text, whatever their codes; copies still are ranked one by one."""
    met = []
    against = V.K.against
    monkeypatch.setattr(V.K, "against", lambda rows, row_key, queries, *rest, **more: met.append((rows.count(), queries.count())) or against(rows, row_key, queries, *rest, **more))
    rng = random.Random(7)
    texts = [("Acme", "oat bar"), ("Akme", "oat bars"), ("Mars", "dark choc"), ("Mars", "milk choc puff")]
    catalog = [(i, "5" + "".join(rng.choice("01") for _ in range(12)), *texts[i % 4]) for i in range(160)]
    asked = [(1000 + i, ("Mars Ltd.", "Acme")[i % 2], ("choc dark", "oat bar")[i % 2], (catalog[7 * i][1], catalog[i][1][:12])[i % 3 == 0]) for i in range(20)]
    frames = spark.createDataFrame(asked, "query_id long, brand string, name string, gtin string"), spark.createDataFrame(catalog, "master_id long, gtin string, brand string, product_name string")
    got = V.rank_candidates(*frames, k=4).collect()
    assert met[-1] == (4, 2)
    want = plain_ranking(asked, catalog)
    assert len(got) == 80 and all(r["master_id"] == want[r["query_id"]][r["rank"] - 1][1] and abs(r["combined"] + want[r["query_id"]][r["rank"] - 1][0]) < 1e-9 for r in got)


def test_calibrators(spark):
    rng = random.Random(3)
    rows = [(x, int(rng.random() < 1 / (1 + math.exp(-(8 * x - 3))))) for x in (rng.random() for _ in range(4000))]
    df = spark.createDataFrame(rows, "x double, y int")
    fit = C.fit_platt(df, "x", "y")
    assert abs(fit.a - 8) < 1.2 and abs(fit.b + 3) < 1.2
    small = rows[:300]
    step = C.fit_isotonic(spark.createDataFrame(small, "x double, y int").repartition(5), "x", "y")
    assert list(step.y) == sorted(step.y)
    by = sorted(small)
    sums = [0]
    for _, y in by:
        sums.append(sums[-1] + y)
    n = len(by)
    want = [max(min((sums[m] - sums[j]) / (m - j) for m in range(k + 1, n + 1)) for j in range(k + 1)) for k in range(0, n, 17)]
    probe = spark.createDataFrame([(k, by[k][0]) for k in range(0, n, 17)], "k int, x double")
    got = [r[0] for r in probe.orderBy("k").select(step(F.col("x"))).collect()]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))
    for c in (fit, step):
        assert C.from_json(C.to_json(c, {"n": 1})) == c
    with pytest.raises(ValueError):
        C.from_json('{"kind": "other"}')


def test_measures(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (1.0, 1)]
    df = spark.createDataFrame(rows, "p double, y int")
    pairs = [(a, b) for a, y in rows if y for b, z in rows if not z]
    assert abs(E.auc(df, "p", "y").first()[0] - sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)) < 1e-12
    assert E.auc(df.filter("y = 1"), "p", "y").first()[0] is None
    bins = {r["bin"]: (r["claimed"], r["observed"], r["n"]) for r in E.reliability(df, "p", "y").collect()}
    assert bins == {1: (0.1, 0.0, 1), 4: (0.4, 0.5, 2), 8: (0.8, 1.0, 1), 9: (1.0, 1.0, 1)}
    assert abs(df.agg(E.brier(F.col("p"), F.col("y"))).first()[0] - sum((p - y) ** 2 for p, y in rows) / 5) < 1e-12
    got = E.bands(df, "p", "y", False).first()
    assert (got["auto"], got["hold"], got["reject"], got["correct_rejected"]) == (0, 2, 3, 1)


def test_state(spark):
    aliases = spark.createDataFrame([("a", 1, "A", "ann", "2024-01-01", 4), ("b", 2, "B", "ann", "2024-01-01", 0)], "alias_key string, resolved_id long, resolved_name string, approved_by string, approved_at string, times_reused long")
    new = spark.createDataFrame([("a", 9, "Z", "bob", "2024-02-01"), ("a", 8, "Y", "bob", "2024-01-15"), ("c", 3, "C", "bob", "2024-02-01")], "alias_key string, resolved_id long, resolved_name string, approved_by string, approved_at string")
    got = {r["alias_key"]: (r["resolved_id"], r["approved_by"], r["times_reused"]) for r in S.approve(aliases, new).collect()}
    assert got == {"a": (9, "bob", 4), "b": (2, "ann", 0), "c": (3, "bob", 0)}
    hits = spark.createDataFrame([("a",), ("a",), ("x",)], "alias_key string")
    assert {r["alias_key"]: r["times_reused"] for r in S.record_reuse(aliases, hits).collect()} == {"a": 6, "b": 0}
    with pytest.raises(Exception, match="approver"):
        S.approve(aliases, new.withColumn("approved_by", F.lit(" "))).collect()


def test_sources(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "c.db") as db:
        db.execute("create table t (id integer primary key, code text)")
        db.executemany("insert into t values (?, ?)", [(i, f"00{i}") for i in range(1, 8)])
    got = IO.read_sqlite(spark, str(tmp_path / "c.db"), "t", "id long, code string", rows=3).collect()
    assert sorted(map(tuple, got)) == [(i, f"00{i}") for i in range(1, 8)]
    (tmp_path / "x.csv").write_bytes('id,name\n1,"caf\xe9 ""a"""\n'.encode("latin-1"))
    assert IO.read_csv(spark, str(tmp_path / "x.csv"), encoding="ISO-8859-1").first()["name"] == 'café "a"'
    body = '{"code":"96385074","brands":"B, C","product_name":" N ","selected_images":{"front":{"display":{"en":"u.400.jpg"},"small":{"en":"s"}},"packaging":{"thumb":{"fr":"t.100.jpg"}},"none":{}}}'
    raw = spark.createDataFrame([(1, body), (2, body.replace(" N ", "later")), (3, '{"code":"","product_name":"x"}'), (4, "not json"), (5, None)], "pos long, json string")
    p = IO.product_records(raw).collect()
    assert len(p) == 1 and (p[0]["brand"], p[0]["product_name"], p[0]["barcode_status"], p[0]["has_packaging_view"]) == ("B", "N", "ean8", True)
    assert p[0]["image_urls"] == {"front": "u.full.jpg", "packaging": "t.full.jpg"}
    assert IO.run_dir("/r", "leipzig", "abt-buy") == "/r/leipzig/abt-buy"
    with pytest.raises(ValueError):
        IO.run_dir("/r", "leipzig", "other")
    IO.save_calibrator(spark, C.Platt(1.5, -2.0), f"{tmp_path}/cal")
    assert IO.load_calibrator(spark, f"{tmp_path}/cal") == C.Platt(1.5, -2.0) and IO.load_calibrator(spark, f"{tmp_path}/nothing") is None
    log = S.decision_rows(spark.createDataFrame([("e", 1, 1, "reject", 0.1, "unresolved", "z", 2)], "event_id string, resolved_id long, true_master_id long, route string, confidence double, problem_class string, b string, a long"), ["b", "a"])
    S.log_decisions(log, f"{tmp_path}/log")
    S.log_decisions(log, f"{tmp_path}/log")
    rows = spark.read.parquet(f"{tmp_path}/log").collect()
    assert len(rows) == 2 and rows[0]["evidence"] == '{"a":2,"b":"z"}'
    S.log_decisions(log, f"{tmp_path}/log", keep=False)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 1


def test_stream_decides_each_event_once(spark, tmp_path):
    from matchloom.streaming.intake import read_events, resolve_stream

    schema = "event_id string, received_at timestamp, x int"
    for k in range(2):
        spark.createDataFrame([("a", 1), ("b", 2 + k)], "event_id string, x int").withColumn("received_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).select("event_id", "received_at", "x").write.mode("append").parquet(f"{tmp_path}/in")
    q = resolve_stream(read_events(spark, f"{tmp_path}/in", schema), lambda b: b.select("event_id"), f"{tmp_path}/out", f"{tmp_path}/ck", available_now=True)
    q.awaitTermination(120)
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_inspection(spark):
    picked = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "query_id long, cand_id long")
    gold = spark.createDataFrame([(1, 10), (1, 11), (2, 21)], "left_id long, right_id long")
    names = spark.createDataFrame([(10, "a"), (11, "b"), (20, "c"), (21, "d")], "id long, name string")
    got = {r["query_id"]: (r["gold_name"], r["picked_name"], r["correct"]) for r in D.inspect(picked, gold, names).collect()}
    assert got == {1: ("a", "a", True), 2: ("d", "c", False), 3: ("—", None, False)}
    assert D.inspect(picked, gold, names, errors_only=True).count() == 2
