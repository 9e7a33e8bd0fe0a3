"""Character n-gram TF-IDF, nearest neighbours, and candidate scoring of a stated query set against all rows, in blocks."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.functions import barcode as B
from matchloom.functions import text as T
from matchloom.functions.similarity import metaphone, metaphone_code, token_sort_ratio
from matchloom.operators import blocks as K

#: Weights of text, sound, vector and barcode in the production score; of text, sound and vector in the benchmark score.
STAGE_WEIGHTS = (0.20, 0.15, 0.35, 0.30)
BENCHMARK_WEIGHTS = (0.5, 0.2, 0.3)


def blob(brand: Column | str, name: Column | str) -> Column:
    return T.strip(F.lower(F.concat_ws(" ", F.when(T.strip(T.blank(brand)) != "", T.strip(T.blank(brand))), F.when(T.strip(T.blank(name)) != "", T.strip(T.blank(name))))))


def char_grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """All n-grams of each word between two spaces, where the padded word has n characters."""
    words = F.transform(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    of_size = lambda w, n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substr(w, i, n))
    return F.flatten(F.transform(words, lambda w: F.flatten(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(w))), lambda n: of_size(w, n)))))


def _counts(texts: DataFrame) -> DataFrame:
    grams = texts.select("text", F.explode(char_grams(F.col("text"))).alias("gram"))
    return grams.groupBy("text", "gram").agg(F.count("*").alias("n"))


class TfidfIndex:
    """Vectors of the distinct texts of a catalogue. Equal texts have one vector, so they are indexed once and ids are joined at the end."""

    def __init__(self, rows: DataFrame, key: str, text: Column):
        self.rows = rows.select(F.col(key).alias("key"), text.alias("text"))
        texts = self.rows.groupBy("text").agg(F.count("*").alias("copies"))
        total = self.rows.count()
        # Grouped by text, so the grams of a text are where it is and nothing is exchanged to count them.
        self._counts = texts.select("text", "copies", F.explode(char_grams(F.col("text"))).alias("gram")).groupBy("text", "gram").agg(F.count("*").alias("n"), F.max("copies").alias("copies"))
        # Document frequency is over rows, so a text counts as often as it stands.
        self.idf = self._counts.groupBy("gram").agg((F.log((1 + F.lit(total)) / (1 + F.sum("copies"))) + 1).alias("idf"))

    def _weights(self, counts: DataFrame) -> DataFrame:
        return counts.join(self.idf, "gram").select("text", "gram", ((1 + F.log("n")) * F.col("idf")).alias("w"))

    @property
    def postings(self) -> DataFrame:
        """(text, gram, weight) of all texts, each text's weights as a vector of length 1."""
        raw = self._weights(self._counts)
        norm = raw.groupBy("text").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return raw.join(norm, "text").select("text", "gram", (F.col("w") / F.col("norm")).alias("weight"))

    def vectors(self, texts: DataFrame | None = None) -> DataFrame:
        """(text, g, w): hashes of grams and their weights, for the indexed texts or others. Grams that the index lacks are dropped before a vector's length is taken."""
        counts = self._counts if texts is None else _counts(texts.select("text").distinct())
        grouped = self._weights(counts).groupBy("text").agg(F.collect_list(F.struct(F.xxhash64("gram").alias("g"), "w")).alias("v"))  # the grams of one text
        return grouped.select("text", F.col("v.g").alias("g"), F.col("v.w").alias("w"))

    def with_vectors(self, rows: DataFrame, text: str, own: bool) -> DataFrame:
        """rows with the vectors of a text column in its place; a text without grams has none. own: whether its texts are the indexed ones."""
        found = self.vectors(None if own else rows.select(F.col(text).alias("text"))).withColumnRenamed("text", text)
        return rows.join(found, text, "left").drop(text)


def top(scored: DataFrame, query: str, score: str, tie: str, k: int) -> DataFrame:
    """The best k of each query with rank from 1. Scores are compared to nine places, then by id, so that sums in another order rank alike."""
    order = W.partitionBy(query).orderBy(F.round(score, 9).desc(), F.col(tie).asc())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def tfidf_neighbours(index: TfidfIndex, queries: DataFrame, key: str, text: Column, k: int) -> DataFrame:
    """(query_id, candidate_id, similarity, rank): the k rows most similar to each query, ties and rows that share no gram with it by id.

    Of rows with equal texts the k least ids can count, so each distinct text is compared once."""
    first = index.rows.withColumn("_n", F.row_number().over(W.partitionBy("text").orderBy("key"))).filter(F.col("_n") <= k)
    texts = first.groupBy("text").agg(F.sort_array(F.collect_list(F.col("key").cast("long"))).alias("ids")).withColumn("least", F.col("ids")[0])  # k ids at most
    asked = queries.select(F.col(key).cast("long").alias("query_id"), text.alias("_text"))
    schema = "query_id long, candidate_id long, similarity double"

    def work(part, block):
        import numpy as np

        scores, least, out = K.sparse_products(part, block), part["least"].to_numpy(), []
        flat, n = K._lists(part, "ids")
        starts = np.cumsum(n) - n
        for j, query in enumerate(block["query_id"].to_pylist()):
            best = K.best_rows(scores[:, j], least, k)
            ids = np.concatenate([flat[starts[i] : starts[i] + n[i]] for i in best.tolist()])
            score = np.repeat(scores[best, j], n[best])
            kept = K.best_rows(score, ids, k)
            out.append((np.full(len(kept), query), ids[kept], score[kept]))
        return K.made(schema, [np.concatenate(c) for c in zip(*out)])

    rows = index.with_vectors(texts.withColumnRenamed("text", "_text"), "_text", True)
    found = K.against(rows, "least", index.with_vectors(asked, "_text", False), "query_id", work, schema)
    return top(found, "query_id", "similarity", "candidate_id", k)


def cosine_neighbours(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact cosine neighbours of a stated query set (vec_id, embedding) among all rows, by matrix products of blocks. A query isn't its own neighbour, vectors of other lengths are no
    neighbours, and one that is all zeros is at 0 to all. Rows without a vector are left out."""
    schema = "query_id long, candidate_id long, similarity double"
    given = lambda df, name: df.filter("embedding is not null").select(F.col("vec_id").cast("long").alias(name), F.col("embedding").alias(f"{name}_vector"))

    def work(part, block):
        import numpy as np

        def unit(table, column):
            flat, n = K._lists(table, column)
            flat, starts = flat.astype(np.float64), np.cumsum(n) - n
            for width in np.unique(n).tolist():
                at = np.flatnonzero(n == width)
                matrix = flat[starts[at][:, None] + np.arange(width)]
                norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
                yield width, at, matrix / np.where(norm > 0, norm, 1)

        ids, asked, out = part["id"].to_numpy(), block["query_id"].to_numpy(), []
        by_width = {width: (at, matrix) for width, at, matrix in unit(part, "id_vector")}
        for width, columns, wanted in unit(block, "query_id_vector"):
            if width not in by_width:
                continue
            at, matrix = by_width[width]
            scores = matrix @ wanted.T
            for c, j in enumerate(columns.tolist()):
                other = np.flatnonzero(ids[at] != asked[j])
                kept = other[K.best_rows(scores[other, c], ids[at][other], k)]
                out.append((np.full(len(kept), asked[j]), ids[at][kept], scores[kept, c]))
        return K.made(schema, [np.concatenate(c) for c in zip(*out)]) if out else None

    found = K.against(given(rows, "id"), "id", given(queries, "query_id"), "query_id", work, schema)
    return top(found, "query_id", "similarity", "candidate_id", k)


def _raw_text(brand: str, name: str) -> Column:
    return F.lower(F.concat(T.blank(brand), F.lit(" "), T.blank(name)))


#: Codes of a part and of a block: what a group costs follows its part, so blocks are large.
CODE_PART, CODE_BLOCK = 1 << 16, 1 << 12


def code_links(asked: DataFrame, codes: DataFrame) -> DataFrame:
    """(asked_code, code, barcode): which distinct codes have a barcode signal with which asked ones (asked_code, valid). A valid EAN-13 is like itself alone, any other code like those
    at two edits or less; empty codes are like none."""
    schema = "asked_code string, code string, barcode double"

    def work(part, block):
        import numpy as np

        known, wanted = part["code"].to_pylist(), block["asked_code"].to_pylist()
        i, j, distance = K.near_codes(known, wanted)
        signal = np.where(distance == 0, 1.0, np.maximum(0.0, 0.5 * (1 - distance / 3.0)))
        return K.made(schema, [[wanted[x] for x in j.tolist()], [known[x] for x in i.tolist()], signal])

    # Aggregates, so that filters on them aren't worked out once more below.
    filled = asked.groupBy("asked_code").agg(F.max("valid").alias("valid"), F.max(F.col("asked_code") != "").alias("_filled")).filter("_filled").drop("_filled")
    near = K.against(codes.groupBy("code").agg(F.max(F.col("code") != "").alias("_filled")).filter("_filled").select("code"), "code", filled.filter("not valid").select("asked_code"), "asked_code", work, schema, part_rows=CODE_PART, block_queries=CODE_BLOCK)
    return near.unionByName(filled.filter("valid").select("asked_code", F.col("asked_code").alias("code"), F.lit(1.0).alias("barcode")))


def rank_candidates(queries: DataFrame, catalog: DataFrame, k: int = 3, weights: tuple[float, float, float, float] = STAGE_WEIGHTS) -> DataFrame:
    """The best k catalogue rows of each query (query_id, brand, name, gtin) over the whole catalogue, with all four signals.

    All signals but the barcode's follow from brand and name, so rows that share them are one text with the k least ids, queries that share them are asked once, and parts of the texts
    meet blocks of those. There the cheap signals are taken for all; the edit similarity is bounded by what letters both texts have, and worked out in order of that bound until no row
    can reach the k-th best any more, so none that belongs in the result is lost. Rows whose code has a signal with a query's (code_links) come to the same groups one by one, and each
    query keeps the best k of them in each part. A row's score without a barcode signal is never above its real one, so the best of both kinds are the best of all."""
    w_text, w_sound, w_vector, w_code = weights
    index = TfidfIndex(catalog, "master_id", blob("brand", "product_name"))

    def common(name: str, key: str) -> tuple[Column, ...]:
        own = F.concat(F.length(T.blank("brand")).cast("string"), F.lit(" "), T.blank("brand"), F.lower(T.blank(name)))  # all that raw, brand and _text follow from
        return own.alias(key), _raw_text("brand", name).alias("raw"), T.blank("brand").alias("brand"), T.blank("gtin").alias("code"), blob("brand", name).alias("_text")

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), B.is_valid_ean13("gtin").alias("valid"), *common("name", "query_key"))
    rows = catalog.select(F.col("master_id").cast("long").alias("master_id"), *common("product_name", "row_key"))
    kinds = asked.select("query_key", "raw", "brand", "_text").distinct()
    least = rows.withColumn("_n", F.row_number().over(W.partitionBy("row_key").orderBy("master_id"))).filter(F.col("_n") <= k)
    texts = least.groupBy("row_key", "raw", "brand", "_text").agg(F.sort_array(F.collect_list("master_id")).alias("ids"))  # k ids at most
    links = code_links(asked.select(F.col("code").alias("asked_code"), "valid"), rows.select("code"))
    coded = asked.select("query_id", "query_key", F.col("code").alias("asked_code")).join(links, "asked_code")
    pairs = coded.join(rows.select("code", "row_key", "master_id"), "code").select("row_key", "query_key", "query_id", "master_id", "barcode")
    schema = "query_key string, tag string, master_id long, text double, phonetic double, vector double, barcode double"

    def work(part, block, pairs):
        import numpy as np

        vector = K.sparse_products(part, block)
        texts, wanted = K.Texts(part["raw"].to_pylist()), K.Texts(block["raw"].to_pylist())
        sounds: dict = {}
        sound = lambda brands: np.array([sounds.setdefault(metaphone(b), len(sounds)) if b else -1 for b in brands])
        own, other, out = sound(part["brand"].to_pylist()), sound(block["brand"].to_pylist()), []
        flat, n = K._lists(part, "ids")
        starts, flat = (np.cumsum(n) - n).tolist(), flat.tolist()
        place = {key: i for i, key in enumerate(part["row_key"].to_pylist())}
        coded: dict = {}  # of each text of queries, of each query: places, ids and barcode signals of the rows with one
        for key, query, row, master, barcode in zip(*(pairs[c].to_pylist() for c in ("query_key", "query_id", "row_key", "master_id", "barcode"))):
            coded.setdefault(key, {}).setdefault(query, []).append((place[row], master, barcode))
        for j, key in enumerate(block["query_key"].to_pylist()):
            phonetic = ((own == other[j]) & (own >= 0)).astype(float)
            bound = w_text * texts.bounds(wanted, j) + w_sound * phonetic + w_vector * vector[:, j]
            known: dict = {}

            def signals(i, master, barcode):
                text = known.get(i)
                if text is None:
                    text = known[i] = texts.similarity(i, wanted, j)
                combined = w_text * text + w_sound * phonetic[i] + w_vector * vector[i, j] + w_code * barcode
                return (-round(float(combined), 9), master, text, float(phonetic[i]), float(vector[i, j]), barcode)

            best: list[tuple] = []
            for i, most in K.descending(bound):
                if len(best) == k and most + 2e-9 < -best[-1][0]:
                    break
                for master in flat[starts[i] : starts[i] + int(n[i])]:
                    bisect.insort(best, signals(i, master, 0.0))
                del best[k:]
            out += [(key, "", *row[1:]) for row in best]
            reached = -best[-1][0] if len(best) == k else float("-inf")
            for query, given in coded.get(key, {}).items():
                mine: list[tuple] = []
                for x, most in K.descending(np.array([bound[i] + w_code * barcode for i, _, barcode in given])):
                    if most + 2e-9 < (max(reached, -mine[-1][0]) if len(mine) == k else reached):
                        break
                    bisect.insort(mine, signals(*given[x]))
                    del mine[k:]
                out += [(key, str(query), *row[1:]) for row in mine]
        return K.made(schema, list(zip(*out))) if out else None

    n_texts, n_kinds = rows.select("row_key").distinct().count(), kinds.count()
    found = K.against(index.with_vectors(texts, "_text", True), "row_key", index.with_vectors(kinds, "_text", False), "query_key", work, schema, pairs, (n_texts, n_kinds))
    # Rows without a barcode signal belong to all queries of the text, the others to the one that their tag names.
    of = asked.select("query_key", "query_id", F.explode(F.array(F.lit(""), F.col("query_id").cast("string"))).alias("tag"))
    scored = found.join(of, ["query_key", "tag"]).groupBy("query_id", "master_id", "text", "phonetic", "vector").agg(F.max("barcode").alias("barcode"))
    scored = scored.withColumn("combined", w_text * F.col("text") + w_sound * F.col("phonetic") + w_vector * F.col("vector") + w_code * F.col("barcode"))
    return top(scored, "query_id", "combined", "master_id", k).select("query_id", "rank", "master_id", "combined", "text", "phonetic", "vector", "barcode")


def blocked_signals(queries: DataFrame, catalog: DataFrame, block: int = 50) -> DataFrame:
    """(query_id, cand_id, pos, text, phonetic, vector): the block of TF-IDF neighbours of each query with its weight-free signals, to be kept for any weights."""
    index = TfidfIndex(catalog, "master_id", blob("brand", "product_name"))
    near = tfidf_neighbours(index, queries, "query_id", blob("brand", "name"), block)
    first = lambda b, n: F.get(F.split(T.strip(F.when(T.strip(T.blank(b)) != "", T.blank(b)).otherwise(T.blank(n))), r"(?U)\s+"), F.lit(0))
    q = queries.select("query_id", blob("brand", "name").alias("q_blob"), metaphone_code(first("brand", "name")).alias("q_code"))
    c = catalog.select(F.col("master_id").alias("candidate_id"), blob("brand", "product_name").alias("c_blob"), metaphone_code(first("brand", "product_name")).alias("c_code"))
    joined = near.join(q, "query_id").join(c, "candidate_id")
    sound = F.when((F.col("q_code") != "") & (F.col("q_code") == F.col("c_code")), F.lit(1.0)).otherwise(F.lit(0.0))
    return joined.select("query_id", F.col("candidate_id").alias("cand_id"), F.col("rank").alias("pos"), token_sort_ratio("q_blob", "c_blob").alias("text"), sound.alias("phonetic"), F.col("similarity").alias("vector"))


def normalized_weights(text: float, phonetic: float, vector: float) -> tuple[float, float, float]:
    total = text + phonetic + vector
    return (text / total, phonetic / total, vector / total) if total > 0 else (1.0, 0.0, 0.0)


def margins(ranked: DataFrame) -> DataFrame:
    """Each query's best candidate, its score and that of the next one, 0 where there is none."""
    by = F.max(F.when(F.col("rank") == 1, F.struct("master_id", "combined")))
    out = ranked.groupBy("query_id").agg(by.alias("best"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("combined"))), F.lit(0.0)).alias("runner_up_score"))
    return out.select("query_id", F.col("best.master_id").alias("top_id"), F.col("best.combined").alias("top_score"), "runner_up_score")


def signal_conflicts(queries: DataFrame, catalog: DataFrame, text_from: float = 0.85) -> DataFrame:
    """Queries whose valid EAN-13 belongs to one row while another fits the text better, at text_from or more. Of equal texts the largest id is taken.

    Texts meet queries in blocks; a text is compared only if the letters that both have allow text_from and the best one so far."""
    owners = catalog.groupBy("gtin").agg(F.min("master_id").alias("gtin_pick"))
    owned = queries.filter(B.is_valid_ean13("gtin")).join(owners, "gtin")
    # Equal texts are compared once: of each distinct catalogue text only the largest id can win.
    texts = catalog.groupBy(_raw_text("brand", "product_name").alias("raw")).agg(F.max("master_id").cast("long").alias("master_id"))
    asked = owned.select(F.col("query_id").cast("long").alias("query_id"), F.col("gtin_pick").cast("long").alias("gtin_pick"), _raw_text("brand", "name").alias("raw"))
    schema = "query_id long, gtin_pick long, text double, master_id long"

    def work(part, block):
        ids = part["master_id"].to_pylist()
        known, wanted, out = K.Texts(part["raw"].to_pylist()), K.Texts(block["raw"].to_pylist()), []
        for j, (query, owner) in enumerate(zip(block["query_id"].to_pylist(), block["gtin_pick"].to_pylist())):
            best = (text_from, float("-inf"))
            for i, most in K.descending(known.bounds(wanted, j)):
                if most < best[0]:
                    break
                best = max(best, (known.similarity(i, wanted, j), ids[i]))
            if best[1] != float("-inf"):
                out.append((query, owner, *best))
        return K.made(schema, list(zip(*out))) if out else None

    found = K.against(texts, "master_id", asked, "query_id", work, schema)
    best = found.groupBy("query_id", "gtin_pick").agg(F.max(F.struct("text", "master_id")).alias("b"))
    return best.filter(F.col("b.master_id") != F.col("gtin_pick")).select("query_id", F.col("b.master_id").alias("text_pick"), "gtin_pick", F.bround("b.text", 3).alias("text_score"))
