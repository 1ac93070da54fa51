"""Registered queries over the driver's tables, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import scores
from larkspur.functions.trigram import similarity, strict_word_similarity
from larkspur.operators import ingest
from larkspur.operators.batch import Batch
from larkspur.operators.candidates import exact_candidates, fuzzy_candidates, partial_candidates, semantic_candidates, similarities, trigram_index, value_similarities
from larkspur.operators.embedding import embedded, hashed_trigrams, product_text, text_vectors
from larkspur.operators.integrity import alignment
from larkspur.operators.ranking import candidate_union
from larkspur.plans.evaluation import latency_percentiles, latency_summary, quality_breakdown, target_status, verdict
from larkspur.plans.search import Catalogue
from larkspur.sources.schema import embedding_view, product_view

Query = Callable[[SparkSession, str], DataFrame]
FIELDS = ("product_name", "brand", "category", "tags")

# ---- SQL ------------------------------------------------------------------------------------------------------------

PRODUCTS = """products AS (
  SELECT p_partkey AS id, p_name AS product_name, p_name || ' size ' || p_size || ' ' || lower(p_type) AS description, p_brand AS brand, p_type AS category,
         split_part(p_name, ' ', 1) || ',' || split_part(p_name, ' ', 2) || ',' || lower(p_type) AS tags, CAST(p_retailprice AS DECIMAL(10,2)) AS price,
         'images/part_' || p_partkey || '.jpg' AS image
  FROM part)"""


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words_sql(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')"


def word_grams_sql(c: str) -> str:
    return f"list_transform({words_sql(c)}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))"


def grams_sql(c: str) -> str:
    return f"list_distinct(flatten({word_grams_sql(c)}))"


def ratio_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0::DOUBLE ELSE ({both}::DOUBLE / (len({a}) + len({b}) - {both}))::FLOAT::DOUBLE END"


def strict_sql(g: str, w: str) -> str:
    """g: trigrams of the query; w: trigrams of the value by word."""
    inner = ratio_sql(g, f"list_distinct(flatten({w}[i:j]))")
    return f"coalesce(list_max(flatten(list_transform(range(1, len({w}) + 1), lambda i: list_transform(range(i, len({w}) + 1), lambda j: {inner})))), 0.0::DOUBLE)"


def best_sql(g: str, f: str) -> str:
    return f"greatest({strict_sql(g, f'{f}_w')}, {ratio_sql(g, f'{f}_g')})"


def tokens_sql(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(trim({c})), '\s+'), lambda t: t <> '')"


def tags_sql(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, ','), lambda t: lower(trim(t))), lambda t: t <> '')"


def exact_where(q: str) -> str:
    x = text(q.lower())
    return f"lower(product_name) = {x} OR lower(brand) = {x} OR lower(category) = {x} OR contains(lower(tags), {x})"


def partial_where(q: str) -> str:
    found = [f"contains(lower({f}), {text(t)})" for t in q.lower().split() if len(t) >= 2 for f in (*FIELDS, "description")]
    return " OR ".join(found) or "false"


def exact_sql(q: str) -> str:
    x, qs, ns = text(q.lower()), f"[{', '.join(map(text, q.lower().split()))}]", tokens_sql("product_name")
    sub = lambda a, b: f"len(list_filter({a}, lambda t: NOT list_contains({b}, t))) = 0"
    return f"""CASE WHEN lower(product_name) = {x} THEN 1.0 WHEN lower(brand) = {x} THEN 0.85 WHEN lower(category) = {x} THEN 0.75
      WHEN list_contains({tags_sql('tags')}, {x}) THEN 0.70 WHEN {sub(qs, ns)} AND {sub(ns, qs)} THEN 0.90 WHEN {sub(qs, ns)} THEN 0.80 ELSE 0.0 END::DOUBLE"""


def token_field_sql(q: str, words: str) -> str:
    def best(t: str) -> str:
        x, n = text(t), len(t)
        rules = [f"WHEN w = {x} THEN 1.0::DOUBLE"]
        if n >= 2:
            rules.append(f"WHEN starts_with(w, {x}) THEN 0.85::DOUBLE * greatest(0.70::DOUBLE, {n}::DOUBLE / length(w))")
        if n >= 3:
            rules.append(f"WHEN contains(w, {x}) THEN 0.50::DOUBLE * greatest(0.60::DOUBLE, {n}::DOUBLE / length(w))")
        return f"coalesce(list_max(list_transform({words}, lambda w: CASE {' '.join(rules)} ELSE 0.0::DOUBLE END)), 0.0::DOUBLE)"

    parts = [best(t) for t in q.lower().split()]
    return f"((0.0::DOUBLE + {' + '.join(parts)}) / {len(parts)})"


def partial_sql(q: str) -> str:
    parts = ((tokens_sql("product_name"), "0.50"), (tokens_sql("brand"), "0.25"), (tokens_sql("category"), "0.15"), (tags_sql("tags"), "0.10"))
    return "least(greatest(" + " + ".join(f"{token_field_sql(q, w)} * {x}::DOUBLE" for w, x in parts) + ", 0.0::DOUBLE), 1.0::DOUBLE)"


def gram_ctes(q: str) -> str:
    """g: a row of each distinct combination of values, with its trigrams; the query's trigrams are t0, t1, ... and f."""
    fields = ", ".join(f"{grams_sql(f)} AS {f}_g, {word_grams_sql(f)} AS {f}_w" for f in FIELDS)
    asked = ", ".join([*(f"{grams_sql(text(t))} AS t{i}" for i, t in enumerate(q.lower().split())), f"{grams_sql(text(q))} AS f"])
    return f"g AS (SELECT *, {fields} FROM (SELECT DISTINCT {', '.join(FIELDS)} FROM products)), asked AS (SELECT {asked})"


def fuzzy_ctes(q: str, limit: int = 50, least: float = 0.01, fallback: int | None = 200) -> str:
    """fuzzy: id, fuzzy_score, rung. Without a fallback, lower rungs are not limited."""
    cut = "" if fallback is None else f" ORDER BY id LIMIT {fallback}"
    ts = q.lower().split()
    long = [i for i, t in enumerate(ts) if len(t) >= 3]
    token = [f"({best_sql(f't{i}', 'product_name')} * 0.50::DOUBLE + {best_sql(f't{i}', 'brand')} * 0.20::DOUBLE + {best_sql(f't{i}', 'category')} * 0.15::DOUBLE + {strict_sql(f't{i}', 'tags_w')} * 0.15::DOUBLE) AS s{i}" for i in range(len(ts))]
    sims = [f"{ratio_sql(f't{i}', f'{f}_g')}" for i in long for f in ("product_name", "brand")]
    stricts = [strict_sql(f"t{i}", f"{f}_w") for i in long for f in ("product_name", "brand", "category")]
    n, total = len(ts), " + ".join(f"s{i}" for i in range(len(ts)))
    mean, cover = f"((0.0::DOUBLE + {total}) / {n})", f"(({' + '.join(f'CASE WHEN s{i} >= 0.15 THEN 1 ELSE 0 END' for i in range(n))})::DOUBLE / {n})"
    score = "s0 * 0.75::DOUBLE + whole * 0.25::DOUBLE" if n == 1 else f"{mean} * 0.60::DOUBLE + {mean} * {cover} * 0.25::DOUBLE + whole * 0.15::DOUBLE"
    at = lambda xs: f"greatest({', '.join(xs)}, -1.0::DOUBLE)" if xs else "-1.0::DOUBLE"
    return f"""{gram_ctes(q)},
      valued AS (SELECT {', '.join(FIELDS)}, {', '.join(token)}, {best_sql('f', 'product_name')} AS whole, {at(sims)} AS sim, {at(stricts)} AS strict FROM g, asked),
      scored AS (SELECT p.id, v.sim, v.strict, {score} AS fuzzy_score FROM products p JOIN valued v USING ({', '.join(FIELDS)})),
      rungs AS (SELECT id, fuzzy_score, 1 AS rung FROM scored WHERE sim >= 0.3
        UNION ALL SELECT * FROM (SELECT id, fuzzy_score, 2 FROM scored WHERE sim >= 0.1{cut})
        UNION ALL SELECT * FROM (SELECT id, fuzzy_score, 3 FROM scored WHERE strict >= 0.35{cut})),
      over AS (SELECT * FROM rungs WHERE fuzzy_score >= {least}),
      fuzzy AS (SELECT id, fuzzy_score, rung FROM over WHERE rung = (SELECT min(rung) FROM over) ORDER BY fuzzy_score DESC, id LIMIT {limit})"""


def similar_cte(vec_id: int) -> str:
    return f"""asked_vector AS (SELECT list_transform(embedding, lambda x: x::DOUBLE / n) AS q FROM (SELECT embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE vec_id = {vec_id})),
      similar_to AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) AS semantic_score FROM embeddings, asked_vector)"""


def union_ctes(q: str, vec_id: int) -> str:
    return f"""{fuzzy_ctes(q)}, {similar_cte(vec_id)},
      candidates AS (SELECT id, max(fuzzy_score) AS fuzzy_score FROM (
        SELECT * FROM (SELECT id, 0.0::DOUBLE AS fuzzy_score FROM products WHERE {exact_where(q)} ORDER BY id LIMIT 50)
        UNION ALL SELECT * FROM (SELECT id, 0.0::DOUBLE FROM products WHERE {partial_where(q)} ORDER BY id LIMIT 50)
        UNION ALL SELECT id, fuzzy_score FROM fuzzy
        UNION ALL SELECT * FROM (SELECT id, 0.0::DOUBLE FROM similar_to ORDER BY semantic_score DESC, id LIMIT 50)) GROUP BY id)"""


def hybrid_sql(q: str, vec_id: int, limit: int, columns: str = "id, product_name, brand, category, exact_score, partial_score, fuzzy_score, semantic_score, final_score") -> str:
    return f"""WITH {PRODUCTS}, {union_ctes(q, vec_id)},
      four AS (SELECT p.*, {exact_sql(q)} AS exact_score, {partial_sql(q)} AS partial_score, least(greatest(c.fuzzy_score, 0.0), 1.0) AS fuzzy_score,
                      least(greatest(coalesce(s.semantic_score, 0.0), 0.0), 1.0) AS semantic_score
               FROM candidates c JOIN products p USING (id) LEFT JOIN similar_to s USING (id)),
      five AS (SELECT *, 0.20::DOUBLE * exact_score + 0.15::DOUBLE * partial_score + 0.30::DOUBLE * fuzzy_score + 0.35::DOUBLE * semantic_score AS final_score FROM four)
      SELECT {columns} FROM five WHERE final_score >= CASE WHEN exact_score > 0 OR partial_score > 0 OR fuzzy_score >= 0.30 THEN 0.10::DOUBLE ELSE 0.15::DOUBLE END
      ORDER BY final_score DESC, semantic_score DESC, fuzzy_score DESC, id LIMIT {limit}"""


#: Texts and their vectors of eight hashed trigram counts, worked out apart from Spark.
EMBEDDED = (
    ("Nike Running Shoes", [0.27735, 0.5547, 0.0, -0.27735, 0.27735, 0.27735, 0.27735, 0.5547]),
    ("café 42", [0.0, 0.40825, 0.8165, 0.0, 0.0, 0.0, 0.0, -0.40825]),
    ("!!", [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]),
    ("aaaa", [0.0, 0.0, 0.37796, 0.37796, 0.0, 0.75593, -0.37796, 0.0]),
)

# ---- queries ----------------------------------------------------------------------------------------------------------

SHOWN = ("id", "product_name", "brand", "category", "exact_score", "partial_score", "fuzzy_score", "semantic_score", "final_score")
#: Query and the vec_id whose vector stands for it.
MANY = (("brand#13", 7), ("economy", 11), ("cold widget", 3), ("widget cold", 3), ("smal widgt", 5), ("idge", 9), ("ecnomy", 2), ("zzzqqq999", 1))


def with_vectors(spark: SparkSession, sf_dir: str, asked: tuple[tuple[str, int], ...]) -> DataFrame:
    """query_id, q and vector: queries by example."""
    queries = spark.createDataFrame([(i, q, v) for i, (q, v) in enumerate(asked)], "query_id long, q string, id long")
    return queries.join(embedding_view(spark, sf_dir), "id").select("query_id", "q", F.col("embedding").cast("array<double>").alias("vector"))


def by_example(spark: SparkSession, sf_dir: str, q: str, vec_id: int) -> Batch:
    vector = embedding_view(spark, sf_dir).where(F.col("id") == vec_id).first()["embedding"]
    return Batch.one(spark, q, vector)


def hybrid(q: str, vec_id: int, limit: int = 10) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalogue = Catalogue(product_view(spark, sf_dir), embedding_view(spark, sf_dir))
        vector = embedding_view(spark, sf_dir).where(F.col("id") == vec_id).first()["embedding"]
        return catalogue.search(q, limit, vector=vector).select(*SHOWN)

    return run


def source(find: Callable[[DataFrame, Batch], DataFrame], q: str, *columns: str) -> Query:
    return lambda spark, sf_dir: find(product_view(spark, sf_dir), Batch.one(spark, q)).select("id", *columns)


def scored(name: str, score: Callable[..., object], q: str) -> Query:
    return lambda spark, sf_dir: product_view(spark, sf_dir).select("id", score(F.lit(q), *(F.col(f) for f in FIELDS)).alias(name))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_view(spark, sf_dir).select("product_name").distinct()


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as rows of a CSV: names repeat, some prices are no numbers and some brands are empty."""
    rows = product_view(spark, sf_dir)
    price = F.when(F.col("id") % 17 == 0, "x").otherwise(F.col("price").cast("string"))
    return rows.select((F.col("id") + 2).alias("row_num"), F.concat(F.lit("  "), F.upper("product_name"), F.lit(" ")).alias("product_name"), "description", F.when(F.col("id") % 13 == 0, " ").otherwise(F.col("brand")).alias("brand"), "category", "tags", price.alias("price"), "image")


def held_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the catalogue is said to hold."""
    return product_view(spark, sf_dir).where(F.col("product_name") < "n").select("product_name")


CLASSIFIED = f"""{PRODUCTS}, raw AS (SELECT id + 2 AS row_num, lower(product_name) AS name_key, CASE WHEN id % 13 = 0 THEN '' ELSE brand END AS brand, CASE WHEN id % 17 = 0 THEN NULL ELSE price END AS price FROM products),
  valid AS (SELECT *, brand <> '' AND price IS NOT NULL AS ok FROM raw),
  known AS (SELECT DISTINCT lower(product_name) AS name_key FROM products WHERE product_name < 'n'),
  classified AS (SELECT row_num, name_key, CASE WHEN NOT ok THEN 'invalid' WHEN row_number() OVER (PARTITION BY name_key, ok ORDER BY row_num) > 1 THEN 'duplicate'
                        WHEN name_key IN (SELECT name_key FROM known) THEN 'existing' ELSE 'new' END AS status FROM valid)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.classified(csv_rows(spark, sf_dir), held_names(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs: a value by type."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("type"), F.col("value").alias("ms"))


def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_candidates(embedding_view(spark, sf_dir), by_example(spark, sf_dir, "vector", 7), 20, 0.2).select("id", "semantic_score")


def embedder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(product_view(spark, sf_dir), hashed_trigrams(64)).select("id", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("length"))


def fixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of fixed texts, an element a row."""
    texts = spark.createDataFrame([(t,) for t, _ in EMBEDDED], "text string")
    return texts.select("text", F.posexplode(text_vectors(hashed_trigrams(8))(F.col("text"))).alias("at", "x")).select("text", "at", F.round(F.col("x").cast("double"), 5).alias("x"))


def response(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = Catalogue(product_view(spark, sf_dir), embedding_view(spark, sf_dir))
    vector = embedding_view(spark, sf_dir).where("id = 3").first()["embedding"]
    return catalogue.response("cold widget", 5, vector).select("query", "count", F.explode("results").alias("r")).select("query", "count", "r.id", "r.product_name", "r.price", "r.final_score")


def many(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = Catalogue(product_view(spark, sf_dir), embedding_view(spark, sf_dir))
    return catalogue.search_many(with_vectors(spark, sf_dir, MANY), 10).select("query_id", "id", *SHOWN[4:])


QUERIES: dict[str, Query] = {
    "scan_products": lambda s, d: product_view(s, d).select("id", "product_name", "brand", "category", F.col("price").cast("double").alias("price"), "image"),
    "exact_candidates_brand": source(exact_candidates, "Brand#13"),
    "exact_candidates_category": source(exact_candidates, "economy"),
    "exact_candidates_name": source(exact_candidates, "cold widget"),
    "exact_candidates_tag": source(exact_candidates, "widget"),
    "partial_candidates_single": source(partial_candidates, "idge"),
    "partial_candidates_multi": source(partial_candidates, "wid x economy"),
    "exact_score": scored("exact_score", scores.exact_score, "widget cold"),
    "partial_score": scored("partial_score", scores.partial_score, "wid idge bran"),
    "trigram_explode": lambda s, d: trigram_index(product_view(s, d)).groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n_values")),
    "trigram_similarity": lambda s, d: names(s, d).select("product_name", similarity(F.lit("smal widgt"), F.col("product_name")).alias("sim")),
    "strict_word_similarity": lambda s, d: names(s, d).select("product_name", strict_word_similarity(F.lit("widgt"), F.col("product_name")).alias("strict")),
    "trigram_index_join": lambda s, d: value_similarities(trigram_index(product_view(s, d), ("product_name", "brand")), s.createDataFrame([("smal",), ("widgt",), ("brand#13",)], "text string")).select("field", "value", "text", "sim", "strict"),
    "fuzzy_rung1": source(partial(fuzzy_candidates, fallback=None), "smal widgt", "fuzzy_score", "rung"),
    "fuzzy_rung2": source(fuzzy_candidates, "plte", "fuzzy_score", "rung"),
    "fuzzy_rung3": source(fuzzy_candidates, "ecnomy", "fuzzy_score", "rung"),
    "fuzzy_none": source(fuzzy_candidates, "zzzqqq999", "fuzzy_score", "rung"),
    "semantic_topk": lambda s, d: semantic_candidates(embedding_view(s, d), by_example(s, d, "vector", 7), 20).select("id", "semantic_score"),
    "semantic_threshold": threshold,
    "semantic_left_default": lambda s, d: product_view(s, d).select("id").join(similarities(embedding_view(s, d), by_example(s, d, "vector", 7)), "id", "left").select("id", scores.clamp(F.coalesce("semantic_score", F.lit(0.0))).alias("semantic_score")),
    "candidate_union": lambda s, d: candidate_union(product_view(s, d), embedding_view(s, d), by_example(s, d, "smal widgt", 5)).select("id", "fuzzy_score"),
    "hybrid_search": hybrid("cold widget", 3),
    "hybrid_typo": hybrid("smal widgt", 5, 20),
    "hybrid_short": hybrid("pl", 4),
    "hybrid_semantic_only": hybrid("zzzqqq999", 1),
    "hybrid_no_result": lambda s, d: Catalogue(product_view(s, d), embedding_view(s, d)).search("zzzqqq999", 10).select(*SHOWN),
    "search_many": many,
    "ingest_dedupe": lambda s, d: classified(s, d).select("row_num", "name_key", "status"),
    "ingest_existing_antijoin": lambda s, d: classified(s, d).where("status = 'new'").select("name_key"),
    "ingest_report": lambda s, d: ingest.report(classified(s, d)),
    "embedding_text": lambda s, d: product_view(s, d).select("id", product_text(*(F.col(c) for c in ("product_name", "description", "brand", "category", "tags"))).alias("text")),
    "verify_alignment": lambda s, d: alignment(product_view(s, d), embedding_view(s, d)),
    "latency_summary": lambda s, d: latency_summary(runs(s, d), "type").select("type", "n", "min_ms", "median_ms", "max_ms", verdict(F.col("median_ms")).alias("verdict"), target_status(F.lit("Exact"), F.col("median_ms")).alias("status")),
    "latency_percentiles": lambda s, d: latency_percentiles(runs(s, d), "type"),
    "quality_breakdown": lambda s, d: quality_breakdown(runs(s, d).select("type", F.when(F.col("ms") < 50, "PASS").otherwise("FAIL").alias("status"))),
    "response_envelope": response,
    "embedder_fixed_texts": fixed_texts,
    "text_embedder": embedder_rows,
}


def latency_sql(body: str) -> str:
    return f"WITH runs AS (SELECT event_type AS type, value AS ms FROM events) {body}"


ORACLE_SQL: dict[str, str] = {
    "scan_products": f"WITH {PRODUCTS} SELECT id, product_name, brand, category, price::DOUBLE AS price, image FROM products",
    **{f"exact_candidates_{k}": f"WITH {PRODUCTS} SELECT id FROM products WHERE {exact_where(q)} ORDER BY id LIMIT 50" for k, q in (("brand", "Brand#13"), ("category", "economy"), ("name", "cold widget"), ("tag", "widget"))},
    **{f"partial_candidates_{k}": f"WITH {PRODUCTS} SELECT id FROM products WHERE {partial_where(q)} ORDER BY id LIMIT 50" for k, q in (("single", "idge"), ("multi", "wid x economy"))},
    "exact_score": f"WITH {PRODUCTS} SELECT id, {exact_sql('widget cold')} AS exact_score FROM products",
    "partial_score": f"WITH {PRODUCTS} SELECT id, {partial_sql('wid idge bran')} AS partial_score FROM products",
    "trigram_explode": f"WITH {PRODUCTS}, v AS (" + " UNION ".join(f"SELECT '{f}' AS field, {f} AS value FROM products" for f in FIELDS) + f") SELECT field, gram, count(*) AS n_values FROM (SELECT field, unnest({grams_sql('value')}) AS gram FROM v) GROUP BY field, gram",
    "trigram_similarity": f"WITH {PRODUCTS}, n AS (SELECT DISTINCT product_name, {grams_sql('product_name')} AS g, {grams_sql(text('smal widgt'))} AS q FROM products) SELECT product_name, {ratio_sql('q', 'g')} AS sim FROM n",
    "strict_word_similarity": f"WITH {PRODUCTS}, n AS (SELECT DISTINCT product_name, {word_grams_sql('product_name')} AS w, {grams_sql(text('widgt'))} AS q FROM products) SELECT product_name, {strict_sql('q', 'w')} AS strict FROM n",
    "trigram_index_join": f"WITH {PRODUCTS}, v AS (SELECT 'product_name' AS field, product_name AS value FROM products UNION SELECT 'brand', brand FROM products), t AS (SELECT unnest(['smal', 'widgt', 'brand#13']) AS text), "
    + f"g AS (SELECT *, {grams_sql('value')} AS a, {word_grams_sql('value')} AS w, {grams_sql('text')} AS b FROM v, t) SELECT field, value, text, {ratio_sql('b', 'a')} AS sim, {strict_sql('b', 'w')} AS strict FROM g WHERE len(list_intersect(a, b)) > 0",
    **{k: f"WITH {PRODUCTS}, {fuzzy_ctes(q, fallback=None if k == 'fuzzy_rung1' else 200)} SELECT id, fuzzy_score, rung FROM fuzzy" for k, q in (("fuzzy_rung1", "smal widgt"), ("fuzzy_rung2", "plte"), ("fuzzy_rung3", "ecnomy"), ("fuzzy_none", "zzzqqq999"))},
    "semantic_topk": f"WITH {similar_cte(7)} SELECT id, semantic_score FROM similar_to ORDER BY semantic_score DESC, id LIMIT 20",
    "semantic_threshold": f"WITH {similar_cte(7)} SELECT id, semantic_score FROM similar_to WHERE semantic_score >= 0.2 ORDER BY semantic_score DESC, id LIMIT 20",
    "semantic_left_default": f"WITH {PRODUCTS}, {similar_cte(7)} SELECT id, least(greatest(coalesce(semantic_score, 0.0), 0.0), 1.0) AS semantic_score FROM products LEFT JOIN similar_to USING (id)",
    "candidate_union": f"WITH {PRODUCTS}, {union_ctes('smal widgt', 5)} SELECT id, fuzzy_score FROM candidates",
    "hybrid_search": hybrid_sql("cold widget", 3, 10),
    "hybrid_typo": hybrid_sql("smal widgt", 5, 20),
    "hybrid_short": hybrid_sql("pl", 4, 10),
    "hybrid_semantic_only": hybrid_sql("zzzqqq999", 1, 10),
    "hybrid_no_result": hybrid_sql("zzzqqq999", -1, 10),
    "search_many": " UNION ALL ".join(f"SELECT {i}::BIGINT AS query_id, * FROM ({hybrid_sql(q, v, 10, 'id, exact_score, partial_score, fuzzy_score, semantic_score, final_score')})" for i, (q, v) in enumerate(MANY)),
    "ingest_dedupe": f"WITH {CLASSIFIED} SELECT row_num, name_key, status FROM classified",
    "ingest_existing_antijoin": f"WITH {CLASSIFIED} SELECT name_key FROM classified WHERE status = 'new'",
    "ingest_report": f"WITH {CLASSIFIED} SELECT count(*) AS total, count_if(status <> 'invalid')::BIGINT AS valid, count_if(status = 'new')::BIGINT AS new, count_if(status = 'duplicate')::BIGINT AS duplicate, count_if(status = 'existing')::BIGINT AS existing, count_if(status = 'invalid')::BIGINT AS invalid FROM classified",
    "embedding_text": f"WITH {PRODUCTS} SELECT id, product_name || ' | Brand: ' || brand || ' | Category: ' || category || ' | Tags: ' || tags || ' | ' || description AS text FROM products",
    "verify_alignment": f"WITH {PRODUCTS} SELECT count(p.id) AS n_products, count(e.vec_id) AS n_embeddings, count_if(e.vec_id IS NULL)::BIGINT AS without_vector, count_if(p.id IS NULL)::BIGINT AS without_product FROM products p FULL JOIN embeddings e ON p.id = e.vec_id",
    "latency_summary": latency_sql("SELECT type, count(*) AS n, min(ms) AS min_ms, quantile_cont(ms, 0.5) AS median_ms, max(ms) AS max_ms, CASE WHEN quantile_cont(ms, 0.5) < 100 THEN 'Excellent' WHEN quantile_cont(ms, 0.5) < 500 THEN 'Good' WHEN quantile_cont(ms, 0.5) < 1000 THEN 'Acceptable' ELSE 'Slow' END AS verdict, CASE WHEN quantile_cont(ms, 0.5) <= 200 THEN 'PASS' ELSE 'FAIL' END AS status FROM runs GROUP BY type"),
    "latency_percentiles": latency_sql("SELECT type, count(*) AS n, list_sort(list(ms))[least(floor(count(*) * 0.95)::BIGINT, count(*) - 1) + 1] AS p95_ms, list_sort(list(ms))[least(floor(count(*) * 0.99)::BIGINT, count(*) - 1) + 1] AS p99_ms FROM runs GROUP BY type"),
    "quality_breakdown": latency_sql("SELECT type, count(*) AS total, count_if(ms < 50)::BIGINT AS passed, (count(*) - count_if(ms < 50))::BIGINT AS failed, 100.0::DOUBLE * count_if(ms < 50) / count(*) AS pass_rate FROM runs GROUP BY type"),
    "response_envelope": f"SELECT 'cold widget' AS query, count(*) OVER () AS count, id, product_name, price::DOUBLE AS price, round(final_score, 4) AS final_score FROM ({hybrid_sql('cold widget', 3, 5, 'id, product_name, price, final_score')})",
    "embedder_fixed_texts": " UNION ALL ".join(f"SELECT {text(t)} AS text, unnest(range(0, 8))::INT AS at, unnest({x}::DOUBLE[]) AS x" for t, x in EMBEDDED),
    "text_embedder": f"WITH {PRODUCTS} SELECT id, 64 AS dimension, 1.0::DOUBLE AS length FROM products",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
