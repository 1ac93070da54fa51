from __future__ import annotations

import json
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import ingest
from larkspur.operators.embedding import build_embeddings, hashed_trigrams, load_embeddings, product_text
from larkspur.operators.integrity import verify_catalogue
from larkspur.plans import evaluation, reports
from larkspur.plans.search import Catalogue
from larkspur.sources.schema import PRODUCTS, product_view
from larkspur.streaming.query_log import search_stream

HEAD = "Product Name,Description,Brand,Category,Tags,Price,Image\n"
LINES = ["Alpha Mug,d,b,c,t,10.50,i", "  ALPHA   mug ,d,b,c,t,11,i", "Beta Pen,d,b,c,t,x,i", ",d,b,c,t,5,i", "existing item,d,b,c,t,7,i", '"Gamma Bag","a ""quoted"", text",b,c,"t,u",12.345,i', "Delta Cap,d,b,c,,9,i"]


@pytest.fixture()
def csv(tmp_path):
    path = tmp_path / "p.csv"
    path.write_text(HEAD + "\n".join(LINES) + "\n")
    return str(path)


def held(spark, path):
    spark.createDataFrame([(4, "Existing  item", "d", "b", "c", "t", Decimal("1"), "i")], PRODUCTS).write.parquet(path)


def test_ingest(spark, csv, tmp_path):
    place = str(tmp_path / "catalogue")
    held(spark, place)
    rows = {r.row_num: (r.status, r.reason) for r in ingest.classified(ingest.read_csv(spark, csv), spark.read.parquet(place)).collect()}
    assert {k: v[0] for k, v in rows.items()} == {2: "new", 3: "duplicate", 4: "invalid", 5: "invalid", 6: "existing", 7: "new", 8: "invalid"}
    assert rows[4][1] == "price is no number" and rows[5][1] == "missing: Product Name" and rows[8][1] == "missing: Tags"
    assert ingest.ingest_csv(spark, csv, place) == {"total": 7, "valid": 4, "new": 2, "duplicate": 1, "existing": 1, "invalid": 3}
    new = spark.read.parquet(place).where("id > 4").orderBy("id").collect()
    assert [(r.id, r.product_name, r.price) for r in new] == [(5, "Alpha Mug", Decimal("10.50")), (6, "Gamma Bag", Decimal("12.35"))] and new[1].description == 'a "quoted", text'
    assert ingest.ingest_csv(spark, csv, place)["new"] == 0 and spark.read.parquet(place).count() == 3


def test_many_files_and_bad_catalogues(spark, tmp_path, monkeypatch):
    """Files are numbered on from one to the next, ids without gaps; a folder without files is empty, one that is no catalogue raises."""
    monkeypatch.setattr(ingest, "BLOCK", 4)
    folder, place = tmp_path / "csv", tmp_path / "place"
    folder.mkdir()
    place.mkdir()
    for k in range(3):
        (folder / f"{k}.csv").write_text(HEAD + "".join(f'"Item {k}\n{i}",d,b,c,t,1.5,i\n' for i in range(5 + k)))
    rows = ingest.read_csv(spark, str(folder)).collect()
    assert sorted(r.row_num for r in rows) == list(range(2, 20))
    for k in range(3):
        own = [r.row_num for r in sorted(rows, key=lambda r: r.product_name) if r.product_name.startswith(f"Item {k}")]
        assert own == list(range(own[0], own[0] + 5 + k))
    assert ingest.ingest_csv(spark, str(folder), str(place))["new"] == 18
    assert sorted(r.id for r in spark.read.parquet(str(place)).collect()) == list(range(1, 19))
    spark.range(3).withColumnRenamed("id", "other").write.parquet(str(tmp_path / "odd"))
    with pytest.raises(ValueError, match="product_name"):
        ingest.ingest_csv(spark, str(folder), str(tmp_path / "odd"))


def test_headers_and_paths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Product Name,Brand\nx,y\n")
    with pytest.raises(ValueError, match="Description"):
        ingest.read_csv(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text(HEAD.replace("Brand", " Brand ") + LINES[0] + "\n")
    assert ingest.read_csv(spark, str(tmp_path / "b.csv")).first().brand == "b"
    assert ingest.resolve_path(spark, str(tmp_path / "none.csv"), str(tmp_path / "b.csv")).endswith("b.csv")
    with pytest.raises(FileNotFoundError):
        ingest.resolve_path(spark, str(tmp_path / "none.csv"))


def test_embeddings(spark, sf, tmp_path):
    products, path = product_view(spark, sf), str(tmp_path / "e")
    info = build_embeddings(products, hashed_trigrams(16), path)
    assert info["count"] == products.count() and json.loads(spark.read.text(f"{path}_info").first().value)["count"] == info["count"]
    rows = load_embeddings(spark, path, 16).collect()
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-5 for r in rows)
    for rows, dimension in (([], 2), ([(1, [1.0, 2.0]), (2, [1.0])], None), ([(1, [1.0, 2.0])], 3), ([(1, [1.0]), (1, [1.0])], 1)):
        spark.createDataFrame(rows, "id long, embedding array<float>").write.mode("overwrite").parquet(str(tmp_path / "bad"))
        with pytest.raises(ValueError):
            load_embeddings(spark, str(tmp_path / "bad"), dimension)
    text = spark.range(1).select(product_text(F.lit(" n "), F.lit(""), F.lit("b"), F.lit("c"), F.lit("t,u")).alias("x")).first().x
    assert text == "n | Brand: b | Category: c | Tags: t,u"


def test_integrity(spark, sf, tmp_path):
    products = product_view(spark, sf)
    path = str(tmp_path / "e")
    build_embeddings(products, hashed_trigrams(8), path)
    good = verify_catalogue(products, load_embeddings(spark, path))
    assert good["overall"] == "PASS" and len(good["checks"]) == 7
    shifted = load_embeddings(spark, path).withColumn("id", F.col("id") + 1)  # as many, but other ids
    assert [c["check"] for c in verify_catalogue(products, shifted)["checks"] if c["status"] == "FAIL"] == ["embeddings"]
    assert verify_catalogue(products.drop("image"))["overall"] == "FAIL"


def test_evaluation_and_reports(spark, sf, tmp_path):
    runs = spark.createDataFrame([("a", "Exact", float(x)) for x in range(57)] + [("b", "Fuzzy", 5.0)], "query string, type string, ms double")
    p = evaluation.latency_percentiles(runs.where("type = 'Exact'")).first()
    assert (p.p95_ms, p.p99_ms, p.n) == (float(sorted(range(57))[int(57 * 0.95)]), 56.0, 57)
    assert evaluation.latency_percentiles(runs, "type").where("type = 'Fuzzy'").first().p99_ms == 5.0
    assert evaluation.latency_rollup(runs, "type").where("type is null").first().n == 58
    s = evaluation.latency_summary(runs, "type").where("type = 'Exact'").first()
    assert (s.median_ms, s.min_ms, s.max_ms) == (28.0, 0.0, 56.0)
    catalogue = Catalogue(product_view(spark, sf))
    times, cases = evaluation.run_suite(spark, lambda q: catalogue.search(q, 5), {"Exact": ["economy"]}, runs=1, expect=lambda q, rows: bool(rows))
    assert times.count() == 1 and cases.first().status == "PASS"
    assert "| Exact | 1 | 1 | 0 | 100.00 |" in reports.quality_report(cases) and "## Percentiles" in reports.performance_report(runs) and "economy" in reports.edge_report(cases)
    reports.write_csv(cases, str(tmp_path / "c"))
    reports.write_json(spark, {"a": 1}, str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 1 and json.loads(spark.read.text(str(tmp_path / "j")).first().value) == {"a": 1}


def test_stream(spark, sf, tmp_path):
    spark.createDataFrame([(1, "economy"), (2, "cold widget")], "query_id long, q string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, q string").json(str(tmp_path / "in"))
    search_stream(stream, Catalogue(product_view(spark, sf)), str(tmp_path / "out"), str(tmp_path / "state"), limit=3, once=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in rows} == {1: 3, 2: 3}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
