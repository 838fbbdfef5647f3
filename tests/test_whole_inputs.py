"""Queries that must read all of their input, against rows made of the whole tables."""

from quarry.plans import catalog, formats
from tests.compare import rows_of, rows_of_sql


def test_glyph_records_hold_the_whole_text(spark, duck, sf):
    whole = """SELECT doc_id, 'TERMINATOR' AS status, length(text)::INTEGER AS n_glyphs, list_sum(list_transform(string_split(text, ''), lambda x: unicode(x)))::BIGINT AS code_sum, (length(text) + 3)::INTEGER AS records FROM documents"""
    assert rows_of(catalog.QUERIES["glyph_records"](spark, sf)) == rows_of_sql(duck, whole)


def test_glyph_records_have_no_limit(spark, tmp_path):
    spark.createDataFrame([(1, "ab" * 70_000), (2, ""), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["status"], r["n_glyphs"], r["code_sum"], r["records"]) for r in catalog.QUERIES["glyph_records"](spark, str(tmp_path)).collect()}
    assert got[1] == ("TERMINATOR", 140_000, 70_000 * (97 + 98), 140_003) and got[2][:2] == ("TERMINATOR", 0) and got[3][0] is None


def test_glyph_records_hold_whole_code_points(spark, duck, tmp_path):
    texts = ["", "\U0001f600", "a\U0001f600b\U0010ffff", "a\0c", "\ufffe\uffff\ufeff", "日本\n" * 300, "x" * 70_000 + "\U00020000"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sql = catalog.ORACLE["glyph_records"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows_of(catalog.QUERIES["glyph_records"](spark, str(tmp_path))) == rows_of_sql(duck, sql)


def test_union_conflicts_of_all_orders_and_customers(spark, duck, sf):
    whole = """
WITH k AS (SELECT o_custkey AS k, o_orderstatus AS v FROM orders UNION ALL SELECT o_custkey, o_orderstatus FROM orders UNION ALL SELECT c_custkey, 'O' FROM customer)
SELECT k, count(DISTINCT v)::BIGINT AS n_values FROM k GROUP BY k HAVING count(DISTINCT v) > 1"""
    assert rows_of(catalog.QUERIES["oracle_union_conflicts"](spark, sf)) == rows_of_sql(duck, whole)


def test_one_byte_mutations_of_every_text(spark, duck, sf, tmp_path):
    whole = "SELECT doc_id, (doc_id % octet_length(encode(text)))::INTEGER AS changed_at, 1 AS n_changed FROM documents WHERE text <> ''"
    assert rows_of(catalog.QUERIES["one_byte_mutations"](spark, sf)) == rows_of_sql(duck, whole)
    texts = [(5, "\x01\x01\x01"), (41, "äöü" * 20), (7, "x"), (8, ""), (9, None), (1_999, "日本\n" * 300)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["changed_at"], r["n_changed"]) for r in catalog.QUERIES["one_byte_mutations"](spark, str(tmp_path)).collect()}
    assert got == {d: (d % len(t.encode()), 1) for d, t in texts if t}


def test_good_and_damaged_containers_in_one_input(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = {}
    for r in formats.damaged_containers(docs).collect():
        found.setdefault(int(r["source"]), []).append((r["page_number"], r["fault_kind"]))
    want = {r["doc_id"]: [(0, "truncated")] if r["doc_id"] % 10 == 3 else [(i + 1, None) for i in range(len(r["text"].split("\n")))] for r in docs.collect()}
    assert {d: sorted(f) for d, f in found.items()} == want
    # A container outside the damaged tenth that breaks the reader's limit of pages is reported too.
    spark.createDataFrame([(2, "\n" * 100_001), (3, "a"), (4, "a\nb")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["fault_kind"] for r in catalog.QUERIES["container_rejects"](spark, str(tmp_path)).collect()}
    assert got == {2: "limit", 3: "truncated"}


def test_backlinks_of_long_conversations(spark, tmp_path):
    spark.createDataFrame([(c, t) for c in (1, 2) for t in range(20)], "conv_id long, turn long").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["node"]: r["status"] for r in catalog.QUERIES["sibling_backlinks"](spark, str(tmp_path)).collect()}
    assert got == {c * 1000 + t: "FAIL" if (c + t + 1) % 7 == 0 and t < 19 else "PASS" for c in (1, 2) for t in range(20)}


def test_large_values_come_to_python_in_small_batches(spark, tmp_path):
    """Containers and texts are bounded by bytes in a batch, not by rows alone."""
    from quarry.plans import formats, inspections, scale

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for name, found in {"container_pages_by_range": scale, "run_container_compare": inspections, "codec_round_trip": formats, "container_pages": formats}.items():
        spark.conf.set(key, str(1 << 30))
        try:
            found.QUERIES[name](spark, "/root/testdata/sf0.001")
            assert int(spark.conf.get(key).rstrip("b")) <= 4 << 20, name
        finally:
            spark.conf.set(key, before)
