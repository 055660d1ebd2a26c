"""Graph operators on hand-made rows: dedup ties, inversion, caps, test set,
matches, dangling references, lookups, sampling."""

from pyspark.sql import functions as F

from citegraph.operators import graph as G
from citegraph.operators.sampling import dense_index, random_docs


def docs_df(spark):
    return spark.createDataFrame(
        [(1, 10, "Paper A", "u1", 50), (2, 10, "Paper A!", "u2", 70), (3, 10, "paper a", "u3", 70), (4, 20, "Paper B", "u4", 5)],
        "doc_id long, id long, title string, url string, doc_len long",
    )


def edges_df(spark):
    return spark.createDataFrame(
        [(4, 0, "Paper A", 10, [["A", "B."]]), (4, 1, "Nowhere", 99, [["C", "D."]]), (1, 0, "Paper B", 20, [["E", "F."]]),
         (2, 0, "Paper B", 20, [["E", "F."]])],
        "citing_id long, pos int, cited_title string, cited_id long, authors array<array<string>>",
    )


def test_dedup_keeps_longest_then_larger_tie(spark):
    d = {r.id: (r.doc_id, r.n_merged) for r in G.dedup_documents(docs_df(spark)).collect()}
    assert d == {10: (3, 3), 20: (4, 1)}


def test_invert_left_outer(spark):
    inv = G.invert_citations(G.dedup_documents(docs_df(spark)), edges_df(spark))
    # the citation of key 99 has no document and is dropped
    assert {r.id: r.citations for r in inv.collect()} == {10: 1, 20: 2}


def test_incoming_chunks_hold_every_citation(spark):
    ded = G.dedup_documents(docs_df(spark))
    whole = {(r.id, r.chunk, r.n_chunks): [(x.citing_id, x.pos) for x in r.incoming] for r in G.incoming_chunks(ded, edges_df(spark)).collect()}
    assert whole == {(10, 0, 1): [(4, 0)], (20, 0, 1): [(1, 0), (2, 0)]}
    parts = G.incoming_chunks(ded, edges_df(spark), chunk_size=1).where("id = 20").collect()
    assert {r.n_chunks for r in parts} == {2} and sorted(x.citing_id for r in parts for x in r.incoming) == [1, 2]


def test_wide_documents_merge_like_narrow_ones(spark):
    narrow = {r.id: (r.doc_id, r.n_merged) for r in G.dedup_documents(docs_df(spark)).collect()}
    wide = G.dedup_documents(docs_df(spark).withColumn("text", F.lit("x"))).collect()
    assert {r.id: (r.doc_id, r.n_merged) for r in wide} == narrow


def test_repeated_captures_leave_one_document(spark):
    """Captures of one page share its id: other titles, other texts of equal length, and equal rows."""
    rows = [(1, 10, "One", "u", 50, "aaa"), (1, 10, "Two", "u", 50, "bbb"), (2, 10, "Old", "v", 9, "c"), (3, 20, "Same", "w", 5, "x"), (3, 20, "Same", "w", 5, "y"),
            (3, 20, "Same", "w", 5, "y"), (4, None, "No key", "z", 1, "q"), (None, 30, "No id", None, None, None), (None, 30, "No id", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, id long, title string, url string, doc_len long, text string")
    for parts in (1, 3):
        wide = {r.id: (r.doc_id, r.title, r.text, r.n_merged) for r in G.dedup_documents(df.repartition(parts)).collect()}
        assert wide.keys() == {10, 20, 30, None} and G.dedup_documents(df).count() == 4
        assert wide[10][::3] == (1, 3) and wide[20][::3] == (3, 3) and wide[20][2] in "xy" and wide[30][::3] == (None, 2)
        narrow = {r.id: (r.doc_id, r.n_merged) for r in G.dedup_documents(df.drop("text").repartition(parts)).collect()}
        assert narrow == {k: v[::3] for k, v in wide.items()}


def test_chunks_of_ids_with_a_common_step(spark):
    edges = spark.range(3000).select((F.col("id") * 3).alias("citing_id"), F.lit(0).alias("pos"), F.lit("T").alias("cited_title"), F.lit(7).cast("long").alias("cited_id"), F.lit(None).cast("array<array<string>>").alias("authors"))
    got = G.incoming_chunks(spark.createDataFrame([(7,)], "id long"), edges).collect()
    assert len(got) == 3 and sum(len(r.incoming) for r in got) == 3000 and max(len(r.incoming) for r in got) < 2000


def test_test_set_counts(spark):
    inv = G.invert_citations(G.dedup_documents(docs_df(spark)), edges_df(spark))
    got = {r.status: r.n for r in G.test_set_counts(inv, edges_df(spark), lo=2, hi=2).collect()}
    assert got == {"Too Few Citations": 1, "Selected": 1, "Missing Document": 1}


def test_incoming_sum_equals_resolvable_outgoing(spark):
    inv = G.invert_citations(G.dedup_documents(docs_df(spark)), edges_df(spark))
    total_in = inv.agg(F.sum("citations")).first()[0]
    resolvable = G.matches(edges_df(spark), docs_df(spark), distinct=False).count()
    assert total_in == resolvable == 3


def test_matches_and_dangling(spark):
    m = {(r.citing_id, r.cited_id) for r in G.matches(edges_df(spark), docs_df(spark)).collect()}
    assert m == {(4, 10), (1, 20), (2, 20)}
    d = [r.cited_title for r in G.dangling_references(edges_df(spark), docs_df(spark)).collect()]
    assert d == ["Nowhere"]


def test_test_set_bounds(spark):
    inv = spark.createDataFrame([(1, 19), (2, 20), (3, 100), (4, 101)], "id long, citations long")
    assert sorted(r.id for r in G.select_test_set(inv).collect()) == [2, 3]


def test_lookup_titles_last_loaded_wins(spark):
    keys = spark.createDataFrame([("Paper A",), ("Missing",)], "t string")
    docs = docs_df(spark).unionByName(spark.createDataFrame([(9, 10, "Paper A", "u9", 1)], docs_df(spark).schema))
    got = [(r.t, r.doc_id) for r in G.lookup_titles(keys, "t", docs).collect()]
    assert got == [("Paper A", 9)]


def test_top_matched_ties_by_key(spark):
    pairs = spark.createDataFrame([(5, 1), (5, 2), (3, 1), (3, 2), (7, 1)], "citing_id long, cited_id long")
    assert [r.citing_id for r in G.top_matched(pairs, k=2).collect()] == [3, 5]


def test_dense_index_is_dense_and_ordered(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "k").repartition(9)
    rows = dense_index(df, "k").orderBy("k").collect()
    assert [r.i for r in rows] == list(range(len(rows))) and rows[0].n == len(rows)


def test_random_docs_deterministic_and_in_range(spark):
    docs = spark.range(0, 300).withColumnRenamed("id", "d")
    a = random_docs(docs, "d", docs, "d", 50, seed=3)
    got = a.orderBy("d", "draw").collect()
    assert len(got) == 300 * 50 and all(0 <= r.sampled_d < 300 for r in got)
    again = random_docs(docs, "d", docs, "d", 50, seed=3).orderBy("d", "draw").collect()
    assert got == again
