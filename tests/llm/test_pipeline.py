import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from citegraph.llm import language_id as L
from citegraph.llm.queries import QUERIES, vocabulary
from tests.llm.test_decontaminate import brute as brute_contained
from tests.llm.test_mixing import brute_mix
from tests.llm.test_ngram_join import brute as brute_components

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in P.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_output"]
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def stages(spark):
    """The table after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10_000, None, "en", "src0", 0), (10_001, "12 !!", "en", "src0", 5), (None, "words of no document", "en", None, 20)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    out = [docs]
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def rows(df):
    return [(r.doc_id, r.source, r.text) for r in df.collect()]


def test_all_but_the_last_keep_the_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns


def test_language_id(stages):
    before, after = stages[0], stages[1]
    model = L.train(before)
    want = {r.doc_id for r in L.predict(before, model, ["doc_id"]).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert {r.doc_id for r in after.collect()} == want
    assert {10_000, 10_001}.isdisjoint(want) and len(want) >= before.count() - 5


def test_near_duplicates_share_80_percent_of_five_word_shingles(stages):
    before, after = rows(stages[1]), rows(stages[2])
    comps = brute_components([(d, t) for d, _, t in before], 5, 80)
    assert sorted((d for d, _, _ in after), key=str) == sorted((d for d, _, c in comps if d is None or d == c), key=str)


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows(stages[2]), rows(stages[3])
    bad = {d for d, _ in brute_contained([(d, t) for d, _, t in before], items)}
    assert bad and {d for d, _, _ in after} == {d for d, _, _ in before} - bad


def test_mixing(stages):
    want = brute_mix(rows(stages[3]), 0.97, 2.0, None)
    got = sorted((str(d), str(s)) for d, s, _ in rows(stages[4]))
    assert got == sorted((str(d), str(s)) for (d, s, _), n in want.items() for _ in range(n))


def test_token_output(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want, start = [], 0
    for d, _, text in sorted(rows(stages[4]), key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in stages[5].collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    mark = F.sum(F.xxhash64("doc_id", "start", "n_tokens", "ids_crc32").cast("decimal(38,0)"))
    assert P.run(spark, SF).agg(mark).first() == docs.agg(mark).first()


CLASHES = {c: "'mine'" for c in ("_rank", "Score", "LANG_PRED", "_epoch", "_block", "_tokens", "_text", "row", "id", "order", "node", "doc", "component_id", "key", "n", "name", "draw", "item_id")}


def test_clashing_columns(spark):
    """Columns with the stages' own names pass through all stages but the last unchanged, and change nothing else."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.where("doc_id = 3")).union(docs.where("doc_id = 3").withColumn("text", F.concat("text", F.lit(" and more"))))
    wide = docs.withColumns({c: F.expr(v) for c, v in CLASHES.items()})
    for _, stage in P.STAGES[:-1]:
        docs, wide = stage(spark, docs, SF), stage(spark, wide, SF)
        assert wide.columns == [*docs.columns, *CLASHES]
        assert wide.select([f"`{c}`" for c in CLASHES]).distinct().count() == 1
        # the row of a repeated id that stays is chosen by its text
        assert sorted(map(tuple, wide.select(docs.columns).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert P.STAGES[-1][1](spark, wide, SF).count() == docs.count()


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_empty_table(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert stage(spark, docs, SF).collect() == []


def test_ties(spark):
    """Rows of one id, and equal rows: every stage gives the same rows again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    docs = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long")).limit(5))
    for _, stage in P.STAGES[:-1]:
        one, two = (sorted(map(tuple, stage(spark, docs.repartition(n), SF).collect()), key=str) for n in (3, 7))
        assert one == two and one
        docs = spark.createDataFrame(one, docs.schema)
