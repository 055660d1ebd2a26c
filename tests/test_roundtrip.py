"""Property: titles rendered into bibliography lines in every style parse back
to the same titles, positions and author counts."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citegraph.operators.citations import extract_citations
from citegraph.plans.fixtures import TEMPLATES

WORD = st.text(alphabet="abcdefghijklmnopqrstuvwxyzéü0123456789,:;'-", min_size=1, max_size=8)
TITLE = st.builds(
    lambda first, rest: " ".join([first] + rest),
    st.text(alphabet="ABCDEFGHIJKLMNOPQRSTUVWXYZ", min_size=1, max_size=1).flatmap(
        lambda c: st.text(alphabet="abcdefghij", min_size=2, max_size=6).map(lambda t: c + t)),
    st.lists(WORD, min_size=1, max_size=8),
)
AUTHORS = {"acm": 2, "acm_comma": 3, "ieee": 2, "springer": 2}


@settings(max_examples=25, deadline=None)
@given(st.lists(TITLE, min_size=1, max_size=6), st.sampled_from(sorted(AUTHORS)))
def test_render_then_parse(spark_session_cached, titles, style):
    spark = spark_session_cached
    bib = "\n".join(TEMPLATES[style].format(t=t) for t in titles)
    df = spark.createDataFrame([(1, bib)], "doc_id long, text string")
    parse_style = "acm" if style.startswith("acm") else style
    got = extract_citations(df, "text", parse_style).orderBy("pos").collect()
    assert [(r.pos, r.cited_title, r.n_authors) for r in got] == [
        (i, t, AUTHORS[style]) for i, t in enumerate(titles)]
    best = extract_citations(df, "text", "best").orderBy("pos").collect()
    assert [r.cited_title for r in best] == titles
