"""Named queries over the driver's tables: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each query reads the given tables (through the fixture views) and runs the
library operators over all of their rows.  Column names match the SQL in
``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citegraph.functions import constants as K
from citegraph.functions.text import extract_year, title_id, token_flags
from citegraph.operators import graph as G
from citegraph.operators.incremental import Inversion
from citegraph.operators.citations import extract_citations
from citegraph.operators import index as Q
from citegraph.operators import learn as L
from citegraph.operators import similarity as S
from citegraph.operators.topk import similar_all
from citegraph.operators.sampling import first_n, random_doc
from citegraph.operators.learners import Lengths, NaiveBayes, learn, training_texts
from citegraph.operators.layout import all_nodes, layout_nodes, with_layout, with_text_and_title
from citegraph.plans import fixtures as X
from citegraph.plans.pipeline import analyze_documents, extract, extract_counters, is_too_long, run_pipeline, title_status
from citegraph.session import cut_lineage, scratch_path, shuffles_removed
from citegraph.sources.archives import read_archives, write_archives
from citegraph.sources.captures import admit_captures, archive_states, ingest, read_captures, split_payload, write_captures
from citegraph.sources.files import PACKED, Stages, load_epochs, load_wanted_epochs, materialize, refresh_index, write_table
from citegraph.streaming import invert_stream

R6 = 6  # doubles are compared at 6 decimals


# ------------------------------------------------------------------ shared building blocks
def _papers(spark, sf):
    return X.papers(spark, sf)


def _edges(spark, sf, style="acm", paper=None):
    p = paper if paper is not None else _papers(spark, sf)
    bib = X.bibliographies(p, X.refs(p), style)
    return extract_citations(bib.withColumnRenamed("doc_id", "citing_id"), "bib", style, keys=("citing_id",))


def _docs(paper):
    return paper.select("doc_id", "title", "url", "n_chars", title_id("title").alias("id"),
                        F.col("n_chars").alias("doc_len"))


def _texts(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", "text")


def _merged(spark, sf, paper=None):
    """The deduplicated documents: narrow, read by several branches, so written once."""
    return cut_lineage(G.dedup_documents(_docs(paper if paper is not None else _papers(spark, sf))))


def _cited(spark, sf, paper=None):
    """The parsed citation edges, written once."""
    return cut_lineage(_edges(spark, sf, "acm", paper))


def _graph(spark, sf):
    """Papers, their parsed citation edges and the deduplicated documents, for queries that need all three."""
    p = _papers(spark, sf)
    return p, _cited(spark, sf, p), _merged(spark, sf, p)


def _stored(df, name):
    """A large table that several branches read, as Parquet in the scratch folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# ------------------------------------------------------------------ sources / scalar queries
def q_title_key(spark, sf):
    p = _papers(spark, sf)
    return p.select("doc_id", "title", title_id("title").alias("id"))


def q_title_key_dedup(spark, sf):
    p = _papers(spark, sf)
    d = G.dedup_documents(_docs(p))
    return d.select("id", "doc_id", "title", "n_merged")


def q_extract_year(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", extract_year(F.col("text")).alias("year"))


# ------------------------------------------------------------------ citations
def _citation_query(style, template=None):
    def q(spark, sf):
        p = _papers(spark, sf)
        bib = X.bibliographies(p, X.refs(p), template or style).withColumnRenamed("doc_id", "citing_id")
        e = extract_citations(bib, "bib", style, keys=("citing_id",))
        return e.select(
            "citing_id", "pos", "cited_title", "cited_id", "n_authors",
            F.array_join(F.transform("authors", lambda a: F.array_join(a, " ")), "; ").alias("author_list"), "style",
        )

    q.__name__ = f"q_citation_{template or style}"
    return q


# ------------------------------------------------------------------ graph
def q_invert_citations(spark, sf):
    _, edges, ded = _graph(spark, sf)
    inv = G.invert_citations(ded, edges)
    return inv.select("id", "doc_id", "title", "n_merged", "citations")


def q_top_cited_50(spark, sf):
    """The 50 documents with the most incoming citations (ties by smaller key)."""
    _, edges, ded = _graph(spark, sf)
    inv = G.invert_citations(ded, edges)
    return inv.orderBy(F.desc("citations"), F.asc("id")).limit(50).select("id", "title", "citations")


def q_top_citing_50(spark, sf):
    """The 50 documents with the most distinct references within the corpus."""
    _, edges, ded = _graph(spark, sf)
    citing = edges.join(ded.select(F.col("doc_id").alias("citing_id"), F.col("id").alias("citing_key")), "citing_id")
    pairs = G.matches(citing, ded, citing="citing_key")
    top = G.top_matched(pairs, citing="citing_key")
    return top.join(ded.select(F.col("id").alias("citing_key"), "title"), "citing_key").select(
        F.col("citing_key").alias("id"), "title", "n_matches"
    )


# ------------------------------------------------------------------ captures
def _admitted(spark, sf):
    return split_payload(admit_captures(X.captures(spark, sf)))


def q_epoch_documents(spark, sf):
    """Documents written as three crawl epochs (epoch = doc_id mod 3 + 1) under
    ``epoch-*/xml`` and read back through the glob with the epoch from the path."""
    root = scratch_path(spark, "epochs")
    docs = X.table(spark, sf, "documents").select("doc_id", "n_chars")
    docs = docs.withColumn("_e", (F.col("doc_id") % 3 + 1).cast("string"))
    for e in ("1", "2", "3"):
        docs.where(F.col("_e") == e).drop("_e").write.parquet(f"{root}/epoch-{e}/xml")
    return load_epochs(spark, f"{root}/epoch-*/xml").select("doc_id", "n_chars", "epoch")


def q_table_round_trip(spark, sf):
    """Documents written by key into folders by source, and loaded through the build-or-load cache."""
    root = scratch_path(spark, "tables")
    docs = X.table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    write_table(docs, f"{root}/docs", key="doc_id", partition_by="source")
    first = materialize(spark, f"{root}/copy", lambda: spark.read.parquet(f"{root}/docs"))
    again = materialize(spark, f"{root}/copy", lambda: first.limit(0))  # it is there: not built again
    return again.select("doc_id", "n_chars", "source")


def q_epoch_refresh(spark, sf):
    """An index of two epochs; then the second is delivered again, changed, and a third one comes."""
    path = scratch_path(spark, "refreshed")
    docs = X.table(spark, sf, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 3 + 1).alias("e"))
    docs = docs.select("doc_id", "n_chars", F.concat(F.lit("e"), "e").alias("epoch"), F.lit(1).alias("version"))
    refresh_index(spark, path, docs.where("epoch < 'e3'"), lambda d: d, version="version")
    again = docs.withColumn("n_chars", F.when(F.col("epoch") == "e2", -F.col("n_chars")).otherwise(F.col("n_chars")))
    again = again.withColumn("version", F.when(F.col("epoch") == "e2", 2).otherwise(1))
    out = refresh_index(spark, path, again, lambda d: d, version="version")
    return out.select("doc_id", "n_chars", "epoch", "version")


def q_capture_admission(spark, sf):
    return _admitted(spark, sf).select("page_id", "url", "status", "filetype", "outcome", "body_len")


def q_capture_status_counts(spark, sf):
    d = _admitted(spark, sf)
    label = F.coalesce(F.col("outcome"), F.col("status"))
    return G.count_status(d.withColumn("status", label), "status")


def q_archive_records(spark, sf):
    """S1+S4: captures written as gzip web-archive files, read back record by record."""
    path = scratch_path(spark, "archives")
    write_captures(X.captures(spark, sf), path)
    recs = read_captures(spark, path + "/*.gz")
    d = split_payload(admit_captures(recs))
    return d.select("url", "length", "status", "filetype", "outcome", "body_len")


def q_archive_members(spark, sf):
    """S1+S4: captures written as archives with a gzip member a record, read back by runs of members."""
    path = scratch_path(spark, "member-archives")
    write_archives(X.captures(spark, sf).coalesce(2), path)
    recs = read_archives(spark, path + "/*.gz", run_bytes=64 << 10)
    return split_payload(admit_captures(recs)).select("url", "length", "status", "filetype", "outcome", "body_len")


def q_archive_states(spark, sf):
    """Whether every written archive file reads back whole, summed over the files."""
    path = scratch_path(spark, "archives")
    write_captures(X.captures(spark, sf), path)
    states = archive_states(spark, path + "/*.gz")
    return states.agg(F.sum("records").alias("records"), F.count("error").alias("errors"))


def q_ingest_documents(spark, sf):
    """Admitted and split captures as documents."""
    d = ingest(X.captures(spark, sf))
    return d.select("url", F.length("xml").alias("xml_len"), F.md5("xml").alias("xml_md5"))


# ------------------------------------------------------------------ extract job
def _extract_input(spark, sf):
    """Papers whose text ends with their rendered bibliography, as layout XML.  The text has no full stops, so that
    the bibliography's lines are the only citations and the edges are known."""
    p = _papers(spark, sf)
    bib = X.bibliographies(p, X.refs(p), "acm")
    texts = _texts(spark, sf).withColumn("text", F.translate("text", ".", ";"))
    return p.join(bib.select("doc_id", "bib"), "doc_id").join(texts, "doc_id").select(
        "doc_id", "url", X.layout_xml(F.concat_ws("\n", "text", "bib")).alias("xml")
    )


def q_extract_documents(spark, sf):
    a = analyze_documents(_extract_input(spark, sf), "acm")
    return a.select("doc_id", "status", "title", "id", "year")


def q_extract_edges(spark, sf):
    """Edges of the whole extract job (layout -> all pages -> citations) of the documents with a good title."""
    docs, edges = extract(_extract_input(spark, sf), "acm")
    return edges.select("citing_id", "pos", "cited_title", "cited_id", F.size("authors").alias("n_authors"))


def q_extract_prose(spark, sf):
    """C5 + D2 over the documents' own texts, unchanged: what the extract job takes for citations in prose (no SQL: a test
    holds it against a parser written out by hand)."""
    docs = X.table(spark, sf, "documents").select("doc_id", F.lit(None).cast("string").alias("url"), X.layout_xml(F.coalesce("text", F.lit(""))).alias("xml"))
    a = analyze_documents(docs, "acm")
    lines = F.transform("outgoing", lambda c: F.concat_ws("|", c["title"], F.array_join(F.transform(c["authors"], lambda x: F.array_join(x, " ")), ";")))
    return a.select("doc_id", "status", "year", F.size("outgoing").alias("n_citations"), F.array_join(lines, "\n").alias("citations"))


def q_wanted_epochs(spark, sf):
    """Documents stored by epoch; of them the epochs that a table of epochs asks for (those with the most
    characters), whose other folders are not read."""
    root = scratch_path(spark, "by-epoch")
    docs = X.table(spark, sf, "documents").select("doc_id", "n_chars", F.concat(F.lit("e"), F.col("doc_id") % 7).alias("epoch"))
    docs.write.partitionBy("epoch").parquet(root)
    sizes = docs.groupBy("epoch").agg(F.sum("n_chars").alias("size"))
    wanted = sizes.orderBy(F.desc("size"), "epoch").limit(2).select("epoch")
    return load_wanted_epochs(spark, root, wanted).select("doc_id", "n_chars", "epoch")


def q_pipeline_records(spark, sf):
    """D6 end to end over stored inputs: the merged documents with their incoming and outgoing citations and postings."""
    root = scratch_path(spark, "pipeline")
    _extract_input(spark, sf).write.parquet(f"{root}/xml")
    t = run_pipeline(spark, f"{root}/xml", f"{root}/out")
    listed = t["incoming"].groupBy("id").agg(F.sum(F.size("incoming")).alias("n_listed"))
    inv = t["inverted"].select("id", "doc_id", "title", "n_merged", "citations", F.size("outgoing").alias("n_outgoing"))
    return inv.join(listed, "id", "left").withColumn("n_listed", F.coalesce("n_listed", F.lit(0)))


def q_pipeline_counters(spark, sf):
    """A1: the extract job's counters, filled while the job writes its documents."""
    root = scratch_path(spark, "counted")
    _extract_input(spark, sf).write.parquet(f"{root}/xml")
    stages = Stages(spark, f"{root}/out")
    stages.stage("document", lambda: analyze_documents(spark.read.parquet(f"{root}/xml")), [f"{root}/xml"], None, extract_counters())
    return stages.counters("document")


def q_streamed_inversion(spark, sf):
    """D2 + D3 as a stream: layouts that arrive in three files, one a batch, are analysed and inverted batch by batch; the stream
    is started again when the last file has come."""
    root = scratch_path(spark, "stream")
    docs = _extract_input(spark, sf).select("doc_id", "url", "xml")
    for part in (0, 1):
        docs.where(F.col("doc_id") % 3 == part).coalesce(1).write.parquet(f"{root}/in/{part}")
    invert_stream(spark, f"{root}/in/*", f"{root}/out", max_files_per_trigger=1).awaitTermination()
    docs.where("doc_id % 3 = 2").coalesce(1).write.parquet(f"{root}/in/2")
    invert_stream(spark, f"{root}/in/*", f"{root}/out", max_files_per_trigger=1).awaitTermination()
    return Inversion(spark, f"{root}/out").inverted()


def q_recrawled_records(spark, sf):
    """D6 over pages that were crawled again: every third document a second time with a longer text, every fifth a second
    time unchanged, under the same ids.  One document stays per key; the citations of all captures count."""
    root = scratch_path(spark, "recrawled")
    first = _extract_input(spark, sf)
    longer = first.where("doc_id % 3 = 0").withColumn("xml", F.replace("xml", F.lit("</pdf2xml>"), F.lit(X.LAST_PAGE)))
    with shuffles_removed(spark):
        first.unionByName(longer).unionByName(first.where("doc_id % 5 = 0")).write.options(**PACKED).parquet(f"{root}/xml")
    t = run_pipeline(spark, f"{root}/xml", f"{root}/out")
    return t["inverted"].select("id", "doc_id", "title", "n_merged", "citations", F.contains("text", F.lit(X.LAST_LINE)).alias("longest"))


def q_incremental_inversion(spark, sf):
    """D3 + S14: three crawl epochs (by id), inverted one by one; then the second is delivered again: every fifth of its
    documents is gone, every seventh is longer, second references are gone and each document cites itself."""
    p = _papers(spark, sf)
    refs, docs = X.refs(p), _docs(p).withColumn("size", F.col("n_chars").cast("long"))
    again = X.delivered_again(p, refs)

    def parsed(rows):
        bib = X.bibliographies(p, rows, "acm").withColumnRenamed("doc_id", "citing_id")
        return extract_citations(bib, "bib", "acm", keys=("citing_id",))

    first = _stored(parsed(refs), "edges")
    inv = Inversion(spark, scratch_path(spark, "inversion"))
    for e in range(3):
        inv.deliver(str(e), docs.where(F.col("doc_id") % 3 == e), first.where(F.col("citing_id") % 3 == e))
    longer = docs.where("doc_id % 3 = 1 and doc_id % 5 <> 0").withColumn("size", F.when(F.col("doc_id") % 7 == 0, F.col("size") * 3).otherwise(F.col("size")))
    inv.deliver("1", longer, parsed(again.where("citing_id % 3 = 1")))
    lst = F.col("incoming")
    listed = inv.table("incoming").groupBy("id").agg(
        F.sum(F.size(lst)).alias("n_listed"), F.sum(F.aggregate(lst, F.lit(0).cast("bigint"), lambda a, x: a + x["citing_id"] * 7 + x["pos"])).alias("mark"))
    return inv.inverted().join(listed, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_listed", "mark")})


# ------------------------------------------------------------------ layout
def _layout(spark, sf, **wanted):
    d = with_layout(X.layout_documents(spark, sf), "xml", "pages")
    return with_text_and_title(d, "pages", **wanted)


def q_layout_text(spark, sf):
    return _layout(spark, sf, title=False).select("doc_id", "text")


def q_layout_title(spark, sf):
    return _layout(spark, sf, text=False).select("doc_id", "title")


def q_layout_long(spark, sf):
    """Layouts of more than 100 pages (each document's text repeated), with self-closed nodes, inline tags, character
    references, single-quoted attributes, two document type lines and, in every 13th document, a malformed node (P1-P4, P6, P7)."""
    d = with_layout(X.long_layouts(spark, sf), "xml", "pages")
    d = with_text_and_title(d.withColumn("n_pages", F.size("pages")).withColumn("_all", all_nodes("pages")), "pages", title=False)
    return d.select(
        "doc_id", "n_pages", F.size("_all").alias("n_nodes"), F.coalesce(F.try_element_at("_all", F.lit(-1))["node_id"], F.lit(0)).alias("last_id"),
        F.size(F.filter("_all", lambda n: n["bold"])).alias("n_bold"), F.length("text").alias("text_len"), F.md5("text").alias("text_md5"),
    )


def q_layout_untidy(spark, sf):
    """P2-P7 on layouts as a lenient reader must take them: comments, character data, processing instructions, bare signs,
    unquoted attributes, nested and unclosed elements."""
    d = with_layout(X.untidy_layouts(spark, sf), "xml", "pages")
    n = d.withColumn("n_pages", F.size("pages")).withColumn("_all", all_nodes("pages")).drop("pages", "xml")
    return n.select(
        "doc_id", "n_pages", F.size("_all").alias("n_nodes"),
        F.array_join(F.transform(F.filter("_all", lambda x: x["bold"]), lambda x: x["node_id"].cast("string")), ",").alias("bold_ids"),
        F.aggregate("_all", F.lit(0).cast("bigint"), lambda a, x: a + x["font_size"] * x["node_id"] + x["top"]).alias("mark"),
        F.md5(F.array_join(F.transform("_all", lambda x: x["text"]), "|")).alias("texts_md5"),
    )


def q_layout_nodes(spark, sf):
    """P2-P7 (+P5 geometry): the NODE table of every rendered document."""
    n = layout_nodes(X.layout_documents(spark, sf), "xml")
    return n.select("doc_id", "page", "node_id", "left", "width", "top", "height", "right", "bottom", "center",
                    "font_id", "bold", "font_size", "text")


def q_title_gate_counts(spark, sf):
    d = _layout(spark, sf, text=False)
    counts = G.count_status(d.withColumn("status", title_status()), "status")
    too_long = d.where(is_too_long()).agg(F.lit("TooLong").alias("status"), F.count(F.lit(1)).alias("n"))
    return counts.unionByName(too_long)


# ------------------------------------------------------------------ graph
def _histograms(spark, sf, scale):
    p = _papers(spark, sf)
    edges = _cited(spark, sf, p)
    out_per_doc = p.select(F.col("doc_id").alias("citing_id")).join(
        edges.groupBy("citing_id").agg(F.count(F.lit(1)).alias("v")), "citing_id", "left"
    ).select(F.coalesce("v", F.lit(0)).alias("v"))
    cites = edges.groupBy(F.col("cited_id").alias("key")).agg(F.count(F.lit(1)).alias("cites"))
    docs = _docs(p).groupBy(F.col("id").alias("key")).agg(F.count(F.lit(1)).alias("docs"))
    per_key = cites.join(docs, "key", "full").select(
        F.coalesce("cites", F.lit(0)).alias("cites"), F.coalesce("docs", F.lit(0)).alias("docs")
    )
    return (
        G.histogram(out_per_doc, "v", "map-citations", scale)
        .unionByName(G.histogram(per_key, "cites", "citation.count", scale))
        .unionByName(G.histogram(per_key, "docs", "doc.count", scale))
    )


def q_citation_histogram(spark, sf):
    return _histograms(spark, sf, "log")


def q_incoming_lists(spark, sf):
    """A13 + W1: all incoming citations, in chunks; every paper also cites the first one, whose key is hot, and its id is
    drawn out to steps of 3000, so that ids alone would not deal the chunks."""
    p, edges, ded = _graph(spark, sf)
    first = p.where("i = 0").select("title").scalar()  # one value, planned as a scalar subquery
    hot = p.select(
        F.col("doc_id").alias("citing_id"), F.lit(100).alias("pos"), title_id(first).alias("cited_id"), first.alias("cited_title"),
        F.lit(None).cast("array<array<string>>").alias("authors"),
    )
    every = edges.select("citing_id", "pos", "cited_id", "cited_title", "authors").unionByName(hot).withColumn("citing_id", F.col("citing_id") * 3000)
    lst = F.col("incoming")
    return G.incoming_chunks(ded, every).select(
        "id", "chunk", "n_chunks", F.size(lst).alias("n_listed"),
        F.get(lst, 0)["citing_id"].alias("first_citing"), F.get(lst, 0)["pos"].alias("first_pos"),
        F.aggregate(lst, F.lit(0).cast("bigint"), lambda a, x: a + x["citing_id"] % 1001).alias("citing_mod_sum"),
        F.md5(F.array_join(F.transform(lst, lambda x: x["title"]), "|")).alias("titles_md5"),
    )


def q_test_set(spark, sf):
    _, edges, ded = _graph(spark, sf)
    inv = G.invert_citations(ded, edges)
    return G.select_test_set(inv).select("id", "doc_id", "title", "citations")


def q_test_set_counts(spark, sf):
    """D4's counters over the references and one dangling one of every document with a long first line."""
    p = _papers(spark, sf)
    bib = X.bibliographies(p, _dangling_edges(spark, sf, p), "acm")
    edges = extract_citations(bib.withColumnRenamed("doc_id", "citing_id"), "bib", "acm", keys=("citing_id",))
    ded = _merged(spark, sf, p)
    return G.test_set_counts(G.invert_citations(ded, edges), edges)


def q_matches_all(spark, sf):
    """J2 keeping duplicates: the number of references to each document, with repeats."""
    _, edges, ded = _graph(spark, sf)
    twice = edges.unionByName(edges.where("pos = 0"))
    return G.matches(twice, ded, distinct=False).groupBy("citing_id", "cited_id").agg(F.count(F.lit(1)).alias("n"))


def q_first_references(spark, sf):
    """The first two references of every document by title."""
    r = X.refs(_papers(spark, sf))
    return first_n(r, "citing_id", ["cited_title", "pos"], 2).select("citing_id", "rank", "cited_title", "pos")


def q_token_flags(spark, sf):
    """The token predicates over the words of all titles, and of each document's reference line, which holds
    key words, conference words, dates and initials."""
    line = F.concat(F.col("title"), F.lit(" and THE Proc. of IEEE pp. 1999 X "), F.col("doc_id").cast("string"))
    p = _papers(spark, sf).select("doc_id", F.posexplode(F.split(line, " ")).alias("pos", "token"))
    return p.select("doc_id", "pos", "token", token_flags("token").alias("f")).select("doc_id", "pos", "token", "f.*")


def q_matches_in_corpus(spark, sf):
    _, edges, ded = _graph(spark, sf)
    return G.matches(edges, ded)


def _dangling_edges(spark, sf, p):
    """Reference lists plus one extra citation of every document whose first line
    is too long to be a paper title (most of those keys have no document)."""
    docs = X.table(spark, sf, "documents")
    extra = docs.select(F.col("doc_id").alias("x_id"), X.first_line("text").alias("cited_title")).where(
        F.length("cited_title") >= 150
    )
    n = p.select(F.max("n")).scalar()
    extra = extra.withColumn("i", F.col("x_id") % n).join(p.select("i", F.col("doc_id").alias("citing_id")), "i")
    extra = extra.select("citing_id", (F.lit(10) + F.col("x_id")).cast("int").alias("pos"), "cited_title")
    return X.refs(p).unionByName(extra)


def q_dangling_references(spark, sf):
    p = _papers(spark, sf)
    truth = _dangling_edges(spark, sf, p)
    bib = X.bibliographies(p, truth, "acm")
    edges = extract_citations(bib.withColumnRenamed("doc_id", "citing_id"), "bib", "acm", keys=("citing_id",))
    ded = G.dedup_documents(_docs(p))
    return G.dangling_references(edges, ded).select("citing_id", "cited_title", "cited_id")


def q_lookup_titles(spark, sf):
    p = _papers(spark, sf)
    keys = _edges(spark, sf, "acm", p).select("cited_title").distinct()
    return G.lookup_titles(keys, "cited_title", _docs(p)).select("cited_title", "doc_id", "id")


def q_lookup_ids(spark, sf):
    _, edges, ded = _graph(spark, sf)
    req = edges.select(G.shard_of("cited_id").alias("shard"), F.col("cited_id").alias("id")).distinct()
    return G.lookup_ids(req, ded).select("shard", "id", "doc_id", "title")


def q_random_doc(spark, sf):
    return random_doc(_merged(spark, sf), "id", seed=0).select("id", "doc_id", "title")


# ------------------------------------------------------------------ term weights
def q_bag_of_words(spark, sf):
    d = X.table(spark, sf, "documents")
    return S.bag_of_words(d, "doc_id")


def q_idf(spark, sf):
    d = X.table(spark, sf, "documents")
    t = S.idf(S.bag_of_words(d, "doc_id"), d, "doc_id")
    return t.select("term", "df", F.round("idf", R6).alias("idf"))


def q_tfidf(spark, sf):
    d = X.table(spark, sf, "documents")
    bow = S.bag_of_words(d, "doc_id")
    w = S.tfidf(bow, S.idf(bow, d, "doc_id"), "doc_id")
    return w.select("doc_id", "term", F.round("weight", R6).alias("weight"))


# ------------------------------------------------------------------ evaluation
def _evaluation(spark, sf, *weights):
    """What the similarity queries share; of the weight tables only those named are built, each stored once."""
    p, edges, ded = _graph(spark, sf)
    corpus = ded.join(_texts(spark, sf), "doc_id")
    citing = edges.join(ded.select(F.col("doc_id").alias("citing_id"), F.col("id").alias("citing_key")), "citing_id")
    pairs = G.matches(citing, ded, citing="citing_key")
    focus = cut_lineage(G.top_matched(pairs, citing="citing_key").select(F.col("citing_key").alias("id")))
    bow = _stored(S.bag_of_words(corpus, "id"), "bow")
    ev = dict(ded=ded, citing=citing, focus=focus, real=S.real_matches(pairs, focus), universe=ded.select("id"))
    if "counts" in weights:
        ev["counts"] = bow.select("id", "term", F.col("cnt").alias("weight"))
    if "weights" in weights:
        # the idf of frequent terms is broadcast and their weights stay in document order
        idf = _stored(S.idf(bow, corpus, "id"), "idf")
        ev["weights"] = _stored(S.stored_tfidf(bow, idf, "id", drop_zero=True), "weights")
    return ev


def _similar_query(kind):
    def q(spark, sf):
        table = "counts" if kind == "overlap" else "weights"
        ev = _evaluation(spark, sf, table)
        r = S.similar(ev["focus"], ev[table], universe=ev["universe"])
        return r.select("focus_id", "id", F.round("score", R6).alias("score"), "rank")

    q.__name__ = f"q_similar_{kind}"
    return q


def q_similar_all(spark, sf):
    """E2 for every document as focus: its ten most similar documents by tf-idf weights."""
    corpus = _merged(spark, sf).select("id", "doc_id").join(_texts(spark, sf), "doc_id")
    bow = _stored(S.bag_of_words(corpus, "id"), "bow")
    weights = S.tfidf(bow, _stored(S.idf(bow, corpus, "id"), "idf"), "id", drop_zero=True)
    return similar_all(weights, k=10).withColumn("score", F.round("score", R6))


def q_recall_curve(spark, sf):
    ev = _evaluation(spark, sf, "counts", "weights")
    out = None
    for kind, w in (("overlap", ev["counts"]), ("tfidf", ev["weights"])):
        c = S.recall_curve(S.similar(ev["focus"], w, universe=ev["universe"]), ev["real"], metric=kind)
        out = c if out is None else out.unionByName(c)
    return out


def q_evaluation_report(spark, sf):
    ev = _evaluation(spark, sf, "weights")
    ranked = S.similar(ev["focus"], ev["weights"], universe=ev["universe"])
    at = S.evaluate_at(ranked, ev["real"], K.EVAL_N_UNTIL)
    total = ev["citing"].groupBy(F.col("citing_key").alias("id")).agg(F.count(F.lit(1)).alias("total"))
    rep = ev["focus"].join(at.withColumnRenamed("focus_id", "id"), "id", "left").join(total, "id", "left")
    rep = rep.join(ev["ded"].select("id", "title"), "id")
    m, f = F.coalesce("matched", F.lit(0)), F.coalesce("found", F.lit(0))
    return rep.select(
        "id", "title", m.alias("matched"), f.alias("found"), F.coalesce("total", F.lit(0)).alias("total"),
        F.round(F.try_divide(100.0 * m, f.cast("double")), R6).alias("percent"),
    )


# ------------------------------------------------------------------ learning
def _learning(spark, sf):
    p, edges, ded = _graph(spark, sf)
    docs = ded.join(_texts(spark, sf), "doc_id")
    return docs, edges


def q_report_lines(spark, sf):
    """Fixed-width report rows of the evaluation."""
    rep = q_evaluation_report(spark, sf)
    return rep.select("id", S.report_line().alias("line"))


def q_nb_positives(spark, sf):
    docs, edges = _learning(spark, sf)
    return L.positives(docs, edges)


def q_nb_negatives(spark, sf):
    return L.negatives(_merged(spark, sf)).select("id", "draw", "sampled_id")


def q_nb_model(spark, sf):
    docs, edges = _learning(spark, sf)
    return L.train(docs, edges)


def q_nb_score(spark, sf):
    """L4 applied: a fifth of the documents scored under the model that the others' texts give."""
    docs, edges = _learning(spark, sf)
    scored = L.score_held_out(docs.select("id", "doc_id", "title", "text"), edges)
    return scored.withColumn("log_odds", F.round("log_odds", R6))


def _learned(learner):
    def q(spark, sf):
        docs, edges = _learning(spark, sf)
        return learn(learner(), training_texts(docs.select("id", "doc_id", "title", "text"), edges))

    return q


def q_learned_lengths(spark, sf):
    """A second learner under the same interface."""
    return _learned(Lengths)(spark, sf).withColumns({c: F.round(c, R6) for c in ("mean", "variance")})


# ------------------------------------------------------------------ index and search
def _indexed(spark, sf, stored: bool = True):
    """Inverted documents and their postings; ``index_postings`` is the build."""
    if not stored:
        ded = _merged(spark, sf).select("id", "doc_id", "title")
        return None, Q.build_index(ded.join(_texts(spark, sf), "doc_id"))
    _, edges, ded = _graph(spark, sf)
    inv = G.invert_citations(ded, edges)
    # queries are analysed into words: shingles, three quarters of the postings, would not be asked for
    post = Q.build_index(inv.select("id", "doc_id", "title").join(_texts(spark, sf), "doc_id"), max_shingle=1)
    # search reads only the query terms' postings (materialised by the search itself)
    return cut_lineage(inv.select("id", "doc_id", "title", "citations")), post


def q_index_postings(spark, sf):
    _, post = _indexed(spark, sf, stored=False)
    return post.drop("positions")


def q_index_positions(spark, sf):
    """Q1: where each word stands in its field."""
    _, post = _indexed(spark, sf, stored=False)
    return post.where("positions is not null").select("field", "term", "id", F.array_join("positions", ",").alias("positions"))


def _written_index(post):
    path = scratch_path(post.sparkSession, "index")
    Q.write_index(post, path)
    return post.sparkSession.read.parquet(path)


def q_stored_index(spark, sf):
    """Postings written one folder per term bucket (sorted by term) and read back."""
    _, post = _indexed(spark, sf, stored=False)
    return _written_index(post).select("field", "term", "id", "shard", "tf", "field_len")


def q_search_stored(spark, sf):
    """Search over the index that was written: only the buckets of the batch's terms are read."""
    inv, post = _indexed(spark, sf)
    return _rounded(Q.search(X.search_queries(spark, sf), _written_index(post), inv, scorer=Q.DEFAULT_SCORER, k=10))


def q_search_phrase(spark, sf):
    """Phrase queries of two to eight words, stop words among them, taken from the documents' texts."""
    inv, post = _indexed(spark, sf)
    return Q.text_scores(X.phrase_queries(spark, sf), post, inv).select("query_id", "id", F.round("text_score", R6).alias("text_score"), "matched")


def q_search_text(spark, sf):
    inv, post = _indexed(spark, sf)
    ts = Q.text_scores(X.search_queries(spark, sf), post, inv)
    top = Q._top(ts, ["query_id"], F.desc(F.round("text_score", 9)), "id", K.SEARCH_CANDIDATES, "rank")
    return top.select("query_id", "rank", "id", F.round("text_score", R6).alias("text_score"), "matched")


def _rounded(df):
    return df.withColumn("text_score", F.round("text_score", R6)).withColumn("score", F.round("score", R6))


def q_search_scored(spark, sf):
    inv, post = _indexed(spark, sf)
    return _rounded(Q.search(X.search_queries(spark, sf), post, inv, scorer=Q.DEFAULT_SCORER, k=10))


def q_search_sharded(spark, sf):
    inv, post = _indexed(spark, sf)
    per = (K.SEARCH_CANDIDATES, K.SEARCH_KEEP)
    return _rounded(Q.search(X.search_queries(spark, sf), post, inv, scorer=Q.DEFAULT_SCORER, per_shard=per))


def q_search_fielded(spark, sf):
    inv, post = _indexed(spark, sf)
    return _rounded(Q.search(X.fielded_queries(spark, sf), post, inv, scorer="text_score", k=10))


QUERIES = {
    "capture_admission": q_capture_admission,
    "capture_status_counts": q_capture_status_counts,
    "archive_records": q_archive_records,
    "archive_members": q_archive_members,
    "archive_states": q_archive_states,
    "ingest_documents": q_ingest_documents,
    "epoch_documents": q_epoch_documents,
    "epoch_refresh": q_epoch_refresh,
    "table_round_trip": q_table_round_trip,
    "extract_documents": q_extract_documents,
    "extract_edges": q_extract_edges,
    "extract_prose": q_extract_prose,
    "wanted_epochs": q_wanted_epochs,
    "layout_text": q_layout_text,
    "layout_title": q_layout_title,
    "title_gate_counts": q_title_gate_counts,
    "layout_nodes": q_layout_nodes,
    "layout_long": q_layout_long,
    "layout_untidy": q_layout_untidy,
    "title_key": q_title_key,
    "title_key_dedup": q_title_key_dedup,
    "extract_year": q_extract_year,
    "citation_acm": _citation_query("acm"),
    "citation_noisy": _citation_query("acm", "acm_noisy"),
    "citation_ieee": _citation_query("ieee"),
    "citation_springer": _citation_query("springer"),
    "citation_best": _citation_query("best"),
    "invert_citations": q_invert_citations,
    "top_cited_50": q_top_cited_50,
    "top_citing_50": q_top_citing_50,
    "citation_histogram": q_citation_histogram,
    "test_set": q_test_set,
    "test_set_counts": q_test_set_counts,
    "matches_all": q_matches_all,
    "first_references": q_first_references,
    "token_flags": q_token_flags,
    "pipeline_records": q_pipeline_records,
    "pipeline_counters": q_pipeline_counters,
    "streamed_inversion": q_streamed_inversion,
    "recrawled_records": q_recrawled_records,
    "incremental_inversion": q_incremental_inversion,
    "incoming_lists": q_incoming_lists,
    "matches_in_corpus": q_matches_in_corpus,
    "dangling_references": q_dangling_references,
    "lookup_titles": q_lookup_titles,
    "lookup_ids": q_lookup_ids,
    "random_doc": q_random_doc,
    "bag_of_words": q_bag_of_words,
    "idf": q_idf,
    "tfidf": q_tfidf,
    "similar_overlap": _similar_query("overlap"),
    "similar_tfidf": _similar_query("tfidf"),
    "similar_all": q_similar_all,
    "recall_curve": q_recall_curve,
    "evaluation_report": q_evaluation_report,
    "report_lines": q_report_lines,
    "nb_positives": q_nb_positives,
    "nb_negatives": q_nb_negatives,
    "nb_model": q_nb_model,
    "nb_score": q_nb_score,
    "learned_naive_bayes": _learned(NaiveBayes),
    "learned_lengths": q_learned_lengths,
    "index_postings": q_index_postings,
    "index_positions": q_index_positions,
    "stored_index": q_stored_index,
    "search_stored": q_search_stored,
    "search_phrase": q_search_phrase,
    "search_text": q_search_text,
    "search_scored": q_search_scored,
    "search_sharded": q_search_sharded,
    "search_fielded": q_search_fielded,
}
