"""Deterministic views over the driver's tables that stand in for the original
system's inputs (crawled papers, their layouts and bibliographies).

Every view is derived by Spark from the given tables, so its size grows with
them; each has an equivalent DuckDB expression in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.functions.text import xml_escape
from citegraph.operators.sampling import dense_index
from citegraph.session import balance

LINES_PER_PAGE = 40

# bibliography line templates, one a form of the grammar (t = cited title)
TEMPLATES = {
    "acm": "O. Niemi and R. Dahl. {t}. Harbour Notes, 2006.",
    "acm_comma": "NIEMI, O., DAHL, R., AND FERRO, M. {t}. Harbour Notes, 2006.",
    "acm_noisy": "  [8] NIEMI, O., AND DAHL, R. 2001. {t}\n  (Quay House, 5, 12), 340-352.",
    "ieee": "O. Niemi and R. Dahl, “{t}” no. 6, 2006.",
    "springer": "Niemi, O., Dahl, R.: {t}. Harbour Notes (2006)",
}


# large text tables and their keys: their scans are spread over the cluster (see session.balance)
_TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return balance(df, _TEXT_TABLES[name]) if name in _TEXT_TABLES else df


def first_line(text) -> F.Column:
    first = F.split_part(F.col(text), F.lit("\n"), F.lit(1))
    return F.trim(F.regexp_replace(first, r"[.?()\s]+", " "))


def paper_title(text, doc_id="doc_id") -> F.Column:
    """The first line as a title of 11..149 characters: a longer one is cut, a shorter one gets the document's number."""
    t = first_line(text)
    short = F.trim(F.concat(t, F.lit(" Document number "), F.col(doc_id).cast("string")))
    return F.when(F.length(t) > 149, F.trim(F.substring(t, 1, 149))).when(F.length(t) < 11, short).otherwise(t)


def papers(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """``(doc_id, title, url, n_chars, i, n[, text])``: every document as a paper, with a
    dense index ``i`` in doc_id order."""
    docs = table(spark, sf_dir, "documents")
    base = docs.select("doc_id", paper_title("text").alias("title"), "n_chars")
    base = base.withColumn(
        "url",
        F.concat(
            F.lit("http://papers.example/"),
            F.col("doc_id").cast("string"),
            F.when(F.col("doc_id") % 3 == 0, F.lit(".ps")).otherwise(F.lit(".pdf")),
        ),
    )
    idx = dense_index(base, "doc_id")
    if with_text:
        idx = idx.join(docs.select("doc_id", "text"), "doc_id")
    return idx


def refs(paper: DataFrame) -> DataFrame:
    """Ground-truth edges ``(citing_id, pos, cited_title)``: paper i cites i%4+1 papers;
    position 0 points at a few popular papers, the rest are spread."""
    e = paper.select(
        "doc_id", "i", "n", F.explode(F.sequence(F.lit(0), (F.col("i") % 4).cast("int"))).alias("j")
    )
    target = F.when(F.col("j") == 0, F.col("i") % (F.floor(F.col("n") / 50).cast("bigint") + 1)).otherwise(
        (F.col("i") * 7 + F.col("j") * 13 + 1) % F.col("n")
    )
    e = e.withColumn("target", target)
    q = paper.select(F.col("i").alias("target"), F.col("title").alias("cited_title"))
    return e.join(q, "target").select(
        F.col("doc_id").alias("citing_id"), F.col("j").cast("int").alias("pos"), "cited_title"
    )


def delivered_again(paper: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` as of a second delivery: those of every fifth document and second references are gone, and each
    other document cites itself last."""
    kept = edges.where("citing_id % 5 <> 0 and pos <> 1")
    own = paper.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("citing_id"), F.lit(9).alias("pos"), F.col("title").alias("cited_title"))
    return kept.unionByName(own)


def _line(style: str, title) -> F.Column:
    a, b = TEMPLATES[style].split("{t}")
    return F.concat(F.lit(a), title, F.lit(b))


def bibliography_line(style: str) -> F.Column:
    """``acm`` alternates the two ACM author forms by position; ``best`` picks the
    style by the citing paper's index (acm, acm_comma, ieee, springer)."""
    t = F.col("cited_title")
    if style == "acm":
        return F.when(F.col("pos") % 2 == 0, _line("acm", t)).otherwise(_line("acm_comma", t))
    if style == "best":
        k = F.col("i") % 4
        return (
            F.when(k == 0, _line("acm", t)).when(k == 1, _line("acm_comma", t))
            .when(k == 2, _line("ieee", t)).otherwise(_line("springer", t))
        )
    return _line(style, t)


def bibliographies(paper: DataFrame, edges: DataFrame, style: str) -> DataFrame:
    """One row per citing paper: ``(doc_id, i, bib)`` with lines in position order.
    Groups are one paper's references (bounded by the rendering rule)."""
    e = edges.join(paper.select(F.col("doc_id").alias("citing_id"), "i"), "citing_id")
    e = e.withColumn("line", bibliography_line(style))
    g = e.groupBy("citing_id", "i").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    return g.select(
        F.col("citing_id").alias("doc_id"), "i", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("bib")
    )


def layout_xml(text) -> F.Column:
    """Render a text as page-layout XML: 40 lines per page, two lines per visual
    row, one hyphenated line in five, a bold first line in a larger font."""
    lines = F.split(F.col(text) if isinstance(text, str) else text, "\n")

    def node(line, i):
        top = F.lit(80) + F.lit(20) * F.floor((i % LINES_PER_PAGE) / 2).cast("int")
        left = F.lit(100) + F.lit(320) * (i % 2)
        width = F.least(F.lit(8) * F.length(line), F.lit(300))
        height = F.when(i == 0, F.lit(20)).otherwise(F.lit(12))
        font = F.when(i == 0, F.lit(1)).otherwise(F.lit(0))
        body = xml_escape(F.when(i % 5 == 3, F.concat(line, F.lit("-"))).otherwise(line))
        body = F.when(i == 0, F.concat(F.lit("<b>"), body, F.lit("</b>"))).otherwise(body)
        page_open = F.when(
            i % LINES_PER_PAGE == 0,
            F.concat(
                F.when(i > 0, F.lit("</page>\n")).otherwise(F.lit("")),
                F.lit('<page number="'), (F.floor(i / LINES_PER_PAGE) + 1).cast("string"), F.lit('">\n'),
            ),
        ).otherwise(F.lit(""))
        return F.concat(
            page_open,
            F.lit('<text top="'), top.cast("string"),
            F.lit('" left="'), left.cast("string"),
            F.lit('" width="'), width.cast("string"),
            F.lit('" height="'), height.cast("string"),
            F.lit('" font="'), font.cast("string"), F.lit('">'),
            body, F.lit("</text>\n"),
        )

    head = F.lit(
        '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE pdf2xml SYSTEM "pdf2xml.dtd">\n'
        '<pdf2xml>\n<fontspec id="0" size="10" family="Times"/>\n<fontspec id="1" size="17" family="Times"/>\n'
    )
    return F.concat(head, F.array_join(F.transform(lines, node), ""), F.lit("</page>\n</pdf2xml>\n"))


def layout_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, url, xml)`` for every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.concat(F.lit("http://papers.example/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("url"),
        layout_xml("text").alias("xml"),
    )


#: what a later capture of a page has more: one page with one line
LAST_LINE = "captured later"
LAST_PAGE = f'<page number="9999"><text top="80" left="100" width="100" height="12" font="0">{LAST_LINE}</text></page></pdf2xml>'

LONG_COPIES = 60


def long_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, xml)``: each document's lines `LONG_COPIES` times, five lines a page, as an untidy layout: the text
    behind an earlier document type line does not count, every 7th line is a self-closed node, every 11th a bold one,
    every 12th has its bold part inside another element, every 10th ends with character references,
    attributes have single quotes on odd pages, and every 13th document has a node without its top."""
    docs = table(spark, sf_dir, "documents")
    lines = F.split(F.concat_ws("\n", F.array_repeat(F.col("text"), LONG_COPIES)), "\n")
    line_rows = docs.select("doc_id", lines.alias("ls"))

    def node(line, i):
        q = F.when(F.floor(i / 5) % 2 == 1, F.lit("'")).otherwise(F.lit('"'))

        def attr(name, value):
            return F.concat(F.lit(f" {name}="), q, value.cast("string"), q)

        bad = (F.col("doc_id") % 13 == 0) & (i == 3)
        attrs = F.concat(
            F.when(bad, F.lit("")).otherwise(attr("top", 80 + 20 * (i % 5))), attr("left", 100 + 320 * (i % 2)),
            attr("width", F.least(8 * F.length(line), F.lit(300))), attr("height", F.lit(12)), attr("font", F.lit(0)),
        )
        body = F.concat(xml_escape(line), F.when(i % 10 == 9, F.lit("&#233;&#x4e2d;&eacute;&amp;#38;&unknown;")).otherwise(F.lit("")))
        body = F.when(i % 11 == 10, F.concat(F.lit("<b>"), body, F.lit("</b>"))).when(
            i % 12 == 11, F.concat(F.lit("<i><b>"), body, F.lit("</b></i>"))).otherwise(body)
        open_page = F.when(i % 5 == 0, F.concat(
            F.when(i > 0, F.lit("</page>")).otherwise(F.lit("")), F.lit('<page number="'), (F.floor(i / 5) + 1).cast("string"), F.lit('">')))
        whole = F.when(i % 7 == 6, F.concat(F.lit("<text"), attrs, F.lit("/>"))).otherwise(F.concat(F.lit("<text"), attrs, F.lit(">"), body, F.lit("</text>\n")))
        return F.concat(F.coalesce(open_page, F.lit("")), whole)

    dtd = '<!DOCTYPE pdf2xml SYSTEM "pdf2xml.dtd">'
    head = F.lit(f'<pdf2xml>{dtd}<page number="1"><text top="1" left="1" width="1" height="1" font="0">lost</text></page>{dtd}<pdf2xml><fontspec id="0" size="10"/>')
    return line_rows.select("doc_id", F.concat(head, F.array_join(F.transform("ls", node), ""), F.lit("</page></pdf2xml>")).alias("xml"))


#: lines in a cycle of `untidy_layouts`
UNTIDY = 9


def untidy_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, xml)``: each document's lines, five a page, in turn: capital tags with unquoted attributes, a bare `<`, a
    comment that holds a node, a plain node, character data with tags in it, a processing instruction, bold inside another
    element, an unclosed node, bold with an unclosed element inside.  Every second page is unclosed; a font stands in a comment."""
    docs = table(spark, sf_dir, "documents")

    def node(line, i):
        k = i % UNTIDY
        body = xml_escape(line)
        values = [("top", 80 + 20 * (i % 5)), ("left", F.lit(100)), ("width", F.least(8 * F.length(line), F.lit(300))), ("height", F.lit(12)), ("font", F.lit(0))]
        attrs = F.concat(*[F.concat(F.lit(f' {n}="'), v.cast("string"), F.lit('"')) for n, v in values])
        bare = F.concat(*[F.concat(F.lit(f" {n}="), v.cast("string")) for n, v in values])
        body = (
            F.when(k == 1, F.concat(body, F.lit(" 1 < 2")))
            .when(k == 4, F.concat(F.lit("<![CDATA["), line, F.lit(" a <b> c</text> &amp; d]]>")))
            .when(k == 5, F.concat(F.lit('<?render mode="<text>"?>'), body))
            .when(k == 6, F.concat(F.lit("<i><b>"), body, F.lit("</b></i>")))
            .when(k == 8, F.concat(F.lit("</i><b><i>"), body, F.lit("</b><br>")))
            .otherwise(body)
        )
        ghost = F.when(k == 2, F.lit(f'<!-- <text top="1" left="1" width="1" height="1" font="0">ghost</text> <!DOCTYPE x> -->')).otherwise(F.lit(""))
        whole = F.when(k == 0, F.concat(F.lit("<TEXT"), bare, F.lit(">"), body, F.lit("</Text >"))).when(k == 7, F.concat(F.lit("<text"), attrs, F.lit(">"), body))
        whole = whole.otherwise(F.concat(F.lit("<text"), attrs, F.lit(">"), body, F.lit("</text>")))
        page = F.floor(i / 5)
        close = F.when((i > 0) & (page % 2 == 1), F.lit("</page>")).otherwise(F.lit(""))
        open_page = F.when(i % 5 == 0, F.concat(close, F.lit('<page number="'), (page + 1).cast("string"), F.lit('">'))).otherwise(F.lit(""))
        return F.concat(open_page, ghost, whole)

    head = F.lit('<?xml version="1.0"?><!DOCTYPE pdf2xml SYSTEM "pdf2xml.dtd"><pdf2xml><fontspec id="0" size="10"/><!-- <fontspec id="0" size="99"/> -->')
    return docs.select("doc_id", F.concat(head, F.array_join(F.transform(F.split("text", "\n"), node), ""), F.lit("</page></pdf2xml>")).alias("xml"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAPTURE rows ``(page_id, url, length, payload)`` from ``pages``: the URL gets a
    .pdf/.ps/no suffix and every 17th page loses its URL, so all admission branches occur."""
    pg = table(spark, sf_dir, "pages")
    suffix = F.when(F.col("page_id") % 3 == 0, F.lit(".PDF")).when(F.col("page_id") % 3 == 1, F.lit(".ps")).otherwise(
        F.lit("")
    )
    url = F.when(F.col("page_id") % 17 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.col("url"), suffix))
    header = F.lit("HTTP/1.1 200 OK\r\nContent-Type: application/pdf\r\n\r\n")
    payload = F.when(F.col("page_id") % 11 == 0, F.col("html")).otherwise(F.concat(header, F.col("html")))
    return pg.select(
        "page_id", url.alias("url"), F.length("html").cast("bigint").alias("length"), F.encode(payload, "UTF-8").alias("payload")
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QUERY rows from ``benchmark``: each item's whole text is one query."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.trim(F.col("text")).alias("text"))


def fielded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QUERY rows with the reachable query syntax: even ids search ``text``, odd ids
    ``title``; ``must`` = first non-stop word, ``must_not`` = last non-stop word
    (when there are two or more), every third query is a phrase."""
    from citegraph.functions.text import index_tokens

    q = search_queries(spark, sf_dir)
    w = F.filter(index_tokens(F.col("text")), lambda x: x.isNotNull())
    q = q.withColumn("_w", w)
    return q.select(
        "query_id", "text",
        F.when(F.col("query_id") % 2 == 0, F.lit("text")).otherwise(F.lit("title")).alias("field"),
        F.when(F.size("_w") > 0, F.array(F.get(F.col("_w"), 0))).otherwise(F.array().cast("array<string>")).alias("must"),
        F.when(F.size("_w") > 1, F.array(F.element_at("_w", -1))).otherwise(F.array().cast("array<string>")).alias("must_not"),
        (F.col("query_id") % 3 == 0).alias("phrase"),
    )


def phrase_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QUERY rows: of every 20th document the words 3.. of its text, two to eight of them, as a phrase."""
    from citegraph.functions.text import words

    docs = table(spark, sf_dir, "documents").where("doc_id % 20 = 0")
    w = docs.select(F.col("doc_id").alias("query_id"), words(F.col("text"), lower=True).alias("w"))
    w = w.select("query_id", F.array_join(F.slice("w", F.lit(3), (F.lit(2) + F.floor(F.col("query_id") / 20) % 7).cast("int")), " ").alias("text"))
    return w.select("query_id", "text", F.lit("text").alias("field"), F.lit(True).alias("phrase"))
