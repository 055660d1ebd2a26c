"""Citation extraction as a narrow (shuffle-free) projection.

Every section of a document is matched by the style regexes inside the row;
the "best" style per section is chosen with array higher-order functions, and
only then are citations exploded.  There is no Python UDF and no shuffle, so the
job scales with the number of documents and the length of their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegraph.functions import patterns as P
from citegraph.functions.text import collapse_ws, explode_rows, title_id

CITATION_TYPE = "struct<title:string,authors:array<array<string>>,conference:string>"


def _authors(style: str, group: Column) -> Column:
    names = F.regexp_extract_all(group, F.lit(P.AUTHOR_PATTERNS[style]), 0)

    def parts(a: Column) -> Column:
        inits = F.regexp_extract_all(a, F.lit(P.INITIAL), 0)
        if style == "springer":
            surname = F.regexp_extract(a, P.NAME_REGULAR, 0)
            return F.when(surname == "", F.array(F.lit("et al"))).otherwise(F.concat(F.array(surname), inits))
        surname = F.regexp_extract(a, P.SURNAME, 0)
        if style == "ieee":
            return F.concat(inits, F.array(surname))
        return F.concat(F.array(surname), inits)

    authors = F.transform(names, parts)
    if style == "acm":
        # "A, B, ..., and Z" stores the last author first
        comma = group.rlike(P.ACM_COMMA_FORM)
        rotated = F.concat(F.slice(authors, -1, 1), F.slice(authors, 1, F.greatest(F.size(authors) - 1, F.lit(0))))
        authors = F.when(comma & (F.size(authors) > 1), rotated).otherwise(authors)
    return authors


def parse_section(text: Column, style: str) -> Column:
    """array<CITATION> of one section for one style.

    The (long) section is scanned once for whole matches; authors and title are
    then re-extracted from each (short) match, which gives the same groups: the
    look-behind holds at the start of a match and the title ends where it did."""
    pat = P.PATTERNS[style]
    matches = F.regexp_extract_all(text, F.lit(pat), 0)

    def one(m: Column) -> Column:
        g = F.regexp_extract(m, pat, 1)
        raw = F.regexp_extract(m, pat, 2)
        t = collapse_ws(raw) if style == "acm" else F.regexp_replace(raw, r"^\s+", "")
        return F.struct(t.alias("title"), _authors(style, g).alias("authors"), F.lit("").alias("conference"))

    return F.transform(matches, one)


def section_score(cites: Column) -> Column:
    """C4: sum(#authors * title length) / (1 + |#citations - 25|)."""
    s = F.aggregate(cites, F.lit(0.0), lambda acc, c: acc + F.size(c["authors"]) * F.length(c["title"]))
    return s / (F.lit(1.0) + F.abs(F.size(cites) - F.lit(25)))


def _pick_best(cands: Column, styles) -> Column:
    """Keep the style list with the highest score; ties go to the later style."""
    best = cands[styles[0]]
    best_score = section_score(best)
    best_style = F.lit(styles[0])
    for st in styles[1:]:
        c = cands[st]
        sc = section_score(c)
        take = sc >= best_score
        best = F.when(take, c).otherwise(best)
        best_style = F.when(take, F.lit(st)).otherwise(best_style)
        best_score = F.greatest(sc, best_score)
    return F.transform(best, lambda c: F.struct(c["title"], c["authors"], c["conference"], best_style.alias("style")))


def _candidates(sections: Column, styles) -> Column:
    """Per section, the citation list of every style (each regex runs once)."""
    return F.transform(sections, lambda s: F.struct(*[parse_section(s, st).alias(st) for st in styles]))


def with_citations(df: DataFrame, text: str = "text", style: str = "acm", sections: bool = False,
                   out: str = "outgoing") -> DataFrame:
    """Adds ``out`` = flat array<struct<title, authors, conference, style>>.

    ``text`` is one section (string) or, with ``sections=True``, an array of
    sections parsed separately; ``style`` is acm, ieee, springer or best (C4).
    Two projections: the first runs every regex once, the second only picks.
    """
    styles = P.STYLES if style == "best" else (style,)
    sec = F.col(text) if sections else F.array(F.col(text))
    staged = df.withColumn("_cands", _candidates(sec, styles))
    return staged.withColumn(out, F.flatten(F.transform("_cands", lambda c: _pick_best(c, styles)))).drop("_cands")


def extract_citations(df: DataFrame, text: str = "text", style: str = "acm", keys=("doc_id",),
                      sections: bool = False) -> DataFrame:
    """Edge rows ``(*keys, pos, cited_title, cited_id, authors, n_authors, style)``."""
    lst = with_citations(df.select(*keys, text), text, style, sections, out="_cites")
    out = explode_rows(lst, keys, "_cites", "c", with_pos="pos")
    return out.select(
        *keys,
        F.col("pos").cast("int").alias("pos"),
        F.col("c.title").alias("cited_title"),
        title_id(F.col("c.title")).alias("cited_id"),
        F.col("c.authors").alias("authors"),
        F.size("c.authors").alias("n_authors"),
        F.col("c.style").alias("style"),
    )


def parse_citations(df: DataFrame, text: str = "text", style: str = "acm", sections: bool = False) -> DataFrame:
    """Nested view: one ``outgoing`` array<CITATION> per row."""
    d = with_citations(df, text, style, sections, out="outgoing")
    return d.withColumn(
        "outgoing", F.transform("outgoing", lambda c: F.struct(c["title"], c["authors"], c["conference"]))
    )
