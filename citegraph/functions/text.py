"""Scalar Column functions (all JVM-side built-ins, no Python UDFs).

Each takes Columns (or names) and returns a Column, so they compose inside one
projection and stay in whole-stage codegen.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from citegraph.functions import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- P12 title key
def simplified_title(title) -> Column:
    """Delete ``proc\\..*`` / ``proceedings.*`` (case-sensitive, to end of line),
    keep only ``[a-zA-Z+]``, lower-case."""
    t = F.regexp_replace(_c(title), r"(proc\..*|proceedings.*)", "")
    return F.lower(F.regexp_replace(t, r"[^a-zA-Z+]", ""))


def title_id(title, shared_empty_key: bool = False) -> Column:
    """First 8 bytes of MD5(simplified title) as a signed big-endian long.

    A title without a Latin letter simplifies to nothing; its key is that of the title itself, so that such
    documents do not all merge into one (``shared_empty_key=True`` gives them one key, as in the original)."""
    simple = simplified_title(title)
    if not shared_empty_key:
        simple = F.when(simple == "", F.concat(F.lit("title:"), _c(title))).otherwise(simple)
    return F.conv(F.substring(F.md5(simple), 1, 16), 16, -10).cast("bigint")


# ---------------------------------------------------------------- trimming
def jtrim(s) -> Column:
    """Trim every character <= U+0020 from both ends (not only spaces)."""
    return F.regexp_replace(_c(s), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def collapse_ws(s) -> Column:
    return F.trim(F.regexp_replace(_c(s), r"\s+", " "))


# ---------------------------------------------------------------- P11 year
def extract_year(text, low: int = K.YEAR_LOW_EXCLUSIVE, high: int = K.YEAR_HIGH_EXCLUSIVE) -> Column:
    """Last non-overlapping 4-digit run with low < y < high, else 0."""
    years = F.transform(F.regexp_extract_all(_c(text), F.lit(r"[0-9]{4}"), 0), lambda y: y.cast("int"))
    ok = F.filter(years, lambda y: (y > low) & (y < high))
    return F.coalesce(F.try_element_at(ok, F.lit(-1)), F.lit(0))


# ---------------------------------------------------------------- A2 histogram bucket
def histogram_bucket(value, scale: str = "log") -> Column:
    """``log``: floor(log1p(v)/ln 1.1), the intended log bucket (default).
    ``asis``: the original expression 1.1^(log1p(v)/ln 1.1) truncated, i.e. v+1
    up to rounding."""
    v = _c(value).cast("double")
    e = F.log1p(v) / F.log(F.lit(K.HISTOGRAM_LOG_BASE))
    if scale == "asis":
        return F.floor(F.pow(F.lit(K.HISTOGRAM_LOG_BASE), e)).cast("int")
    return F.floor(e).cast("int")


# ---------------------------------------------------------------- P18 tokenizer A
BOW_DELIM = r"[0-9\s\p{Punct}]"


def bow_tokens(text, keep_empty: bool = True) -> Column:
    """Lower-case, split on every single ``[0-9\\s\\p{Punct}]``.

    Interior and leading empty tokens are terms (as in a Java regex split);
    trailing empties are dropped; delimiter-only text gives no tokens.
    """
    low = F.lower(_c(text))
    stripped = F.regexp_replace(low, BOW_DELIM + "+$", "")
    toks = F.when((low != F.lit("")) & (stripped == F.lit("")), F.array().cast("array<string>")).otherwise(
        F.split(stripped, BOW_DELIM)
    )
    if not keep_empty:
        toks = F.filter(toks, lambda t: t != F.lit(""))
    return toks


# ---------------------------------------------------------------- P19/P20 word tokens, shingles
WORD = r"[\p{L}\p{N}]+(?:['’.][\p{L}\p{N}]+)*"


def words(text, lower: bool = False) -> Column:
    """Standard-tokenizer approximation: letter/digit runs joined by ' ’ ."""
    t = _c(text)
    if lower:
        t = F.lower(t)
    return F.regexp_extract_all(t, F.lit(WORD), 0)


def stop_gaps(tokens, stop=K.ENGLISH_STOP_WORDS) -> Column:
    """Replace stop words by null (a gap no shingle may span)."""
    if not stop:
        return _c(tokens)
    return F.transform(_c(tokens), lambda w: F.when(w.isin(*stop), F.lit(None)).otherwise(w))


def ngram_windows(w: Column, n: int) -> Column:
    """All n-word windows of ``w`` (joined by a space) that contain no null."""

    def window(i: Column) -> Column:  # null with any null in it
        return F.concat(*[x for j in range(n) for x in (F.lit(" "), F.get(w, i + j))][1:])

    joined = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), window)
    return F.filter(joined, lambda x: x.isNotNull())


def shingles(tokens, min_n: int = 2, max_n: int = 2, unigrams: bool = True) -> Column:
    """Unigrams plus word n-grams (``min_n``..``max_n``) of a token array in which
    null marks a removed stop word (see ``stop_gaps``); no n-gram spans a gap.

    ``tokens`` should be a column reference (materialise the token array with
    ``withColumn`` first): it is read once per window.
    """
    w = _c(tokens)
    parts = []
    if unigrams:
        parts.append(F.filter(w, lambda x: x.isNotNull()))
    for n in range(min_n, max_n + 1):
        parts.append(ngram_windows(w, n))
    if not parts:
        return F.array().cast("array<string>")
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def index_tokens(text) -> Column:
    """P20 tokens: lower-case words with English stop words as gaps (null)."""
    return stop_gaps(words(text, lower=True))


def index_terms(gapped_tokens, max_shingle: int = 4, unigrams: bool = True) -> Column:
    """P20 terms over ``index_tokens``: unigrams + 2..``max_shingle`` shingles."""
    return shingles(gapped_tokens, 2, max_shingle, unigrams=unigrams)


def nb_ngrams(tokens) -> Column:
    """P19 over ``words(text)``: case kept, unigrams + bigrams."""
    return shingles(_c(tokens), 2, 2, unigrams=True)


# ---------------------------------------------------------------- P21 token predicates
def token_flags(token) -> Column:
    t = _c(token)
    ws = F.split(F.lower(t), " ")
    kw = F.array(*[F.lit(w) for w in K.KEY_WORDS])
    conf = F.array(*[F.lit(w) for w in K.CONFERENCE_WORDS])
    return F.struct(
        F.lower(t).alias("lower"),
        (t == F.upper(t)).alias("is_upper"),
        F.arrays_overlap(ws, kw).alias("is_key_word"),
        F.arrays_overlap(ws, conf).alias("is_conference"),
        t.rlike(r"\d").alias("is_numeric"),
        ((t == F.upper(t)) & (F.length(t) == 1)).alias("is_initial"),
        F.exists(ws, lambda w: w.rlike(r"\d\d\d\d")).alias("has_date"),
    )


# ---------------------------------------------------------------- P1 / P7 XML helpers
#: the document type line after which a layout starts (fixed value)
DTD = '<!DOCTYPE pdf2xml SYSTEM "pdf2xml.dtd">'
#: a character reference: decimal, hexadecimal or named
_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def strip_dtd(xml) -> Column:
    """What stands after the last document type line, without variants of that line."""
    return F.regexp_replace(F.substring_index(_c(xml), DTD, -1), r"<!DOCTYPE pdf2xml[^>]*>", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often and however deep in lambdas
    ``body`` uses it (an expression used inside a lambda is computed anew for every element)."""
    return F.get(F.transform(F.array(value), body), 0)


def xml_unescape(s) -> Column:
    """Character references decoded, each once; unknown names and impossible numbers stay."""
    c = _c(s)
    names = F.create_map(*[F.lit(x) for n, k in sorted({**name2codepoint, "apos": 39}.items()) for x in (n, chr(k))])

    def char(ref: Column) -> Column:
        body = F.substr(ref, F.lit(2), F.length(ref) - 2)
        code = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 8), 16, 10)).when(body.startswith("#"), F.substring(body, 2, 8)).cast("int")
        ok = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        byte = F.unhex(F.lpad(F.hex(code), 8, "0"))
        return F.coalesce(F.when(ok, F.decode(byte, "UTF-32")), F.try_element_at(names, body), ref)

    parts = F.regexp_extract_all(c, F.lit(rf"[^&]+|{_REFERENCE}|&"), 0)
    decoded = F.array_join(F.transform(parts, lambda x: F.when(x.startswith("&") & (F.length(x) > 1), char(x)).otherwise(x)), "")
    return F.when(c.contains("&"), decoded).otherwise(c)


def xml_escape(s) -> Column:
    c = F.replace(_c(s), F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


# ---------------------------------------------------------------- counting within a row
def term_counts(tokens, term: str = "term", cnt: str = "cnt") -> Column:
    """array<struct<term, cnt>> of a token array: the tokens are sorted and the lengths of equal runs taken, so
    a document's terms are counted in its own row, without a shuffle and in linear steps after the sort."""
    def runs(w: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(w["s"]) - 1), lambda i: (i == 0) | (F.get(w["s"], i) != F.get(w["s"], i - 1)))
        zipped = F.struct(w["s"].alias("s"), at.alias("at"))
        return let(zipped, lambda z: F.transform(z["at"], lambda i, k: F.struct(
            F.get(z["s"], i).alias(term), (F.coalesce(F.get(z["at"], k + 1), F.size(z["s"])) - i).cast("long").alias(cnt))))

    none = F.array().cast(f"array<struct<{term}:string,{cnt}:bigint>>")
    return F.when(F.size(_c(tokens)) > 0, let(F.struct(F.sort_array(_c(tokens)).alias("s")), runs)).otherwise(none)


def term_positions(gapped_tokens) -> Column:
    """array<struct<term, tf, positions>> of a token array in which null marks a removed word: where in the
    array (from 0, removed words counted) each word stands, in order."""
    t = F.transform(_c(gapped_tokens), lambda x, i: F.struct(x.alias("term"), i.alias("pos")))
    ordered = F.sort_array(F.filter(t, lambda x: x["term"].isNotNull()))

    def runs(w: Column) -> Column:
        def starts(i: Column) -> Column:
            return (i == 0) | (F.get(w["s"], i)["term"] != F.get(w["s"], i - 1)["term"])

        at = F.when(F.size(w["s"]) > 0, F.filter(F.sequence(F.lit(0), F.size(w["s"]) - 1), starts)).otherwise(F.array().cast("array<int>"))

        def run(z: Column, i: Column, k: Column) -> Column:
            n = F.coalesce(F.get(z["at"], k + 1), F.size(z["s"])) - i
            return F.struct(F.get(z["s"], i)["term"].alias("term"), n.cast("long").alias("tf"),
                            F.transform(F.slice(z["s"], i + 1, n), lambda x: x["pos"]).alias("positions"))

        return let(F.struct(w["s"].alias("s"), at.alias("at")), lambda z: F.transform(z["at"], lambda i, k: run(z, i, k)))

    return let(F.struct(ordered.alias("s")), runs)


# ---------------------------------------------------------------- exploding computed arrays
def explode_rows(df, keep, array_col, alias: str, with_pos: str | None = None):
    """One row per element of a computed array (rows with empty arrays vanish).

    ``explode`` makes Spark infer ``size(array) > 0`` and push that filter below the
    projection that computes the array, which evaluates the array program twice;
    ``explode_outer`` infers nothing, so it is used with a null filter instead."""
    keep = list(keep)
    arr = _c(array_col)
    if with_pos:
        out = df.select(*keep, F.posexplode_outer(arr).alias(with_pos, alias))
    else:
        out = df.select(*keep, F.explode_outer(arr).alias(alias))
    return out.where(F.col(alias).isNotNull())


# ---------------------------------------------------------------- Q3 length norm
def length_norm(length) -> Column:
    """``1/sqrt(length)``."""
    return F.lit(1.0) / F.sqrt(_c(length).cast("double"))
