from citegraph.functions.text import (
    bow_tokens,
    collapse_ws,
    extract_year,
    histogram_bucket,
    index_terms,
    index_tokens,
    stop_gaps,
    jtrim,
    nb_ngrams,
    shingles,
    simplified_title,
    strip_dtd,
    title_id,
    token_flags,
    words,
    xml_escape,
    xml_unescape,
)

__all__ = [
    "bow_tokens", "collapse_ws", "extract_year", "histogram_bucket", "index_terms", "index_tokens", "stop_gaps", "jtrim",
    "nb_ngrams", "shingles", "simplified_title", "strip_dtd", "title_id", "token_flags",
    "words", "xml_escape", "xml_unescape",
]
