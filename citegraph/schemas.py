"""Explicit schemas of the record types (no inference at read time)."""

from pyspark.sql import types as T

AUTHOR_NAMES = T.ArrayType(T.StringType())

CITATION = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("authors", T.ArrayType(AUTHOR_NAMES)),
    T.StructField("conference", T.StringType()),
])

DOCUMENT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("xml", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("outgoing", T.ArrayType(CITATION)),
    T.StructField("incoming", T.ArrayType(CITATION)),
])

EDGE = T.StructType([
    T.StructField("citing_id", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("cited_title", T.StringType()),
    T.StructField("cited_id", T.LongType()),
    T.StructField("authors", T.ArrayType(AUTHOR_NAMES)),
])

NODE = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("top", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("font_id", T.IntegerType()),
    T.StructField("bold", T.BooleanType()),
    T.StructField("font_size", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

QUERY = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("must", T.ArrayType(T.StringType())),
    T.StructField("must_not", T.ArrayType(T.StringType())),
    T.StructField("phrase", T.BooleanType()),
])
