"""Schemas of the store's tables."""

from pyspark.sql import types as T

SEEDS = T.StructType([T.StructField("url", T.StringType())])
PENDING = SEEDS
PAGES = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("crawled_at", T.TimestampType()),
        T.StructField("is_indexed", T.BooleanType()),
        T.StructField("headers", T.ArrayType(T.BooleanType())),
        T.StructField("last_indexed", T.TimestampType()),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("page_rank", T.DoubleType()),
    ]
)
POSTINGS = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("frequency", T.IntegerType()),
        T.StructField("tf", T.DoubleType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
        T.StructField("headers", T.ArrayType(T.BooleanType())),
        T.StructField("snippets", T.ArrayType(T.StringType())),
    ]
)
TERM_STATS = T.StructType([T.StructField("term", T.StringType()), T.StructField("df", T.IntegerType()), T.StructField("idf", T.DoubleType())])
EDGES = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())])
RESULTS = T.StructType([T.StructField(n, T.StringType()) for n in ("term", "url", "title", "snippet", "id")] + [T.StructField("score", T.DoubleType())])
