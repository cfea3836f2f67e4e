"""Declared schemas; nothing is inferred from data."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


LAW_CHUNK = _strings("LawCode", "ArticleNumber", "Text")
PAIR = _strings("law", "article", "ru", "ky")
PROMPT_ANSWER = _strings("context", "answer")
REQUEST = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("direction", T.StringType()),
    T.StructField("text", T.StringType()),
])
SESSION_LINE = T.StructType([
    T.StructField("session", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("line", T.StringType()),
])
