"""Small inputs of the tests of this folder."""

from pyspark.sql import types as T

SF_DIR = "/root/testdata/sf0.001"
DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def documents(spark, texts, first=0):
    """Documents with ids from ``first``; a text may be (id, text) or (id, text, source)."""
    rows = []
    for i, t in enumerate(texts):
        row = t if isinstance(t, tuple) else (first + i, t)
        text = row[1]
        rows.append((row[0], text, "en", row[2] if len(row) > 2 else "s", None if text is None else len(text)))
    return spark.createDataFrame(rows, DOCUMENT)


def components_of(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}
