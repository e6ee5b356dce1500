"""A small fixture with the awkward rows, written as the tables a query reads."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n", "a", "The quick, brown fox.", "The quick, brown fox.", "don't  stop   now \n\n\n x  ", "naïve Élan ǅ ñandú İstanbul", "x" * 5000,
    "tab\tand nbsp  wide", "<|endoftext|> kept <|startoftext|>", "12345 67 8", "!!! ### $$$ %%%", "é combining", "中文 字符", "😀 emoji", "word " * 3000, "a\r\nb\r\nc",
]


def docs(spark, texts=ODD, langs=None, ids=None):
    rows = [(i if ids is None else ids[i], t, (langs[i] if langs else "en"), "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def folder(spark, tmp_path, texts=ODD, langs=None, **tables):
    at = f"{tmp_path}/sf"
    docs(spark, texts, langs).write.parquet(f"{at}/documents.parquet")
    for name, df in tables.items():
        df.write.parquet(f"{at}/{name}.parquet")
    return at
