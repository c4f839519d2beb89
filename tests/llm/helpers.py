from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("node", T.StringType()), T.StructField("tokens", T.StringType())])


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "hot", "x", "y") for i, t in rows], DOCS).repartition(3)


LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "Größe ÀÉ ß, l’été 東京 😀"), (5, "a second row of id five"), (None, "no id here"), (None, None), (6, LONG), (7, LONG), (7, LONG), (8, "x" * 5000)]
