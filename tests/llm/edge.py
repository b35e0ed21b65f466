"""A small table with everything awkward: nulls, empty and long texts, repeated rows, copies, clashing extra columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       T.StructField("key", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("row", T.StringType()), T.StructField("label", T.LongType()), T.StructField("node", T.StringType()), T.StructField("size", T.StringType())])
WORDS = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(300)]


def texts():
    plain = " ".join(WORDS[i * 17 % 300] for i in range(120))
    near = plain.replace(WORDS[17 * 60 % 300], "other")
    long = " ".join(f"{WORDS[i % 300]}{i}" for i in range(60_000))
    return [(1, plain), (2, plain), (3, near), (4, near), (4, near), (5, None), (6, ""), (7, "   \n \t "), (8, "one two"), (9, "One  TWO"), (10, "a"), (None, plain), (None, None), (None, "lost and found here"),
            (11, long), (12, "a" * 3000), (13, "\n".join(["same line here"] * 200)), (14, "x"), (14, "y"), (15, "日本語 のテキスト です 。" * 60), (16, " lead  and  trail "), (17, "tab\tand\nline \n\n end"), (18, "<|endoftext|> inside <|endoftext|>")]


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(d, t, ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4], None if t is None else len(t), "k", i, "r", i, None, "s") for i, (d, t) in enumerate(rows)], SCHEMA)


def documents(name="sf0.001"):
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/{name}/documents.parquet' ORDER BY doc_id").fetchall()
