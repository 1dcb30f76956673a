import random

import pytest

WORDS = "der wald steht still und the river runs under stone la casa es grande le ciel est bleu orange lantern quiet mountain".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("" if r.random() < 0.9 else r.choice([",", ".", "\n"])) + str(r.randrange(60)) * (r.random() < 0.3) for _ in range(n))


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source): copies, near copies, a long text, nulls and empty texts, repeated rows, other scripts."""
    rows = [(i, prose(i, 40 + i * 7), ["en", "de", None, "fr"][i % 4], f"s{i % 3}") for i in range(24)]
    base = prose(99, 200)
    near = base.split(" ")
    rows += [(30, base, "en", "s0"), (31, base, "de", None), (32, " ".join([*near[:-3], "changed", "end"]), "en", "s0"), (33, " ".join(["front", *near]), None, "s1")]
    rows += [(40, None, "en", "s0"), (41, "", "en", "s0"), (42, " \n\t ", None, "s2"), (43, "12 34 !!", "de", "s1"), (44, "one", "en", "s0"), (45, "one", "en", "s0")]
    rows += [(50, prose(7, 30_000), "en", "s0"), (51, "Привет мир, это текст. " * 30, "de", "s2"), (52, "漢字かな交じり文です。" * 20, None, "s2"), (53, "x" * 70_000, "en", "s0"), (54, "naïve café bar line \U0001f600 é", "fr", "s1")]
    rows += [(55, "foo<|endoftext|>bar <|StartOfText|> x<|startoftext|>'ll", None, "s1")]
    rows += [(60, rows[3][1], "fr", "s0"), (60, rows[3][1], "fr", "s0"), (None, prose(5, 90), "en", "s0"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def sf_dir(spark, docs, empty, tmp_path_factory):
    """A folder with documents and the tables that queries read beside it, with columns whose names operators use."""
    from pyspark.sql import functions as F

    d = str(tmp_path_factory.mktemp("sf"))
    names = "ids tokens id a b node hub size shard slot start score held part kept row_key secrets body lang_pred drop_id terms n_words txt contaminated".split()
    wide = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    wide.select("*", *(F.lit(1).alias(n) for n in names)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(prose(9, 60).split()[10:40])), (2, "zz yy xx"), (3, None), (4, ""), (2, "again")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "u", "<p>x</p>"), (2, None, None), (3, "", "")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    e = str(tmp_path_factory.mktemp("empty"))
    empty.write.parquet(f"{e}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{e}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{e}/pages.parquet")
    return d, e
