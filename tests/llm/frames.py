"""Small tables with every awkward case, and columns whose names the operators use inside."""

import random

DOC_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, node long, key string, digest string, n int, "
    "words int, kept boolean, component_id long, units string, unit int, row long, word string, block int, task int"
)


def odd_docs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    plain = " ".join(rng.choice(words) for _ in range(80))
    texts = [
        (1, plain, "en", "a"),
        (1, plain, "en", "a"),  # a repeated row
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \t\n ", "en", None),
        (5, plain.upper(), None, "b"),
        (6, long, "fr", "b"),
        (7, "x" * 5000, "fr", "b"),
        (8, "a b a b a b " * 200, "en", "a"),
        (9, "Été à la plage. " * 3 + plain, "fr", "a"),
        (None, plain + " tail", "en", "a"),
        (None, None, None, None),
        (11, "one", "en", "a"),
        (12, "one", "en", "a"),
    ]
    rest = (1, "k", "d", 1, 1, True, 5, "u", 1, 1, "w", 1, 1)
    return spark.createDataFrame([(i, t, lang, source, 7, *rest) for i, t, lang, source in texts], DOC_SCHEMA)


def no_docs(spark):
    return odd_docs(spark).where("doc_id > 1000")


def table(spark, name, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
