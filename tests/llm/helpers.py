"""Fixtures for all operators: awkward rows that every operator must take."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """Words by a fixed rule, different for each seed."""
    x, out = seed * 2654435761 % (1 << 32) + 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x >> 8 & 15] + str(x >> 12 & 63))
    return " ".join(out)


def awkward(spark, n: int = 60):
    """Null ids and texts, empty and very long texts, repeated rows and texts, odd spaces, and extra columns with clashing names."""
    rows = [(i, prose(i, 20 + i), "en" if i % 2 else "fr", f"s{i % 3}", 0) for i in range(n)]
    rows += [(n, None, "en", None, None), (n + 1, "", None, "s", 0), (n + 2, " \t\n\x0b ", "fr", "s", 5), (n + 3, "x" * 30_000, "en", "s", 1), (n + 4, prose(7, 5_000), "en", "s", 1)]
    rows += [(n + 5, rows[3][1], "en", "s", 1), (n + 6, rows[3][1], "en", "s", 1), rows[4], rows[4], (None, "no id here", "en", "s", 1), (n + 7, "日本語 ▁ ﬁ é\x00   123", "fr", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'clash' AS score", "1 AS print", "'c' AS shard", "'k' AS kept", "0 AS label", "'p' AS pieces", "'w' AS words")


def empty(spark):
    return awkward(spark).filter("doc_id < -1")


def documents(spark, texts):
    """Texts as documents 0, 1, ..."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
