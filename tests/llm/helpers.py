"""Small tables with every awkward case, and SQL results to hold queries against."""

import random


def awkward(spark, n=60, seed=1, kind="long"):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""
    rng = random.Random(seed)
    words = ["the", "of", "alpha", "beta", "gamma", "delta", "omega", "Sigma", "tau", "x1", "it's", chr(0xE9) + "t" + chr(0xE9)]
    passages = [" ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(0, 5))]
        text = rng.choice(["\n", ". ", "\n\n", "  "]).join(parts)
        if rng.random() < 0.2 and rows and rows[-1][1]:
            text = rows[-1][1] if rng.random() < 0.5 else rows[-1][1] + " tail"
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "b", None]), len(text), i, "k"))
    rows += [(None, "null id " * 9, "en", "src0", 5, 1, "k"), (None, None, None, None, None, None, None), (n, "", "en", "src1", 0, 1, "k"), (n + 1, None, "en", "src1", 3, 1, "k")]
    rows += [(n + 2, "word " * 3000 + "\n" + passages[0], "en", "src0", 15000, 1, "k")] + [(n + 3, passages[1] + ". Again and again it is. " + passages[2], "en", "src0", 300, 1, "k")] * 3
    if kind == "string":
        rows = [(None if r[0] is None else str(r[0]), *r[1:]) for r in rows]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string, n_chars long, node long, kept string").repartition(3)


def empty(df):
    return df.limit(0)


def duck(sql, **tables):
    """Rows of SQL over Spark tables."""
    import duckdb

    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    found = con.sql(sql)
    return found.columns, found.fetchall()


def same(df, sql, **tables):
    columns, want = duck(sql, **tables)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    norm = lambda x: round(x, 9) if isinstance(x, float) else list(x) if isinstance(x, (list, tuple)) else x
    got = sorted((tuple(norm(x) for x in r) for r in df.select(*columns).collect()), key=key)
    assert got == sorted((tuple(norm(x) for x in r) for r in want), key=key)
    return len(got)
