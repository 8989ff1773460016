"""Small tables with every odd case: nulls, empty and long texts, repeated rows, ties, clashing column names."""

import random

LONG = 30_000

#: Columns named like names that operators use themselves.
CLASHES = ("row", "d", "t", "key", "w", "gone", "node", "listed", "part", "chunk", "body")


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def odd_documents(spark, seed=7, extra=()):
    """(doc_id, text, lang, source, n_chars, *CLASHES): some sixty documents."""
    rng = random.Random(seed)
    base = [words(rng, 120) for _ in range(8)]
    shared = words(rng, 60)
    texts = [" ".join(b) for b in base]
    for b in base[:4]:  # near copies of growing distance, and exact ones
        for edits in (1, 2, 3, 6, 12):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = f"x{rng.randrange(10_000)}"
            texts.append(" ".join(c))
        texts += [" ".join(b), " ".join(b)]
    texts += [" ".join(words(rng, 50) + shared + words(rng, 50)) for _ in range(5)]
    texts += ["Same line.\n" + " ".join(words(rng, 80)) + "\n\n  Same line. \t\nlast" for _ in range(14)]
    texts += [None, "", " \t\n ", "one", "two words", "a b c", "A b C", "a b über 中文 \U0001f600 it's <|endoftext|> x"]
    texts += [" ".join(words(rng, LONG, 10_000)), "y" * 50_000, "z " * 20_000]
    texts += list(extra)
    rows = [(i, t, ("en", "de", None, "xx")[i % 4], f"src{i % 12}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[10], (None, texts[0], "en", "src1", 1), (None, None, None, None, None)]
    rows = [r + tuple(f"{c}{i}" for c in CLASHES) for i, r in enumerate(rows)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", `{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(3)


def nothing(spark):
    return odd_documents(spark).limit(0)
