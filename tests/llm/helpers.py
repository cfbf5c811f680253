"""Small tables with the awkward cases every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, **extra):
    rows = [(i, t, extra.get("lang", "en"), f"s{i % 7}", len(t) if t else 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, odd bytes."""
    long = "lorem ipsum " * 20_000
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, long, "en", "a", len(long)), (4, long, "en", "a", len(long)),
        (5, "one", None, "b", 3), (6, "é\x00ß 😀 ñ", "de", "b", 8), (6, "é\x00ß 😀 ñ", "de", "b", 8), (7, "a" * 5000, "en", "c", 5000), (None, "no id", "en", "c", 5),
    ]
    return spark.createDataFrame(rows, DOCS)


def widened(df):
    """Columns whose names clash with those the operators make inside: all that their sources name."""
    import re
    from pathlib import Path

    import chronoscape.llm
    from pyspark.sql import functions as F

    taken, names = {c.lower() for c in df.columns}, {}
    for path in sorted(Path(chronoscape.llm.__path__[0]).glob("*.py")):
        for name in re.findall(r"""["']([A-Za-z_][A-Za-z0-9_]*)["']""", path.read_text()):
            if name.lower() not in taken and name not in ("turn", "role", "conv_id"):
                taken.add(name.lower())
                names[name] = F.lit(1)
    private = {f"__{c}": F.lit(2) for c in ("gone", "doc", "row", "n", "id", "hash", "drop", "cut", "lines", "removed")}
    return df.select("*", *[c.alias(n) for n, c in (names | private).items()])
