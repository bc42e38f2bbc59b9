import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, spans string, kind int"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 30)) for _ in range(n))


def awkward(spark, more=()):
    """Nulls in every column, empty and long texts, repeated rows, columns whose names clash with results."""
    draw = random.Random(5)
    long_text = sentence(draw, 4000)
    texts = [None, "", " ", "a", "one two", sentence(draw, 60), sentence(draw, 60), long_text, long_text + " tail", "naïve café 漢字 😀 'tis it's", "\x1c\x85 odd spaces ​"]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t) if t else None, 7, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[5], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [(100 + i, t, "en", "s0", len(t), 0, "", 0) for i, t in enumerate(more)]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
