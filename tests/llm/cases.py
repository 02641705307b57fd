"""Documents with everything that may be odd in a table."""

import random

NAMES = "doc_id long, text string, lang string, source string, n_chars long, n long, block string, digest string, size string, fp long, chunk long, target string, __x long"


def rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "und", "the", "le", "ñandú", "straße", "Zeta.", "eta!", "theta?"]
    texts = [
        None, None, "", " \t\n", "a", "a b", "a  b", "a b c", "A B C", "x y z. " * 3, "long " * 9000, "é" * 5000, "😀 emoji 😀", "line\r\nline\x0b\x0c", "\x1c\x85\xa0",
        "<|endoftext|> token", "Σας ΣΑΣ", "12345 67890", "same text here", "same  text here", "same text here",
    ]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    base = " ".join(rng.choice(words) + str(k) for k in range(400))
    texts += [base + f" tail{k}" for k in range(12)]
    out = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None, "é"]), None, k, "b", "d", "s", k, k, "t", k) for k, t in enumerate(texts)]
    out += [out[5], out[5], (None, "no id", None, None, None, *[None] * 8), (500, None, None, None, None, *[None] * 8)]
    return out


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, NAMES).repartition(3)


def empty(spark):
    return spark.createDataFrame([], NAMES)
