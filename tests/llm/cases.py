"""Small tables with every odd case, and plain versions of the text rules."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, run int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows(seed=3):
    """Nulls in every column, empty and long texts, ties, repeated rows, copies, near copies and clashing extra columns."""
    rng = random.Random(seed)
    base, passage = sentence(rng, 120), sentence(rng, 70)
    texts = [None, "", "   \n ", "word", "two words", base, base, base.replace(" ", "  \t"), base.upper(), base + " tail", "x" + base[1:], passage]
    texts += [sentence(rng, 60) + " " + passage + " " + sentence(rng, 50) for _ in range(4)]
    near = base.split()
    for i in range(6):
        copy = list(near)
        copy[17 * i + 3] = f"edit{i}"
        texts.append(" ".join(copy))
    texts += ["été naïve ß 漢字 🙂 " * 30, "De " * 400, "line one\nline one\nline two\n\nline one", sentence(rng, 20_000), "null\x00byte " * 20, "tail\x00" * 20]
    texts += [sentence(rng, rng.randint(1, 90)) for _ in range(20)]
    sources = ["b", "a", None, "é", "z"]
    rows = [(i * 3, t, None if i % 7 == 0 else "en", sources[i % 5], None if i % 5 == 0 else len(t or ""), 0.5, "n", 1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [(15, "another text under an id that is there " * 3, "en", "a", 1, 1.0, "x", 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)
