"""Small tables for the operators: every awkward case, and random texts with copies."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, rid long, sha string, chunk long, lang_pred string, n long"


def _row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), True, 0.5, 7, "x", 3, "zz", 9)


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    words = [f"w{k}" for k in range(400)]
    r = random.Random(1)
    long = " ".join(r.choice(words) for _ in range(5000))
    rows = [
        _row(1, None),
        _row(2, ""),
        _row(3, " \t\n\x0b\x0c\r "),
        _row(4, "one"),
        _row(5, "one two  three\n\n  four five six"),
        _row(6, "one two three four five six"),
        _row(7, long, "fr", None),
        _row(8, long, None, "b"),
        _row(9, long + " end", "de", "b"),
        _row(10, "é ß 日本語 🙂 \x00 a\x1cb <|endoftext|>", "es", "c"),
        _row(11, "same text of nine words that is twice there", "en", "c"),
        _row(11, "same text of nine words that is twice there", "en", "c"),
        _row(11, "another text under the same id", None, None),
        _row(None, "a text without an id", None, None),
        _row(None, "a text without an id", None, None),
        _row(None, None, None, None),
        _row(12, "12345 67 !!! ###", "en", "d"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def random_texts(seed: int, n: int = 120, vocabulary: int = 60, length: int = 60) -> list[tuple[int, str, str, str]]:
    """(doc_id, text, lang, source) with exact copies, edited copies and shared passages."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 8))) for _ in range(vocabulary)]
    passage = " ".join(r.choice(words) for _ in range(40))
    out: list[tuple[int, str, str, str]] = []
    for k in range(n):
        roll = r.random()
        if out and roll < 0.2:
            text = r.choice(out)[1]
        elif out and roll < 0.5:
            w = r.choice(out)[1].split(" ")
            for _ in range(r.randint(1, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
            text = " ".join(w)
        else:
            text = " ".join(r.choice(words) for _ in range(r.randint(0, length)))
            if roll > 0.85:
                text = f"{text}\n{passage}\n{text[:30]}"
        out.append((k * 3 % 1000 + k // 1000, text, r.choice(["en", "fr"]), r.choice("aaab")))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
