"""Small fixtures with the awkward cases: nulls, empty and long texts, ties, repeats."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven small wizards box quietly under old bridges near rivers and mills".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def documents() -> list[tuple]:
    texts = [prose(k, 30 + 7 * k) for k in range(24)]
    texts += [texts[3], texts[3], texts[5] + " tail", None, "", "   \n\t ", "one", "one two", "ÄÖ ünïcode ☃ 漢字 " + prose(90, 25), prose(91, 6000), "line a b\nline a b\n\nline a b\n" + prose(92, 20)]
    texts += ["x " * 60, "### *** $$$ " * 30]
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 4}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]
    return [*rows, rows[4], (None, prose(93, 40), None, None, None), (None, None, None, None, None)]


def frame(spark, rows=None, schema=DOC):
    return spark.createDataFrame(documents() if rows is None else rows, schema)
