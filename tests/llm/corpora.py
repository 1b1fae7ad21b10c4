"""Small corpora with the odd cases: nulls, empty and long texts, repeated rows, copies, clashing columns."""

import random

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") + rng.choice(["", "", "", "é", "ß"]) for _ in range(n))


def corpus(seed=3, n=60):
    """(doc_id, text, lang, source, n_chars) rows; ids are unique but for two rows that repeat one, and one null."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([0, 1, 3, 4, 19, 20, 21, 60, 200])) for _ in range(n)]
    passage, line = prose(rng, 45), "Released under the MIT License."
    for i in range(0, n, 5):
        texts[i] = prose(rng, 30) + " " + passage + "\n" + line + "\n" + prose(rng, 10)
    texts += [texts[0]] * 6 + [texts[5] + " tail", "Start " + texts[5], texts[10].upper()]
    texts += [None, "", "   \n\t ", "x" * 30_000, prose(rng, 6_000), "a a a a a a a a a " * 40, "na me ▁   🙂 漢字 '' <|endoftext|> <s>", prose(rng, 25) + " " + " ".join(["w1 w2 w3"] * 30)]
    rows = [(i * 3 + 1, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], rows[0], (None, texts[5], "en", "s1", 1)]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    """The rows in five partitions, with columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.selectExpr("*", "'x' as n_words", "1 as fp", "2 as kept", "'b' as block", "3 as pack", "4 as h", "5 as start", "6 as key", "7 as component_id", "8 as row", "9 as w")


def key(x):
    return (x is None, x or 0)
