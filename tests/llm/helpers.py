"""Small hostile tables and brute-force versions that the operator tests share."""

import random


def write(spark, rows, schema, path, name):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def prose(rng, n, words="the of and river stone garden light winter paper number letter music window open near far".split()):
    return " ".join(rng.choice(words) + str(rng.randint(0, 9)) * rng.randint(0, 1) for _ in range(n))


def hostile_docs():
    """(doc_id, text, lang, source): nulls, empties, blanks, repeats, one long text, marks of all kinds."""
    rng = random.Random(11)
    long = "\n".join(prose(rng, 12) for _ in range(400))
    shared = "This very line of text stands in many documents of the table."
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, long, "en", "a"), (5, long, "en", "b"),
        (6, long + " tail", "de", "a"), (7, "one two", "de", None), (8, "ONE two", "de", "a"), (9, "!!! ### $$$", "fr", "a"),
        (10, "Été à la plage 日本 😀", "fr", "b"), (11, "x" * 5000, None, "b"),
    ]
    rows += [(20 + k, f"{prose(rng, 30)}\n  {shared.upper() if k % 2 else shared}\t\n{prose(rng, 25)}", "en", "a" if k < 9 else "b") for k in range(12)]
    rows += [(40, prose(random.Random(40), 60), "en", "a")] * 2
    return rows
