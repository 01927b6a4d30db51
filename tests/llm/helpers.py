"""Small documents with the awkward cases: nulls, empty and long texts, ties,
repeated rows and columns with clashing names."""

import random
import re

from pyspark.sql import types as T

WS = " \t\n\x0b\x0c\r"
SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()),
                                      ("key", T.StringType()), ("size", T.LongType()), ("h", T.LongType()), ("tk", T.LongType()), ("root", T.StringType()))]
)


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def sentence(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def rows(n=60, seed=3):
    """(doc_id, text, lang, source): random texts, exact and near copies, lines and
    passages that many share, and the awkward ones."""
    r = random.Random(seed)
    line, passage = "Read More  here", sentence(r, 40)
    out = []
    for i in range(n):
        text = sentence(r, r.choice([3, 20, 60, 120, 200]), 5000)
        if i % 3 == 0:
            text += "\n  " + (line.upper() if i % 2 else line) + "\t"
        if i % 7 == 0:
            text = text[: len(text) // 2] + " " + passage + " " + text[len(text) // 2 :]
        if i % 10 == 4 and out[i - 1][1]:
            text = out[i - 1][1] + "  "
        if i % 10 == 6 and out[i - 1][1]:
            w = out[i - 1][1].split(" ")
            text = " ".join(w[:-1] + ["changed"])
        out.append((i, text, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", "c", None])))
    out += [(n, None, "en", "a"), (n + 1, "", None, None), (n + 2, " \n\t", "de", "b"), (n + 3, "é" * 70 + " ñandú", "en", "b")]
    out += [(n + 4, sentence(r, 6000, 50) + "\n" * 50, "en", "a"), (None, out[1][1], "en", "a"), (None, None, None, None)]
    out += [out[2], out[2], (n + 5, "%%% " * 80, "en", "a"), (n + 6, "\n".join(["same line here"] * 30), "en", "a")]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*x, None, "k", 7, 8, 9, "root") for x in data], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
