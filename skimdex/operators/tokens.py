"""Code tokens of TypeScript sources, from the text that :mod:`skimdex.operators.lexer`
masks: inside literals there are only ``_``, comments are blanks, so one pattern finds
the tokens and every bracket is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skimdex.operators import lexer as L

FILE_KEYS = ["target_dir", "path"]
TOKEN_RE = r"\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`|=>|\.\.\.|[A-Za-z_$][A-Za-z0-9_$]*|[0-9][0-9A-Za-z_.]*|[^\sA-Za-z0-9_$]"
OPENERS = ["{", "(", "["]
CLOSERS = ["}", ")", "]"]


def code_tokens(files: DataFrame) -> DataFrame:
    """``(target_dir, path, pos, tok)``: the masked code tokens of every file, in order."""
    code = L.lexed(F.col("content"), L.is_jsx(F.col("path")), depths=L.DEPTHS)[f"d{L.DEPTHS - 1}"]
    tokens = F.regexp_extract_all(code, F.lit(TOKEN_RE), F.lit(0))
    return files.select(*FILE_KEYS, F.posexplode(tokens).alias("pos", "tok"))


def _depths(tokens: Column) -> Column:
    """Greatest depth of a token and depth at the end, over a file's tokens in order."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, t: Column) -> Column:
        now = s["now"] + F.when(t.isin(OPENERS), 1).when(t.isin(CLOSERS), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], F.least(now, s["now"])).alias("most"))

    return F.aggregate(tokens, start, step)


def token_stats(files: DataFrame) -> DataFrame:
    """Per file: token count, words, greatest and final depth, ``balanced`` and
    ``suspect``. Rows stay where they are: nothing is shuffled."""
    lexed = L.lexed(F.col("content"), L.is_jsx(F.col("path")), depths=L.DEPTHS)
    t = files.select(*FILE_KEYS, lexed.alias("x"))
    toks = F.regexp_extract_all(F.col(f"x.d{L.DEPTHS - 1}"), F.lit(TOKEN_RE), F.lit(0))
    t = t.select(*FILE_KEYS, toks.alias("toks"), F.col("x.suspect").alias("suspect"))
    # Out of a generator, so that the filter doesn't lex the text a second time.
    t = t.select(*FILE_KEYS, "suspect", F.explode_outer(F.array("toks")).alias("toks"))
    t = t.filter(F.size("toks") > 0).withColumn("d", _depths(F.col("toks")))
    return t.select(
        *FILE_KEYS,
        F.size("toks").cast("bigint").alias("n_tokens"),
        F.size(F.filter("toks", lambda t: t.rlike("^[A-Za-z_$]"))).cast("bigint").alias("n_words"),
        F.col("d.most").alias("max_depth"),
        F.col("d.now").alias("final_depth"),
        (F.col("d.now") == 0).alias("balanced"),
        "suspect",
    )
