"""Search tokens, made in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a token is, and words that are none.
TOKEN = "[a-z0-9]+|[가-힣]+|[぀-ヿ一-鿿]+"
STOPWORDS = """
a an the and or but if then than of to in on at by for with from into onto over under about as is are was were
be been being this that these those it its we our us you your they their them he she his her i me my
do does did done can could may might must shall should will would not no nor so such too very via per
which who whom whose what when where why how all any both each few more most other some own same only
also just there here up down out off again further once between through during before after above below
using use used based paper propose proposed proposes approach method methods new novel show shows shown
""".split()


def _ascii_word(t: Column) -> Column:
    """Whether a token is of ASCII letters alone: it starts with one and holds no digit."""
    return t.between("a", "zz") & (F.translate(t, "0123456789", "") == t)


def stem(t: Column) -> Column:
    """Plural endings of ASCII words are cut: ies to y, sses to ss, and a single s."""
    n = F.length(t)
    cut = F.when(t.endswith("ies") & (n > 4), F.concat(F.left(t, n - 3), F.lit("y"))).when(t.endswith("sses"), F.left(t, n - 2))
    cut = cut.when(t.endswith("s") & ~t.endswith("ss") & ~t.endswith("us") & ~t.endswith("is"), F.left(t, n - 1)).otherwise(t)
    return F.when((n > 3) & t.endswith("s") & _ascii_word(t), cut).otherwise(t)


def _is_token(t: Column) -> Column:
    return ((F.length(t) > 1) | t.between("0", "9")) & ~t.isin(STOPWORDS)


def _found(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), 1)


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; single characters other than digits and stop words are left out; null gives none."""
    return F.transform(F.filter(_found(text), _is_token), stem)


def token_rows(df: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """(key, term): the tokens of a text as rows, under one key column or several. Unlike ``tokens`` all that is done to one is compiled code."""
    keys = [key] if isinstance(key, str) else key
    return df.select(*keys, F.explode(_found(F.col(text))).alias("_t")).where(_is_token(F.col("_t"))).select(*keys, stem(F.col("_t")).alias("term"))
