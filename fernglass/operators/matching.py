"""Which texts contain which forms, by grams instead of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the piece of a form that texts are looked up by.
GRAM = 3
#: Forms that each text is held against, and characters of forms that are sent to every task.
FEW, SMALL = 64, 1_000_000


def _pieces(text: str, lengths: list[int]):
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % n), F.lit(1)) for n in lengths])))


def containing(texts: DataFrame, forms: DataFrame, *, key: str, text: str, form: str) -> DataFrame:
    """key and the columns of forms, for texts (key, text) that contain the form. Empty forms and null texts match nothing.

    Few forms are sent to every task, where each text is held against each of them: that is less than a text has pieces.
    Otherwise a text has pieces of GRAM characters, and of as many as shorter forms have; those that a form has too are counted
    over all texts. A form waits under its piece that fewest texts have (all of it, if it is no longer than GRAM), and
    texts ask for their pieces, so a pair meets once and only where it may match: a common beginning that many forms share
    is nothing they are looked up by. Only keys travel with the pieces; texts come back for pairs that met. Forms are sent
    to every task while they are small, which is counted; texts never are, whatever their files' size makes Spark expect.
    """
    forms = forms.where(F.length(form) > 0)
    size = F.least(F.length(form), F.lit(GRAM))
    counted = forms.groupBy(size.alias("n")).agg(F.count("*").alias("k"), F.sum(F.length(form)).alias("chars")).collect()  # GRAM rows at most
    lengths, rows, chars = sorted(r.n for r in counted), sum(r.k for r in counted), sum(r.chars for r in counted)
    if not lengths:
        return texts.select(key).limit(0).join(forms, F.lit(False))
    if rows <= FEW and chars <= SMALL:
        return texts.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(forms), F.col("_text").contains(F.col(form))).select(F.col("_key").alias(key), *forms.columns)
    small = chars + 100 * rows <= SMALL
    sent = F.broadcast if small else (lambda df: df.hint("merge"))
    own = forms.select(form).distinct()
    # forms of GRAM characters or less are their own piece
    of_forms = own.select(form, F.explode(F.when(F.length(form) <= GRAM, F.array(form)).otherwise(_pieces(form, [GRAM]))).alias("_gram"))
    asked = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.explode(_pieces(text, lengths)).alias("_gram"))
    found = asked.join(sent(of_forms.select("_gram").distinct()), "_gram", "left_semi")
    many = found.groupBy("_gram").agg(F.count("*").alias("_n"))
    # a piece that no text has is no row here: its form is in no text
    rarest = of_forms.join(many.hint("merge"), "_gram", "left").groupBy(form).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_r")).where("_r.n > 0").select(F.col(form).alias("_form"), F.col("_r._gram").alias("_gram"))
    # pairs meet by the form alone; rows that share it come in for pairs that match
    met = asked.join(sent(rarest), "_gram").drop("_gram")
    whole = texts.select(F.col(key).alias("_k"), F.col(text).alias("_text")).hint("merge")
    both = met.join(whole, F.col("_key") == F.col("_k")).where(F.col("_text").contains(F.col("_form"))).select("_key", "_form")
    both = both.join(sent(forms), F.col("_form") == F.col(form))
    return both.select(F.col("_key").alias(key), *forms.columns)
