"""Language identification as a Spark job: character-trigram profiles.

Training counts trigrams per language on labelled text (hash aggregate with
partial aggregation). A document's score for language l is
    Σ_g count(d, g) · log((c(l, g) + 1) / (C_l + V))
with add-one smoothing (C_l = trigrams seen for l, V = distinct trigrams).
The profile is pivoted to one row per trigram with one column per language,
so scoring is a single join (broadcast when the profile is under a checked
size) followed by an aggregate per document. Above that size a document's
trigrams are counted first, so the join carries each distinct one once, and
adaptive execution splits the frequent trigrams. Ties go to the alphabetically
first language; a text none of whose trigrams was seen in training is not
identified (null), which the English gate then treats as not English.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.operators.lookup import at_most
from litspark.session import stage_table

GRAM = 3
# Broadcast bound for the pivoted profile, in cells (trigrams × (languages + 1)):
# about 4M doubles ≈ 32 MB, whatever the number of languages.
MAX_BROADCAST_CELLS = 4_000_000


def normalised(c):
    """Lower-case, whitespace runs → one space, padded with a space each side."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"(?U)\s+", " "), F.lit(" "))


def char_grams(c, n: int = GRAM):
    """Every run of ``n`` characters of the normalised text, in order.

    A zero-width lookahead with a capture yields each start position in one
    regex pass over the text.
    """
    return F.regexp_extract_all(normalised(c), F.lit(f"(?s)(?=(.{{{n}}}))"), 1)


class LanguageProfile:
    def __init__(self, langs: list[str], grams: DataFrame, log_denominator: dict[str, float]):
        self.langs = langs
        self.grams = grams
        self.log_denominator = log_denominator


def train_profile(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageProfile:
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.explode(char_grams(F.col(text_col))).alias("gram"))
    # Model-sized (languages × distinct trigrams); read four times below.
    counts = stage_table(rows.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c")), "trigrams")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("c")).collect()}
    n_grams = counts.select("gram").distinct().count()
    log_den = {l: math.log(totals[l] + n_grams) for l in langs}
    wide = (counts.withColumn("lc", F.log(F.col("c") + 1))
                  .groupBy("gram").pivot("lang", langs).agg(F.first("lc")))
    wide = wide.select("gram", *[F.coalesce(F.col(l), F.lit(0.0)).alias(f"lc_{l}") for l in langs])
    return LanguageProfile(langs, stage_table(wide, "language-profile"), log_den)


def detect_language(df: DataFrame, profile: LanguageProfile, text_col: str = "text",
                    id_col: str = "doc_id", out_col: str = "detected_lang") -> DataFrame:
    """(id, detected language) for every id of ``df``; null where no trigram was seen
    in training (null, empty and very short texts, other scripts, an empty profile)."""
    if not profile.langs:
        return df.select(id_col, F.lit(None).cast("string").alias(out_col))
    grams = df.select(id_col, F.explode_outer(char_grams(F.col(text_col))).alias("gram"))
    max_grams = max(1, MAX_BROADCAST_CELLS // (len(profile.langs) + 1))
    if at_most(profile.grams, max_grams):
        joined = grams.withColumn("_n", F.when(F.col("gram").isNotNull(), 1).otherwise(0)).join(
            F.broadcast(profile.grams), "gram", "left")
    else:
        joined = grams.groupBy(id_col, "gram").agg(F.count("gram").alias("_n")).join(profile.grams, "gram", "left")
    hit = F.col(f"lc_{profile.langs[0]}").isNotNull()
    sums = [F.sum(F.col("_n") * F.coalesce(F.col(f"lc_{l}"), F.lit(0.0))).alias(f"s_{l}") for l in profile.langs]
    per_doc = joined.groupBy(id_col).agg(F.sum("_n").alias("_t"), F.max(hit).alias("_hit"), *sums)
    scores = F.array(*[F.col(f"s_{l}") - F.col("_t") * F.lit(profile.log_denominator[l]) for l in profile.langs])
    best = F.element_at(F.array(*[F.lit(l) for l in profile.langs]),
                        F.array_position(scores, F.array_max(scores)).cast("int"))
    return per_doc.select(id_col, F.when(F.col("_hit"), best).alias(out_col))


def with_language(df: DataFrame, profile: LanguageProfile, text_col: str = "abstract", id_col: str = "paper_id",
                  out_col: str = "lang") -> DataFrame:
    """``df`` with the identified language of ``text_col`` (null where identification
    fails); ``id_col`` must be unique."""
    found = detect_language(df, profile, text_col, id_col, out_col)
    return df.join(found, id_col, "left")
