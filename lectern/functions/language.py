"""Language and subject labels from small word lists, evaluated row by row in the JVM.

The lists are bounded by the code, so they are literals of the expression: labelling a text
needs no join and no shuffle. Better models can be plugged in where a `Classifier` is taken.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import DEFAULTS, REPLY_LANGUAGES
from lectern.functions.text import bind, strip, strip_ends

# Frequent function words per language (our own short profiles).
STOP_WORDS: dict[str, tuple[str, ...]] = {
    "ar": ("في", "من", "على", "إلى", "عن", "هذا", "هذه", "التي", "الذي", "ما", "هو", "هي"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "von",
           "mit", "sich", "auf", "für", "im", "dem", "wie", "was"),
    "en": ("the", "of", "and", "to", "is", "that", "it", "for", "was", "on", "are", "with",
           "as", "by", "this", "from", "what", "how"),
    "es": ("el", "los", "las", "que", "en", "por", "para", "con", "una", "del", "como",
           "se", "lo", "más", "y", "es"),
    "fr": ("le", "les", "des", "et", "est", "que", "dans", "pour", "qui", "une", "du", "pas",
           "sur", "avec", "ou", "sont", "au", "ce"),
    "it": ("il", "di", "che", "per", "non", "sono", "della", "gli", "nel", "alla", "come", "più"),
    "pt": ("não", "uma", "os", "dos", "das", "em", "ao", "pelo", "são", "mais", "com", "você"),
}

# Words that point to a course subject (our own short table).
SUBJECT_WORDS: dict[str, tuple[str, ...]] = {
    "Biology": ("cell", "cells", "protein", "gene", "organism", "species", "cellule"),
    "Chemistry": ("molecule", "reaction", "acid", "organic", "atom", "bond", "molécule"),
    "Computer Science": ("algorithm", "python", "function", "loop", "variable", "recursion",
                         "algorithme", "boucle", "fonction"),
    "Linear Algebra": ("matrix", "vector", "eigenvalue", "basis", "matrice", "vecteur"),
    "Physics": ("force", "energy", "velocity", "quantum", "énergie", "vitesse"),
    "Statistics": ("probability", "variance", "sample", "regression", "probabilité"),
}


def words(c: Column) -> Column:
    """Lower-case words: runs of letters."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: w != "")


def most_hits(c: Column, profiles: Mapping[str, Sequence[str]], otherwise: str) -> Column:
    """The label whose word list matches the most words; equal counts go to the first label."""

    def hits(word_array: Column, listed: Sequence[str]) -> Column:
        return F.size(F.filter(word_array, lambda w: w.isin(*listed)))

    def votes(word_array: Column) -> Column:
        # counts are negated, so array_min finds the most hits and then the first label
        counted = [
            F.struct((-hits(word_array, listed)).alias("votes"), F.lit(label).alias("label"))
            for label, listed in sorted(profiles.items())
        ]
        return bind(
            F.array_min(F.array(*counted)),
            lambda best: F.when(best["votes"] < 0, best["label"]).otherwise(F.lit(otherwise)),
        )

    # most words are on no list, so one look at each leaves few for the lists of the labels
    listed = sorted({w for words_of in profiles.values() for w in words_of})
    return bind(F.filter(words(F.coalesce(c, F.lit(""))), lambda w: w.isin(*listed)), votes)


def detect_language(c: Column, sample_chars: int | None = 500) -> Column:
    """Language code of a document, judged on its first `sample_chars` characters."""
    sample = c if sample_chars is None else F.substring(c, 1, sample_chars)
    return most_hits(strip_ends(sample), STOP_WORDS, "unknown")


def keyword_subject(
    c: Column, profiles: Mapping[str, Sequence[str]] = SUBJECT_WORDS
) -> Column:
    """The default subject classifier."""
    return most_hits(c, profiles, "Unknown")


def subject_fallback(subject: Column, text: Column, classifier=keyword_subject) -> Column:
    """Classify the first 800 characters, only where the file name gave no subject."""
    sample = strip_ends(F.substring(text, 1, 800))
    guess = F.when(F.length(sample) > 0, classifier(sample))
    return F.when(subject == "Unknown", F.coalesce(guess, F.lit("Unknown"))).otherwise(subject)


def lookup(
    df: DataFrame, key: str, table: Mapping[str, Sequence[str]], names: Sequence[str], default: str
) -> DataFrame:
    """Attach the columns `names` of a fixed small table; unknown keys get `default`'s row."""
    spark: SparkSession = df.sparkSession
    rows = [(code, *values) for code, values in table.items()]
    ddl = ", ".join(f"{n} string" for n in ("_code", *names))
    fixed = spark.createDataFrame(rows, ddl)
    known = F.col(key).isin(*table)
    keyed = df.withColumn("_code", F.when(known, F.col(key)).otherwise(F.lit(default)))
    # a handful of rows written in the code: always small enough to broadcast
    return keyed.join(F.broadcast(fixed), "_code", "left").drop(key).withColumnRenamed("_code", key)


def detect_reply_language(
    df: DataFrame, text: str, default: str = DEFAULTS.default_language
) -> DataFrame:
    """Add `lang_code`, `lang_name` and `voice_code` of the language to answer in."""
    if default not in REPLY_LANGUAGES:
        default = "fr"
    stripped = strip(F.coalesce(F.col(text), F.lit("")))
    code = F.when(F.length(stripped) < 3, F.lit(default)).otherwise(
        detect_language(F.col(text), sample_chars=None)
    )
    return lookup(
        df.withColumn("lang_code", code), "lang_code", REPLY_LANGUAGES,
        ("lang_name", "voice_code"), default,
    )
