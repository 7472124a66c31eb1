"""Language of a text by its function words: built in, for routing; null when the text is short or undecided."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Most frequent function words (fixed values).
FUNCTION_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "it", "with", "was", "are", "this", "be", "by", "on", "as", "at"],
    "fr": ["le", "la", "les", "des", "du", "et", "un", "une", "est", "qui", "dans", "pour", "sur", "par", "ou", "au", "elle"],
    "de": ["der", "die", "das", "und", "von", "mit", "den", "dem", "zu", "ist", "nicht", "auf", "ein", "eine", "als", "bei"],
    "es": ["el", "los", "las", "y", "del", "que", "se", "por", "con", "su", "para", "al", "es", "lo", "una"],
}
LEAST_CHARS, SAMPLE_CHARS, LEAST_SHARE = 80, 4_000, 0.75


def detect(text: Column, least: float = LEAST_SHARE) -> Column:
    """struct(lang, share): the language with most function words in the first characters, its share of all hits; lang null below the share."""
    words = F.split(F.lower(F.substring(text, 1, SAMPLE_CHARS)), r"[^\p{L}]+")
    hits = {code: _hits(words, known) for code, known in FUNCTION_WORDS.items()}
    total = sum(hits.values(), F.lit(0))
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(c).alias("c")) for c, n in hits.items()]))
    share = F.coalesce(F.try_divide(best["n"].cast("double"), total), F.lit(0.0))
    sure = (F.length(text) >= LEAST_CHARS) & (share >= least)
    return F.struct(F.when(sure, best["c"]).alias("lang"), F.when(F.length(text) >= LEAST_CHARS, share).otherwise(0.0).alias("share"))


def _hits(words: Column, known: list[str]) -> Column:
    return F.size(F.filter(words, lambda x: x.isin(known)))
