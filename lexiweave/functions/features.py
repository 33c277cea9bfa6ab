"""Sense tags, grammatical features by word form, keyword categories and relation distances."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TAG = r"^(.*)_wn\.([0-9]+)_([a-z])$"

# Target distance of a relation, by profile.
DISTANCES = {
    "graph": {
        "synonym": 0.1, "antonym": 0.9, "hypernym": 0.3, "hyponym": 0.3, "part-meronym": 0.4, "substance-meronym": 0.4, "member-meronym": 0.4,
        "part-holonym": 0.4, "substance-holonym": 0.4, "member-holonym": 0.4, "entailment": 0.35, "cause": 0.35, "verb-group": 0.2, "similar": 0.15,
        "also-see": 0.4, "attribute": 0.5, "pertainym": 0.3, "derivationally-related": 0.25, "describes": 0.3, "is-agent-of": 0.4, "is-patient-of": 0.4,
        "modifies-manner": 0.4, "modifies-degree": 0.4, "coordinates-with": 0.3, "related-to": 0.5,
    },
    "lexicon": {
        "synonym": 0.1, "hypernym": 0.3, "hyponym": 0.3, "antonym": 1.0, "similar": 0.2, "meronym": 0.5, "holonym": 0.5, "entailment": 0.4, "cause": 0.4,
        "also-see": 0.6, "attribute": 0.5, "verb-group": 0.3, "pertainym": 0.4, "derivationally-related": 0.3,
    },
    "mixed": {"hypernym": 0.3, "hyponym": 0.3, "similar": 0.2, "meronym": 0.5, "holonym": 0.5, "antonym": 1.0, "co-occur": 0.4},
    "pairs": {"hypernym": 0.3, "hyponym": 0.3, "similar": 0.2, "meronym": 0.5, "holonym": 0.5, "antonym": 1.0},
}

# Keywords of each semantic type.
CATEGORIES = {
    "size": "big small large tiny huge little enlarge reduce", "morality": "good bad right wrong virtue evil", "emotion": "happy sad joy sorrow glad gloomy",
    "temperature": "hot cold warm cool", "speed": "fast slow quick sluggish", "light": "light dark bright dim heavy", "strength": "strong weak powerful feeble",
    "difficulty": "easy hard simple difficult", "quantity": "many few more less", "age": "young old new ancient", "distance": "near far close distant",
    "wealth": "rich poor wealthy impoverished", "knowledge": "wise foolish intelligent stupid", "safety": "safe dangerous secure risky", "truth": "true false real fake",
}
NEGATIVE_PREFIXES = "un in im il ir non dis".split()


def sense_tag(word: Column, sense: Column, pos: Column) -> Column:
    """``word_wn.NN_p``; ``word_p`` where there is no sense (null or negative)."""
    known = F.concat(word, F.lit("_wn."), F.lpad(sense.cast("string"), 2, "0"), F.lit("_"), pos)
    return F.when(sense.isNull() | (sense < 0), F.concat(word, F.lit("_"), pos)).otherwise(known)


def base_word(tag: Column) -> Column:
    return F.regexp_replace(tag, r"_wn\..*$", "")


def features(word: Column, pos: Column) -> Column:
    """Grammatical features that follow from a word's form and part of speech, as a map without empty values."""
    low = F.lower(word)
    plural = low.endswith("s") & ~low.endswith("ss")
    degree = F.when(low.endswith("er"), F.lit("comparative")).when(low.endswith("est"), F.lit("superlative")).otherwise(F.lit("positive"))
    negative = low.rlike("^(" + "|".join(NEGATIVE_PREFIXES) + ")")
    noun, verb, adj, adv = (pos == p for p in ("NOUN", "VERB", "ADJ", "ADV"))
    cells = {
        "number": F.when(noun, F.when(plural, F.lit("plural")).otherwise(F.lit("singular"))),
        "tense": F.when(verb, F.lit("present")),
        "aspect": F.when(verb, F.lit("simple")),
        "voice": F.when(verb, F.lit("active")),
        "mood": F.when(verb, F.lit("indicative")),
        "degree": F.when(adj | adv, degree),
        "polarity": F.when(adj, F.when(negative, F.lit("negative")).otherwise(F.lit("positive"))),
    }
    m = F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), v)])
    return F.map_filter(m, lambda _, v: v.isNotNull())


def category(word: Column) -> Column:
    """Semantic types whose keywords hold the word."""
    found = [F.when(word.isin(*ws.split()), F.lit(name)) for name, ws in CATEGORIES.items()]
    return F.array_compact(F.array(*found))
