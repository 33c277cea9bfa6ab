"""Text functions as Catalyst expressions, each with its SQL twin for the checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import wordlists

#: White space as Unicode has it; both regular-expression engines know this class.
WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WINDOW = 5

# The markup rules and their order (pattern, replacement).
MARKUP_RULES = (
    (r"\{\{[^}]*\}\}", ""),
    (r"(?i)\[\[File:[^\]]*\]\]", ""),
    (r"(?i)\[\[Image:[^\]]*\]\]", ""),
    (r"(?i)\[\[Category:[^\]]*\]\]", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "1"),
    (r"\[http[^\s]*\s+([^\]]*)\]", "1"),
    (r"https?://[^\s]+", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"<[^>]+>", ""),
    (r"(?is)<ref[^>]*>.*?</ref>", ""),
    (r"(?i)<ref[^>]*/>", ""),
    (r"'{2,}", ""),
    (r"={2,}[^=]*={2,}", ""),
    (r"(?m)^\s*[*#:;]+", ""),
)


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{WS}+", ""), f"{WS}+$", "")


def strip_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def clean_markup(c: Column) -> Column:
    """Plain text of wiki or HTML markup; templates go first, white space is evened out last."""
    out = reduce(lambda x, r: F.regexp_replace(x, r[0], "$1" if r[1] else ""), MARKUP_RULES, c)
    return strip(F.regexp_replace(out, f"{WS}+", " "))


def clean_markup_sql(c: str) -> str:
    def one(x: str, rule: tuple[str, str]) -> str:
        pattern = rule[0].replace("'", "''")
        return f"regexp_replace({x}, '{pattern}', '{chr(92) + '1' if rule[1] else ''}', 'g')"

    return strip_sql(f"regexp_replace({reduce(one, MARKUP_RULES, c)}, '{WS}+', ' ', 'g')")


def sentences(c: Column) -> Column:
    """Parts of a text between an end mark with white space and a capital A–Z; parts of one character drop out."""
    parts = F.split(c, rf"(?<=[.!?]){WS}+(?=[A-Z])")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 1)


def sentences_sql(c: str) -> str:
    parts = f"string_split(regexp_replace({c}, '([.!?]){WS}+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda s: {strip_sql('s')}), lambda s: length(s) > 1)"


def tokens(c: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(c, f"{WS}+"), lambda t: t != "")


def tokens_sql(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{WS}+'), lambda t: t <> '')"


#: Characters that make a sentence look technical, beyond 3 % of it.
SPECIAL = r"[\[\]{}|<>@#$%^&*]"


def is_quality_sentence(c: Column) -> Column:
    """5–50 words, a verb-like ending on a word of more than 3 letters, few special characters
    and digits, no address, a capital first and an end mark last."""
    s = strip(c)
    words = tokens(s)
    size = F.length(s)
    return (
        F.size(words).between(5, 50)
        & F.exists(words, lambda w: F.lower(w).rlike("(ed|ing|s|en)$") & (F.length(w) > 3))
        & ((size - F.length(F.regexp_replace(s, SPECIAL, ""))) * 100 <= size * 3)
        & ~F.lower(s).rlike(r"http|www\.|\.com")
        & ((size - F.length(F.regexp_replace(s, "[0-9]", ""))) * 100 <= size * 15)
        & s.rlike(r"^\p{Lu}")
        & s.rlike(r"[.!?]$")
    )


def is_quality_sentence_sql(c: str) -> str:
    s = strip_sql(c)
    return f"""(len({tokens_sql(s)}) BETWEEN 5 AND 50
  AND len(list_filter({tokens_sql(s)}, lambda w: regexp_matches(lower(w), '(ed|ing|s|en)$') AND length(w) > 3)) > 0
  AND (length({s}) - length(regexp_replace({s}, '{SPECIAL}', '', 'g'))) * 100 <= length({s}) * 3
  AND NOT regexp_matches(lower({s}), 'http|www\\.|\\.com')
  AND (length({s}) - length(regexp_replace({s}, '[0-9]', '', 'g'))) * 100 <= length({s}) * 15
  AND regexp_matches({s}, '^\\p{{Lu}}') AND regexp_matches({s}, '[.!?]$'))"""


# Words by tag and language, with their inflected forms. Other words follow from capitals and endings.
ENGLISH_TAGS = wordlists.english_tags()
SPANISH_TAGS = wordlists.spanish_tags()
#: Words with several candidate tags.
AMBIGUOUS = wordlists.ambiguous()
PUNCTUATION_TAGS = {",": "COMMA", ";": "SEMICOLON", ":": "COLON", "(": "LPAREN", ")": "RPAREN", "—": "EM_DASH", "–": "EM_DASH"}
QUOTES = ('"', "'", "“", "”", "‘", "’")
ENGLISH_ENDINGS = (("ly", "ADV"), ("ing", "VERB"), ("ed", "VERB"))
SPANISH_ENDINGS = (("mente", "ADV"), ("ar", "VERB"), ("er", "VERB"), ("ir", "VERB"), ("ando", "VERB"), ("iendo", "VERB"), ("ado", "VERB"), ("ido", "VERB"))


def _rules(lang: str):
    return (SPANISH_TAGS, SPANISH_ENDINGS) if lang == "es" else (ENGLISH_TAGS, ENGLISH_ENDINGS)


def tag(t: Column, lang: str = "en") -> Column:
    """Tag of a token: punctuation, word lists, a capital for a proper noun, endings, else noun."""
    words, endings = _rules(lang)
    low = F.lower(t)
    out = F.when(t.isNull(), F.lit(None).cast("string"))
    if lang != "es":
        for p, name in PUNCTUATION_TAGS.items():
            out = out.when(t == p, F.lit(name))
        out = out.when(t.isin(*QUOTES), F.lit("QUOTE"))
    for name, ws in words.items():
        out = out.when(low.isin(*ws), F.lit(name))
    proper = t.rlike(r"^\p{Lu}") if lang == "es" else t.rlike(r"^\p{Lu}") & ~t.isin("I", "A")
    out = out.when(proper, F.lit("PROPN"))
    for end, name in endings:
        out = out.when(low.endswith(end), F.lit(name))
    return out.otherwise(F.lit("NOUN"))


def tag_sql(t: str, lang: str = "en") -> str:
    words, endings = _rules(lang)

    def listed(xs) -> str:
        return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)

    out = f"CASE WHEN {t} IS NULL THEN NULL"
    if lang != "es":
        for p, name in PUNCTUATION_TAGS.items():
            out += f" WHEN {t} = '{p}' THEN '{name}'"
        out += f" WHEN {t} IN ({listed(QUOTES)}) THEN 'QUOTE'"
    for name, ws in words.items():
        out += f" WHEN lower({t}) IN ({listed(ws)}) THEN '{name}'"
    capital = f"regexp_matches({t}, '^\\p{{Lu}}')"
    out += f" WHEN {capital if lang == 'es' else capital + f' AND {t} NOT IN (' + listed(('I', 'A')) + ')'} THEN 'PROPN'"
    for end, name in endings:
        out += f" WHEN ends_with(lower({t}), '{end}') THEN '{name}'"
    return out + " ELSE 'NOUN' END"


def possible_tags(t: Column, lang: str = "en") -> Column:
    """All candidate tags of a token; its own tag alone where it is not ambiguous."""
    # one look-up in a literal map instead of a branch for each word
    known = F.create_map(*[F.lit(x) for w, tags in AMBIGUOUS.items() for x in (w, tags)])
    return F.coalesce(F.split(F.try_element_at(known, F.lower(t)), " "), F.array(tag(t, lang)))


def possible_tags_sql(t: str, lang: str = "en") -> str:
    out = "CASE"
    for w, tags in AMBIGUOUS.items():
        out += f" WHEN lower({t}) = '{w}' THEN [{', '.join(repr(x) for x in tags.split())}]"
    return out + f" ELSE [{tag_sql(t, lang)}] END"


def plain_lang(c: Column) -> Column:
    """Two-letter language: ``en-XX`` and ``EN`` give ``en``; null and blank give ``und``."""
    return F.coalesce(F.nullif(F.substring(F.lower(F.btrim(c)), 1, 2), F.lit("")), F.lit("und"))


def plain_lang_sql(c: str) -> str:
    return f"coalesce(nullif(substr(lower(trim({c})), 1, 2), ''), 'und')"


STOP_WORDS = sorted({w for k in ("DET", "CCONJ", "ADP", "PRON", "AUX", "PART", "SCONJ") for w in ENGLISH_TAGS[k] if w.isalpha()})


def content_words(c: Column) -> Column:
    """Lower-case runs of letters that are no stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def content_words_sql(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(regexp_extract_all(lower({c}), '\\p{{L}}+'), lambda w: w NOT IN ({stop}))"


def window_pairs(words: Column, window: int = WINDOW) -> Column:
    """(source, target, distance) of each word with the next ``window`` ones, inside the JVM."""
    return F.flatten(
        F.transform(
            words,
            lambda w, i: F.transform(
                F.slice(words, i + 2, window),
                lambda v, j: F.struct(w.alias("source"), v.alias("target"), (j + 1).cast("int").alias("distance")),
            ),
        )
    )
