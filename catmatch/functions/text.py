"""Column expressions for text normalisation; everything stays in the JVM."""
from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from catmatch import fixed_values as fv

WORD = r"[\p{L}\p{N}]+"


@lru_cache(maxsize=None)
def _base_letters() -> tuple[str, str]:
    """(from, to) tables that drop accents, derived from Unicode decomposition."""
    ranges = [(0x00A0, 0x0250), (0x0370, 0x0530), (0x1E00, 0x2000), (0xFF10, 0xFF5B)]
    source, target = [], []
    for first, last in ranges:
        for code in range(first, last):
            letter = chr(code)
            base = "".join(c for c in unicodedata.normalize("NFKD", letter)
                           if not unicodedata.combining(c)).casefold()
            if len(base) == 1 and base != letter and letter.isalnum():
                source.append(letter)
                target.append(base)
    return "".join(source), "".join(target)


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def fold_case(text: Column) -> Column:
    """Case folding: lower case, with sharp s written out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


_COMBINING = "".join(chr(c) for c in range(0x0300, 0x0370))


def strip_accents(text: Column) -> Column:
    """One pass: accented letters to base letters, loose combining marks dropped."""
    source, target = _base_letters()
    return F.translate(text, source + _COMBINING, target)


def words_of(text: Column) -> Column:
    """Runs of letters and digits; an underscore separates."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def normalize_phrase(text: Column) -> Column:
    """Folded, accent-free words joined by single spaces (й becomes и)."""
    folded = F.translate(fold_case(F.coalesce(text, F.lit(""))), "ё", "е")
    return F.array_join(words_of(strip_accents(folded)), " ")


def raw_words(text: Column) -> Column:
    return words_of(fold_case(text))


@lru_cache(maxsize=None)
def _latin_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """(from, to) letters in one table, and the letters written with several."""
    single = [(c, t) for c, t in zip(fv.CYRILLIC, fv.LATIN) if len(t) == 1]
    dropped = [c for c, t in zip(fv.CYRILLIC, fv.LATIN) if t == ""]
    longer = [(c, t) for c, t in zip(fv.CYRILLIC, fv.LATIN) if len(t) > 1]
    # Cyrillic letters first, then accents, then letters to drop.
    accents = [(a, b) for a, b in zip(*_base_letters()) if a not in fv.CYRILLIC]
    return ("".join(c for c, _ in single + accents) + "".join(dropped) + _COMBINING,
            "".join(t for _, t in single + accents), longer)


def transliterate(text: Column) -> Column:
    """Cyrillic to Latin (й becomes y), then accents dropped."""
    source, target, longer = _latin_tables()
    out = F.translate(text, source, target)
    for letter, latin in longer:
        out = F.replace(out, F.lit(letter), F.lit(latin))
    return out


def resolve_alias(latin: Column) -> Column:
    return F.when(latin.isin(list(fv.WORD_ALIASES)),
                  F.element_at(literal_map(fv.WORD_ALIASES), latin)).otherwise(latin)


def canonical(word: Column) -> Column:
    """Alias-resolved Latin form of one word."""
    return resolve_alias(transliterate(fold_case(word)))


def usable(word: Column) -> Column:
    return ((F.length(word) >= 2) & ~word.isin(fv.STOP_WORDS)
            & ((F.length(word) < 4) | ~word.rlike(r"^\p{N}{4,}$")))


@lru_cache(maxsize=None)
def _tokens_sql() -> str:
    """`tokens` as SQL text over @text: one parse instead of hundreds of literal columns."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    among = lambda values: "(" + ", ".join(quote(v) for v in values) + ")"
    source, target, longer = _latin_tables()
    latin = f"translate(replace(lower(coalesce(@text, '')), 'ß', 'ss'), {quote(source)}, {quote(target)})"
    for letter, letters in longer:
        latin = f"replace({latin}, {quote(letter)}, {quote(letters)})"
    aliases = "map(" + ", ".join(f"{quote(k)}, {quote(v)}" for k, v in fv.WORD_ALIASES.items()) + ")"
    words = f"regexp_extract_all({latin}, {quote(WORD)}, 0)"
    resolved = f"CASE WHEN w IN {among(fv.WORD_ALIASES)} THEN element_at({aliases}, w) ELSE w END"
    keep = (f"length(t) >= 2 AND t NOT IN {among(fv.STOP_WORDS)} AND "
            f"(length(t) < 4 OR NOT t RLIKE {quote('^' + chr(92) + 'p{N}{4,}$')})")
    return f"filter(transform({words}, w -> {resolved}), t -> {keep})"


def tokens(text: Column | str) -> Column:
    """Canonical usable words of a text, in order.

    Transliteration runs once over the whole text: it maps letters to letters,
    so the word boundaries stay where they were.
    """
    if isinstance(text, str):
        return F.expr(_tokens_sql().replace("@text", text))
    latin = words_of(transliterate(fold_case(F.coalesce(text, F.lit("")))))
    return F.filter(F.transform(latin, lambda w: resolve_alias(w)), lambda w: usable(w))


def reading_forms(word: Column) -> Column:
    """array<string>: the word as read, with look-alike glyphs, with split glyphs and digits."""
    low = fold_case(word)
    swap = lambda c: F.translate(c, fv.LOOKALIKE_FROM, fv.LOOKALIKE_TO)
    joined = F.regexp_replace(low, fv.SPLIT_GLYPH_PATTERN, fv.SPLIT_GLYPH_LETTER)
    glyph = swap(F.translate(joined, fv.DIGIT_GLYPHS_FROM, fv.DIGIT_GLYPHS_TO))
    return F.array(low, swap(low), glyph)


def variants_from_terms(terms: Column) -> Column:
    """array<struct<term, method, prior>> of three canonical readings, each term once."""
    methods = list(fv.VARIANT_PRIORS)

    def entry(i):
        return F.struct(terms[i].alias("term"), F.lit(methods[i]).alias("method"),
                        F.lit(fv.VARIANT_PRIORS[methods[i]]).alias("prior"))

    fresh = [F.lit(True), terms[1] != terms[0], (terms[2] != terms[0]) & (terms[2] != terms[1])]
    readings = F.array(*[F.when(f, entry(i)) for i, f in enumerate(fresh)])
    return F.filter(readings, lambda v: v.isNotNull() & usable(v["term"]))


def attribute_words() -> list[str]:
    """Cyrillic words of the colour and sweetness vocabularies, normalised."""
    words = set()
    for vocabulary in (fv.COLOR_VOCABULARY, fv.SWEETNESS_VOCABULARY):
        for value, spellings in vocabulary.items():
            for phrase in [value, *spellings]:
                for word in py_normalize_phrase(phrase).split():
                    if all("а" <= c <= "я" for c in word):
                        words.add(word)
    return sorted(words)


def py_normalize_phrase(text: str) -> str:
    """The phrase normaliser for small driver-side vocabularies."""
    folded = unicodedata.normalize("NFKD", text.casefold().replace("ё", "е"))
    plain = "".join(c if c.isalnum() else " " for c in folded if not unicodedata.combining(c))
    return " ".join(plain.split())


def decode_attribute_glyphs(text: Column, vocabulary: list[str] | None = None,
                            glyphs_from: str = fv.ATTRIBUTE_GLYPHS_FROM,
                            glyphs_to: str = fv.ATTRIBUTE_GLYPHS_TO) -> Column:
    """Look-alike decoding per word, kept only where it yields a known attribute word."""
    known = vocabulary if vocabulary is not None else attribute_words()

    def decode(word):
        swapped = F.translate(word, glyphs_from, glyphs_to)
        return F.when(swapped.isin(known), swapped).otherwise(word)

    return F.array_join(F.transform(F.split(normalize_phrase(text), " "), decode), " ")


def blank_patterns_in_order(text: Column, patterns: list[tuple[str, str]]) -> list[tuple[str, Column]]:
    """(value, matched?) per ordered pattern; a match is blanked before the next one."""
    results = []
    rest = F.translate(fold_case(text), "ё", "е")
    for value, pattern in patterns:
        bounded = r"(?<![\p{L}\p{N}_])(?:" + pattern + r")(?![\p{L}\p{N}_])"
        results.append((value, rest.rlike(bounded)))
        rest = F.regexp_replace(rest, bounded, " ")
    return results


def split_list(text: Column) -> Column:
    """Comma list to array: trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)),
                    lambda x: x != "")


def join_list(values: Column) -> Column:
    return F.array_join(values, ",")
