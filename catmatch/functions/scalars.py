"""Scalar rules of the catalogue feed, scores and labels as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from catmatch import fixed_values as fv
from catmatch.functions.text import fold_case, literal_map, tokens


def optional_double(value: Column) -> Column:
    return value.try_cast("double")


def rescale_alcohol(value: Column) -> Column:
    number = optional_double(value)
    return F.when(number > 30, number / 10).otherwise(number)


def valid_year(first: Column, second: Column) -> Column:
    """The first truthy value as a year within 1900..2100, else null."""
    number = F.coalesce(F.nullif(first.try_cast("int"), F.lit(0)), second.try_cast("int"))
    return F.when(number.between(1900, 2100), number)


def zero_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0).cast("bigint"))


def empty_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def text_of(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def names_of(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")),
                                lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != "")


def absolute_url(path: Column, base: str) -> Column:
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return (F.when(F.coalesce(path, F.lit("")) == "", F.lit(None))
            .when(path.startswith("http://") | path.startswith("https://"), path)
            .otherwise(F.concat(F.lit(base), rooted)))


def image_key(item_id: Column, url: Column, prefix: str = "items") -> Column:
    """Storage key: prefix/id plus the URL's image extension, .webp when it has none."""
    last = F.regexp_extract(F.split(url, r"\?")[0], r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(last, r"[^.](\.[^.]+)$", 1))
    allowed = [".webp", ".jpg", ".jpeg", ".png", ".gif"]
    return F.concat(F.lit(prefix + "/"), item_id,
                    F.when(suffix.isin(allowed), suffix).otherwise(F.lit(".webp")))


def resolve_image(explicit: Column, object_key: Column, item_id: Column, has_file: Column,
                  object_base: str, file_base: str) -> Column:
    return F.coalesce(
        F.nullif(explicit, F.lit("")),
        F.when(F.coalesce(object_key, F.lit("")) != "", F.concat(F.lit(object_base), object_key)),
        F.when(has_file, F.concat(F.lit(file_base), item_id, F.lit("/image"))))


def string_hash31(text: Column) -> Column:
    """Signed 32-bit polynomial hash (base 31) of the code units."""
    step = lambda h, c: F.pmod(h * 31 + F.ascii(c).cast("bigint"), F.lit(1 << 32))
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    unsigned = F.aggregate(letters, F.lit(0).cast("bigint"), step)
    return F.when(unsigned >= (1 << 31), unsigned - (1 << 32)).otherwise(unsigned)


def demo_rating(item_id: Column, rating: Column) -> Column:
    stable = 4 + F.pmod(string_hash31(item_id), F.lit(11)) / 10
    return F.when(rating.isNotNull() | (F.trim(item_id) == ""), rating).otherwise(stable)


def product_key(slug: Column, winery: Column, grapes: Column, category: Column) -> Column:
    """Slug without year tokens, plus normalised winery, grapes and category."""
    bare = F.regexp_replace(F.regexp_replace(slug, fv.YEAR_PATTERN, ""), "-+", "-")
    bare = F.regexp_replace(bare, "^-+|-+$", "")
    derived = F.concat_ws("|", bare, *[F.array_join(tokens(c), " ")
                                       for c in (winery, grapes, category)])
    return F.coalesce(F.element_at(literal_map(fv.EQUIVALENT_SLUGS), slug), derived)


def year_candidates(text: Column, as_of_year: int) -> Column:
    """Printed years up to `as_of_year`; a line about founding has none."""
    low = F.translate(fold_case(text), "ё", "е")
    years = F.regexp_extract_all(low, F.lit("(" + fv.YEAR_PATTERN + ")"), F.lit(1))
    recent = F.filter(years, lambda y: y.cast("int") <= as_of_year)
    # Unicode classes so that word boundaries hold for Cyrillic words too.
    founding = low.rlike("(?U)" + fv.FOUNDING_PATTERN)
    return F.when(founding, F.array().cast("array<string>")).otherwise(recent)


def packaging_hint(title: Column, slug: Column, description: Column,
                   patterns: dict[str, str] | None = None,
                   context: str = fv.PACKAGING_CONTEXT) -> Column:
    """struct<kind, source>: exactly one packaging class in the name, else in the prose."""
    patterns = patterns or fv.PACKAGING_PATTERNS

    def hits(text):
        return F.filter(F.array(*[F.when(text.rlike("(?U)" + p), F.lit(kind))
                                  for kind, p in patterns.items()]), lambda x: x.isNotNull())

    def outcome(kind, source):
        return F.struct(kind.alias("kind"), source.alias("source"))

    name = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(slug, F.lit(""))))
    prose = F.lower(F.coalesce(description, F.lit("")))
    by_name, by_prose = hits(name), hits(prose)
    return (F.when(F.size(by_name) == 1, outcome(by_name[0], F.lit("title_or_slug")))
            .when(F.size(by_name) > 1, outcome(F.lit("unknown"), F.lit("ambiguous_metadata")))
            .when((F.size(by_prose) == 1) & prose.rlike(context),
                  outcome(by_prose[0], F.lit("description")))
            .when(F.size(by_prose) > 1, outcome(F.lit("unknown"), F.lit("ambiguous_metadata")))
            .otherwise(outcome(F.lit("unknown"), F.lit(None).cast("string"))))


def packaging_factor(query_kind: Column, reliable: Column, card_kind: Column,
                     kinds: list[str] | None = None) -> Column:
    known = kinds or list(fv.PACKAGING_PATTERNS)
    usable_pair = query_kind.isin(known) & reliable & (card_kind != "unknown")
    return (F.when(~F.coalesce(usable_pair, F.lit(False)), F.lit(1.0))
            .when(query_kind == card_kind, F.lit(fv.PACKAGING_MATCH))
            .otherwise(F.lit(fv.PACKAGING_CONFLICT)))


def region_to_territory(region: Column, aliases: list[tuple[str, str]]) -> Column:
    """Territory of a free-text region for a fixed alias list: longest alias contained wins."""
    low = F.replace(F.lower(F.trim(region)), F.lit("ё"), F.lit("е"))
    ordered = sorted(aliases, key=lambda pair: -len(pair[0]))
    return F.coalesce(*[F.when(F.contains(low, F.lit(alias)), F.lit(name))
                        for alias, name in ordered])


def reviewed_attr(status: Column, value: Column) -> Column:
    return F.when(status.isin("confirmed", "applied"), value)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def evidence_strength(confidence: Column, similarity: Column) -> Column:
    return F.when(is_finite(confidence) & is_finite(similarity),
                  clip(confidence, 0, 1) * clip(similarity, 0, 1))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-clip(z, -700, 700)))


def single(values: Column) -> Column:
    return F.when(F.size(values) == 1, values[0])


def tag_status(values: Column) -> Column:
    return (F.when(F.size(values) == 1, F.lit("read")).when(F.size(values) > 1, F.lit("ambiguous"))
            .otherwise(F.lit("missing")))


def level_for(points: Column) -> Column:
    """struct<level, progress, points_from, points_to> for a points total."""
    steps = fv.LEVEL_THRESHOLDS
    bounds = F.array(*[F.lit(s).cast("bigint") for s in steps])
    level = F.greatest(F.size(F.filter(bounds, lambda b: b <= points)), F.lit(1))
    low = F.element_at(bounds, level)
    high = F.element_at(bounds, F.least(level + 1, F.lit(len(steps))))
    progress = F.when(high > low, clip((points - low) / (high - low), 0, 1)).otherwise(F.lit(1.0))
    return F.struct(level.cast("bigint").alias("level"), progress.alias("progress"),
                    low.alias("points_from"), high.alias("points_to"))
