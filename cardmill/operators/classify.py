"""Facets and tags by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.functions import quality, text
from cardmill.settings import UNRESOLVED, Profile, Taxonomy


def _first(rules: list[tuple[Column, str]]) -> Column:
    """The value of the first rule that holds, else null: a CASE chain, evaluated within the stage."""
    out = F.lit(None).cast("string")
    for holds, value in reversed(rules):
        out = F.when(holds, F.lit(value)).otherwise(out)
    return out


def _any(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def keyword_facets(profile: Profile, normal: Column) -> dict[str, Column]:
    """Per category the first value one of whose keywords is contained in the normal text."""
    return {c: _first([(_any(normal, [k.lower() for k in words]), v) for v, words in values.items()]) for c, values in profile.keyword_rules.items()}


def topic_facet(profile: Profile, taxonomy: Taxonomy, semantic: Column, fold) -> Column:
    """The first topic one of whose keywords, folded like the text, is contained; topics outside a non-empty list are skipped."""
    known = taxonomy.categories.get("topic", ())
    return _first([(_any(semantic, [fold(k) for k in words]), t) for t, words in profile.topic_keywords.items() if not known or t in known])


def type_facet(profile: Profile, taxonomy: Taxonomy, semantic_front: Column, intent: Column) -> Column:
    known = taxonomy.categories.get("type", ())
    rules = []
    for kind, patterns in profile.type_patterns.items():
        if known and kind not in known:
            continue
        hit = F.lit(False)
        for p in patterns:
            hit = hit | semantic_front.rlike(p)
        rules.append((hit, kind))
    return F.coalesce(_first(rules), F.when(intent.isin(*known) if known else intent != "unknown", intent))


def deck_facets(profile: Profile, parts: Column, fold_path) -> dict[str, Column]:
    """Facets of the first rule whose folded path equals the last parts of the deck's path."""
    rules = [(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - len(path) + 1), F.lit(len(path))) == F.array(*[F.lit(p) for p in path]), facets) for deck, facets in profile.deck_tag_rules.items() if (path := fold_path(deck))]
    categories = list(dict.fromkeys(c for _, facets in rules for c in facets))
    place = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        place = F.when(rules[i][0], F.lit(i)).otherwise(place)
    return {c: _first([(place == i, facets[c]) for i, (_, facets) in enumerate(rules) if c in facets]) for c in categories}


def resolve_tags(suggested: Column, taxonomy: Taxonomy) -> tuple[Column, Column, Column]:
    """(resolved, unresolved, first facets): valid tags once each, in order; others marked and kept as often as they come."""
    valid = F.array(*[F.lit(t) for t in taxonomy.tags()]).cast("array<string>")
    parsed = F.transform(suggested, lambda t: F.coalesce(F.concat(text.parse_tag(t)["category"], F.lit("::"), text.parse_tag(t)["value"]), F.lit("")))
    both = F.arrays_zip(suggested.alias("raw"), parsed.alias("tag"))
    good = F.array_distinct(F.filter(parsed, lambda t: F.array_contains(valid, t)))
    bad = F.transform(F.filter(both, lambda x: ~F.array_contains(valid, x["tag"])), lambda x: F.concat(F.lit(UNRESOLVED), x["raw"]))
    return good, bad, good


def _tag_value(tags: Column, category: str) -> Column:
    """The value of the first tag of a category, else null."""
    start = f"{category}::"
    return F.substring(F.get(F.filter(tags, lambda t: t.startswith(start)), F.lit(0)), len(start) + 1, 1 << 30)


def merged_scope(resolved: Column, *layers: dict[str, Column]) -> Column:
    """Facet map: the first valid tag of a category, else the first layer that has the category (deck, keyword, topic, type)."""
    categories = list(dict.fromkeys(c for layer in layers for c in layer))
    entries = []
    for c in categories:
        tagged = _tag_value(resolved, c)
        entries.append(F.struct(F.lit(c).alias("key"), F.coalesce(tagged, *[layer[c] for layer in layers if c in layer]).alias("value")))
    # categories that only tags name
    others = F.filter(resolved, lambda t: ~F.split(t, "::")[0].isin(categories)) if categories else resolved
    tagged = F.transform(others, lambda t: F.struct(F.split(t, "::", 2)[0].alias("key"), F.split(t, "::", 2)[1].alias("value")))
    firsts = F.filter(tagged, lambda e, i: F.size(F.filter(F.slice(tagged, 1, i), lambda p: p["key"] == e["key"])) == 0)
    return F.map_from_entries(F.filter(F.concat(F.array(*entries), firsts) if entries else firsts, lambda e: e["value"].isNotNull()))


def scope_tags(resolved: Column, scope: Column, taxonomy: Taxonomy) -> Column:
    """Resolved tags, then those that follow from the scope and are valid."""
    valid = F.array(*[F.lit(t) for t in taxonomy.tags()]).cast("array<string>")
    derived = F.transform(F.array_sort(F.map_entries(scope)), lambda e: F.concat(e["key"], F.lit("::"), e["value"]))
    return F.array_distinct(F.concat(resolved, F.filter(derived, lambda t: F.array_contains(valid, t))))


def python_fold(value: str) -> str:
    """The semantic form of a rule's word, on the driver."""
    import re
    import unicodedata

    value = re.sub(r"<[^>]+>", " ", unicodedata.normalize("NFKC", value)).lower()
    value = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w\s]", " ", value).split())


def python_path(deck: str) -> list[str]:
    return [p for p in (python_fold(x) for x in deck.split("::")) if p]


def classify(cards: DataFrame, profile: Profile, taxonomy: Taxonomy, front: str = "front", back: str = "back", deck: str = "deck", tags: str = "suggested_tags") -> DataFrame:
    """Adds ``scope, tags_resolved, tags_unresolved, confidence`` and needs no shuffle."""
    both = F.concat_ws(" ", F.col(front), F.col(back))
    out = cards.withColumns({"_n": text.normal(both), "_f": text.semantic(F.col(front)), "_p": text.deck_parts(F.coalesce(F.col(deck), F.lit("")))})
    out = out.withColumn("_s", text.words_only(text.unaccented(F.col("_n"))))
    intent, _ = text.question_key(text.words_only(text.without_brackets(text.unaccented(text.normal(F.col(front))))))
    suggested = F.coalesce(F.col(tags), F.array().cast("array<string>"))
    resolved, unresolved, _ = resolve_tags(suggested, taxonomy)
    layers = [
        deck_facets(profile, F.col("_p"), python_path),
        keyword_facets(profile, F.col("_n")),
        {"topic": topic_facet(profile, taxonomy, F.col("_s"), python_fold)},
        {"type": type_facet(profile, taxonomy, F.col("_f"), intent)},
    ]
    out = out.withColumns({"_resolved": resolved, "tags_unresolved": unresolved})
    out = out.withColumn("scope", merged_scope(F.col("_resolved"), *layers))
    out = out.withColumn("tags_resolved", scope_tags(F.col("_resolved"), F.col("scope"), taxonomy))
    out = out.withColumn("confidence", quality.confidence(list(profile.required_categories), F.col("scope"), F.col("tags_resolved"), F.col("tags_unresolved")))
    return out.drop("_n", "_f", "_s", "_p", "_resolved")


def missing_categories(categories: list[str], existing: Column, resolved: Column) -> Column:
    """Those of ``categories`` that neither an existing nor a resolved tag has."""
    both = F.concat(existing, resolved)
    return F.filter(F.array(*[F.lit(c) for c in categories]), lambda c: ~F.exists(both, lambda t: t.startswith(F.concat(c, F.lit("::")))))


def untagged(required: list[str], scope: Column) -> Column:
    out = F.lit(False)
    for c in required:
        out = out | scope[c].isNull()
    return out


def route_decks(cards: DataFrame, decks: DataFrame, categories: list[str], root: str, key: str = "record_id") -> DataFrame:
    """``<key>, deck``: per category in order, the first deck under ``root`` that has the facet as a path part, else in its path; else ``root``.

    ``decks`` (deck_name, ordinal) is a small dimension; its folded parts meet the distinct facet values only.
    """
    under = decks.filter((F.col("deck_name") == root) | F.col("deck_name").startswith(root + "::")).withColumns({"parts": text.deck_parts(F.col("deck_name")), "whole": text.semantic(F.col("deck_name"))})
    asked = None
    for place, c in enumerate(categories):
        part = cards.select(key, F.lit(place).alias("place"), text.semantic(F.col("scope")[c]).alias("value")).filter("value <> ''")
        asked = part if asked is None else asked.union(part)
    values = asked.select("value").distinct()
    hits = values.join(F.broadcast(under), F.expr("array_contains(slice(parts, 2, 1000000), value) OR contains(whole, value)"))
    kind = F.when(F.expr("array_contains(slice(parts, 2, 1000000), value)"), 0).otherwise(1)
    best = hits.groupBy("value").agg(F.min(F.struct(kind.alias("kind"), "ordinal", "deck_name")).alias("hit"))
    found = asked.join(best, "value").groupBy(key).agg(F.min_by("hit.deck_name", "place").alias("deck"))
    return cards.select(key).join(found, key, "left").select(key, F.coalesce("deck", F.lit(root)).alias("deck"))
