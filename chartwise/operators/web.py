"""Landed web records: profile JSON and forecast HTML.

* ``parse_profiles``      the body parsed once, as VARIANT                  (A8, H7)
* ``profile_affiliations`` full name (a name part that is null → "Unknown
                          Name"), one row per affiliation group from its
                          first summary: ``org (start-end)``, open end →
                          "Present", missing start → "?"                    (H5, H6)
* ``profile_works``       title and year of every work, missing year →
                          "Unknown"                                         (H7)
* ``class_texts``         texts of the elements of a class, any tag, page
                          order, nested elements included                   (H9, A9)
* ``forecast_blocks``     blocks by class, child texts by class             (H9)
* ``next_high``           first block (page order) that is not "Today" /
                          "Afternoon", has a temperature and a "High";
                          first signed integer as the value; alias map,
                          city before the first comma                        (B10, F8, H8, H10, H11)
* ``city_highs``          the rows with a temperature                       (H11)

A page is cut into tokens (tags, texts, comments) and its tags are folded
over a stack of open elements, all in built-in array functions: a closing
tag ends the nearest open element of its name and what was opened inside it,
one that matches nothing is ignored, elements never closed reach to the end of
what encloses them, void elements (``br`` and the like) hold nothing, and
comments, scripts and styles have no text. Character references stay as
written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Location aliases (matched on upper-cased, trimmed text).
LOCATION_ALIASES = {
    "MDW": "Chicago Midway Airport, Chicago, IL",
    "CENTRAL PARK": "Central Park, New York, NY",
}


def parse_profiles(raw: DataFrame, body: str = "body", out: str = "parsed") -> DataFrame:
    """``raw`` with its JSON text parsed once into a VARIANT column; text that is no JSON gives null."""
    return raw.withColumn(out, F.try_parse_json(body))


def _at(v: Column, path: str, kind: str = "string") -> Column:
    """What ``v`` holds at ``path``: null where the path, or the kind asked for, is not there."""
    return F.try_variant_get(v, path, kind)


def _no_object(v: Column, path: str) -> Column:
    """The path is absent, or its value is JSON null."""
    at = _at(v, path, "variant")
    return at.isNull() | F.is_variant_null(at)


def _named(value: Column) -> Column:
    """Missing parts of a sentence read "None"."""
    return F.coalesce(value, F.lit("None"))


_NAME = "$.person.name"


def profile_affiliations(raw: DataFrame, key: str = "profile_id", body: str = "body") -> DataFrame:
    """Full name and one row per affiliation group with a summary.

    An absent name part is left out; a part that is JSON null makes the
    name "Unknown Name". Profiles without groups, groups without
    summaries, and bodies that are no JSON give no row.
    """
    v = F.col("parsed")
    unknown = F.lit(False)
    for path in ("$.person", _NAME, f"{_NAME}['given-names']", f"{_NAME}['family-name']"):
        unknown = unknown | F.coalesce(F.is_variant_null(_at(v, path, "variant")), F.lit(False))
    parts = [F.coalesce(_at(v, f"{_NAME}['{c}'].value"), F.lit("")) for c in ("given-names", "family-name")]
    full = F.when(unknown, F.lit("Unknown Name")).otherwise(F.trim(F.concat_ws(" ", *parts)))
    groups = _at(v, "$['activities-summary'].employments['affiliation-group']", "array<variant>")
    p = parse_profiles(raw, body).select(key, full.alias("full_name"), F.posexplode(groups).alias("aff_no", "grp"))
    grp, summary = F.col("grp"), "$.summaries[0]['employment-summary']"
    g = p.where(F.size(_at(grp, "$.summaries", "array<variant>")) > 0)
    return g.select(key, "full_name", F.col("aff_no").cast("int").alias("aff_no"), F.concat(
        _named(_at(grp, f"{summary}.organization.name")), F.lit(" ("),
        F.when(_no_object(grp, f"{summary}['start-date']"), F.lit("?")).otherwise(_named(_at(grp, f"{summary}['start-date'].year.value"))), F.lit("-"),
        F.when(_no_object(grp, f"{summary}['end-date']"), F.lit("Present")).otherwise(_named(_at(grp, f"{summary}['end-date'].year.value"))),
        F.lit(")")).alias("affiliation"))


def profile_works(raw: DataFrame, key: str = "profile_id", body: str = "body") -> DataFrame:
    """One row per work group with a title, from its first summary; a missing year is "Unknown"."""
    groups = _at(F.col("parsed"), "$['activities-summary'].works.group", "array<variant>")
    g = parse_profiles(raw, body).select(key, F.posexplode(groups).alias("work_no", "grp"))
    grp, summary = F.col("grp"), "$['work-summary'][0]"
    return g.select(
        key, F.col("work_no").cast("int").alias("work_no"), _at(grp, f"{summary}.title.title.value").alias("title"),
        F.coalesce(_at(grp, f"{summary}['publication-date'].year.value"), F.lit("Unknown")).alias("year"),
    ).where(F.col("title").isNotNull() & (F.col("title") != ""))


# Comments, scripts and styles whole; declarations; tags (a ">" in quotes does not end them); texts; a lone "<".
_TOKEN = (r"""(?si)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<[!?][^>]*>?"""
          r"""|</?[a-z](?:[^>"']|"[^"]*"|'[^']*')*+>|</?[a-z][^>]*>?|[^<]+|<""")
# HTML elements without content.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_STACK = "array<struct<tag:string,at:int,cls:array<int>>>"
_DONE = "array<struct<start:int,end:int,cls:array<int>>>"


def _once(expression: Column) -> Column:
    """``expression`` as a one-row generator: a filter on what is made of it is not pushed below, where it would run again."""
    return F.explode(F.array(expression))


def _bind(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _has_class(cls: str) -> str:
    """A tag whose class attribute has ``cls`` among its tokens."""
    return rf"""(?si)^<[a-z].*?[\s"']class\s*=\s*(?:["'](?:[^"']*\s)?(?-i:{cls})(?:\s[^"']*)?["']|(?-i:{cls})[\s>])"""


def html_tokens(html: Column) -> Column:
    """Tags, texts and comments of a page, in order; joined they are the page."""
    return F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))


def class_elements(tokens: Column, classes) -> Column:
    """Elements that have one of ``classes``, in page order: first token, token after the last, numbers of their classes."""
    def tag(t: Column, i: Column) -> Column:
        opens = t.rlike(r"(?i)^<(?!(?:script|style)\b)[a-z]")
        # the name is looked for first, which is cheap; what does not open a tag has no class
        found = F.array_compact(F.array(*[F.when(t.contains(c) & t.rlike(_has_class(c)), F.lit(k)) for k, c in enumerate(classes)]))
        return F.struct(
            F.lower(F.regexp_extract(t, "^</?([A-Za-z][A-Za-z0-9]*)", 1)).alias("tag"), i.alias("at"), opens.alias("opens"), found.alias("cls"))

    def step(state: Column, t: Column) -> Column:
        stack, done = state["stack"], state["done"]
        depth = F.size(stack)
        above = F.array_position(F.reverse(F.transform(stack, lambda o: o["tag"])), t["tag"]).cast("int")

        def closed(up: Column) -> Column:
            gone = F.filter(F.slice(stack, depth - up + 1, up), lambda o: F.size(o["cls"]) > 0)
            ended = F.concat(done, F.transform(gone, lambda o: F.struct(o["at"].alias("start"), t["at"].alias("end"), o["cls"].alias("cls"))))
            return F.when(up > 0, F.struct(F.slice(stack, F.lit(1), depth - up).alias("stack"), ended.alias("done"))).otherwise(state)

        opened = F.concat(stack, F.array(F.struct(t["tag"].alias("tag"), t["at"].alias("at"), t["cls"].alias("cls"))))
        return F.when(t["opens"], F.struct(opened.alias("stack"), done.alias("done"))).otherwise(_bind(above, closed))

    tags = F.filter(F.transform(tokens, tag), lambda t: (t["tag"] != "") & ~t["tag"].isin(*VOID_TAGS, "script", "style"))
    start = F.struct(F.array().cast(_STACK).alias("stack"), F.array().cast(_DONE).alias("done"))
    rest = lambda s: F.concat(s["done"], F.transform(  # noqa: E731  never closed: to the end of the page
        F.filter(s["stack"], lambda o: F.size(o["cls"]) > 0),
        lambda o: F.struct(o["at"].alias("start"), F.size(tokens).alias("end"), o["cls"].alias("cls"))))
    return F.array_sort(F.aggregate(tags, start, step, rest))


def _element_text(tokens: Column, element: Column, sep: str) -> Column:
    """Texts between an element's tags, ``sep`` where tags were, white space made one space, trimmed."""
    inside = F.slice(tokens, element["start"] + 2, F.greatest(element["end"] - element["start"] - 1, F.lit(0)))
    texts = F.filter(inside, lambda t: ~t.startswith("<") | (t == "<"))
    return F.trim(F.regexp_replace(F.array_join(texts, sep), r"\s+", " "))


def class_texts(pages: DataFrame, cls: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """Text of every element with class ``cls``, in page order; an element inside another of the class has its own row too."""
    hit = pages.where(F.col(html).contains(cls)).select(key, _once(html_tokens(F.col(html))).alias("_tokens"))
    found = hit.select(key, "_tokens", _once(class_elements(F.col("_tokens"), [cls])).alias("_found"))
    texts = F.transform("_found", lambda e: _element_text(F.col("_tokens"), e, " "))
    return found.select(key, F.posexplode(texts).alias("pos", "text")).select(key, F.col("pos").cast("int").alias("pos"), "text")


_BLOCK_CLASSES = ("tombstone-container", "period-name", "temp", "short-desc")


def forecast_blocks(tokens: Column, found: Column) -> Column:
    """Array of (period, temp_text, description) in page order: the first element of each class inside a container."""
    def child(block: Column, k: int, sep: str) -> Column:
        inner = F.get(F.filter(found, lambda e: F.array_contains(e["cls"], k) & (e["start"] > block["start"]) & (e["end"] <= block["end"])), F.lit(0))
        return _bind(inner, lambda e: F.when(e.isNotNull(), _element_text(tokens, e, sep)))

    containers = F.filter(found, lambda e: F.array_contains(e["cls"], 0))
    return F.transform(containers, lambda b: F.struct(
        child(b, 1, "").alias("period"), child(b, 2, " ").alias("temp_text"), child(b, 3, " ").alias("description")))


def first_int(text) -> Column:
    return F.nullif(F.regexp_extract(text, r"(-?\d+)", 1), F.lit("")).try_cast("int")


def next_high(pages: DataFrame, key: str = "page_id", location: str = "location", html: str = "html") -> DataFrame:
    """Per page the first block after today's with a high; one projection, no shuffle."""
    cut = pages.select(key, location, _once(html_tokens(F.col(html))).alias("_tokens"))
    cut = cut.select(key, location, "_tokens", _once(class_elements(F.col("_tokens"), _BLOCK_CLASSES)).alias("_found"))
    eligible = F.filter(forecast_blocks(F.col("_tokens"), F.col("_found")), lambda b: b["period"].isNotNull() & b["temp_text"].isNotNull()
                        & ~(b["period"].contains("Today") | b["period"].contains("Afternoon")) & b["temp_text"].contains("High"))
    mapped = F.upper(F.trim(F.col(location)))
    alias = F.col(location)
    for short, full in LOCATION_ALIASES.items():
        alias = F.when(mapped == short, F.lit(full)).otherwise(alias)
    return cut.select(key, alias.alias("location"), _once(F.get(eligible, F.lit(0))).alias("b")).select(
        key, "location",
        F.trim(F.split_part(F.col("location"), F.lit(","), F.lit(1))).alias("city"),
        F.col("b.period").alias("period"),
        first_int(F.col("b.temp_text")).alias("temp"),
        F.col("b.description").alias("description"),
    )


def city_highs(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """City and temperature of the pages that have one (the rows of the bar chart)."""
    return next_high(pages, key).where(F.col("temp").isNotNull()).select(key, "city", "temp")
