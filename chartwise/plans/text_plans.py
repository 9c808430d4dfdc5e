"""Text, JSON and HTML queries: publication themes, profiles, forecast highs."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartwise.operators import text as tx
from chartwise.operators import web
from chartwise.operators.joins import spread
from chartwise.plans.catalog import query
from chartwise.sources import fixtures as fx

_STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)

_WORDS = f"""
tw AS (SELECT author, coalesce(year, 'Unknown') AS year, work_id, title FROM fx_works WHERE title IS NOT NULL AND title <> ''),
sp AS (SELECT author, year, work_id,
              string_split_regex(trim(regexp_replace(lower(title), '{tx.NON_WORD}', '', 'g')), '\\s+') AS l FROM tw),
tok AS (SELECT author, year, work_id, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS pos FROM sp),
kept AS (SELECT author, year, work_id, pos, upper(substr(w, 1, 1)) || substr(w, 2) AS word FROM tok
         WHERE w <> '' AND w NOT IN ({_STOPS}) AND length(w) > 2),
seen AS (SELECT author, year, word, work_id, pos, count(*) OVER (PARTITION BY author, year, word) AS n,
                row_number() OVER (PARTITION BY author, year, word ORDER BY work_id, pos) AS nth FROM kept),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY author, year ORDER BY n DESC, work_id, pos, word) AS rank
                       FROM seen WHERE nth = 1) AS r
        WHERE rank <= {tx.TOP_K})"""


@query("top_words", f"WITH {_WORDS.strip()} SELECT author, year, CAST(rank AS INTEGER) AS rank, word, n FROM top",
       ids="F5 H1 H2 H3 H4")
def top_words(t):
    return tx.top_words(fx.works(t))


_TURN_WORDS = _WORDS.replace("fx_works", "turns")


@query("turn_words", f"""WITH turns AS (SELECT role AS author, CAST(turn AS VARCHAR) AS year, conv_id AS work_id, text AS title FROM conversations),
{_TURN_WORDS.strip()} SELECT author AS role, year AS turn, CAST(rank AS INTEGER) AS rank, word, n FROM top""", ids="F5 H1 H2 H3 H4")
def turn_words(t):
    """Top words of every role and turn of the stored conversations."""
    turns = t["conversations"].select(F.col("role").alias("author"), F.col("turn").cast("string").alias("year"),
                                      F.col("conv_id").alias("work_id"), F.col("text").alias("title"))
    return tx.top_words(turns).withColumnsRenamed({"author": "role", "year": "turn"})


@query("works_by_year", f"""WITH {_WORDS.strip()},
themes AS (SELECT author, year, string_agg(word, ', ' ORDER BY rank) AS themes FROM top GROUP BY author, year),
counts AS (SELECT author, year, count(*) AS n_works FROM tw GROUP BY author, year)
SELECT c.author, c.year, c.n_works, coalesce(th.themes, '') AS themes,
       row_number() OVER (PARTITION BY c.author ORDER BY c.year = 'Unknown', c.year DESC) AS display_order
FROM counts AS c LEFT JOIN themes AS th ON c.author = th.author AND c.year = th.year""", ids="D5 F4 F5 H4")
def works_by_year(t):
    return tx.works_by_year(fx.works(t))


@query("works_totals", """
SELECT author, year, count(*) AS n_works
FROM (SELECT author, coalesce(year, 'Unknown') AS year FROM fx_works WHERE title IS NOT NULL AND title <> '') AS w
GROUP BY ROLLUP (author, year)""", ids="D6")
def works_totals(t):
    return tx.works_totals(fx.works(t))


@query("publication_series", """
SELECT author, year, count(*) AS n_works, row_number() OVER (PARTITION BY author ORDER BY year) AS chrono_idx
FROM fx_works WHERE title IS NOT NULL AND title <> '' AND year IS NOT NULL GROUP BY author, year""", ids="F6")
def publication_series(t):
    return tx.publication_series(fx.works(t))


def _text_at(json: str, path: str) -> str:
    return f"json_extract_string({json}, '{path}')"


_NAME = " OR ".join(f"json_type(body, '{p}') = 'NULL'" for p in (
    "$.person", "$.person.name", '$.person.name."given-names"', '$.person.name."family-name"'))


@query("profile_affiliations", f"""
WITH p AS (SELECT profile_id,
                  CASE WHEN {_NAME} THEN 'Unknown Name' ELSE
                    trim(coalesce({_text_at('body', '$.person.name."given-names".value')}, '') || ' ' ||
                         coalesce({_text_at('body', '$.person.name."family-name".value')}, '')) END AS full_name,
                  json_extract(body, '$."activities-summary".employments."affiliation-group"[*]') AS groups
           FROM fx_profiles),
g AS (SELECT profile_id, full_name, unnest(groups) AS grp, generate_subscripts(groups, 1) - 1 AS aff_no FROM p),
s AS (SELECT *, json_extract(grp, '$.summaries[0]."employment-summary"') AS es FROM g
      WHERE json_array_length(grp, '$.summaries') > 0)
SELECT profile_id, full_name, CAST(aff_no AS INTEGER) AS aff_no,
       coalesce({_text_at('es', '$.organization.name')}, 'None') || ' (' ||
       CASE WHEN {_text_at('es', '$."start-date"')} IS NULL THEN '?' ELSE coalesce({_text_at('es', '$."start-date".year.value')}, 'None') END
       || '-' ||
       CASE WHEN {_text_at('es', '$."end-date"')} IS NULL THEN 'Present' ELSE coalesce({_text_at('es', '$."end-date".year.value')}, 'None') END
       || ')' AS affiliation
FROM s""", ids="A8 H5 H6 H7")
def profile_affiliations(t):
    return web.profile_affiliations(fx.profiles(t))


@query("profile_works", f"""
WITH g AS (SELECT profile_id, unnest(gs) AS grp, generate_subscripts(gs, 1) - 1 AS work_no
           FROM (SELECT profile_id, json_extract(body, '$."activities-summary".works.group[*]') AS gs FROM fx_profiles) AS x),
w AS (SELECT profile_id, CAST(work_no AS INTEGER) AS work_no, {_text_at('grp', '$."work-summary"[0].title.title.value')} AS title,
             coalesce({_text_at('grp', '$."work-summary"[0]."publication-date".year.value')}, 'Unknown') AS year FROM g)
SELECT profile_id, work_no, title, year FROM w WHERE title IS NOT NULL AND title <> ''""", ids="A8 H7 D5")
def profile_works(t):
    return web.profile_works(fx.profiles(t))


_OPEN = r"""<[A-Za-z][A-Za-z0-9]*\b[^>]*\bclass="([^"]*\s)?{}(\s[^"]*)?"[^>]*>"""


def _tag_sql(cls: str, sep: str) -> str:
    inner = f"regexp_extract(block, '(?s){_OPEN.format(cls)}(.*?)</[A-Za-z0-9]+>', 3)"
    text = f"trim(regexp_replace(regexp_replace({inner}, '<[^>]+>', '{sep}', 'g'), '\\s+', ' ', 'g'))"
    return f"CASE WHEN regexp_matches(block, '{_OPEN.format(cls)}') THEN {text} END"


_HIGHS = f"""
l AS (SELECT page_id, string_split_regex(html, '{_OPEN.format("tombstone-container").replace("([", "(?:[").replace("(\\s", "(?:\\s")}')[2:] AS bl
      FROM fx_forecasts),
b AS (SELECT page_id, unnest(bl) AS block, generate_subscripts(bl, 1) - 1 AS pos FROM l),
t AS (SELECT page_id, pos, {_tag_sql('period-name', '')} AS period, {_tag_sql('temp', ' ')} AS temp_text,
             {_tag_sql('short-desc', ' ')} AS description FROM b),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM t
      WHERE period IS NOT NULL AND temp_text IS NOT NULL AND NOT (contains(period, 'Today') OR contains(period, 'Afternoon'))
        AND contains(temp_text, 'High')) AS q WHERE rn = 1),
loc AS (SELECT page_id, CASE upper(trim(location)) WHEN 'MDW' THEN '{web.LOCATION_ALIASES['MDW']}'
                        WHEN 'CENTRAL PARK' THEN '{web.LOCATION_ALIASES['CENTRAL PARK']}' ELSE location END AS location
        FROM fx_forecasts),
highs AS (SELECT loc.page_id, loc.location, trim(split_part(loc.location, ',', 1)) AS city, e.period,
                 TRY_CAST(nullif(regexp_extract(e.temp_text, '(-?\\d+)', 1), '') AS INTEGER) AS temp, e.description
          FROM loc LEFT JOIN e ON loc.page_id = e.page_id)"""


@query("forecast_highs", f"WITH {_HIGHS.strip()} SELECT * FROM highs", ids="A9 B10 F8 H8 H9 H10 H11")
def forecast_highs(t):
    return web.next_high(fx.forecasts(t))


@query("city_highs", f"WITH {_HIGHS.strip()} SELECT page_id, city, temp FROM highs WHERE temp IS NOT NULL", ids="H11 B4")
def city_highs(t):
    return web.city_highs(fx.forecasts(t))


@query("page_ads", """
WITH l AS (SELECT page_id, regexp_extract_all(html, '(?s)<div\\b[^>]*\\bclass="(?:[^"]*\\s)?ad(?:\\s[^"]*)?"[^>]*>(.*?)</div>', 1) AS bl FROM pages),
b AS (SELECT page_id, unnest(bl) AS block, generate_subscripts(bl, 1) - 1 AS pos FROM l)
SELECT page_id, CAST(pos AS INTEGER) AS pos, trim(regexp_replace(regexp_replace(block, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM b""",
       ids="A9 H9")
def page_ads(t):
    """Blocks of one class, in page order, from the stored web pages."""
    return web.class_texts(spread(t["pages"].select("page_id", "html"), "page_id"), "ad")
