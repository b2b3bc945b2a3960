"""Queries over web pages: extraction, ingredient lines, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewright.functions import names, recipe_units, stems
from pricewright.operators import lexicon
from pricewright.plans.matching import NORMAL_SQL
from pricewright.plans.registry import query
from pricewright.sources.domain import Domain

#: Quantity, unit and the rest of a line, tried in this order.
LINE = r"^([0-9]+(?:[.,][0-9]+)?)\s*(?:(kg|g|l|ml|vnt)\b)?\s*(.*)$"


def fields(html):
    """Title, headline and number of paragraphs of a page, whatever else is in it."""
    first = lambda p: F.regexp_extract(html, p, 1)
    return F.struct(first(r"<title>([^<]*)</title>").alias("title"), first(r"<h1>([^<]*)</h1>").alias("headline"), F.regexp_count(html, F.lit(r"<p>")).alias("paragraphs"))


@query("src06_page_fields", r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS headline, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def src06(d: Domain):
    return d.table("pages").select("page_id", fields(F.col("html")).alias("f")).select("page_id", "f.title", "f.headline", "f.paragraphs")


@query("src03_list_entries", r"""
SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS link FROM pages""")
def src03(d: Domain):
    return d.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)">'), F.lit(1))).alias("link"))


@query("src09_page_language", "SELECT regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, count(*) AS pages FROM pages GROUP BY 1")
def src09(d: Domain):
    return d.table("pages").groupBy(F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang")).agg(F.count("*").alias("pages"))


@query("rcp01_ingredient_lines", r"""
raw AS (SELECT sp_id, CASE sp_id % 3 WHEN 0 THEN CAST(CAST(amount AS INT) AS VARCHAR) || ' ' || unit || ' ' || name WHEN 1 THEN CAST(CAST(amount AS INT) AS VARCHAR) || ',5 ' || name ELSE name END AS line FROM sp)
SELECT sp_id, CASE sp_id % 3 WHEN 0 THEN regexp_extract(line, '^([0-9]+)', 1)::DOUBLE WHEN 1 THEN replace(regexp_extract(line, '^([0-9]+,5)', 1), ',', '.')::DOUBLE END AS quantity,
  CASE WHEN sp_id % 3 = 0 AND unit <> 'pak' THEN unit END AS unit, CASE WHEN sp_id % 3 = 0 AND unit = 'pak' THEN 'pak ' || name ELSE name END AS name FROM (SELECT r.sp_id, r.line, s.unit, s.name FROM raw r JOIN sp s USING (sp_id))""")
def rcp01(d: Domain):
    count = F.col("amount").cast("int").cast("string")
    line = F.when(F.col("sp_id") % 3 == 0, F.concat_ws(" ", count, "unit", "name")).when(F.col("sp_id") % 3 == 1, F.concat(count, F.lit(",5 "), F.col("name"))).otherwise(F.col("name"))
    part = lambda i: F.regexp_extract("line", LINE, i)
    known = F.col("line").rlike(LINE)
    lines = d.sp.select("sp_id", line.alias("line"))
    return lines.select("sp_id", F.when(known, F.regexp_replace(part(1), ",", ".").cast("double")).alias("quantity"), F.when(known & (part(2) != ""), part(2)).alias("unit"), F.when(known, part(3)).otherwise(F.col("line")).alias("name"))


@query("rcp06_sweep_diff", """
a AS (SELECT sp_id, max(price) AS v FROM price WHERE day < DATE '1999-01-01' GROUP BY sp_id), b AS (SELECT sp_id, max(price) AS v FROM price WHERE day >= DATE '1999-01-01' GROUP BY sp_id)
SELECT coalesce(a.sp_id, b.sp_id) AS sp_id, CASE WHEN a.v IS NULL THEN 'new' WHEN b.v IS NULL THEN 'gone' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS verdict FROM a FULL JOIN b ON a.sp_id = b.sp_id""")
def rcp06(d: Domain):
    day = F.lit("1999-01-01").cast("date")
    side = lambda cond, name: d.price.where(cond).groupBy("sp_id").agg(F.max("price").alias(name))
    both = side(F.col("day") < day, "a").join(side(F.col("day") >= day, "b"), "sp_id", "full")
    return both.select("sp_id", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("verdict"))


UNIT_ROWS = ", ".join(f"('{n}', '{u}', '{d}', {m if m is not None else 'NULL'}, {str(v).lower()})" for n, u, d, m, v in (recipe_units.unit_row(n, u) for n, u in sorted(recipe_units.names().items())))


@query("uni09_recipe_units", f"""
unit(unit_name, unit, dimension, metric, vague) AS (VALUES {UNIT_ROWS}),
word AS (SELECT doc_id, string_split(trim(regexp_replace(replace(translate(lower(text), '{names.MARKED}', '{names.PLAIN}'), '.', ' '), '\\s+', ' ', 'g')), ' ') AS w FROM documents),
run AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS unit_name FROM word)
SELECT unit, dimension, metric::DOUBLE AS metric, vague, count(*) AS n FROM run JOIN unit USING (unit_name) GROUP BY ALL""")
def uni09(d: Domain):
    """Words and pairs of words of all documents that name a unit."""
    words = d.table("documents").select(F.split(recipe_units.unit_key(F.col("text")), " ").alias("words"))
    found = words.select(F.explode(recipe_units.named_runs(F.col("words"))).alias("phrase"))
    return recipe_units.with_unit(found.groupBy("phrase").agg(F.count("*").alias("n")), "phrase").where("unit IS NOT NULL").groupBy("unit", "dimension", "metric", "vague").agg(F.sum("n").alias("n"))


def link_lexicon(d: Domain):
    """Link texts and the first two words of headlines, as names of things; the page's address orders them."""
    page = d.table("pages").select("page_id", "html", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))
    links = page.select("page_id", "lang", F.explode(F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a>'), F.lit(1))).alias("form"))
    heads = page.select("page_id", "lang", F.concat_ws(" ", F.slice(names.tokens(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)), 1, 2)).alias("form"))
    return links.unionByName(heads).select(F.struct("page_id", "form").alias("place"), names.normal_name(F.col("form")).alias("key"), "lang", "form")


STEMS_SQL = rf"regexp_replace({{0}}, '{stems.RECIPE_STEM.replace('{', '{{').replace('}', '}}')}', '\1')"
SINGULAR_SQL = "CASE WHEN length({0}) >= 4 AND {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN left({0}, length({0}) - 1) ELSE {0} END"


def _changed(sql: str, words: str) -> str:
    return f"array_to_string(list_transform({words}, lambda w: {sql.format('w')}), ' ')"


@query("rcp02_lexicon_hits", f"""
page AS (SELECT page_id, html, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages),
link AS (SELECT page_id, lang, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS form FROM page
  UNION ALL SELECT page_id, lang, array_to_string(list_filter(string_split({NORMAL_SQL.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, ' '), lambda t: t <> '')[1:2], ' ') FROM page),
form AS (SELECT page_id, form, lang, {NORMAL_SQL.format('form')} AS key, string_split({NORMAL_SQL.format('form')}, ' ') AS w FROM link WHERE {NORMAL_SQL.format('form')} <> ''),
way AS (SELECT 0 AS kind, array_to_string(w, ' ') AS txt, * FROM form UNION ALL SELECT CASE WHEN lang = 'en' THEN 2 ELSE 1 END, CASE WHEN lang = 'en' THEN {_changed(SINGULAR_SQL, 'w')} ELSE {_changed(STEMS_SQL, 'w')} END, * FROM form),
known AS (SELECT kind, txt, arg_min(key, (page_id, form, key)) AS key FROM way GROUP BY kind, txt),
line AS (SELECT doc_id, unnest(string_split(text, '.')) AS phrase, generate_subscripts(string_split(text, '.'), 1) - 1 AS line_no FROM documents),
word AS (SELECT doc_id, line_no, list_filter(string_split({NORMAL_SQL.format('phrase')}, ' '), lambda t: t <> '') AS w FROM line),
run AS (SELECT doc_id, line_no, n, i AS pos, w[i + 1:i + n] AS r FROM word, (SELECT unnest(range(1, (SELECT max(len(w)) FROM form) + 1)) AS n), LATERAL (SELECT unnest(range(0, len(w) - n + 1)) AS i)),
tried AS (SELECT doc_id, line_no, n, pos, array_to_string(r, ' ') AS form, unnest([0, 1, 2]) AS kind, unnest([array_to_string(r, ' '), {_changed(STEMS_SQL, 'r')}, {_changed(SINGULAR_SQL, 'r')}]) AS txt FROM run),
hit AS (SELECT doc_id, line_no, n, pos, min(k.kind) AS kind, arg_min(k.key, (k.kind, k.key)) AS key, any_value(form) AS form FROM tried JOIN known k USING (kind, txt) GROUP BY ALL)
SELECT doc_id, line_no, key, form, n AS words, kind = 0 AS exact, pos FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY n DESC, kind = 0 DESC, pos) = 1""")
def rcp02(d: Domain):
    """What every sentence of every document is about, by the longest run of words that pages have links or headlines for."""
    lines = d.table("documents").select("doc_id", F.posexplode(F.split("text", r"\.")).alias("line_no", "phrase")).select(F.struct("doc_id", "line_no").alias("id"), "phrase")
    return lexicon.first_hit(lines, link_lexicon(d)).select("id.*", "key", "form", "words", "exact", F.col("at").alias("pos"))
