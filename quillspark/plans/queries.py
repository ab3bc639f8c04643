"""The core queries, by name, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import strings, urls
from quillspark.operators import chunking, classify, crawl, html, jsonrepair, links, merge, pipeline, report, shred
from quillspark.plans import fixtures
from quillspark.sources import remote
from quillspark.sources.fetch import lookup
from quillspark.sources.files import inventory
from quillspark.sources.sinks import as_json
from quillspark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

SITE = "https://www.nadupura-acts.example"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


P5_SQL = """
WITH sections AS (SELECT rec_id, generate_subscripts(detailed_sections, 1) - 1 AS pos, unnest(detailed_sections) AS s FROM aiscript),
penalties AS (SELECT rec_id, generate_subscripts(penalties_and_consequences, 1) - 1 AS pos, unnest(penalties_and_consequences) AS p FROM aiscript),
details AS (SELECT rec_id, pos AS parent_pos, generate_subscripts(s.key_details, 1) - 1 AS pos, unnest(s.key_details) AS v FROM sections),
lists AS (
  SELECT rec_id, 'people' AS child, important_entities.people AS a FROM aiscript
  UNION ALL SELECT rec_id, 'organizations', important_entities.organizations FROM aiscript
  UNION ALL SELECT rec_id, 'locations', important_entities.locations FROM aiscript
  UNION ALL SELECT rec_id, 'amounts', important_entities.amounts FROM aiscript
  UNION ALL SELECT rec_id, 'dates', important_entities.dates FROM aiscript
  UNION ALL SELECT rec_id, 'references', important_entities."references" FROM aiscript),
entities AS (SELECT rec_id, child, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS v FROM lists)
SELECT rec_id, 'detailed_sections' AS child, -1 AS parent_pos, CAST(pos AS INTEGER) AS pos FROM sections
WHERE s.section_title IS NOT NULL OR s.content IS NOT NULL OR s.key_details IS NOT NULL
UNION ALL SELECT rec_id, 'key_details', CAST(parent_pos AS INTEGER), CAST(pos AS INTEGER) FROM details WHERE v IS NOT NULL
UNION ALL SELECT rec_id, 'penalties_and_consequences', -1, CAST(pos AS INTEGER) FROM penalties
WHERE p.violation IS NOT NULL OR p.penalty IS NOT NULL OR p.amount IS NOT NULL OR p.conditions IS NOT NULL
UNION ALL SELECT rec_id, child, -1, CAST(pos AS INTEGER) FROM entities WHERE v IS NOT NULL
"""


@_query(P5_SQL)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.elements(shred.adjacency(table(spark, d, "aiscript")))


def _p5_table(name: str, columns: list[str]) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return shred.entity_tables(shred.adjacency(table(spark, d, "aiscript")))[name].select(*columns)

    query.__name__ = f"p5_{name}"
    return query


_query("""WITH s AS (SELECT rec_id, generate_subscripts(detailed_sections, 1) - 1 AS pos, unnest(detailed_sections) AS s FROM aiscript)
SELECT rec_id, 'detailed_sections[' || pos || ']' AS node, CAST(pos AS INTEGER) AS pos, s.section_title AS section_title, s.content AS content FROM s
WHERE s.section_title IS NOT NULL OR s.content IS NOT NULL OR s.key_details IS NOT NULL""")(_p5_table("sections", ["rec_id", "node", "pos", "section_title", "content"]))
_query("""WITH s AS (SELECT rec_id, generate_subscripts(detailed_sections, 1) - 1 AS pos, unnest(detailed_sections) AS s FROM aiscript),
k AS (SELECT rec_id, pos AS parent_pos, generate_subscripts(s.key_details, 1) - 1 AS pos, unnest(s.key_details) AS value FROM s)
SELECT rec_id, 'detailed_sections[' || parent_pos || ']' AS parent, CAST(pos AS INTEGER) AS pos, value FROM k WHERE value IS NOT NULL""")(_p5_table("key_details", ["rec_id", "parent", "pos", "value"]))
_query("""WITH s AS (SELECT rec_id, generate_subscripts(penalties_and_consequences, 1) - 1 AS pos, unnest(penalties_and_consequences) AS p FROM aiscript)
SELECT rec_id, CAST(pos AS INTEGER) AS pos, p.violation AS violation, p.penalty AS penalty, p.amount AS amount, p.conditions AS conditions FROM s
WHERE p.violation IS NOT NULL OR p.penalty IS NOT NULL OR p.amount IS NOT NULL OR p.conditions IS NOT NULL""")(_p5_table("penalties", ["rec_id", "pos", "violation", "penalty", "amount", "conditions"]))
_query("""WITH lists AS (
  SELECT rec_id, 'people' AS kind, important_entities.people AS a FROM aiscript
  UNION ALL SELECT rec_id, 'organizations', important_entities.organizations FROM aiscript
  UNION ALL SELECT rec_id, 'locations', important_entities.locations FROM aiscript
  UNION ALL SELECT rec_id, 'amounts', important_entities.amounts FROM aiscript
  UNION ALL SELECT rec_id, 'dates', important_entities.dates FROM aiscript
  UNION ALL SELECT rec_id, 'references', important_entities."references" FROM aiscript),
e AS (SELECT rec_id, kind, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS value FROM lists)
SELECT rec_id, kind, CAST(pos AS INTEGER) AS pos, value FROM e WHERE value IS NOT NULL""")(_p5_table("entities", ["rec_id", "kind", "pos", "value"]))


# ---- links and URLs -------------------------------------------------------------------------

_ALL_LINKS = """SELECT page_id, url, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href
FROM (SELECT page_id, url, regexp_extract_all(html, '<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1, 'is') AS h FROM {pages}) t"""


@_query(f"SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM ({_ALL_LINKS.format(pages='page')}) l")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    return links.extract(table(spark, d, "page"))


@_query(f"SELECT page_id, count(*) AS n_links, sum(CAST(contains(lower(href), 'pdf') AS BIGINT)) AS n_pdf FROM ({_ALL_LINKS.format(pages='page')}) l GROUP BY page_id")
def link_counts(spark: SparkSession, d: str) -> DataFrame:
    """Links and PDF links of each page that has any."""
    return links.extract(table(spark, d, "page")).groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_if(links.is_pdf_link(F.col("href"))).alias("n_pdf"))


@_query("""SELECT l.page_id, l.pos, l.href, CASE
  WHEN href IS NULL THEN NULL WHEN href = '' THEN url WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
  WHEN href LIKE '//%' THEN regexp_extract(url, '^[a-z]+:') || href
  WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href
  WHEN href LIKE '?%' THEN regexp_replace(url, '[?#].*$', '') || href
  WHEN href LIKE '#%' THEN regexp_replace(url, '#.*$', '') || href
  WHEN href LIKE '../%' THEN regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', ''), '([^/:])/[^/]+/$', '\\1/') || substr(href, 4)
  ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END AS page_abs,
  CASE WHEN href LIKE 'http%' THEN href ELSE 'https://www.nadupura-acts.example' || href END AS naive_abs
FROM link l JOIN page p ON l.page_id = p.page_id""")
def link_absolute(spark: SparkSession, d: str) -> DataFrame:
    """Links seen from their page, and naively behind the site's address."""
    own = table(spark, d, "link").join(table(spark, d, "page").select("page_id", "url"), "page_id")
    href = F.col("href")
    return own.select("page_id", "pos", "href", urls.resolve(F.col("url"), href).alias("page_abs"), urls.prefixed(SITE, href).alias("naive_abs"))


@_query("SELECT page_id, pos, href, regexp_matches(lower(href), '\\.pdf([?#].*)?$') AND NOT regexp_matches(regexp_replace(lower(href), '[?#].*$', ''), '[^f]$') AS by_suffix FROM link WHERE contains(lower(href), 'pdf')")
def pdf_link_filter(spark: SparkSession, d: str) -> DataFrame:
    """Links with ``pdf`` anywhere, and whether the path really ends in ``.pdf``."""
    href = F.col("href")
    return table(spark, d, "link").filter(links.is_pdf_link(href)).select("page_id", "pos", "href", links.is_pdf_link(href, "suffix").alias("by_suffix"))


@_query(f"""WITH p AS ({fixtures.PAGES}), l AS ({_ALL_LINKS.format(pages='p')}), c AS (
  SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'onclick="window.open\\(.([^)]*\\.pdf)', 1))) AS target FROM p WHERE html IS NOT NULL)
SELECT page_id, href AS target FROM l WHERE contains(lower(href), 'pdf') UNION ALL SELECT page_id, target FROM c""")
def onclick_links(spark: SparkSession, d: str) -> DataFrame:
    """PDF links, then onclick targets that are not among them."""
    pages = fixtures.make(spark, d, fixtures.PAGES)
    return links.pdf_targets(pages, lambda url, h: h).select("page_id", "target")


@_query(f"WITH p AS ({fixtures.PAGES}) SELECT page_id, unnest(regexp_extract_all(html, 'var u=\"([^\"]*\\.pdf)\"', 1)) AS target FROM p")
def script_links(spark: SparkSession, d: str) -> DataFrame:
    pages = fixtures.make(spark, d, fixtures.PAGES)
    return pages.select("page_id", F.explode(links.script_targets(F.col("html"))).alias("target"))


@_query("""SELECT abs_url, min(page_id) AS page_id, CAST(min_by(pos, page_id * 1000000 + pos) AS INTEGER) AS pos, count(*) AS n_seen FROM link WHERE abs_url IS NOT NULL GROUP BY abs_url""")
def link_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Each address once, where it was seen first."""
    return links.first_seen(table(spark, d, "link"), "abs_url", ["page_id", "pos"])


@_query("""WITH n AS (SELECT page_id, pos, abs_url, regexp_extract(regexp_replace(regexp_replace(regexp_replace(abs_url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '^//[^/]*', ''), '[^/]*$') AS base FROM link WHERE abs_url IS NOT NULL)
SELECT page_id, pos, base AS base_name, CASE WHEN base LIKE '%.pdf' THEN base ELSE 'document_' || (pos + 1) || '.pdf' END AS saved_name,
  CASE WHEN lower(base) LIKE '%.pdf' THEN base ELSE 'document_' || (pos + 1) || '.pdf' END AS saved_any_case,
  url_decode(regexp_extract(abs_url, '[^/]*$')) AS unquoted, regexp_replace(base, '[<>:"/\\\\|?*]', '_', 'g') AS safe_name FROM n""")
def filename_from_url(spark: SparkSession, d: str) -> DataFrame:
    u, pos = F.col("abs_url"), F.col("pos")
    return table(spark, d, "link").filter(u.isNotNull()).select(
        "page_id", "pos", urls.base_name(u).alias("base_name"), urls.saved_name(u, pos).alias("saved_name"), urls.saved_name(u, pos, True).alias("saved_any_case"), urls.unquoted_name(u).alias("unquoted"), urls.safe_name(urls.base_name(u)).alias("safe_name")
    )


@_query("""SELECT act_title, left(regexp_replace(regexp_replace(act_title, '[\\\\/*?:"<>|]', '', 'g'), '\\s+', '_', 'g'), 150) || '.pdf' AS saved_name FROM (SELECT act_title FROM view_log UNION ALL SELECT document_info.title FROM aiscript) t""")
def sanitize_title(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "view_log").select("act_title").unionAll(table(spark, d, "aiscript").select(F.col("document_info.title").alias("act_title")))
    return titles.select("act_title", strings.squeeze_name(F.col("act_title")).alias("saved_name"))


_CLASSIFIED = f"""WITH x AS ({fixtures.DETAILS}) SELECT page_id, act_title, act_url,
  CASE page_id % 5 WHEN 0 THEN 'Direct PDF' WHEN 1 THEN 'Google Drive' WHEN 2 THEN 'Scribd Viewer' WHEN 3 THEN 'Scribd Viewer' ELSE 'Not Found' END AS link_type,
  CASE page_id % 5 WHEN 0 THEN '{SITE}' || regexp_extract(html, 'href="([^"]*)"', 1) WHEN 1 THEN regexp_extract(html, 'src="([^"]*)"', 1) END AS source_url,
  CASE page_id % 5 WHEN 0 THEN '{SITE}' || regexp_extract(html, 'href="([^"]*)"', 1) WHEN 1 THEN 'https://drive.google.com/uc?export=download&id=' || regexp_extract(html, '/d/([a-zA-Z0-9_-]+)', 1) END AS download_url,
  CASE WHEN page_id % 5 IN (2, 3) THEN regexp_extract(html, 'scribd_iframe_embed" src="([^"]*)"', 1) WHEN page_id % 5 = 4 THEN 'N/A' END AS viewer_url FROM x"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return classify.classify(fixtures.make(spark, d, fixtures.DETAILS), SITE)


@_query(f"SELECT page_id, link_type, source_url, download_url, viewer_url FROM ({_CLASSIFIED}) c")
def link_classify(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("page_id", "link_type", "source_url", "download_url", "viewer_url")


@_query(f"SELECT act_title, act_url AS page_url, link_type, viewer_url FROM ({_CLASSIFIED}) c WHERE link_type IN ('Scribd Viewer', 'Not Found')")
def act_view_log(spark: SparkSession, d: str) -> DataFrame:
    return classify.view_rows(_classified(spark, d))


@_query(f"""SELECT act_title, regexp_replace(regexp_replace(act_title, '[\\\\/*?:"<>|]', '', 'g'), '\\s+', '_', 'g') || '.pdf' AS saved_filename, source_url FROM ({_CLASSIFIED}) c WHERE link_type IN ('Direct PDF', 'Google Drive')""")
def act_download_log(spark: SparkSession, d: str) -> DataFrame:
    return classify.download_rows(_classified(spark, d))


@_query("SELECT l.page_id, l.pos, l.abs_url, length(p.html) AS html_chars FROM link l JOIN page p ON l.abs_url = p.url")
def detail_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Listing links with the page they lead to; links to pages that are not there are dropped."""
    found = lookup(table(spark, d, "link").select("page_id", "pos", "abs_url"), table(spark, d, "page"), "abs_url")
    return found.select("page_id", "pos", "abs_url", F.length("html").alias("html_chars"))


@_query("SELECT split_part(split_part(abs_url, '://', 2), '/', 1) AS host, count(*) AS n_links, sum(CAST(contains(lower(href), 'pdf') AS BIGINT)) AS n_pdf FROM link WHERE abs_url LIKE 'http%' GROUP BY 1")
def host_counts(spark: SparkSession, d: str) -> DataFrame:
    """Links and PDF links by host."""
    host = F.regexp_extract("abs_url", r"^[a-z]+://([^/]*)", 1)
    return table(spark, d, "link").filter(F.col("abs_url").startswith("http")).groupBy(host.alias("host")).agg(F.count("*").alias("n_links"), F.sum(links.is_pdf_link(F.col("href")).cast("bigint")).alias("n_pdf"))


# ---- listing pages --------------------------------------------------------------------------


@_query(f"WITH x AS ({fixtures.LISTING}) SELECT page_id, '/handle/' || page_id AS href FROM x WHERE html IS NOT NULL")
def table_row_links(spark: SparkSession, d: str) -> DataFrame:
    pages = html.parsed(fixtures.make(spark, d, fixtures.LISTING))
    return pages.select("page_id", F.explode(html.panel_links(F.col("elements"))).alias("href"))


@_query(f"WITH x AS ({fixtures.LISTING}) SELECT page_id, '/bare-acts/' || page_id AS href, 'The Water & Land Act' AS text FROM x WHERE html IS NOT NULL")
def container_links(spark: SparkSession, d: str) -> DataFrame:
    pages = html.parsed(fixtures.make(spark, d, fixtures.LISTING))
    return pages.select("page_id", F.inline(html.container_links(F.col("elements"), "ul", "act_child_list")))


@_query(f"WITH x AS ({fixtures.LISTING}) SELECT page_id, '/browse?p=' || (page_id % 7) AS href FROM x WHERE page_id % 7 > 1")
def numbered_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = html.parsed(fixtures.make(spark, d, fixtures.LISTING))
    return pages.select("page_id", F.explode(html.numbered_pages(F.col("elements"))).alias("href"))


@_query(f"""WITH RECURSIVE x AS ({fixtures.LISTING}), e AS (SELECT url, nullif(regexp_extract(html, 'title="Next Page" href="([^"]*)"', 1), '') AS next FROM x),
c AS (SELECT url AS start, url, 0 AS depth FROM e UNION ALL SELECT start, e.next, depth + 1 FROM c JOIN e ON c.url = e.url WHERE e.next IS NOT NULL AND depth < 20)
SELECT start, url, depth FROM c""")
def next_page_closure(spark: SparkSession, d: str) -> DataFrame:
    pages = html.parsed(fixtures.make(spark, d, fixtures.LISTING)).select("url", html.next_page(F.col("elements")).alias("next"))
    return crawl.next_page_closure(pages, pages.select("url"))


@_query("""WITH n AS (SELECT page_id, url, unnest([2, 3, 4, 5]) AS n, strpos(url, '#') AS h FROM page),
u AS (SELECT page_id, n, CASE WHEN h > 0 THEN left(url, h - 1) ELSE url END AS bare, CASE WHEN h > 0 AND h < length(url) THEN substr(url, h) ELSE '' END AS fragment FROM n),
v AS (SELECT page_id, n, fragment, split_part(bare, '?', 1) AS place, CASE WHEN contains(bare, '?') THEN substr(bare, strpos(bare, '?') + 1) ELSE '' END AS query FROM u)
SELECT page_id, place || '?' || CASE WHEN query = '' THEN '' ELSE query || '&' END || 'page=' || n || fragment AS page_url FROM v
UNION ALL SELECT page_id, CASE WHEN right(place, 1) = '/' THEN place ELSE place || '/' END || 'page/' || n || CASE WHEN query = '' THEN '' ELSE '?' || query END || fragment FROM v""")
def pagination_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page").select("page_id", F.explode(urls.page_urls(F.col("url"), F.lit(7))).alias("page_url"))


@_query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/s/' || page_id || '.pdf' WHEN 1 THEN '/u/' || page_id || '.pdf' WHEN 2 THEN '/q?a=1&b=' || page_id || '.pdf/€' WHEN 3 THEN '/yes/' || page_id || '.pdf' WHEN 4 THEN '/t/' || page_id || '.pdf' ELSE '/c/' || page_id || '.pdf' END AS target FROM page""")
def link_markup(spark: SparkSession, d: str) -> DataFrame:
    """Links in any quotes, with references, beside comments and scripts that hold none; onclick handlers in single quotes."""
    return links.pdf_targets(fixtures.make(spark, d, fixtures.MARKUP), lambda url, h: h).select("page_id", "target")


@_query("SELECT page_id, '/deep/' || page_id AS href FROM page UNION ALL SELECT page_id, '/second/' || page_id FROM page")
def nested_rows(spark: SparkSession, d: str) -> DataFrame:
    """Cells that hold a table of their own."""
    pages = html.parsed(fixtures.make(spark, d, fixtures.NESTED))
    return pages.select("page_id", F.explode(html.panel_links(F.col("elements"))).alias("href"))


@_query("""WITH p AS (SELECT page_id FROM page WHERE page_id % 3 <> 0) SELECT page_id, '/one' AS href, 'First <Act>' AS text, CAST(NULL AS VARCHAR) AS missing FROM p
UNION ALL SELECT page_id, '/two/' || page_id, 'Second Act', NULL FROM p UNION ALL SELECT page_id, '/three', 'Third', NULL FROM p
UNION ALL SELECT page_id, NULL, NULL, 'no ul with id act_child_list' FROM page WHERE page_id % 3 = 0""")
def nested_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists in lists, and a row for each page without its list."""
    pages = html.parsed(fixtures.make(spark, d, fixtures.NESTED))
    found = F.col("elements")
    own = pages.select("page_id", F.inline_outer(html.container_links(found, "ul", "act_child_list")), html.missing_container(found, "ul", "act_child_list").alias("missing"))
    return own


@_query("""SELECT page_id, CASE page_id % 13 WHEN 0 THEN '/x?page=' WHEN 1 THEN '/x?p=' WHEN 2 THEN '/x?offset=' WHEN 3 THEN '/x?start=' WHEN 11 THEN '/m/next/' ELSE '/m' END || page_id AS href FROM page""")
def pagination_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that page on, by each of the marks."""
    pages = html.parsed(fixtures.make(spark, d, fixtures.PAGER))
    return pages.select("page_id", F.explode(html.pagination_links(F.col("elements"))).alias("href"))


@_query("""SELECT page_id, pos, CASE WHEN href = '' THEN 'https://www.nadupura-acts.example' WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN 'https:' || href
  WHEN href LIKE '/%' THEN 'https://www.nadupura-acts.example' || href WHEN href LIKE '?%' OR href LIKE '#%' THEN 'https://www.nadupura-acts.example' || href
  WHEN href LIKE '../%' THEN 'https://www.nadupura-acts.example/' || substr(href, 4) ELSE 'https://www.nadupura-acts.example/' || href END AS site_abs FROM link WHERE href IS NOT NULL""")
def link_from_site(spark: SparkSession, d: str) -> DataFrame:
    """Links seen from the site's root instead of their page."""
    return table(spark, d, "link").filter("href is not null").select("page_id", "pos", urls.resolve(F.lit(SITE), F.col("href")).alias("site_abs"))


@_query("SELECT page_id, min_by(href, pos) FILTER (WHERE contains(href, '.pdf')) AS by_part, min_by(href, pos) FILTER (WHERE lower(href) LIKE '%.pdf') AS by_end FROM (" + _ALL_LINKS.format(pages="page") + ") l GROUP BY page_id")
def first_pdf(spark: SparkSession, d: str) -> DataFrame:
    """The first link of a page that has ``.pdf`` anywhere, and the first that ends in it in any case."""
    h = F.col("html")
    return table(spark, d, "page").filter(F.size(links.hrefs(h)) > 0).select("page_id", classify.first_pdf(h, False).alias("by_part"), classify.first_pdf(h, True).alias("by_end"))


@_query("""SELECT page_id, pos, CASE WHEN starts_with(href, 'http://') OR starts_with(href, 'https://') THEN href ELSE 'https://' || href END AS with_scheme, 'pdfs/' || regexp_extract(regexp_replace(abs_url, '[?#].*$', ''), '[^/]*$') AS saved_path,
  NOT (contains(lower(coalesce(abs_url, '')), 'pdf') OR pos % 3 = 0) AS suspect FROM link WHERE href IS NOT NULL AND abs_url LIKE 'http%/%/%'""")
def link_checks(spark: SparkSession, d: str) -> DataFrame:
    """Links with a scheme, the path they are saved under, and whether neither address nor content type (of every third) speaks of a PDF."""
    own = table(spark, d, "link").filter("href is not null and abs_url like 'http%/%/%'")
    u = F.col("abs_url")
    kind = F.when(F.col("pos") % 3 == 0, F.lit("Application/PDF")).otherwise(F.lit("text/html"))
    return own.select("page_id", "pos", urls.with_scheme(F.col("href")).alias("with_scheme"), urls.joined("pdfs", urls.base_name(u)).alias("saved_path"), pipeline.is_suspect(u, kind).alias("suspect"))


@_query("""WITH a AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN ' YES ' WHEN 1 THEN 'y' WHEN 2 THEN 'no' WHEN 3 THEN '' ELSE 'yep' END AS answer,
  CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'many' ELSE CAST(page_id AS VARCHAR) END AS number FROM page)
SELECT page_id, page_id % 5 < 2 AS download, coalesce(TRY_CAST(number AS DOUBLE), 3.0) AS delay, CAST(greatest(1, least(20, coalesce(TRY_CAST(number AS INTEGER), 5))) AS INTEGER) AS max_pages, greatest(1.0, coalesce(TRY_CAST(number AS DOUBLE), 2.0)) AS crawl_delay,
  'line ' || page_id || CASE WHEN page_id % 2 = 0 THEN chr(10) || chr(10) || 'more' ELSE '' END AS prompt FROM a""")
def parameters(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a dialogue: flags, numbers with defaults and bounds, a prompt that two empty lines end."""
    asked = spark.sql(f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN ' YES ' WHEN 1 THEN 'y' WHEN 2 THEN 'no' WHEN 3 THEN '' ELSE 'yep' END AS answer,
      CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'many' ELSE CAST(page_id AS STRING) END AS number,
      concat('line ', page_id, CASE WHEN page_id % 2 = 0 THEN concat(chr(10), chr(10), 'more') ELSE '' END, CASE WHEN page_id % 3 = 0 THEN concat(chr(10), chr(10), chr(10), 'not read') ELSE '' END) AS typed FROM parquet.`{d}/page.parquet`""")
    n = F.col("number")
    return asked.select("page_id", strings.yes(F.col("answer")).alias("download"), strings.number_or(n, 3.0).alias("delay"), urls.clamp_pages(n).alias("max_pages"), urls.clamp_delay(n).alias("crawl_delay"), strings.prompt_lines(F.col("typed")).alias("prompt"))


#: A crawl in SQL: one row for each depth, with the lists of new and of all pages as its state.
_CRAWL_SQL = """WITH RECURSIVE best AS (SELECT p.url, l.pos, l.abs_url AS target FROM link l JOIN page p ON l.page_id = p.page_id WHERE l.abs_url IS NOT NULL),
level AS (SELECT 0 AS depth, list(url ORDER BY url) AS front, list(url ORDER BY url) AS seen, count(*) + 500 AS budget FROM (SELECT DISTINCT url FROM page) p
  UNION ALL SELECT depth + 1, new, list_concat(seen, new), budget FROM (SELECT depth, seen, budget, (SELECT list_slice(list(target ORDER BY o, target), 1, budget - len(seen)) FROM (
      SELECT target, min({'by_': by_, 'pos': pos}) AS o FROM (
        SELECT target, list_position(front, b.url) - 1 AS by_, pos, row_number() OVER (PARTITION BY b.url ORDER BY pos, target) AS k FROM best b WHERE list_contains(front, b.url) AND NOT list_contains(seen, target)) c WHERE k <= 3 GROUP BY target) t) AS new
    FROM level WHERE len(seen) < budget) s WHERE len(new) > 0)
SELECT unnest(front) AS url, depth, CAST(len(seen) - len(front) + generate_subscripts(front, 1) - 1 AS INTEGER) AS rank FROM level"""


@_query(_CRAWL_SQL)
def crawl_pages(spark: SparkSession, d: str) -> DataFrame:
    """A breadth-first crawl over the link table from all pages: 500 further addresses at most, three new links from each."""
    pages = table(spark, d, "page").select("page_id", "url")
    own = table(spark, d, "link").join(pages, "page_id").select("url", "pos", F.col("abs_url").alias("target"))
    return crawl.bounded_crawl(own, pages, pages.select("url").distinct().count() + 500)


# ---- chunks ---------------------------------------------------------------------------------


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _folded(source: str) -> str:
    """SQL of the chunk lists of the texts of ``source``, as ``c``."""
    return f"""d AS ({source}), f AS (SELECT doc_id, text, list_reduce(
  list_transform(string_split(text, chr(10) || chr(10)), lambda p: {{done: CAST([] AS VARCHAR[]), cur: p}}),
  lambda a, p: CASE
    WHEN length(a.cur) + length(p.cur) + 2 <= 2000 THEN {{done: a.done, cur: a.cur || p.cur || chr(10) || chr(10)}}
    WHEN a.cur <> '' THEN {{done: list_append(a.done, {_STRIP.format("a.cur")}), cur: p.cur}}
    ELSE list_reduce(list_transform(string_split(p.cur, '. '), lambda s: {{done: CAST([] AS VARCHAR[]), cur: s}}),
      lambda b, s: CASE
        WHEN length(b.cur) + length(s.cur) + 2 <= 2000 THEN {{done: b.done, cur: b.cur || s.cur || '. '}}
        WHEN b.cur <> '' THEN {{done: list_append(b.done, {_STRIP.format("b.cur")}), cur: s.cur}}
        ELSE {{done: list_append(b.done, left(s.cur, 2000)), cur: ''}} END, {{done: a.done, cur: ''}}) END,
  {{done: CAST([] AS VARCHAR[]), cur: ''}}) AS r FROM d WHERE length(text) > 2000),
c AS (SELECT doc_id, text, CASE WHEN {_STRIP.format("r.cur")} <> '' THEN list_append(r.done, {_STRIP.format("r.cur")}) ELSE r.done END AS chunks FROM f
  UNION ALL SELECT doc_id, text, [text] FROM d WHERE length(text) <= 2000)"""


_CHUNKS_SQL = f"""WITH {_folded(fixtures.CHUNKS)}
SELECT doc_id, CAST(generate_subscripts(chunks, 1) AS INTEGER) AS chunk_no, CAST(len(chunks) AS INTEGER) AS n_chunks, unnest(chunks) AS chunk FROM c"""


@_query(_CHUNKS_SQL)
def chunk_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_rows(fixtures.make(spark, d, fixtures.CHUNKS))


@_query(f"""SELECT doc_id, left(t, 1000) || chr(10) || chr(10) || '{chunking.TRUNCATED.strip()}' AS text FROM (SELECT doc_id, regexp_replace(text, '[.\\n]+', ' ', 'g') AS t FROM documents) d WHERE length(t) > 1000""")
def chunk_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Texts without any boundary that are too long, cut and marked."""
    solid = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[.\n]+", " ").alias("text"))
    return solid.select("doc_id", chunking.truncated(F.col("text"), F.lit(1000)).alias("text")).filter("text is not null")


@_query(f"""SELECT doc_id, chunk_no, n_chunks, CAST(19 + CASE WHEN n_chunks > 1 THEN 36 + length(CAST(chunk_no AS VARCHAR)) + length(CAST(n_chunks AS VARCHAR)) ELSE 0 END + 20 + length(chunk) AS INTEGER) AS prompt_chars FROM ({_CHUNKS_SQL}) q""")
def chunk_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of all chunks: their number and length."""
    made = chunking.prompts(chunking.chunk_rows(fixtures.make(spark, d, fixtures.CHUNKS)), "Extract the record.")
    return made.select("doc_id", "chunk_no", "n_chunks", F.length("prompt").alias("prompt_chars"))


# ---- replies --------------------------------------------------------------------------------


@_query("""SELECT doc_id, chunk_no, regexp_replace(regexp_replace(trim(response_text, ' ' || chr(10)), '^```(json)?\\s*', ''), '\\s*```$', '') AS bare FROM model_response""")
def json_fence_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "model_response").select("doc_id", "chunk_no", jsonrepair.strip_fences(F.col("response_text")).alias("bare"))


@_query(f"""WITH x AS ({fixtures.REPLIES}) SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 1, 6) THEN 'parsed' WHEN doc_id % 7 IN (2, 3) THEN 'repaired' WHEN doc_id % 7 = 4 THEN 'fallback' ELSE 'not_object' END AS status,
  'direct_upload' || CASE WHEN doc_id % 7 IN (2, 3) THEN '_repaired' WHEN doc_id % 7 = 4 THEN '_fallback' ELSE '' END AS method_resolved FROM x""")
def json_parse_class(spark: SparkSession, d: str) -> DataFrame:
    return jsonrepair.parse_replies(fixtures.make(spark, d, fixtures.REPLIES)).select("doc_id", "status", "method_resolved")


@_query(f"WITH x AS ({fixtures.REPLIES}) SELECT doc_id, 'T' || doc_id AS title, 's' || doc_id AS summary, 'f' || doc_id AS full_text FROM x WHERE doc_id % 7 IN (2, 3)")
def json_repaired(spark: SparkSession, d: str) -> DataFrame:
    """What repair gets out of replies with prose around the object or trailing commas."""
    got = jsonrepair.typed(jsonrepair.parse_replies(fixtures.make(spark, d, fixtures.REPLIES))).filter("status = 'repaired'")
    return got.select("doc_id", F.col("record.document_info.title").alias("title"), F.col("record.main_content.summary").alias("summary"), F.col("record.full_text_content").alias("full_text"))


@_query(f"""WITH x AS ({fixtures.REPLIES}) SELECT doc_id, 'Raw Content - JSON Parse Failed' AS title, 'N/A' AS authority, 'JSON parsing failed: No JSON structure found. Raw response content is provided in full_text_content.' AS summary, response_text AS full_text FROM x WHERE doc_id % 7 = 4""")
def json_fallback_record(spark: SparkSession, d: str) -> DataFrame:
    got = jsonrepair.typed(jsonrepair.parse_replies(fixtures.make(spark, d, fixtures.REPLIES))).filter("status = 'fallback'")
    return got.select("doc_id", F.col("record.document_info.title").alias("title"), F.col("record.document_info.authority").alias("authority"), F.col("record.main_content.summary").alias("summary"), F.col("record.full_text_content").alias("full_text"))


#: Replies without fences, the object in them, and that object after the thorough repair, each rule as it is fixed.
_READ = """b AS (SELECT *, trim(regexp_replace(regexp_replace(trim(response_text, ' ' || chr(10)), '^```(json)?', ''), '```$', ''), ' ' || chr(10)) AS bare FROM {replies}),
p AS (SELECT *, nullif(regexp_extract(bare, '[{].*[}]', 0, 's'), '') AS piece FROM b),
t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(piece, '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g'), '\\"', '"'), '\\\\', '\\'), ',\\s*[}]', '}', 'g'), ',\\s*[]]', ']', 'g'), '([0-9A-Za-z_]+):', '"\\1":', 'g'), chr(39) || '([^' || chr(39) || ']*)' || chr(39), '"\\1"', 'g') AS mended FROM p),
v AS (SELECT *, json_valid(bare) AND NOT regexp_matches(bare, ',\\s*[]}]') AS strict FROM t),
j AS (SELECT *, CASE WHEN strict THEN bare WHEN json_valid(mended) THEN mended END AS body, CASE WHEN strict THEN 'parsed' WHEN json_valid(mended) THEN 'repaired' ELSE 'fallback' END AS status FROM v)"""


@_query(f"""WITH {_READ.replace("{replies}", "model_response")} SELECT method, status, coalesce(json_exists(body, '$.error'), false) AS is_error, count(*) AS n_replies FROM j GROUP BY ALL""")
def reply_status(spark: SparkSession, d: str) -> DataFrame:
    """How the replies of the model were read, by method."""
    parsed = jsonrepair.typed(jsonrepair.parse_replies(table(spark, d, "model_response")))
    return parsed.groupBy("method", "status", "is_error").agg(F.count("*").alias("n_replies"))


_CHUNK_VALUES = f"""SELECT doc_id, file_id, chunk_no, doc_id % 7 IN (5, 6) AS is_error, doc_id % 7 = 4 AS fell FROM ({fixtures.REPLIES}) r"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    typed = jsonrepair.typed(jsonrepair.parse_replies(fixtures.make(spark, d, fixtures.REPLIES)))
    return merge.merge_chunks(typed, "file_id", "chunk_no")


@_query(f"""WITH v AS ({_CHUNK_VALUES}), u AS (SELECT file_id, chunk_no, is_error,
  CASE WHEN fell THEN 'Raw Content - JSON Parse Failed' ELSE 'T' || doc_id END AS title,
  CASE WHEN fell THEN 'Content extraction encountered JSON parsing issues' ELSE 'p' || (doc_id % 3) END AS purpose,
  CASE WHEN fell THEN 'JSON parsing failed: No JSON structure found. Raw response content is provided in full_text_content.' ELSE 's' || doc_id END AS summary,
  CASE WHEN fell THEN 'no structure at all' ELSE 'f' || doc_id END AS body FROM v)
SELECT file_id, min_by(title, chunk_no) FILTER (WHERE NOT is_error) AS title, coalesce(min_by(purpose, chunk_no) FILTER (WHERE NOT is_error), '') AS purpose,
  coalesce(string_agg(' ' || summary, '' ORDER BY chunk_no) FILTER (WHERE NOT is_error), '') AS summary,
  coalesce(string_agg(chr(10) || chr(10) || body, '' ORDER BY chunk_no) FILTER (WHERE NOT is_error), '') AS full_text, CAST(count(*) AS INTEGER) AS total_chunks FROM u GROUP BY file_id""")
def merge_scalars(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select("file_id", F.col("document_info.title").alias("title"), F.col("main_content.purpose").alias("purpose"), F.col("main_content.summary").alias("summary"), F.col("full_text_content").alias("full_text"), "total_chunks")


_IN_ORDER = "coalesce(string_agg({}, '|' ORDER BY chunk_no) FILTER (WHERE NOT is_error AND NOT fell), '')"


@_query(f"""WITH v AS ({_CHUNK_VALUES}) SELECT file_id, {_IN_ORDER.format("'a' || doc_id")} AS action_items, {_IN_ORDER.format("'t' || doc_id")} AS sections, {_IN_ORDER.format("'r' || doc_id")} AS rules,
  {_IN_ORDER.format("'v' || doc_id || '|w'")} AS violations, {_IN_ORDER.format("'e' || doc_id")} AS terms FROM v GROUP BY file_id""")
def merge_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The five lists of a record, chunk by chunk."""
    joined = lambda x: F.array_join(x, "|")
    return _merged(spark, d).select(
        "file_id", joined("action_items").alias("action_items"), joined(F.col("detailed_sections.section_title")).alias("sections"), joined(F.col("rules_and_provisions.rule")).alias("rules"),
        joined(F.col("penalties_and_consequences.violation")).alias("violations"), joined(F.col("definitions.term")).alias("terms"),
    )


@_query(f"""WITH v AS ({_CHUNK_VALUES}), k AS (SELECT file_id, chunk_no * 2 AS o, 'k' || (doc_id % 3) AS point FROM v WHERE NOT is_error AND NOT fell UNION ALL SELECT file_id, chunk_no * 2 + 1, 'k' || (doc_id % 2) FROM v WHERE NOT is_error AND NOT fell
  UNION ALL SELECT file_id, chunk_no * 2, unnest(['JSON parsing failed', 'Raw content available in full_text_content', 'Error: No JSON structure found']) FROM v WHERE fell),
n AS (SELECT file_id, o, point, row_number() OVER (PARTITION BY file_id ORDER BY o, CASE left(point, 1) WHEN 'J' THEN 0 WHEN 'R' THEN 1 ELSE 2 END) AS i FROM k), u AS (SELECT file_id, point, min(i) AS i FROM n GROUP BY file_id, point), f AS (SELECT DISTINCT file_id FROM v)
SELECT f.file_id, coalesce(string_agg(point, '|' ORDER BY i), '') AS key_points FROM f LEFT JOIN u ON f.file_id = u.file_id GROUP BY f.file_id""")
def merge_key_points(spark: SparkSession, d: str) -> DataFrame:
    """Key points of all chunks, each once, where it came first."""
    return _merged(spark, d).select("file_id", F.array_join("main_content.key_points", "|").alias("key_points"))


def _distinct(value: str) -> str:
    return f"coalesce((SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT {value} AS x FROM v WHERE v.file_id = f.file_id AND NOT is_error AND NOT fell) t), '')"


@_query(f"""WITH v AS ({_CHUNK_VALUES}), f AS (SELECT DISTINCT file_id FROM v)
SELECT file_id, {_distinct("'n' || (doc_id % 5)")} AS people, {_distinct("unnest(['o' || (doc_id % 2), 'o9'])")} AS organizations, '' AS locations, {_distinct("'m' || (doc_id % 3)")} AS amounts, '' AS dates, {_distinct("'f' || doc_id")} AS "references" FROM f""")
def merge_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The six kinds of entities, each value once."""
    return _merged(spark, d).select("file_id", *[F.array_join(f"important_entities.{k}", "|").alias(k) for k in merge.ENTITIES])


@_query(f"""WITH x AS ({fixtures.REPLIES}) SELECT doc_id, 'direct_upload' || CASE WHEN doc_id % 7 IN (2, 3) THEN '_repaired' WHEN doc_id % 7 = 4 THEN '_fallback' ELSE '' END AS processing_method, '2024-02-29 23:05:09' AS processed_timestamp,
  CASE WHEN doc_id % 7 IN (2, 3) THEN 'JSON was automatically repaired' WHEN doc_id % 7 = 4 THEN 'No JSON structure found' END AS note FROM x WHERE doc_id % 7 <> 5""")
def reply_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The metadata that a parsed reply is stamped with, at a given time."""
    parsed = jsonrepair.parse_replies(fixtures.make(spark, d, fixtures.REPLIES))
    stamped = parsed.select("doc_id", jsonrepair.metadata(F.lit("2024-02-29 23:05:09").cast("timestamp_ntz")).alias("m")).filter("m is not null")
    return stamped.select("doc_id", "m.processing_method", "m.processed_timestamp", "m.note")


@_query("""WITH b AS (SELECT doc_id, chr(123) || chr(39) || 'k' || chr(39) || ': ' || doc_id || ',' || chr(125) AS quoted FROM documents)
SELECT doc_id, 'repaired' AS status, 'k' AS key, doc_id AS value FROM b WHERE doc_id % 4 < 2 UNION ALL SELECT doc_id, 'parsed', 'k', doc_id FROM b WHERE doc_id % 4 = 2 UNION ALL SELECT doc_id, 'fallback', NULL, NULL FROM b WHERE doc_id % 4 = 3""")
def reply_repair(spark: SparkSession, d: str) -> DataFrame:
    """Damage of four kinds: single quotes and a comma too many; a bare key; a control character in prose (light repair is enough); nothing that can be mended."""
    made = spark.sql(f"""SELECT doc_id, 'direct_upload' AS method, CASE doc_id % 4
      WHEN 0 THEN concat('x {{', chr(39), 'k', chr(39), ': ', doc_id, ',}} y') WHEN 1 THEN concat('{{k: ', doc_id, '}}')
      WHEN 2 THEN concat('Result: {{', chr(1), '}}') ELSE '{{"k" 5 [}}' END AS response_text FROM parquet.`{d}/documents.parquet`""")
    got = jsonrepair.parse_replies(made)
    value = F.get_json_object("json", "$.k").cast("bigint")
    known = F.col("status") != jsonrepair.FALLBACK
    return got.select("doc_id", "status", F.when(known, F.lit("k")).alias("key"), F.when(known, F.coalesce(value, F.col("doc_id"))).alias("value"))


@_query("""WITH p AS (SELECT doc_id, generate_subscripts(h, 1) - 1 AS page_no, unnest(h) AS page_text FROM (SELECT doc_id, string_split(text, chr(10)) AS h FROM documents WHERE text IS NOT NULL) t)
SELECT doc_id, regexp_replace(string_agg(page_text, chr(10) ORDER BY page_no), '^\\s+|\\s+$', '', 'g') AS text FROM p GROUP BY doc_id""")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of a document from its pages (here its lines), in order."""
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page_no", "page_text"))
    return merge.pages_to_text(lines, "doc_id", "page_no", "page_text")


def _flat(path: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct(flatten(list(CAST(json_extract_string(body, '{path}[*]') AS VARCHAR[]) ORDER BY chunk_no) FILTER (WHERE body IS NOT NULL)))), '|'), '')"


@_query(f"""WITH r AS (SELECT DISTINCT doc_id, chunk_no, method, response_text FROM model_response), {_READ.replace("{replies}", "r")}
SELECT doc_id, coalesce(min_by(json_extract_string(body, '$.document_info.title'), chunk_no) FILTER (WHERE body IS NOT NULL AND json_type(body, '$.document_info') = 'OBJECT'), max(CASE WHEN body IS NULL THEN 'Raw Content - JSON Parse Failed' END)) AS title, {_flat('$.important_entities.people')} AS people, {_flat('$.important_entities."references"')} AS "references",
  CAST(coalesce(sum(CASE WHEN json_type(body, '$.penalties_and_consequences') = 'ARRAY' THEN json_array_length(body, '$.penalties_and_consequences') END), 0) AS INTEGER) AS n_penalties, CAST(count(*) AS INTEGER) AS total_chunks FROM j GROUP BY doc_id""")
def merge_responses(spark: SparkSession, d: str) -> DataFrame:
    """The merged record of every document with replies, flattened to scalars; repeated replies count once."""
    replies = table(spark, d, "model_response").dropDuplicates(["doc_id", "chunk_no", "method", "response_text"])
    m = merge.merge_chunks(jsonrepair.typed(jsonrepair.parse_replies(replies)))
    return m.select("doc_id", F.col("document_info.title").alias("title"), F.array_join("important_entities.people", "|").alias("people"), F.array_join("important_entities.references", "|").alias("references"), F.size("penalties_and_consequences").alias("n_penalties"), "total_chunks")


@_query(f"""WITH {_folded("SELECT doc_id, coalesce(text, '') AS text FROM documents")}
SELECT doc_id, CASE WHEN length(text) <= 2000 THEN 'text_extraction' WHEN len(chunks) <= 1 THEN 'text_truncated' ELSE 'multi_chunk' END AS method, NULL AS error, CAST(greatest(len(chunks), 1) AS INTEGER) AS total_chunks,
  CAST(CASE WHEN length(text) > 2000 AND len(chunks) <= 1 THEN 2002 + {len(chunking.TRUNCATED)} ELSE list_sum(list_transform(chunks, lambda x: CASE WHEN x = '' THEN 0 ELSE length(x) + 2 END)) END AS INTEGER) AS text_chars FROM c WHERE text <> ''
UNION ALL SELECT doc_id, NULL, 'no text', NULL, NULL FROM documents WHERE coalesce(text, '') = ''""")
def extract_all(spark: SparkSession, d: str) -> DataFrame:
    """The run over all documents with the offline model, long ones by chunks."""
    done = pipeline.run(table(spark, d, "documents"), pipeline.Settings(max_chars=2000))
    return done.select("doc_id", F.col("method_resolved").alias("method"), "error", "total_chunks", F.length("full_text_content").alias("text_chars"))


# ---- runs, files, logs ----------------------------------------------------------------------


#: A failure for every ninth record, as the tables have none.
_FAILURE = "CASE WHEN rec_id % 9 = 4 THEN 'OSError: no space' END"


@_query("""WITH r AS (SELECT coalesce(lower(trim(source)), '') AS source, rec_id % 9 = 4 AS lost, error FROM aiscript) SELECT source, count(*) AS total_files, count(*) FILTER (WHERE NOT lost) AS processed_successfully, count(*) FILTER (WHERE lost) AS failed, count(error) FILTER (WHERE NOT lost) AS n_error_records FROM r GROUP BY 1""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the run by source."""
    records = table(spark, d, "aiscript").withColumn("source", F.coalesce(F.lower(F.trim("source")), F.lit("")))
    return report.run_summary(report.statuses(records, ("source",), F.expr(_FAILURE)), ("source",))


@_query("""WITH r AS (SELECT coalesce(source_file, file) AS file, rec_id % 9 = 4 AS lost, coalesce(processing_method, 'unknown') AS method FROM aiscript WHERE document_info.type = 'act'),
o AS (SELECT file, lost, method, CASE WHEN lost THEN 'failed' ELSE 'success' END AS status, regexp_replace(file, '(.)\\.[^.]+$', '\\1') || '_extracted.json' AS output FROM r)
SELECT CAST(count(*) AS INTEGER) AS total_files, CAST(count(*) FILTER (WHERE NOT lost) AS INTEGER) AS processed_successfully, CAST(count(*) FILTER (WHERE lost) AS INTEGER) AS failed,
  md5(string_agg(concat_ws('|', coalesce(file, '-'), status, CASE WHEN lost THEN '-' ELSE coalesce(output, '-') END, CASE WHEN lost THEN '-' ELSE method END, CASE WHEN lost THEN 'OSError: no space' ELSE '-' END), chr(10) ORDER BY file, status, output, method)) AS results_digest,
  '2024-01-01 00:00:00' AS processing_started, '2024-01-01 01:02:03' AS processing_completed FROM o""")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    """The summary document of a run over the acts: counters, the results of all files, stamps."""
    rows = report.statuses(table(spark, d, "aiscript").filter("document_info.type = 'act'"), (), F.expr(_FAILURE))
    out = report.run_report(rows, F.lit("2024-01-01 00:00:00"), F.lit("2024-01-01 01:02:03"))
    said = F.array_join(F.transform("results", lambda r: F.concat_ws("|", *[F.coalesce(r[x], F.lit("-")) for x in ("file", "status", "output", "method", "error")])), "\n")
    return out.select("total_files", "processed_successfully", "failed", F.md5(said).alias("results_digest"), "processing_started", "processing_completed")


@_query("""SELECT count(*) AS total, count(*) FILTER (WHERE source_url NOT LIKE '%1%') AS successful, count(*) FILTER (WHERE source_url LIKE '%1%') AS failed, sum(CASE WHEN source_url LIKE '%1%' THEN 0 ELSE length(source_url) END)::BIGINT AS n_bytes FROM download_log""")
def download_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a download whose outcomes are made of the log."""
    lost = F.col("source_url").like("%1%")
    outcomes = table(spark, d, "download_log").select(F.when(lost, "failed").otherwise("success").alias("status"), F.when(lost, 0).otherwise(F.length("source_url")).alias("n_bytes"))
    return report.download_summary(outcomes)


@_query("""SELECT path, CASE WHEN hex(content)[1:10] = '255044462D' THEN 'ACTIVE' ELSE 'FAILED' END AS state, CASE WHEN hex(content)[1:10] = '255044462D' THEN 'files/' || regexp_extract(path, '[^/]*$') END AS result, CASE WHEN coalesce(hex(content)[1:10], '') <> '255044462D' THEN 'file processing failed: FAILED' END AS error FROM file_inventory""")
def remote_files(spark: SparkSession, d: str) -> DataFrame:
    """Files handed to the offline store: put, looked at until ready, used, deleted."""
    out = remote.upload(table(spark, d, "file_inventory"), use=lambda store, handle: handle, delay=0.0)
    return out.select("path", "state", "result", "error")


@_query("""SELECT to_json({'rec_id': rec_id, 'title': document_info.title, 'file': source_file, 'error': error, 'chunk': chunk}) AS json FROM aiscript""")
def record_json(spark: SparkSession, d: str) -> DataFrame:
    """Records as JSON objects, nulls kept."""
    rows = table(spark, d, "aiscript").select("rec_id", F.col("document_info.title").alias("title"), F.col("source_file").alias("file"), "error", "chunk")
    return as_json(rows, pretty=False)


@_query("""SELECT rec_id, coalesce(source_file, file) AS file, coalesce(processing_method, 'unknown') AS method, regexp_replace(coalesce(source_file, file), '(.)\\.[^.]+$', '\\1') || '_extracted.json' AS output,
  CASE WHEN main_content.summary <> '' THEN left(main_content.summary, 200) || '...' END AS preview FROM aiscript""")
def run_details(spark: SparkSession, d: str) -> DataFrame:
    return report.statuses(table(spark, d, "aiscript"), ("rec_id",)).select("rec_id", "file", "method", "output", "preview")


@_query("""SELECT path, regexp_extract(path, '[^/]*$') AS file_name, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]+$', '\\1') AS file_stem, length, coalesce(hex(content)[1:10] = '255044462D', false) AS is_pdf FROM file_inventory""")
def binary_inventory(spark: SparkSession, d: str) -> DataFrame:
    return inventory(table(spark, d, "file_inventory")).select("path", "file_name", "file_stem", "length", "is_pdf")


@_query("""SELECT saved_filename, count(DISTINCT source_url) AS n_sources, count(*) AS n_rows FROM download_log GROUP BY 1 HAVING count(DISTINCT source_url) > 1 OR count(*) > 1""")
def name_collisions(spark: SparkSession, d: str) -> DataFrame:
    return report.name_collisions(table(spark, d, "download_log"))


@_query("""WITH t AS (SELECT DISTINCT document_info.title AS act_title FROM aiscript WHERE document_info.title IS NOT NULL)
SELECT act_title, act_title IN (SELECT act_title FROM view_log WHERE act_title IS NOT NULL) AS in_view, act_title IN (SELECT act_title FROM download_log WHERE act_title IS NOT NULL) AS in_download FROM t""")
def act_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Acts by the log that knows them; in neither are those that could not be fetched."""
    acts = table(spark, d, "aiscript").select(F.col("document_info.title").alias("act_title")).filter("act_title is not null")
    return report.reconcile(acts, table(spark, d, "view_log").filter("act_title is not null"), table(spark, d, "download_log").filter("act_title is not null"))


@_query("""SELECT a.rec_id, a.source_file, f.length, f.n_copies, '2024-02-29 23:05:09' AS extraction_timestamp FROM aiscript a JOIN (SELECT regexp_extract(path, '[^/]*$') AS file_name, max(length) AS length, count(*) AS n_copies FROM file_inventory GROUP BY 1) f ON regexp_extract(a.source_file, '[^/]*$') = f.file_name""")
def file_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Records with the size of their file."""
    files = inventory(table(spark, d, "file_inventory")).groupBy("file_name").agg(F.max("length").alias("length"), F.count("*").alias("n_copies"))
    records = table(spark, d, "aiscript").select("rec_id", "source_file", F.substring_index("source_file", "/", -1).alias("file_name"))
    at = jsonrepair.stamp(F.lit("2024-02-29 23:05:09").cast("timestamp_ntz"))
    return records.join(files, "file_name").select("rec_id", "source_file", "length", "n_copies", at.alias("extraction_timestamp"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
