"""Inputs made from the test tables by SQL that Spark and DuckDB both run, for operators that the raw tables would leave idle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGES = """SELECT page_id, url, html || (CASE page_id % 4
  WHEN 0 THEN concat('<a href="/acts/act_', CAST(page_id AS STRING), '.pdf">Act</a>')
  WHEN 1 THEN concat('<a href="https://share.example/send?text=acts/act_', CAST(page_id AS STRING), '.PDF">Share</a>')
  WHEN 2 THEN concat('<button onclick="window.open(', chr(39), '/dl/act_', CAST(page_id AS STRING), '.pdf', chr(39), ')">Get</button>')
  ELSE concat('<script>var u="/static/n_', CAST(page_id AS STRING), '.pdf";</script>') END) AS html
FROM page"""

DETAILS = """SELECT page_id, concat('Act ', CAST(page_id AS STRING), ': The "Water/Land"  Rules?') AS act_title,
  concat('/bare-acts/', CAST(page_id AS STRING)) AS act_url,
  CASE page_id % 5
  WHEN 0 THEN concat('<p><a href="/files/a', CAST(page_id AS STRING), '.PDF">d</a></p>')
  WHEN 1 THEN concat('<iframe src="https://drive.google.com/file/d/Id_', CAST(page_id AS STRING), '-x/preview"></iframe>')
  WHEN 2 THEN concat('<a href="https://drive.google.com/open?id=', CAST(page_id AS STRING), '">g</a><iframe class="scribd_iframe_embed" src="https://viewer.example/', CAST(page_id AS STRING), '"></iframe>')
  WHEN 3 THEN concat('<iframe class="scribd_iframe_embed" src="https://viewer.example/', CAST(page_id AS STRING), '"></iframe>')
  ELSE '<p>nothing</p>' END AS html
FROM page"""

CHUNKS = "SELECT doc_id, replace(text, chr(10), concat(chr(10), chr(10))) AS text, 2000 AS max_chars FROM documents WHERE text IS NOT NULL"

REPLIES = """SELECT doc_id, CAST(floor(doc_id / 4) AS BIGINT) AS file_id, CAST(doc_id % 4 AS INT) AS chunk_no, 'direct_upload' AS method,
  CASE doc_id % 7
  WHEN 0 THEN body
  WHEN 1 THEN concat('```json', chr(10), body, chr(10), '```')
  WHEN 2 THEN concat('Here is the result ', body, ' end')
  WHEN 3 THEN concat('Sure ', substr(body, 1, length(body) - 1), ',}')
  WHEN 4 THEN 'no structure at all'
  WHEN 5 THEN '[1,2]'
  ELSE concat('{"error":"blocked","chunk":', CAST(doc_id % 4 AS STRING), '}') END AS response_text
FROM (SELECT doc_id, concat('{"document_info":{"title":"T', CAST(doc_id AS STRING), '"},"main_content":{"purpose":"p', CAST(doc_id % 3 AS STRING),
  '","summary":"s', CAST(doc_id AS STRING), '","key_points":["k', CAST(doc_id % 3 AS STRING), '","k', CAST(doc_id % 2 AS STRING),
  '"]},"detailed_sections":[{"section_title":"t', CAST(doc_id AS STRING), '","content":"c","key_details":["d"]}],"rules_and_provisions":[{"rule":"r', CAST(doc_id AS STRING), '"}],"penalties_and_consequences":[{"violation":"v', CAST(doc_id AS STRING), '"},{"violation":"w"}],',
  '"important_entities":{"people":["n', CAST(doc_id % 5 AS STRING), '"],"organizations":["o', CAST(doc_id % 2 AS STRING), '","o9"],"locations":[],"amounts":["m', CAST(doc_id % 3 AS STRING), '"],"dates":[],"references":["f', CAST(doc_id AS STRING),
  '"]},"action_items":["a', CAST(doc_id AS STRING), '"],"definitions":[{"term":"e', CAST(doc_id AS STRING), '"}],"full_text_content":"f', CAST(doc_id AS STRING), '"}') AS body FROM documents) b"""

LISTING = """SELECT page_id, concat('/browse?offset=', CAST(page_id AS STRING)) AS url,
  concat('<table class="panel"><tr><th>h</th></tr><tr><td>1</td><td>d</td><td>t</td><td><a href="/handle/', CAST(page_id AS STRING), '">View</a></td></tr><tr><td>short</td></tr></table>',
  '<ul id="act_child_list"><li><a href="/bare-acts/', CAST(page_id AS STRING), '"> The <b>Water</b> &amp; Land Act </a></li></ul>',
  CASE WHEN (page_id + 1) % 10 = 0 THEN '' ELSE concat('<a title="Next Page" href="/browse?offset=', CAST(page_id + 1 AS STRING), '">n</a>') END,
  '<a href="/browse?p=', CAST(page_id % 7 AS STRING), '">', CAST(page_id % 7 AS STRING), '</a>') AS html
FROM page"""


#: The ways in which a link can be written, and places where it is none.
MARKUP = """SELECT page_id, url, CASE page_id % 6
  WHEN 0 THEN concat('<a href=', chr(39), '/s/', CAST(page_id AS STRING), '.pdf', chr(39), '>x</a>')
  WHEN 1 THEN concat('<a class=k href=/u/', CAST(page_id AS STRING), '.pdf>y</a>')
  WHEN 2 THEN concat('<a data-x="a > b" href="/q?a=1&amp;b=', CAST(page_id AS STRING), '.pdf&#47;&#x20ac;">z</a>')
  WHEN 3 THEN concat('<!-- <a href="/no/1.pdf">no</a> --><a href="/yes/', CAST(page_id AS STRING), '.pdf">v</a>')
  WHEN 4 THEN concat('<script>var s=', chr(39), '<a href="/no.pdf">', chr(39), ';</script><a title="href=', chr(39), '/no.pdf', chr(39), '" HREF = "/t/', CAST(page_id AS STRING), '.pdf">w</a><a name="href">n</a>')
  ELSE concat('<button onclick=', chr(39), 'go("/c/', CAST(page_id AS STRING), '.pdf")', chr(39), '>Get</button>') END AS html
FROM page"""

#: A cell with a table of its own, and a list with a list in it; each third page has no list.
NESTED = """SELECT page_id, url, concat('<table class="wide panel x"><tr><td>1</td><td>2</td><td>3</td><td><table><tr><td><a href="/deep/', CAST(page_id AS STRING), '">in</a></td></tr></table></td></tr>',
  '<tr><td>1</td><td>2</td><td>3</td><td>no <br> link <a name="x">y</a><a href=/second/', CAST(page_id AS STRING), '>View</a></td></tr></table>',
  CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('<ul id=', chr(39), 'act_child_list', chr(39), '><li><a href="/one">First &lt;Act&gt;</a><ul><li><a href="/two/', CAST(page_id AS STRING), '"><b>Second</b> Act</a></li></ul></li><li><a href="/three">Third</a></li></ul>') END, '<a href="/after">after</a>') AS html
FROM page"""

#: One mark of pagination for each page, and a link without any.
PAGER = """SELECT page_id, url, concat('<p><a href="/about">About</a></p>', CASE page_id % 13
  WHEN 0 THEN concat('<a href="/x?page=', CAST(page_id AS STRING), '">a</a>')
  WHEN 1 THEN concat('<a href="/x?p=', CAST(page_id AS STRING), '">a</a>')
  WHEN 2 THEN concat('<a href="/x?offset=', CAST(page_id AS STRING), '">a</a>')
  WHEN 3 THEN concat('<a href="/x?start=', CAST(page_id AS STRING), '">a</a>')
  WHEN 4 THEN concat('<div class="nav pagination"><ul><li><a href="/m', CAST(page_id AS STRING), '">a</a></li></ul></div>')
  WHEN 5 THEN concat('<div class="pager"><a href="/m', CAST(page_id AS STRING), '">a</a></div>')
  WHEN 6 THEN concat('<div class="page-numbers"><a href="/m', CAST(page_id AS STRING), '">a</a></div>')
  WHEN 7 THEN concat('<a rel="next" href="/m', CAST(page_id AS STRING), '">a</a>')
  WHEN 8 THEN concat('<a href="/m', CAST(page_id AS STRING), '">Next one</a>')
  WHEN 9 THEN concat('<a href="/m', CAST(page_id AS STRING), '">&gt;</a>')
  WHEN 10 THEN concat('<a href="/m', CAST(page_id AS STRING), '">&rarr;</a>')
  WHEN 11 THEN concat('<a href="/m/next/', CAST(page_id AS STRING), '">a</a>')
  ELSE concat('<a href="/m', CAST(page_id AS STRING), '"> 12 </a>') END, '<a class="pagination" href="/own">self</a><a href="/about">2x</a>') AS html
FROM page"""


def make(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """The fixture over the tables of a folder."""
    name = "documents" if "FROM documents" in sql else "page"
    return spark.sql(sql.replace(f"FROM {name}", f"FROM parquet.`{folder}/{name}.parquet`"))
