"""Line dedup by site-relative frequency, in DataFrame operations alone.

Pages are grouped by host; a line that stands on more than a share of a host's pages is boilerplate there and dropped
from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

#: Largest share of a host's pages that a line may stand on.
MAX_RATIO = 0.3
#: Pages of a host that a line must stand on to be boilerplate: a line of one page is above any ratio on a small host.
MIN_ON = 2
#: A table of hosts of so many bytes, measured, is broadcast; of a larger one, only hosts that hold more than
#: 1 / HEAVY_HOSTS of all pages are (there are fewer than HEAVY_HOSTS of those), and the others are shuffled.
BROADCAST_BYTES = 32 << 20
HEAVY_HOSTS = 1000

# An unclosed script, style or comment reaches to the end and a tag ends before the next one, so that no pattern reads a
# stretch of text twice.
_UNSEEN = r"(?is)<(?:script[^<>]*>.*?(?:</script>|\z)|style[^<>]*>.*?(?:</style>|\z)|!--.*?(?:-->|\z))"
_BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|div|dl|dt|dd|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^<>]*>"
_TAG = r"<[^<>]*>"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port; null and strange URLs give the empty host."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))), ":[0-9]*$", "")


def lines_of(html: Column) -> Column:
    """The lines a reader sees: block tags end lines, other tags vanish, blanks are folded, empty lines dropped."""
    text = html
    for blank in "\r\n\t":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _UNSEEN, " "), _BLOCK, "\n"), _TAG, "")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    lines = F.split(F.regexp_replace(text, " {2,}", " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def digest(line: Column) -> Column:
    """128 bits that stand for a line in shuffles and look-ups."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def by_host(rows: DataFrame, hosts: DataFrame, heavy: DataFrame, width: Column, how: str) -> DataFrame:
    """Join rows to hosts (a stored table, a row per host of `width` bytes), no host being a task of its own however
    many rows it has: hosts are broadcast if they are small, otherwise those of heavy are, and the others shuffled."""
    size = lambda df: df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    if size(hosts) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(hosts), "host", how)
    of_heavy = hosts.join(F.broadcast(heavy), "host", "left_semi")
    hint = F.broadcast if size(of_heavy) <= BROADCAST_BYTES else (lambda df: df)
    return rows.join(F.broadcast(heavy), "host", "left_semi").join(hint(of_heavy), "host", how).union(rows.join(F.broadcast(heavy), "host", "left_anti").join(hosts, "host", how))


def site_lines(pages: DataFrame, max_ratio: float = MAX_RATIO, min_on: int = MIN_ON) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text (the lines that stay): a row per row of pages (page_id, url, html;
    others are ignored).

    A line is dropped from a host of any size where it stands on more than max_ratio of the host's pages and on min_on of
    them at least; so the only page of a host keeps all its lines, however often one is repeated there.

    A line counts once a page; every row is a page, repeated ones too. Null html has no lines; null or strange URLs
    share the empty host. No rows give no rows. Lines are counted and looked up by 128-bit digests. Lines above the
    ratio are at most as many as a host's pages have lines on average, divided by the ratio, so that one array holds
    them however large the host is.
    """
    read = stored(pages.select("page_id", host_of(F.col("url")).alias("host"), F.coalesce(lines_of(F.col("html")), F.expr("cast(array() as array<string>)")).alias("lines")))
    pages_of = stored(read.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    total = pages_of.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    heavy = pages_of.where(F.col("pages") * HEAVY_HOSTS > F.lit(total)).select("host")
    each = read.select("host", F.explode(F.array_distinct(F.transform("lines", digest))).alias("line"))
    held = each.groupBy("host", "line.h1", "line.h2").agg(F.count(F.lit(1)).alias("on")).where(F.col("on") >= min_on)
    above = by_host(held, pages_of, heavy, F.octet_length("host") + 64, "inner").where(F.col("on") > F.col("pages") * F.lit(max_ratio))
    common = stored(above.groupBy("host").agg(F.collect_list(F.struct("h1", "h2")).alias("boilerplate")))
    both = by_host(read, common, heavy, F.octet_length("host") + 64 + 32 * F.size("boilerplate"), "left")
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("boilerplate", digest(x))))
    return both.withColumn("kept", kept).select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text")
    )


def _digests(out: DataFrame) -> DataFrame:
    return out.select("page_id", "host", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op5_site_lines(spark, sf_dir: str) -> DataFrame:
    return _digests(site_lines(table(spark, sf_dir, "pages")))


def op5_site_lines_all_hosts(spark, sf_dir: str) -> DataFrame:
    """The rule of op5_site_lines, which has no exempt hosts any more, under its earlier name."""
    return op5_site_lines(spark, sf_dir)


def _sql_text() -> str:
    text = "replace(replace(replace(html, chr(13), ' '), chr(10), ' '), chr(9), ' ')"
    for pattern, by in ((_UNSEEN, "' '"), (_BLOCK, "chr(10)"), (_TAG, "''")):
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    for entity, char in _ENTITIES:
        text = f"replace({text}, '{entity}', '{char}')"
    return f"regexp_replace({text}, ' +', ' ', 'g')"


SQL = {
    "op5_site_lines": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, page_id,
    regexp_replace(lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '')), ':[0-9]*$', '') AS host,
    {_sql_text()} AS txt
  FROM pages),
l AS (SELECT r, page_id, host, coalesce(list_filter(list_transform(string_split(txt, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), []) AS lines FROM d),
h AS (SELECT host, count(*) AS pages FROM l GROUP BY host),
u AS (SELECT r, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM l),
c AS (SELECT host, line, count(DISTINCT r) AS n FROM u GROUP BY host, line),
bad AS (SELECT c.host, c.line FROM c JOIN h USING (host) WHERE c.n >= {MIN_ON} AND c.n > h.pages * CAST({MAX_RATIO} AS DOUBLE)),
k AS (SELECT u.r, string_agg(u.line, chr(10) ORDER BY u.pos) AS txt, count(*) AS n
      FROM u WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.host = u.host AND bad.line = u.line) GROUP BY u.r)
SELECT l.page_id, l.host, CAST(len(l.lines) AS BIGINT) AS n_lines, CAST(len(l.lines) - coalesce(k.n, 0) AS BIGINT) AS n_dropped,
  CAST(length(coalesce(k.txt, '')) AS BIGINT) AS n_chars, md5(coalesce(k.txt, '')) AS text_md5
FROM l LEFT JOIN k ON l.r = k.r
"""
}

SQL["op5_site_lines_all_hosts"] = SQL["op5_site_lines"]
