"""Queries on pages, links, keyed tables and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.config import PageRank
from lexiloom.functions import analyzers, web
from lexiloom.operators import graph, tables
from lexiloom.session import ship_package
from lexiloom.sources.corpus import resume_frontier

from .registry import query, quoted, table

URL_CTE = f"""parts AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS authority,
regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)"""
NORMAL = f"""{URL_CTE}, normal AS (SELECT page_id, url, scheme, authority, path, scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(authority, ':80$', '') ELSE regexp_replace(authority, ':443$', '') END
|| CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS normalized
FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({quoted(web.TRACKING)}))), '&') AS kept FROM parts))"""


def pages(spark, d):
    return table(spark, d, "pages")


@query(f"WITH {NORMAL} SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND authority <> '' THEN normalized END AS normalized FROM normal")
def url_normalize_simple(spark, d):
    return pages(spark, d).select("page_id", web.normalize_url(F.col("url")).alias("normalized"))


@query(
    f"""WITH {URL_CTE} SELECT page_id, length(url) <= 2000 AND scheme IN ('http', 'https') AND authority <> '' AND regexp_extract(lower(path), '\\.([^./]*)$', 1) NOT IN ({quoted(web.BLOCKED)}) AS ok,
length(url) <= 2000 AND scheme IN ('http', 'https') AND regexp_extract(lower(path), '\\.([^./]*)$', 1) NOT IN ({quoted(web.BLOCKED)})
AND (regexp_replace(authority, ':\\d*$', '') = 'example.com' OR ends_with(regexp_replace(authority, ':\\d*$', ''), '.example.com')) AS ok_on_domain FROM parts"""
)
def url_crawlable(spark, d):
    return pages(spark, d).select("page_id", web.is_crawlable(F.col("url")).alias("ok"), web.is_crawlable(F.col("url"), ("example.com",)).alias("ok_on_domain"))


@query(f"WITH {URL_CTE} SELECT authority AS host, count(*) AS n FROM parts GROUP BY authority")
def host_counts(spark, d):
    return pages(spark, d).groupBy(web.host_key(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(
    r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), ''),
nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '\s+', ' ', 'g')), ''))[1:500] AS title FROM pages"""
)
def page_title(spark, d):
    return pages(spark, d).select("page_id", web.page_title(F.col("html"), F.col("url")).alias("title"))


@query("SELECT page_id, sha256(url) AS url_sha256, sha256(url)[1:2] AS shard FROM pages")
def raw_html_shards(spark, d):
    return tables.html_shards(pages(spark, d)).select("page_id", "url_sha256", "shard")


LINKS = """linked AS (SELECT DISTINCT url AS src, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || href AS dst FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) WHERE starts_with(href, '/'))"""


def links(spark, d):
    """All absolute-path links of the pages, those in navigation too, each once a page."""
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")
    own = pages(spark, d).select("url", href).filter(F.col("href").startswith("/"))
    return own.select(F.col("url").alias("src"), F.concat(F.regexp_extract("url", "^([^:]+://[^/?#]*)", 1), "href").alias("dst")).distinct()


@query(f"WITH {LINKS} SELECT src, dst FROM linked")
def links_all(spark, d):
    return links(spark, d)


@query(f"WITH {LINKS} SELECT dst, count(*) AS inbound FROM linked GROUP BY dst ORDER BY inbound DESC, dst LIMIT 20")
def inbound_top20(spark, d):
    return graph.inbound(links(spark, d))


@query(f"WITH {LINKS} SELECT src, count(*) AS outdegree FROM linked GROUP BY src")
def outdegree(spark, d):
    return graph.outdegree(links(spark, d))


@query(f"WITH {LINKS}, o AS (SELECT src, count(*) AS n FROM linked GROUP BY src) SELECT dst, round(0.15 + 0.85 * sum(1.0::DOUBLE / n), 6) AS score FROM linked JOIN o USING (src) GROUP BY dst")
def pagerank_one_iter(spark, d):
    return graph.one_iteration(links(spark, d)).select("dst", F.round("score", 6).alias("score"))


def supply_edges(spark, d):
    """Suppliers and parts, linked both ways where a line item has both; each third part links to none."""
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    back = pairs.filter("l_partkey % 3 <> 0")
    return pairs.select(s.alias("src"), p.alias("dst")).unionByName(back.select(p.alias("src"), s.alias("dst")))


SUPPLY = "pairs AS MATERIALIZED (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), e AS MATERIALIZED (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM pairs UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM pairs WHERE l_partkey % 3 <> 0)"


def pagerank_sql(steps: int) -> str:
    """Power iteration written out, a CTE a step."""
    head = f"""WITH {SUPPLY}, v AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM v), o AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY src),
r0 AS MATERIALIZED (SELECT node, 1.0 / n AS score FROM v, c)"""
    for i in range(steps):
        head += f""", r{i + 1} AS MATERIALIZED (SELECT v.node, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(s, 0.0) + (SELECT coalesce(sum(score), 0.0) FROM r{i} WHERE node NOT IN (SELECT src FROM o)) / n) AS score
FROM v CROSS JOIN c LEFT JOIN (SELECT dst, sum(score / k) AS s FROM e JOIN r{i} ON r{i}.node = e.src JOIN o ON o.src = e.src GROUP BY dst) x ON x.dst = v.node)"""
    return head


@query(f"{pagerank_sql(PageRank().iterations)} SELECT node, round(score, 9) AS score FROM r{PageRank().iterations}")
def pagerank_fixed(spark, d):
    """All of the rounds, whether or not it has converged."""
    return graph.pagerank(supply_edges(spark, d), stop_early=False).select("node", F.round("score", 9).alias("score"))


def converged_sql() -> str:
    """CTE ``done(node, score)``: the production parameters' rounds, up to the first that moves ranks by less than the tolerance."""
    p = PageRank()
    moved = " UNION ALL ".join(f"SELECT {i} AS i, (SELECT sum(abs(a.score - b.score)) FROM r{i} a JOIN r{i - 1} b USING (node)) AS moved" for i in range(1, p.iterations + 1))
    every = " UNION ALL ".join(f"SELECT {i} AS i, node, score FROM r{i}" for i in range(1, p.iterations + 1))
    return f"""{pagerank_sql(p.iterations)}, moves AS MATERIALIZED ({moved}), last AS MATERIALIZED (SELECT coalesce(min(i) FILTER (moved < {p.tolerance}), {p.iterations}) AS i FROM moves),
done AS (SELECT node, score FROM ({every}) WHERE i = (SELECT i FROM last))"""


@query(f"{converged_sql()} SELECT node, round(score, 9) AS score FROM done")
def pagerank_converged(spark, d):
    """PageRank with the production parameters: 30 rounds, or until it converges."""
    return graph.pagerank(supply_edges(spark, d)).select("node", F.round("score", 9).alias("score"))


@query(f"{converged_sql()} SELECT node, round(score, 9) AS score FROM done ORDER BY round(score, 9) DESC, node LIMIT 10")
def pagerank_top10(spark, d):
    return pagerank_converged(spark, d).orderBy(F.desc("score"), "node").limit(10)


@query(f"{converged_sql()} SELECT abs(sum(score) - 1) < 1e-6 AS sums_to_one, count(*) AS n FROM done")
def pagerank_sum(spark, d):
    return graph.pagerank(supply_edges(spark, d)).agg((F.abs(F.sum("score") - 1) < 1e-6).alias("sums_to_one"), F.count("*").alias("n"))


@query(
    f"""WITH {SUPPLY}, d0 AS (SELECT 's1' AS node), d1 AS (SELECT DISTINCT dst AS node FROM e JOIN d0 ON src = node), d2 AS (SELECT DISTINCT dst AS node FROM e JOIN d1 ON src = node),
d3 AS (SELECT DISTINCT dst AS node FROM e JOIN d2 ON src = node), every AS (SELECT node, 0 AS depth FROM d0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2 UNION ALL SELECT node, 3 FROM d3)
SELECT node, min(depth) AS depth FROM every GROUP BY node"""
)
def bfs_depth(spark, d):
    return graph.bfs(supply_edges(spark, d), spark.createDataFrame([("s1",)], "node string"), 3)


@query()
def html_text(spark, d):
    """Title, text and links of every page; the links are normalised, and those in chrome are left out."""
    ship_package(spark)
    return pages(spark, d).withColumn("x", web.html_extract_udf()("html", "url")).select("page_id", "x.title", "x.text", F.array_join("x.links", " ").alias("links"))


@query()
def url_normalize_exact(spark, d):
    ship_package(spark)
    return pages(spark, d).select("page_id", web.normalize_url_udf("url").alias("normalized"))


@query()
def pagerank_documents(spark, d):
    """Over links between documents, those without any included; up to a hundred rounds."""
    own = table(spark, d, "documents").select("doc_id")
    links = own.select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 3).alias("dst")).filter("src % 2 = 0")
    return graph.document_pagerank(links, own).select("doc_id", F.round("pagerank", 9).alias("pagerank"))


@query()
def links_normalized(spark, d):
    """Links of every page as a crawl takes them: absolute, normalised, without those in chrome, on pages alone."""
    ship_package(spark)
    got = pages(spark, d).select("url", F.explode(web.html_extract_udf()("html", "url")["links"]).alias("dst"))
    return got.select(F.col("url").alias("src"), "dst").distinct()


# Keyed tables


@query("SELECT c_custkey, coalesce(n_name, '') AS nation, coalesce(o.n, 0) AS n_orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def left_join_defaults(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    out = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(nations, "c_nationkey", "left").join(counts, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("n_name", F.lit("")).alias("nation"), F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT sha256(coalesce(text, '')) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_hash_having(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return own.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, d):
    own = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return tables.newest(own, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT c_custkey AS key, 'customer' AS kind FROM customer UNION ALL SELECT DISTINCT o_custkey + 100, 'order' FROM orders WHERE o_custkey + 100 NOT IN (SELECT c_custkey FROM customer)")
def insert_ignore_anti(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("kind"))
    new = table(spark, d, "orders").select((F.col("o_custkey") + 100).alias("key"), F.lit("order").alias("kind"))
    return tables.insert_ignore(old, new, "key")


@query("SELECT event_id, value FROM events WHERE event_type = 'click' AND user_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def semi_known_docs(spark, d):
    known = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("user_id"))
    return table(spark, d, "events").filter("event_type = 'click'").join(known, "user_id", "left_semi").select("event_id", "value")


@query("SELECT coalesce(lang, 'overall') AS lang, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY ROLLUP (lang)")
def rollup_summary(spark, d):
    own = table(spark, d, "documents").rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))
    return own.withColumn("lang", F.coalesce("lang", F.lit("overall")))


@query("SELECT doc_id, trim(text) <> '' AS accepted FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '  ' ELSE text END AS text FROM documents) WHERE trim(coalesce(text, '')) <> ''")
def blank_rejected(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "  ").otherwise(F.col("text")).alias("content"))
    return tables.accepted_pages(own).select("doc_id", F.lit(True).alias("accepted"))


@query(
    """WITH f AS (SELECT DISTINCT url, CASE page_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'visited' ELSE 'failed' END AS status FROM pages WHERE page_id % 4 <> 0)
SELECT url, 'pending' AS state FROM f WHERE status = 'pending' UNION ALL SELECT url, 'pending' FROM (SELECT DISTINCT url FROM pages) WHERE url NOT IN (SELECT url FROM f)
UNION ALL SELECT url, 'seen' FROM f WHERE status <> 'pending'"""
)
def frontier_resume(spark, d):
    """A saved frontier of three quarters of the pages, taken up again with all pages as seeds."""
    status = F.when(F.col("page_id") % 3 == 0, "pending").when(F.col("page_id") % 3 == 1, "visited").otherwise("failed")
    frontier = pages(spark, d).filter("page_id % 4 <> 0").select("url", status.alias("status")).distinct()
    pending, seen = resume_frontier(frontier, pages(spark, d).select("url", F.lit("pending").alias("status")).distinct())
    return pending.select("url", F.lit("pending").alias("state")).unionByName(seen.select("url", F.lit("seen").alias("state")))


# Logs


@query(
    """SELECT event_id, nth, nth <= 30 AS allowed FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id % 5, date_trunc('minute', ts) ORDER BY ts, event_id) AS nth FROM events)"""
)
def rate_limit_window(spark, d):
    own = table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 5).alias("client"))
    return tables.rate_limited(own, "client", "ts", ["event_id"]).select("event_id", "nth", "allowed")


@query(
    """WITH o AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT event_id, (max(us - i * 60000000) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 60000000)::BIGINT AS slot FROM o"""
)
def politeness_slots(spark, d):
    own = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return tables.politeness_slots(own, "user_id", "us", ["event_id"], 60_000_000).select("event_id", "slot")


@query(
    """SELECT doc_id, bytes_so_far FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT AS bytes_so_far, row_number() OVER (ORDER BY doc_id) AS k FROM documents)
WHERE k <= 200 AND bytes_so_far - n_chars < 300000"""
)
def crawl_budget(spark, d):
    own = table(spark, d, "documents").select("doc_id", "n_chars")
    return tables.within_budget(own, "doc_id", "n_chars", 200, 300_000).select("doc_id", "bytes_so_far")


@query("SELECT event_id, user_id AS doc_id FROM events WHERE event_type = 'click' AND value IS NOT NULL AND user_id IN (SELECT doc_id FROM documents)")
def click_valid(spark, d):
    from lexiloom.streaming.streams import valid_clicks

    clicks = table(spark, d, "events").filter("event_type = 'click'").select("event_id", F.col("user_id").alias("doc_id"), F.col("props").alias("query"), F.col("value").alias("position"))
    return valid_clicks(clicks, table(spark, d, "documents")).select("event_id", "doc_id")


@query(
    """WITH o AS (SELECT user_id, event_type, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM o)
SELECT user_id, epoch_us(min(ts)) AS first_us, count(*) AS n, count(*) FILTER (event_type = 'click') AS n_clicks FROM s GROUP BY user_id, nth"""
)
def session_stats(spark, d):
    from lexiloom.streaming import streams

    out = streams.session_stats(streams.with_event_time(table(spark, d, "events").select("user_id", "event_type", "ts")))
    return out.select("user_id", F.unix_micros("session_window.start").alias("first_us"), "n", "n_clicks")


@query(
    """SELECT '{"level":"INFO","message":"click","data":{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}}' AS value FROM events WHERE event_type = 'click'"""
)
def log_lines(spark, d):
    from lexiloom.streaming import streams

    return streams.log_lines(table(spark, d, "events").filter("event_type = 'click'").select("event_id", "user_id", "event_type"), "click")


@query("SELECT count(*) AS n_pages, count(DISTINCT url) AS n_urls, max(length(html)) AS longest FROM pages")
def page_totals(spark, d):
    return pages(spark, d).agg(F.count("*").alias("n_pages"), F.count_distinct("url").alias("n_urls"), F.max(F.length("html")).alias("longest"))


@query(
    """SELECT page_id, coalesce(nullif(trim(translate(split_part(rtrim(path, '/'), '/', -1), '-_', '  ')), ''), host) AS title
FROM (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages)"""
)
def url_title(spark, d):
    return pages(spark, d).select("page_id", analyzers.title_from_url(F.col("url")).alias("title"))
