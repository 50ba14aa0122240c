"""The engine's own queries over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import paths, text
from folium.operators import links, log, pages, ranking, search, users, versions
from folium.sources import config, corpus

QUERY, CASED, BELOW = "ouen", "The", "src3/en"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents_as_pages(_table(spark, sf_dir, "documents"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.events_as_versions(_table(spark, sf_dir, "events"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.events_as_log(_table(spark, sf_dir, "events"))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user for each customer: the token is tok_<name>, every seventh has none, and remotes are named after the segment."""
    c = _table(spark, sf_dir, "customer")
    hashed = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.sha2(F.concat(F.lit("tok_"), "c_name"), 256))
    remotes = F.create_map(F.lower("c_mktsegment"), F.concat(F.lit("https://git.example/"), "c_name"), F.lit("backup"), F.concat(F.lit("https://backup.example/"), "c_name"))
    none = F.lit(None).cast("timestamp")
    return c.select(F.col("c_name").alias("username"), hashed.alias("token_hash"), F.concat(F.lit("/wikis/"), "c_name").alias("wiki_dir"), none.alias("created_at"), none.alias("last_active"), remotes.alias("remotes"), F.array(F.lit("backup")).alias("auto_push_remotes"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each order, with its customer's token; every fifth has a wrong one."""
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("request_id"), F.concat(F.when(F.col("o_orderkey") % 5 == 0, "bad_").otherwise("tok_"), "c_name").alias("token"))


def _user_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the customer for each order, some of them not .md."""
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    name = F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ".txt").otherwise(".md"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("wiki_id"), name.alias("path"), F.col("o_orderstatus").alias("content"))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common table expressions: pages; lines, without the last if it is empty; lines that have the query.
P = "p AS (SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, text AS content FROM documents)"
L = (
    P + r", s AS (SELECT path, regexp_split_to_array(content, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS a FROM p), "
    "t AS (SELECT path, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM s), "
    "l AS (SELECT path, unnest(a) AS line, unnest(range(1, len(a) + 1))::INT AS line_number FROM t)"
)
H = L + f", h AS (SELECT * FROM l WHERE regexp_matches(line, '(?i){QUERY}'))"
V = (
    "v AS (SELECT 'users/' || user_id || '.md' AS path, event_id AS version, ts, CASE WHEN event_type = 'error' THEN 'delete_page' ELSE 'write_page' END AS op, "
    "CASE WHEN event_type <> 'error' THEN event_type END AS content, event_type = 'error' AS is_delete FROM events)"
)
C = (
    V + ", o AS (SELECT *, lag(content) OVER w AS c0, lag(is_delete) OVER w AS d0 FROM v WINDOW w AS (PARTITION BY path ORDER BY ts, version)), "
    "c AS (SELECT * FROM o WHERE (d0 IS NULL AND NOT is_delete) OR (d0 IS NOT NULL AND (c0 IS DISTINCT FROM content OR d0 <> is_delete)))"
)
U = "u AS (SELECT c_name AS username, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE sha256('tok_' || c_name) END AS token_hash, '/wikis/' || c_name AS wiki_dir, c_mktsegment FROM customer)"
R = "r AS (SELECT o_orderkey AS request_id, (CASE WHEN o_orderkey % 5 = 0 THEN 'bad_' ELSE 'tok_' END) || c_name AS token FROM orders JOIN customer ON o_custkey = c_custkey)"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {H} SELECT path, line_number, line FROM h")
def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_lines(_pages(spark, sf_dir), QUERY)


@query(f"WITH {L} SELECT path, line_number, line FROM l WHERE contains(line, '{CASED}')")
def search_case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_lines(_pages(spark, sf_dir), CASED, case_sensitive=True)


@query(f"WITH {H} SELECT path, string_agg(line_number || ':' || line, chr(10) ORDER BY line_number) AS matches FROM h GROUP BY path")
def search_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.transform("matches", lambda m: F.concat_ws(":", m["line_number"].cast("string"), m["line"]))
    return search.search(_pages(spark, sf_dir), QUERY).select("path", F.array_join(shown, "\n").alias("matches"))


@query(f"WITH {H} SELECT path, line_number, line, greatest(count(*) OVER (PARTITION BY path) - 5, 0)::BIGINT AS more FROM h QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_number) <= 5")
def search_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.first_matches(search.search_lines(_pages(spark, sf_dir), QUERY))


@query(f"WITH {H} SELECT path, count(*)::BIGINT AS n_matches, min(line_number)::INT AS first_line, greatest(count(*) - 5, 0)::BIGINT AS more FROM h GROUP BY path")
def search_more_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.match_counts(search.search_lines(_pages(spark, sf_dir), QUERY))


@query(f"WITH {P} SELECT path FROM p ORDER BY path")
def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.list_pages(_pages(spark, sf_dir))


@query(f"WITH {P} SELECT path FROM p WHERE starts_with(path, '{BELOW}/')")
def list_pages_subdirectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.list_pages(_pages(spark, sf_dir), BELOW)


@query(f"WITH {P} SELECT path, content FROM p WHERE path = 'src1/en/1.md'")
def read_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page(_pages(spark, sf_dir), "src1/en/1.md")


@query("SELECT 'index.md' AS path, string_agg('- ' || source || ': ' || n, chr(10) ORDER BY source) AS content FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def read_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a corpus whose index.md lists the sources."""
    counts = _table(spark, sf_dir, "documents").groupBy("source").count()
    line = F.concat(F.lit("- "), "source", F.lit(": "), F.col("count").cast("string"))
    index = counts.agg(F.array_join(F.array_sort(F.collect_list(F.struct("source", line.alias("l"))))["l"], "\n").alias("content"))
    every = _pages(spark, sf_dir).unionByName(index.select(F.lit("main").alias("wiki_id"), F.lit(paths.INDEX).alias("path"), "content"))
    return pages.page(every, paths.INDEX)


@query("SELECT (SELECT count(*) FROM documents)::BIGINT AS page_count, 1::BIGINT AS log_entries, '/corpus' AS wiki_root, 'guide' AS schema")
def wiki_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    log_page = spark.createDataFrame([("main", "log.md", "# Activity Log\n\n\n## 2026-01-01T00:00:00Z [ingest]\n\nall documents\n")], "wiki_id string, path string, content string")
    return pages.wiki_info(_pages(spark, sf_dir).unionByName(log_page), "/corpus", "guide")


@query(f"WITH {P} SELECT path, replace(string_split(path, '/')[-1], '.md', '') AS label, (len(string_split(path, '/')) - 1)::INT AS depth, '/wiki/main/' || path || '?token=t' AS url FROM p")
def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_tree(_pages(spark, sf_dir), "/wiki/main", "t")


@query(f"WITH {P} SELECT path, 'Home(/wiki/main) > ' || replace(replace(path, '.md', ''), '/', ' > ') AS trail FROM p")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = pages.with_breadcrumbs(_pages(spark, sf_dir), "/wiki/main")
    return shown.select("path", F.array_join(F.transform("breadcrumbs", lambda b: F.concat(b["label"], F.coalesce(F.concat(F.lit("("), b["url"], F.lit(")")), F.lit("")))), " > ").alias("trail"))


@query(f"WITH {P} SELECT path, replace(string_split(path, '/')[-1], '.md', '') AS title FROM p")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.with_title(_pages(spark, sf_dir))


@query(f"WITH {V} SELECT path, arg_max(content, (ts, version)) AS content FROM v GROUP BY path HAVING NOT arg_max(is_delete, (ts, version))")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.latest(_versions(spark, sf_dir)).select("path", "content")


@query(f"WITH {C} SELECT path, version, op, 'wiki: ' || op || ' wiki/' || path AS message FROM c")
def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.commits(_versions(spark, sf_dir)).select("path", "version", "op", "message")


@query(f"WITH {V} SELECT path, max(version)::BIGINT AS version FROM v GROUP BY path HAVING arg_max(is_delete, (ts, version))")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose last version deletes them."""
    v = _versions(spark, sf_dir)
    gone = v.select("path").distinct().join(versions.latest(v).select("path"), "path", "left_anti")
    return v.join(gone, "path", "left_semi").groupBy("path").agg(F.max("version").alias("version"))


@query(f"WITH {C} SELECT path, count(*)::BIGINT AS n_commits, count_if(is_delete)::BIGINT AS n_deletes FROM c GROUP BY path")
def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.commits(_versions(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("n_commits"), F.count_if("is_delete").alias("n_deletes"))


@query(f"WITH {C} SELECT version, op, content FROM c WHERE path = 'users/7.md'")
def page_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.history(_versions(spark, sf_dir), "users/7.md").select("version", "op", "content")


@query(f"WITH {C} SELECT path, version, (coalesce(content, '') <> '')::INT AS lines_added, (coalesce(c0, '') <> '')::INT AS lines_removed FROM c")
def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.line_changes(_versions(spark, sf_dir)).select("path", "version", "lines_added", "lines_removed")


@query("SELECT event_id, '## ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' [' || event_type || ']' AS heading FROM events")
def log_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("operation", F.col("event_type")).select("event_id", log.heading().alias("heading"))


@query("SELECT chr(10) || '## ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' [' || event_type || ']' || chr(10) || chr(10) || trim(coalesce(props, '')) || chr(10) AS block, 'wiki: append_log ' || event_type || ' ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS message FROM events")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.rendered(_log(spark, sf_dir)).select("block", "message")


@query("SELECT event_type AS operation, count(*)::BIGINT AS n_entries, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first_ts, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_ts FROM events GROUP BY event_type")
def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.counts(_log(spark, sf_dir)).select("operation", "n_entries", text.utc_text(F.col("first_ts")).alias("first_ts"), text.utc_text(F.col("last_ts")).alias("last_ts"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n_entries FROM events GROUP BY 1")
def log_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.per_day(_log(spark, sf_dir)).select("day", "n_entries")


@query("SELECT 'chats/' || conv_id || '.md' AS path, string_agg('## ' || role || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def chat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.conversations_as_pages(_table(spark, sf_dir, "conversations")).select("path", "content")


@query("SELECT c_name AS username, sha256('tok_' || c_name) AS token_hash FROM customer")
def token_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_name").alias("username"), text.token_hash(F.concat(F.lit("tok_"), "c_name")).alias("token_hash"))


@query(f"WITH {U}, {R} SELECT request_id, username, wiki_dir FROM r JOIN u ON sha256(token) = token_hash AND token_hash <> ''")
def auth_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.authenticated(_requests(spark, sf_dir), _users(spark, sf_dir)).select("request_id", "username", "wiki_dir")


@query(f"WITH {U}, {R} SELECT request_id, token FROM r WHERE sha256(token) NOT IN (SELECT token_hash FROM u WHERE token_hash <> '')")
def auth_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.rejected(_requests(spark, sf_dir), _users(spark, sf_dir))


@query(
    f"WITH {U}, n AS (SELECT c_name, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name) "
    "SELECT username, wiki_dir, coalesce(n, 0)::BIGINT AS page_count, CASE WHEN token_hash = '' THEN 'N/A' ELSE 'folium_' || username || '_' || repeat('*', 24) || right(token_hash, 8) END AS masked_token "
    "FROM u LEFT JOIN n ON n.c_name = username"
)
def user_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.list_users(_users(spark, sf_dir), _user_pages(spark, sf_dir)).drop("last_active")


@query(f"WITH {U} SELECT username, lower(c_mktsegment) AS name, 'https://git.example/' || username AS url, false AS auto_push FROM u UNION ALL SELECT username, 'backup', 'https://backup.example/' || username, true FROM u")
def remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.list_remotes(_users(spark, sf_dir))


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_active FROM events GROUP BY user_id")
def last_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = users.last_active(_table(spark, sf_dir, "events").select(F.col("user_id").alias("username"), "ts"))
    return found.select(F.col("username").alias("user_id"), text.utc_text(F.col("last_active")).alias("last_active"))


@query("WITH q AS (SELECT url AS path FROM pages UNION ALL SELECT '../' || page_id || '.md' FROM pages UNION ALL SELECT '/' || page_id FROM pages) SELECT path, path <> '' AND NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..') AS valid FROM q")
def path_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    every = [F.col("url"), F.concat(F.lit("../"), F.col("page_id").cast("string"), F.lit(".md")), F.concat(F.lit("/"), F.col("page_id").cast("string"))]
    return p.select(F.explode(F.array(*every)).alias("path")).select("path", paths.is_valid(F.col("path")).alias("valid"))


@query(
    r"WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href=\"([^\"]*)\"', 1)) AS target FROM pages) "
    "SELECT target, count(*)::BIGINT AS n_links, count(DISTINCT page_id)::BIGINT AS n_pages FROM a GROUP BY target"
)
def most_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.most_linked(links.html_links(_table(spark, sf_dir, "pages")))


@query(
    f"WITH {P}, w AS (SELECT path, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS term FROM p), n AS (SELECT path, count(*) AS len FROM w GROUP BY path), "
    "g AS (SELECT (SELECT count(*) FROM p) AS docs, avg(len) AS mean FROM n), f AS (SELECT path, term, count(*) AS tf FROM w WHERE term IN ('the', 'ouen', 'with') GROUP BY ALL), "
    "d AS (SELECT term, count(*) AS df FROM f GROUP BY term) "
    "SELECT path, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 9) AS score FROM f JOIN d USING (term) JOIN n USING (path), g GROUP BY path"
)
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: ranked search."""
    return ranking.bm25(_pages(spark, sf_dir), ["the", "ouen", "with"]).select("path", F.round("score", 9).alias("score"))


ACCENT = "ÉT"


@query(f"WITH {L} SELECT path, line_number, line FROM l WHERE regexp_matches(line, '(?i){ACCENT}')")
def search_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_lines(_pages(spark, sf_dir), ACCENT)


@query("SELECT 'k/' || doc_id || '.md' AS path, 1 AS line_number, 'Kelvin ' || chr(8490) || doc_id AS line FROM documents WHERE doc_id % 10 = 1")
def search_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unicode folding: k finds the Kelvin sign. Pages are one line each."""
    d = _table(spark, sf_dir, "documents")
    line = F.concat(F.lit("Kelvin \u212a"), F.col("doc_id").cast("string"))
    made = d.select(F.lit("main").alias("wiki_id"), F.concat(F.lit("k/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("doc_id") % 10 == 1, line).otherwise("none").alias("content"))
    return search.search_lines(made, "N k")


@query(f"WITH {H} SELECT path, replace(string_split(path, '/')[-1], '.md', '') AS title, '/wiki/main/' || path || '?token=t' AS url, line_number, line, greatest(count(*) OVER (PARTITION BY path) - 5, 0)::BIGINT AS more FROM h QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_number) <= 5")
def web_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.web_rows(_pages(spark, sf_dir), f" {QUERY} ", "/wiki/main", "t")


@query(f"WITH {L} SELECT path, line_number, line FROM l")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.numbered_lines(_pages(spark, sf_dir))


@query("SELECT url, CASE WHEN ends_with(url, '.md') THEN url ELSE url || '.md' END AS path FROM pages")
def page_without_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("url", paths.with_extension(F.col("url")).alias("path"))


#: Pages in hidden folders, folders that begin with _, logs in folders, and files of other kinds.
O = "o AS (SELECT ['.hid/h', '_drafts/d', 'topics/.x/y', '_t', 'logs/l'][doc_id % 5 + 1] || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.txt' WHEN doc_id % 7 = 1 THEN '/log.md' ELSE '.md' END AS path, text AS content FROM documents)"


def _odd_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    head = F.element_at(F.array(*map(F.lit, (".hid/h", "_drafts/d", "topics/.x/y", "_t", "logs/l"))), (i % 5 + 1).cast("int"))
    tail = F.when(i % 7 == 0, ".txt").when(i % 7 == 1, "/log.md").otherwise(".md")
    return _table(spark, sf_dir, "documents").select(F.lit("main").alias("wiki_id"), F.concat(head, i.cast("string"), tail).alias("path"), F.col("text").alias("content"))


@query(f"WITH {O} SELECT path FROM o WHERE ends_with(path, '.md') AND NOT regexp_matches(path, '(^|/)[.]') ORDER BY path")
def list_visible_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.list_pages(_odd_pages(spark, sf_dir))


@query(f"WITH {O} SELECT count(*)::BIGINT AS page_count, 0::BIGINT AS log_entries, '/odd' AS wiki_root, '' AS schema FROM o WHERE ends_with(path, '.md') AND NOT regexp_matches(path, '(^|/)log[.]md$')")
def wiki_info_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.wiki_info(_odd_pages(spark, sf_dir), "/odd")


@query(f"WITH {O} SELECT 'main' AS wiki_id, count(*)::BIGINT AS page_count FROM o WHERE ends_with(path, '.md')")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_counts(_odd_pages(spark, sf_dir))


#: Two versions of each document's page, the second in upper case where it has "the", and a first line more.
W = "w AS (SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, text AS t1, 'new' || chr(10) || replace(text, 'the', 'THE') AS t2 FROM documents)"
W += r", x AS (SELECT path, regexp_split_to_array(t1, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS a, regexp_split_to_array(t2, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS b FROM w)"
W += ", y AS (SELECT path, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a, CASE WHEN b[-1] = '' THEN b[:-2] ELSE b END AS b FROM x)"
W += ", n AS (SELECT path, line, sum(k) AS k FROM (SELECT path, unnest(a) AS line, -1 AS k FROM y UNION ALL SELECT path, unnest(b), 1 FROM y) GROUP BY ALL)"


@query(f"WITH {W} SELECT path, 1::BIGINT AS version, len(a)::INT AS lines_added, 0::INT AS lines_removed FROM y UNION ALL SELECT path, 2, sum(greatest(k, 0))::INT, sum(greatest(-k, 0))::INT FROM n GROUP BY path")
def line_changes_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    both = F.explode(F.array(F.struct(F.lit(1).cast("long").alias("version"), "content"), F.struct(F.lit(2).cast("long").alias("version"), F.concat(F.lit("new\n"), F.replace("content", F.lit("the"), F.lit("THE"))).alias("content"))))
    rows = p.select("wiki_id", "path", both.alias("v")).select("wiki_id", "path", "v.version", F.lit("2026-01-01").cast("timestamp").alias("ts"), "v.content")
    return versions.line_changes(versions.bulk_writes(rows)).select("path", "version", "lines_added", "lines_removed")


@query(
    "WITH q AS (SELECT page_id, unnest([url, '../' || page_id || '.md', '/' || page_id, 'index.md', 'log.md', 'a/' || page_id || '.md']) AS path FROM pages), "
    "g AS (SELECT *, page_id % 3 = 0 AS gone FROM q WHERE path <> '' AND NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..')) "
    "SELECT path, page_id AS version, CASE WHEN gone THEN 'delete_page' ELSE 'write_page' END AS op, 'wiki: ' || CASE WHEN gone THEN 'delete_page' ELSE 'write_page' END || ' wiki/' || path AS message FROM g WHERE NOT (gone AND path IN ('index.md', 'log.md'))"
)
def bulk_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes and deletions, of which invalid paths and deletions of protected pages are left out."""
    i = F.col("page_id").cast("string")
    each = F.explode(F.array("url", F.concat(F.lit("../"), i, F.lit(".md")), F.concat(F.lit("/"), i), F.lit("index.md"), F.lit("log.md"), F.concat(F.lit("a/"), i, F.lit(".md"))))
    rows = _table(spark, sf_dir, "pages").select(F.lit("main").alias("wiki_id"), each.alias("path"), F.col("page_id").alias("version"), F.lit("2026-01-01").cast("timestamp").alias("ts"), F.when(F.col("page_id") % 3 != 0, "x").alias("content"))
    return versions.bulk_writes(rows).select("path", "version", "op", "message")


#: Pages of conversations that link to the next one's, to themselves and elsewhere.
K = "k AS (SELECT DISTINCT conv_id AS c FROM conversations)"


def _linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id").cast("string")
    content = F.concat(F.lit("[next]("), (F.col("conv_id") + 1).cast("string"), F.lit(".md) [me](./"), c, F.lit('.md "t") [i](/index.md#top) [x](https://x.example/y.md)'))
    return _table(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.concat(F.lit("chats/"), c, F.lit(".md")).alias("path"), content.alias("content"))


@query(f"WITH {K} SELECT 'chats/' || c || '.md' AS path, unnest(['chats/' || (c + 1) || '.md', 'chats/' || c || '.md', 'index.md']) AS target FROM k")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_links(_linked_pages(spark, sf_dir))


@query(f"WITH {K} SELECT 'chats/' || c || '.md' AS path FROM k WHERE c - 1 NOT IN (SELECT c FROM k)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.orphans(_linked_pages(spark, sf_dir))


@query("SELECT 'd/' || doc_id || '.md' AS path FROM documents WHERE lang = 'fr'")
def pages_with_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: pages by a field of their front matter."""
    d = _table(spark, sf_dir, "documents")
    head = F.concat(F.lit("---\nsource: "), "source", F.lit("\nlang: "), "lang", F.lit("\n---\n"), "text")
    return links.with_field(d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), head.alias("content")), "lang", "fr")


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT list(CASE WHEN i % 3 = 0 THEN 1.0 ELSE -0.5 END ORDER BY i)::DOUBLE[] FROM (SELECT unnest(range(len((SELECT any_value(embedding) FROM embeddings)))) AS i))), 6) AS cosine FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT list(CASE WHEN i % 3 = 0 THEN 1.0 ELSE -0.5 END ORDER BY i)::DOUBLE[] FROM (SELECT unnest(range(len((SELECT any_value(embedding) FROM embeddings)))) AS i))) DESC, vec_id LIMIT 10")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the ten nearest vectors."""
    e = _table(spark, sf_dir, "embeddings")
    size = len(e.first().embedding)
    return ranking.nearest(e, [1.0 if i % 3 == 0 else -0.5 for i in range(size)], 10).select("vec_id", F.round("cosine", 6).alias("cosine"))


NAMES = tuple(f"Customer#{k:09}" for k in (1, 2, 3))


@query(
    f"WITH {U}, a AS (SELECT username, CASE WHEN username = '{NAMES[0]}' THEN sha256('fresh') ELSE token_hash END AS token_hash, lower(c_mktsegment) AS segment FROM u WHERE username <> '{NAMES[1]}'), "
    "b AS (SELECT username, token_hash, 'backup,' || segment AS names FROM a UNION ALL SELECT 'zoe', sha256('t'), '') "
    f"SELECT username, token_hash, CASE WHEN username = '{NAMES[2]}' THEN 'mirror' || substr(names, 7) WHEN username = 'zoe' THEN 'hub' ELSE names END AS names FROM b"
)
def user_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token rotated, a user removed, one added with a remote, and one's remote replaced by another."""
    u = _users(spark, sf_dir)
    u = users.remove_user(users.rotate_token(u, NAMES[0], "fresh"), NAMES[1])
    u = users.add_remote(users.remove_remote(u, NAMES[2], "backup"), NAMES[2], "mirror", "https://m.example", auto_push=True)
    new = users.add_user(spark, u, "zoe", "t", "/wikis/zoe", datetime.datetime(2026, 1, 1))
    u = users.add_remote(u.unionByName(new), "zoe", "hub", "https://h.example")
    names = F.map_keys("remotes")
    mirror = F.concat(F.filter(names, lambda n: n.isin("backup", "mirror", "hub")), F.filter(names, lambda n: ~n.isin("backup", "mirror", "hub")))
    return u.select("username", "token_hash", F.array_join(mirror, ",").alias("names"))


@query(f"WITH {U} SELECT username, token_hash, wiki_dir, NULL::VARCHAR AS last_active, 'https://backup.example/' || username AS backup, 1::INT AS n_auto FROM u")
def config_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts written as the configuration's JSON and read again."""
    u = _users(spark, sf_dir)
    fields = F.struct("token_hash", "wiki_dir", F.col("created_at").cast("string").alias("created_at"), F.col("last_active").cast("string").alias("last_active"), "remotes", "auto_push_remotes")
    read = u.select("username", config.user_json(fields).alias("json")).select("username", config.parsed_user(F.col("json")).alias("u"))
    return read.select("username", "u.token_hash", "u.wiki_dir", "u.last_active", F.col("u.remotes")["backup"].alias("backup"), F.size("u.auto_push_remotes").alias("n_auto"))


@query("SELECT count(*)::BIGINT AS n_users FROM customer")
def user_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.count_users(_users(spark, sf_dir))


@query(f"WITH {U}, {R} SELECT request_id, username, username = 'Customer#' || lpad((request_id % 1500)::VARCHAR, 9, '0') AS allowed FROM r JOIN u ON sha256(token) = token_hash AND token_hash <> ''")
def auth_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a request asks for its own user's pages."""
    found = users.authenticated(_requests(spark, sf_dir), _users(spark, sf_dir))
    asked = F.concat(F.lit("Customer#"), F.lpad((F.col("request_id") % 1500).cast("string"), 9, "0"))
    return users.routed(found.withColumn("requested_user", asked)).select("request_id", "username", "allowed")


@query("SELECT c_name AS username, CASE WHEN c_custkey % 3 <> 0 THEN 'tok_' || c_name END AS password FROM customer")
def basic_passwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens from headers of kind Basic, as git sends them; every third request has another kind."""
    c = _table(spark, sf_dir, "customer")
    header = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("Basic "), F.base64(F.concat(F.lit("git:tok_"), "c_name").cast("binary")))).otherwise(F.lit("Bearer x"))
    return c.select(F.col("c_name").alias("username"), users.basic_password(header).alias("password"))


@query("SELECT c_name AS username, string_agg('Push to ' || name || ' failed: timed out', ';' ORDER BY name) AS warnings FROM (SELECT c_name, c_custkey, unnest(['origin', 'backup']) AS name FROM customer) WHERE (c_custkey + length(name)) % 4 <> 0 AND c_custkey % 2 = 0 GROUP BY c_name")
def push_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("username"), F.explode(F.array(F.lit("origin"), F.lit("backup"))).alias("name"))
    error = F.when(((F.col("c_custkey") + F.length("name")) % 4 != 0) & (F.col("c_custkey") % 2 == 0), "timed out")
    return users.push_warnings(c.select("username", "name", error.alias("error"))).select("username", F.array_join("warnings", ";").alias("warnings"))


@query(r"""SELECT event_type AS wiki_id, 'log.md' AS path, '# Activity Log' || chr(10) || chr(10) || string_agg(chr(10) || '## ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || chr(10) || 'event' || chr(10), '' ORDER BY ts) AS content FROM events GROUP BY event_type""")
def log_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered log of a wiki for each kind of event."""
    e = _table(spark, sf_dir, "events")
    return log.log_page(e.select(F.col("event_type").alias("wiki_id"), "ts", F.lit(None).cast("string").alias("operation"), F.lit(" event\n").alias("entry")))
