"""Queries over the driver's tables that go through files, pages' links and fragments, each with its SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as X
from loam.operators import html, messages, profile, scratch, vector
from loam.plans import catalogue, pipelines
from loam.plans.catalogue import SQL, docs, headed, pages, query, turns
from loam.ship import ship
from loam.sources import readers, sinks


#: Lines of an array file, at most: an item each, and its end.
LINES = 2000


def array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items as lines of JSON arrays, each of LINES lines; the last may be shorter."""
    n = 0
    for batch in batches:
        lines = []
        for item in batch.column(0).to_pylist():
            lines.append(f"{',' if n else '['}{item}")
            n += 1
            if n == LINES - 1:
                lines.append("]")
                n = 0
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])


def array_files(rows: DataFrame, item: Column, path: str) -> None:
    """Write items as JSON arrays: a task writes its rows as they come, a file for every LINES lines, so that there are few files and none is large."""
    ship(rows.sparkSession)
    rows.select(item.alias("value")).mapInArrow(array_lines, "value string").write.option("maxRecordsPerFile", LINES).text(path)


@query("SELECT 'https://h/' || lang || '/' || doc_id AS url, 'T\"' || doc_id || ', [x]' AS title, md5(text) AS content FROM documents")
def article_json(s, d):
    """Articles of array files."""
    i = F.col("doc_id").cast("string")
    row = F.struct(F.concat(F.lit("https://h/"), "lang", F.lit("/"), i).alias("url"), F.concat(F.lit('T"'), i, F.lit(", [x]")).alias("title"), F.col("text").alias("content"), F.lit(1).alias("other"))
    path = scratch.fresh_path(s)
    array_files(docs(s, d), F.to_json(row), path)
    return readers.articles(s, path).select("url", "title", F.md5(F.col("content").cast("binary")).alias("content"))


LAWS = ["Трудового кодекса", "Жилищного кодекса", "Налогового кодекса"]


@query("SELECT question, answer, count(*) AS n FROM (" + SQL["title_parse_qa"].replace("'Какая статья из ТК регулирует: '", "'Какая статья из ' || CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LAWS)) + " END || ' регулирует: '") + ") GROUP BY ALL")
def qa_written(s, d):
    """Question and answer messages of array files of several laws, from the file that they are written to; a listed file that isn't there is passed over."""
    base, out, files = scratch.fresh_path(s), scratch.fresh_path(s), {}
    for i, law in enumerate(LAWS):
        rows = docs(s, d).filter(F.col("doc_id") % 3 == i).withColumn("_title", headed())
        array_files(rows, F.to_json(F.struct(F.col("_title").alias("title"), F.col("text").alias("content"))), f"{base}/{i}")
        files[f"{base}/{i}"] = law
    pipelines.qa_dataset(s, files | {f"{base}/missing": "x"}, out)
    told = s.read.schema(f"messages {messages.MESSAGES}").json(out)
    last = lambda role: messages.last_of(F.col("messages"), role)
    return told.select(last("user").alias("question"), F.md5(last("assistant").cast("binary")).alias("answer")).groupBy("question", "answer").agg(F.count(F.lit(1)).alias("n"))


@query(SQL["labels_written"])
def label_file(s, d):
    """Counts of laws of array files of records that are labelled and written."""
    i, m = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    article = F.when(m == 0, F.concat(F.lit("Статья "), i, F.lit(" ГК РФ"))).when(m == 1, F.concat(F.lit("статья "), i, F.lit(" тк"))).when(m == 2, "Статья 1 КоАП").when(m == 3, F.concat(F.lit("Статья "), i, F.lit(". Понятие"))).otherwise(F.col("text"))
    path, out = scratch.fresh_path(s), scratch.fresh_path(s)
    array_files(docs(s, d), F.to_json(F.struct(article.alias("article"), F.when(m == 4, "").otherwise("Статья 9 УК").alias("title"))), path)
    return pipelines.label_file(s, path, out)


@query(SQL["length_stats"])
def lengths_read(s, d):
    """Answer lengths of a training file."""
    path = scratch.fresh_path(s)
    sinks.jsonl(turns(s, d), path)
    return profile.length_stats(readers.training_records(s, path))


TWICE = "(SELECT page_id, url, html || html AS html FROM pages)"


@query(f"""WITH found AS ({SQL['page_links'].replace('FROM pages)', f'FROM {TWICE})')}), named AS (SELECT url, pos, CASE WHEN starts_with(href, '/') THEN 'https://law.example.org' || href ELSE href END AS link FROM found WHERE contains(href, 'e') AND contains(href, '/t')),
    once AS (SELECT url, link, min(pos) AS pos FROM named GROUP BY url, link) SELECT url, link, pos, row_number() OVER (PARTITION BY url ORDER BY pos)::INTEGER AS rank FROM once QUALIFY rank <= 2""")
def law_links(s, d):
    """The first links of each page to what its marks name, each once, absolute."""
    twice = pages(s, d).withColumn("html", F.concat("html", "html"))
    return html.article_links(twice, "https://law.example.org", 2, ("e", "/t"))


@query("""WITH p AS (SELECT url, page_id, split_part(url, '/', 3) AS host FROM pages), f AS (SELECT *, sha256(host) AS hash FROM p WHERE contains('Кодекс ' || host, 'blog.') OR contains('Кодекс ' || host, 'example.net'))
    SELECT hash, 'Кодекс ' || arg_min(host, url) AS doc_link_title, '/proxy/?docbody=&hash=' || hash || '&docid=' || arg_min(page_id, url) AS doc_url, arg_min(page_id, url) AS docid FROM f GROUP BY hash""")
def codex_index(s, d):
    """Documents that pages of an index link to under one of the spellings of a name, the first link of each."""
    host, i = F.split_part("url", F.lit("/"), F.lit(3)), F.col("page_id").cast("string")
    page = F.concat(F.lit('<ul><li><a class="x" href="/proxy/?docbody=&amp;hash='), F.sha2(host.cast("binary"), 256), F.lit("&amp;docid="), i, F.lit('">Кодекс '), host, F.lit('</a><a href="/about">about</a></ul>'))
    return html.codex_links(pages(s, d).select("url", page.alias("html")), "blog.", "example.net")


def content_trees(s: SparkSession, d: str) -> DataFrame:
    """Pages with anchors and a content tree of two nodes, one of which lacks an end."""
    marked = F.replace(F.replace("html", F.lit("<h1>"), F.lit('<h1 id="p1">')), F.lit("<article>"), F.lit('<div id="p0"></div><article>'))
    marked = F.replace(marked, F.lit("</article>"), F.lit('<p id="p2">End.</p></article>'))
    node = lambda i, end: F.struct(F.lit(i).alias("id"), F.lit("p1").alias("np"), end.alias("npe"), F.concat(F.lit("Статья "), F.col("page_id").cast("string"), F.lit(".5 Заголовок")).alias("caption"), F.lit("статья").alias("unit"), F.lit(3).alias("lvl"))
    nodes = F.array(node("n1", F.lit("p2")), node("n2", F.lit(None).cast("string")), node("n3", F.when(F.col("page_id") % 2 == 0, "p2").otherwise("p9")))
    return pages(s, d).select("page_id", F.split_part("url", F.lit("/"), F.lit(4)).alias("code"), F.col("url").alias("doc_hash"), marked.alias("html"), nodes.alias("nodes"))


SLICED = """slices AS (SELECT page_id, url, split_part(url, '/', 4) AS code, replace(replace(replace(html, '<h1>', '<h1 id="p1">'), '<article>', '<div id="p0"></div><article>'), '</article>', '<p id="p2">End.</p></article>') AS h FROM pages),
    cut AS (SELECT *, instr(h, 'id="p1"') AS s, instr(h, 'id="p2"') AS e FROM slices WHERE contains(h, 'id="p1"') AND contains(h, 'id="p2"')),
    sliced AS (SELECT page_id, url, code, substring(h, s, e + instr(substring(h, e), '</p>') + 3 - s) AS html FROM cut)"""
RECORDS = f"""{SLICED}, texts AS ({SQL['fragment_to_text'].replace('FROM pages)', 'FROM sliced)')}),
    records AS (SELECT page_id, url, code, unnest(CASE WHEN page_id % 2 = 0 THEN ['n1', 'n3'] ELSE ['n1'] END) AS node_id, text, coalesce(nullif(regexp_extract(text, 'Статья\\s+(\\d+(?:\\.\\d+)*)', 1), ''), page_id || '.5') AS article_number
        FROM texts JOIN sliced USING (page_id) WHERE length(text) >= 200)"""


@query(f"WITH {RECORDS} SELECT page_id, node_id, md5(text) AS title, md5(text) AS content, article_number FROM records")
def node_records(s, d):
    """Article records of pages with content trees, cut between anchors."""
    got = html.article_records(html.node_slices(content_trees(s, d)))
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return got.select("page_id", "node_id", digest("title"), digest("content"), "article_number")


@query(f"""WITH {RECORDS}, capped AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY url, node_id) AS ord FROM records QUALIFY ord <= 60),
    once AS (SELECT code, text, min(ord) AS first_seen FROM capped GROUP BY code, text),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY md5('42:' || first_seen)) AS r, count(*) OVER (PARTITION BY code) AS n FROM once)
    SELECT code, md5(text) AS "case", md5(text) AS article, CASE WHEN r <= greatest(1, floor(n * 0.1::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM ranked""")
def page_pairs_written(s, d):
    """Pairs of pages with content trees, from the folders by code and split that they are written to."""
    path = scratch.fresh_path(s)
    pipelines.page_pairs(content_trees(s, d), path, most=60)
    got = s.read.schema("`case` string, article string, code string, split string").json(path)
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return got.select("code", digest("case"), digest("article"), "split")


ASKED = [1.0 if i % 3 == 0 else -0.5 if i % 3 == 1 else 0.25 for i in range(64)]


@query(f"""WITH p AS (SELECT vec_id, label, 1 - list_cosine_similarity({ASKED}::DOUBLE[], embedding::DOUBLE[]) AS d FROM embeddings)
    SELECT row_number() OVER (ORDER BY d, vec_id)::INTEGER AS rank, round(d, 6) AS distance, round(1 - d, 6) AS similarity, 'text of ' || vec_id AS text, 't' || label AS article_title, 'https://h/' || vec_id AS article_url, CASE WHEN label % 2 = 0 THEN 'GK' ELSE 'TK' END AS legal_code
    FROM p ORDER BY d, vec_id LIMIT 10""")
def search_results(s, d):
    """What a search tells of the ten chunks nearest to a query."""
    i = F.col("vec_id").cast("string")
    index = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", F.concat(F.lit("text of "), i).alias("document"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("article_title"), F.concat(F.lit("https://h/"), i).alias("article_url"), F.when(F.col("label") % 2 == 0, "GK").otherwise("TK").alias("legal_code"))
    found = vector.results(vector.search(index, ASKED, 10))
    return found.withColumns({c: F.round(c, 6) for c in ("distance", "similarity")})


ESCAPED = r"replace(replace(replace(text, chr(10), '\r\n'), ' a', '\t'), 'e', '\" \n')"


@query(rf"""SELECT doc_id, md5(replace(replace(replace(replace({ESCAPED}, '\"', '"'), '\r\n', chr(10)), '\n', chr(10)), '\t', chr(9))) AS text FROM documents""")
def unescaped(s, d):
    """Texts with escapes of quotes, line ends and tabs undone."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("\n"), F.lit("\\r\\n")), F.lit(" a"), F.lit("\\t")), F.lit("e"), F.lit('\\" \\n'))
    return docs(s, d).select("doc_id", F.md5(X.unescape(escaped).cast("binary")).alias("text"))


def sql_crc32() -> str:
    """Remainders of a byte under crc32's polynomial."""
    x = "i::UBIGINT"
    for _ in range(8):
        x = f"(SELECT CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END FROM (SELECT {x} AS y))"
    return f"SELECT list(x ORDER BY i) AS t FROM (SELECT i, {x} AS x FROM range(256) a(i))"


@query(rf"""WITH RECURSIVE words AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[\s\x0b\x1c-\x1f]+'), lambda x: x <> '')) AS w FROM documents),
    remainders AS MATERIALIZED ({sql_crc32()}), names AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM words),
    steps(w, h, pos, crc) AS (SELECT w, h, 1::BIGINT, 4294967295::UBIGINT FROM names
        UNION ALL SELECT w, h, pos + 2, xor(crc >> 8, t[(1 + (xor(crc, ('0x' || substr(h, pos, 2))::UBIGINT) & 255))::BIGINT]) FROM steps, remainders WHERE pos < len(h)),
    hashes AS MATERIALIZED (SELECT w, xor(crc, 4294967295::UBIGINT) AS x FROM steps WHERE pos > len(h)),
    counts AS (SELECT doc_id, (x % 256)::INTEGER AS b, sum(CASE WHEN x >= 2147483648 THEN 1 ELSE -1 END) AS n FROM words JOIN hashes USING (w) GROUP BY ALL)
    SELECT doc_id, count(*) FILTER (n <> 0) AS n_buckets, md5(string_agg(b || ':' || round(n / length * 1000000)::BIGINT, ',' ORDER BY b) FILTER (n <> 0)) AS vector
    FROM counts JOIN (SELECT doc_id, sqrt(sum(n * n)::DOUBLE) AS length FROM counts GROUP BY doc_id) USING (doc_id) WHERE length > 0 GROUP BY doc_id""")
def hashed_embedding(s, d):
    """The embedding that stands in where none is fitted, as its buckets that aren't empty."""
    got = vector.hashed(docs(s, d).select("doc_id", F.col("text").alias("document"))).filter("embedding is not null")
    parts = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("b"), x.alias("v"))), lambda p: p["v"] != 0)
    lines = F.transform(parts, lambda p: F.concat(p["b"].cast("string"), F.lit(":"), F.round(p["v"] * 1_000_000).cast("long").cast("string")))
    return got.select("doc_id", F.size(parts).cast("long").alias("n_buckets"), F.md5(F.array_join(lines, ",").cast("binary")).alias("vector"))

