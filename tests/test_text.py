import duckdb
import pytest
from pyspark.sql import functions as F

from loam.functions import text as X
from loam.operators import html
from loam.plans import catalogue


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [('id="n-77"  > Закон принят', "Закон принят"), ("a null b", "a  b"), ("x\r\ny", "x\r y"), ("<b>x</b>", "<b>x</b>"), ("nullable Undefined", "nullable"), ("  > a", "> a"), ("яnull z", "яnull z")],
)
def test_clean_chat(spark, given, wanted):
    assert one(spark, X.clean_chat(F.lit(given))) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("Статья 81. Отпуск", "81"), ("см. Статья 30  4. Сроки", "30__4"), ("Глава о договорах", "unknown"), ("статья 14.3 x", "14"), ("СТАТЬЯ 7", "7"), ("Статья 5 2024 года", "5_2024")])
def test_article_number(spark, given, wanted):
    assert one(spark, X.article_number(F.lit(given))) == wanted


@pytest.mark.parametrize(("given", "number", "title"), [("Статья 44. Залог", "44", "Залог"), ("Статья 12", "1", "2"), ("Статья 5", "неизвестная", "Статья 5"), ("Статья 7½. Аренда", "7½", "Аренда"), ("Статья 3-1 Имя", "3-1", "Имя")])
def test_title(spark, given, number, title):
    n, t = X.title_parts(F.lit(given))
    assert (one(spark, n), one(spark, t)) == (number, title)


@pytest.mark.parametrize(("given", "name", "code"), [("Статья 5 ГК РФ", "Гражданский кодекс РФ", "ГК"), ("статья 7 тк", "Трудовой кодекс РФ", "ТК"), ("Статья 1 КоАП", "Другой закон", "КОАП"), ("Статья 77. О сроках", "Неизвестно", "UNKNOWN")])
def test_law(spark, given, name, code):
    n, c = X.law(F.lit(given), F.lit(""))
    assert (one(spark, n), one(spark, c)) == (name, code)


@pytest.mark.parametrize(("given", "wanted"), [("abcdeaaaaa", False), ("abcdeaaaaab", True), ("abc      defgh", False), ("абвггггг\nzz", True)])
def test_repetitive(spark, given, wanted):
    assert one(spark, X.repetitive(F.lit(given))) is wanted


@pytest.mark.parametrize(("given", "wanted"), [("слово " * 20 + "конец", True), ("слово " * 20 + "конец.", False), ("слово " * 18 + "да. " + "x" * 10, False), ("", True)])
def test_truncated(spark, given, wanted):
    assert one(spark, X.truncated(F.lit(given))) is wanted


def test_anchor_slice(spark):
    page = '<p id="p1">a</p><p id="p2">b</p><p>c</p>'
    assert one(spark, html.anchor_slice(F.lit(page), F.lit("p1"), F.lit("p2"))) == 'id="p1">a</p><p id="p2">b</p>'
    assert one(spark, html.anchor_slice(F.lit(page), F.lit("p1"), F.lit("p9"))) == ""


def test_strategies(spark):
    a = '<h1 class="law-element__h1">T</h1><div class="law-element__body"><p>x</p><p>y<p>z</div>'
    b = '<h1>H</h1><div class="law-document-content"><p>x</p></div><p>no</p>'
    df = spark.createDataFrame([("u", a), ("v", None)], "url string, html string")
    rows = {r["url"]: r for r in html.parse_pages(df, "element").collect()}
    assert (rows["u"]["title"], rows["u"]["content"]) == ("T", "x\n\ny\n\nz")
    assert rows["v"]["title"] == "Unknown Title"
    assert html.parse_pages(spark.createDataFrame([("u", b)], "url string, html string"), "document").first()["content"] == "x"


CUT = [f"<h1>A &amp; B&{cut}</h1><article><div>{'word ' * 50}&lt;&quot;{i}&quot;&gt; &copy &{cut}</div>last &amp;</article>" for i, cut in enumerate(("amp", "am", "quo", "lt", "", "amp;amp", "copyx;", "unknown;"))]


@pytest.mark.parametrize("name", ["fragment_to_text", "node_records", "page_pairs_written", "parse_pages"])
def test_cut_references(spark, tmp_path, name):
    """References without their semicolon, and unknown ones, stay as they are written."""
    rows = [(i, f"https://h/{'de' if i % 2 else 'en'}/{i}", x) for i, x in enumerate(CUT)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    wanted = con.execute(f"select {', '.join(f'"{c}"' for c in got.columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted) and wanted


def test_links(spark):
    page = '<a href="/law/statia-1">a</a><a href="/law/statia-1">b</a><a href="/x">c</a><a href="https://h/law/statia-2">d</a>'
    df = spark.createDataFrame([("u", page)], "url string, html string")
    assert [r["link"] for r in html.article_links(df, "https://h").orderBy("rank").collect()] == ["https://h/law/statia-1", "https://h/law/statia-2"]
    assert html.article_links(df, "https://h", 1).count() == 1
    page = f'<a href="?hash={"a" * 64}&docid=5">Кодекс</a>'
    got = html.codex_links(spark.createDataFrame([("u", page)], "url string, html string"), "Кодекс").first()
    assert (got["hash"], got["docid"]) == ("a" * 64, 5)
    page = "".join(f'<a href="?hash={c * 64}">{label}</a>' for c, label in (("a", "КоАП РФ"), ("b", "Кодекс об административных"), ("c", "коап"), ("d", "иное")))
    got = html.codex_links(spark.createDataFrame([("u", page)], "url string, html string"), "административных", "КоАП").collect()
    assert sorted(r["hash"][0] for r in got) == ["a", "b"]


@pytest.mark.parametrize(
    ("page", "url", "wanted"),
    [
        ('<i data-redid="12"></i><meta name="redid" content="9999">', None, 12),
        ('<meta content="7 x" name="app-RDK"><script>redid = 5555</script>', None, 7),
        ("<script>redid: 900; rdk = '12345678'</script>", None, 12345678),
        ("<p>redid = 5555</p>", "https://h/x#docid=31", 31),
        ("<p>page 2024, but only very much later 4321 (doc)</p>", None, 4321),
        ("<p>rdk, and then long after it 4321</p>", None, None),
        ("<p>0012 rdk 1234567 rdk</p>", None, None),
        ("", None, None),
    ],
)
def test_redid(spark, page, url, wanted):
    df = spark.createDataFrame([(page, url)], "page string, url string")
    assert df.select(html.redid(F.col("page"), None if url is None else F.col("url")).alias("x")).first()["x"] == wanted


def test_redid_null(spark):
    assert spark.createDataFrame([(None,)], "page string").select(html.redid(F.col("page")).alias("x")).first()["x"] is None
