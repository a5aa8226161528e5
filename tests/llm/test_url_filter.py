import pyarrow as pa

from graticule.llm import url_filter

from .helpers import DATA, duck, write_table

PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("node", pa.string())])
COLUMNS = ["page_id", "host", "path", "rule", "verdict"]


def rows_of(spark, folder):
    return sorted((tuple(r) for r in url_filter.op8_url_filter(spark, folder).select(COLUMNS).collect()), key=str)


def sql_rows(folder):
    return sorted(duck(folder, f"SELECT {','.join(COLUMNS)} FROM ({url_filter.OP8_SQL})", ("pages",)), key=str)


def canon(url):
    return f'<html><LINK href="{url}" rel="canonical"></html>'


def refresh(url):
    return f"<meta http-equiv='Refresh' content='0; URL={url}'>"


def test_whole_table_against_sql(spark):
    folder = str(DATA / "sf0.01")
    rows = rows_of(spark, folder)
    assert rows == sql_rows(folder)
    assert {r[4] for r in rows} == {"allow", "block"}


def test_aliases(spark, tmp_path):
    pages = [
        ("http://a.com/x", canon("http://b.com/y")), ("https://b.com/y#top", refresh("http://spam.net/z")), ("http://spam.net/z", "<p>"),  # block reaches a and b
        ("http://c.com/1", canon("/2")), ("http://c.com/2", canon("http://k.net/q")), ("http://k.net/q", canon("http://x.org/fr/1")),  # an allowed member wins
        ("http://x.org/fr/1", None), ("http://d.com/dir/1", canon("other")), ("http://d.com/dir/other?x", "<p>"), ("http://d.com/dir/other", refresh("http://outside.net/")),
        ("HTTP://WWW.Example.NET/en/1", None), ("http://example.net", ""), ("http://notexample.com/de/", None), ("http://example.com/de/x?y#z", None), ("no-scheme/x", canon("http://spam.net/z")),
        (None, canon("http://spam.net/z")), ("", None), ("http://", None), ("x://y://z/p", None), ("http://a.com/x", None), ("http://e.com/\nx", None), ("http://l.com/" + "x" * 5000, canon("//spam.net/z")),
    ]
    write_table(tmp_path, "pages", [{"page_id": i, "url": u, "html": h, "node": "n"} for i, (u, h) in enumerate(pages)], PAGES)
    rows = rows_of(spark, str(tmp_path))
    assert rows == sql_rows(str(tmp_path))
    verdict = {r[0]: r[4] for r in rows}
    assert [verdict[i] for i in range(10)] == ["block", "block", "block", "allow", "allow", "block", "allow", "block", "allow", "block"]
    assert verdict[21] == "block" and verdict[15] == "allow"


def test_redirect_table(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", None), (2, "http://b.com/", None)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://a.com/", "http://m.com/"), ("http://m.com/", "http://z.net/")], "source string, target string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, redirects=redirects).collect()} == {1: "block", 2: "allow"}


def test_empty(spark, tmp_path):
    write_table(tmp_path, "pages", [], PAGES)
    assert rows_of(spark, str(tmp_path)) == []
