"""Tables of pages against a plain tag parser."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from stridecast.sources import pages as pg


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.open = [], []
        self.part, self.row, self.cell = "tbody", None, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.open.append((a.get("id") or "", a.get("class") or "", []))
            self.tables.append(self.open[-1])
            self.part, self.row, self.cell = "tbody", None, None
        elif self.open and tag in ("thead", "tbody", "tfoot"):
            self.part = tag
        elif self.open and tag == "tr":
            self.row = [self.part, a.get("class") or "", []]
            self.open[-1][2].append(self.row)
        elif tag in ("td", "th") and self.row is not None:
            self.cell = [a.get("data-stat") or "", "", None, tag == "th"]
            self.row[2].append(self.cell)
        elif tag == "a" and self.cell is not None and self.cell[2] is None:
            self.cell[2] = a.get("href")

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()
            self.part, self.row, self.cell = "tbody", None, None
        elif tag in ("td", "th"):
            self.cell = None
        elif tag in ("thead", "tfoot"):
            self.part = "tbody"

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[1] += data


def plain(html):
    parser = Plain()
    parser.feed(html)
    parser.close()
    clean = lambda s: " ".join(s.replace("\xa0", " ").split())
    return [(i, c, [(p, k, [(n, clean(t), h, th) for n, t, h, th in cells]) for p, k, cells in rows]) for i, c, rows in parser.tables]


WORDS = ["Al Bo", "1 &lt; 2", "&amp;amp;", "AT&T", "caf&eacute;", "&#233;&#x1D11E;", "&nbsp;x", "a\n b\t", "<b>bold</b>", "<br/>", "x > y", "<i class='a>b'>q</i>", "", "5&nbsp;", "&bogus;", "'\"", "<!-- <td>no</td> -->", "é中", "<p>para</p>", "&apos;"]


def page(r):
    quote = lambda v: r.choice([f'"{v}"', f"'{v}'"] + ([v] if v.isalnum() else []))
    case = lambda t: r.choice([t, t.upper(), t])

    def cell():
        tag = case(r.choice(["td", "th", "td"]))
        attrs = "".join(r.choice(["", f" data-stat={quote(r.choice(['pts', 'a b', 'q']))}", f" class={quote('x > y')}", " hidden"]) for _ in range(2))
        link = r.choice(["", f"<a href={quote('/p/x.html?a=1&amp;b=2')} class=z>link</a>", "<a name=n>no</a>"])
        inner = table(1) if r.random() < 0.04 else ""
        return f"<{tag}{attrs}>{r.choice(WORDS)}{link}{r.choice(WORDS)}{inner}" + (f"</{tag}>" if not inner else f"</{tag}>")

    def row():
        return f"<{case('tr')}{r.choice(['', ' class=' + quote('thead')])}>" + "".join(cell() for _ in range(r.randrange(4))) + r.choice(["</tr>", "</tr>", ""])

    def table(depth=0):
        parts = "".join(f"<{p}>{''.join(row() for _ in range(r.randrange(3)))}</{p}>" for p in r.choice([[], ["tbody"], ["thead", "tbody"], ["thead", "tbody", "tfoot"]]))
        head = "".join(r.choice(["", f" id={quote('players')}", f" class={quote('datatable center')}"]) for _ in range(1))
        return f"<{case('table')}{head}>{parts}{''.join(row() for _ in range(r.randrange(3)))}</{case('table')}>"

    return "<html>" + "".join(r.choice(["text <td>stray</td>", "<p>x</p>", "<!-- <table><tr><td>z</td></tr></table> -->", ""]) + table() for _ in range(r.randrange(4))) + "</html>"


def test_tables_equal_a_tag_parser(spark):
    r = random.Random(7)
    pages = [(i, page(r)) for i in range(500)] + [(1000, None), (1001, "no"), (1002, "<table"), (1003, "<table>"), (1004, "<table><tr><td>open"), (1005, "</table><table></table>")]
    found = pg.tables(spark.createDataFrame(pages, "k int, html string").repartition(4)).collect()
    got = {}
    for x in sorted(found, key=lambda x: (x.k, x.table_no)):
        got.setdefault(x.k, []).append((x.table_id, x.table_classes, [(w.part, w.classes, [(c.name, c.text, c.href, c.header) for c in w.cells]) for w in x.table_rows]))
    want = {k: plain(t) for k, t in pages if t and plain(t)}
    different = [(dict(pages)[k], want.get(k), got.get(k)) for k in sorted(want.keys() | got.keys()) if want.get(k) != got.get(k) and k != 1002]
    assert not different, (len(different), *different[0])


def test_long_tables(spark):
    """Ten thousand rows, a cell of a megabyte, and no Python worker."""
    html = "<table id='big'>" + "".join(f"<tr><td data-stat='n'>{i}</td></tr>" for i in range(10_000)) + "<tr><td data-stat='n'>" + "z " * 500_000 + "</td></tr></table>"
    df = pg.tables(spark.createDataFrame([(html,)], "html string"))
    assert "Python" not in df._jdf.queryExecution().toString() and "MapInArrow" not in df._jdf.queryExecution().toString()
    rows = df.first().table_rows
    assert len(rows) == 10_001 and rows[9_999].cells[0].text == "9999" and len(rows[-1].cells[0].text) == 999_999


def test_unescaped(spark):
    texts = ["&amp;lt;", "&#65;&#x41;", "&#xD800;&#1114112;", "a & b &c", "&eacute;&bogus;&apos;", "", "&", "&&amp;&"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(pg.unescaped(F.col("t")).alias("u"))
    assert [x.u for x in df.collect()] == ["&lt;", "AA", "��", "a & b &c", "é&bogus;'", "", "&", "&&&"]


def test_page_facts(spark, tmp_path):
    """Titles keep what isn't a reference of markup; each page has its own facts, with its address twice or null."""
    import duckdb

    from stridecast.plans import catalog

    pages = [(1, "/?start=25", "<title>  a = &quot;b&quot;&nbsp; <i>c</i> &amp;lt; &lt;d&gt; </title> start=1 ?start=50"), (2, "/?start=25", "<title>two</title>?start=75"), (3, None, "<title>\n three \n</title>"), (4, "/4", None), (5, "/?start=99999999999", "?start=99999999999")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = catalog.queries()["page_facts"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert found.columns == ["page_id", "title", "current_start", "apparent_total"]
    assert sorted(tuple(r) for r in found.collect()) == sorted(con.execute(catalog.oracle_sql()["page_facts"]).fetchall())


@pytest.mark.parametrize("name", ["bio_pages", "injury_logs"])
def test_pages_are_dealt_out(spark, sf_dir, name):
    """A small file of customers is one part as it is read; pages are made and cut in as many as a shuffle has."""
    from stridecast.plans import catalog

    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD [c_custkey" in plan and "parquet" not in plan


def test_page_archives(spark, tmp_path):
    """Of an archive the pages that are new, changed or came late, each as it was archived last; none seen, all."""
    import os

    from stridecast.sources import tables as src

    path, at = str(tmp_path / "pages"), [1_700_000_000]

    def save(when=None, **pages):
        before = set(os.listdir(path)) if os.path.isdir(path) else set()
        src.archive_pages(spark.createDataFrame(list(pages.items()), "key string, text string").select("key", F.encode("text", "UTF-8").alias("content")).coalesce(1), path)
        at[0] += 10
        for f in set(os.listdir(path)) - before:
            os.utime(f"{path}/{f}", (when or at[0], when or at[0]))

    found = lambda seen: sorted((r.key, r.html) for r in src.changed_in_archive(spark, path, seen).collect())
    save(a="one", b="two", c="é")
    save(a="one", b="new")
    seen = src.seen_in_archive(spark, path).checkpoint() if spark.sparkContext.getCheckpointDir() else src.seen_in_archive(spark, path).localCheckpoint()
    assert {r.key: r.modified.timestamp() for r in seen.collect()} == {"a": at[0], "b": at[0], "c": at[0] - 10}
    assert found(seen) == [] and found(seen.limit(0)) == [("a", "one"), ("b", "new"), ("c", "é")]
    save(a="one", c="later", d="fresh")
    save(c="last")
    save(when=1_600_000_000, e="late")
    assert found(seen) == [("c", "last"), ("d", "fresh"), ("e", "late")]


def test_page_scan_makes_few_files(spark, sf_dir):
    """As many files as the pages have parts, not one for each page."""
    import os
    from urllib.parse import urlparse

    from stridecast.plans import catalog
    from stridecast.sources.shared import shared_folder

    folder = urlparse(shared_folder(spark)).path
    before = set(os.listdir(folder))
    assert catalog.queries()["page_scan"](spark, sf_dir).count() > 0
    made = [f"{d}/{x}" for n in set(os.listdir(folder)) - before if n.startswith("pages-") for d, _, names in os.walk(f"{folder}/{n}") for x in names if x.startswith("part-")]
    assert 0 < len(made) <= 2 * spark.read.parquet(f"{sf_dir}/pages.parquet").rdd.getNumPartitions()


def test_the_fold_is_made_once(spark):
    """Which table a part belongs to is told once a page, not again for a filter below."""
    plan = pg.tables(spark.createDataFrame([("<table>",)], "html string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1, plan[:2000]
