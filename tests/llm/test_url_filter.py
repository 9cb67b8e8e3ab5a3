"""URL filter: against its statement in DuckDB on random and odd tables, and on trees whose result is known."""

import random

import duckdb
import pytest

from murmur.llm import url_filter as uf

PAGES = "page_id long, url string, html string, host string, n long, node string, shape string"
LABELS = "doc_id long, quality int, toxic int"


def both(spark, tmp_path, pages, labels):
    spark.createDataFrame([(*p, "", "h", 1, "x", "y") for p in pages], PAGES).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, LABELS).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    got = uf.op12_url_filter(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.sql(uf.ORACLE)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == sorted(want.select(*(f'"{c}"' for c in got.columns)).fetchall(), key=repr)
    return rows


def test_random_trees(spark, tmp_path):
    r = random.Random(3)
    words = ["en", "de", "tag", "a1", "x|y", "*", "{n}", "é", "user-77.html"] + [f"slug{chr(97 + i)}" for i in range(20)]
    urls = ["http://" + r.choice(["A.com", "b.example.net", "www.example.com", "c.org", "net"]) + "".join("/" + r.choice(words[: r.choice([3, 9, 29])]) for _ in range(r.randrange(9))) + r.choice(["", "/", "?q=://x/", "#f"]) for _ in range(900)]
    pages = [(r.choice([i, i % 7, None]), u) for i, u in enumerate(urls)]
    labels = [(r.randrange(900), r.choice([0, 1, 1, None]), r.choice([0, 0, 1, None])) for _ in range(600)]
    rows = both(spark, tmp_path, pages, labels)
    assert len(rows) == 900 and {x[-1] for x in rows} == {"allow", "block"}


def test_odd_and_empty_tables(spark, tmp_path):
    odd = [(None, None), (1, ""), (1, "no host/path"), (2, "://"), (2, "://"), (3, "http://h"), (4, "http:///only/path"), (5, "x://H?a/b"), (6, "x://h#/c"),
           (7, "http://h/" + "a/" * 40_000), (8, "http://h/" + "b" * 200_000 + "/c"), (9, "http://h//en///1"), (10, "http://h/\n/\u00e9?\n"), (None, "a\nb://h/x")]
    rows = {(x[0], x[1], x[2]): x for x in both(spark, tmp_path, odd, [(None, 0, 1), (1, None, None), (5, 0, 0), (5, 1, 1)])}
    assert len(rows) == 12  # two pairs of rows are equal
    assert rows[7, "h", "/" + "a/" * 40_000][4] == "/*" * 7  # six segments and the rest
    assert rows[4, "", "/only/path"][3] is None and rows[5, "h", ""][4] == ""
    assert both(spark, tmp_path, [], []) == [] and len(both(spark, tmp_path, odd, [])) == len(odd)


@pytest.mark.parametrize("url,rule,verdict", [
    ("http://net/", "net/", "block"), ("http://a.b.net/x", "net/", "block"), ("http://anet/x", None, None), ("http://net", None, None),
    ("http://EXAMPLE.net/en/1", "example.net/en/", "allow"), ("http://example.net/EN/1", "net/", "block"), ("http://x.example.net/en", "net/", "block"),
    ("http://example.com/de/", "example.com/de/", "block"), ("http://example.com/deu", None, None), ("ftp://q.org/fr/?://net/", "org/fr/", "allow")])
def test_rules(spark, url, rule, verdict):
    from pyspark.sql import functions as F

    host, path = uf.host_and_path(F.lit(url))
    name, found = uf.rule_of(host, path, uf.RULES)
    assert tuple(spark.range(1).select(name, found).first()) == (rule, verdict)


def known(spark, counts):
    """Templates by (host, shape) for ``{shape: (pages, good, bad)}`` of one host."""
    rows = spark.createDataFrame([("h", s, *c) for s, c in counts.items()], "host string, shape string, n long, good long, bad long")
    return {r["shape"]: (r["template"], round(r["purity"], 3)) for r in uf.templates(rows).collect()}


def test_rare_children_share_the_wildcard_and_similar_siblings_merge(spark):
    got = known(spark, {"en/{n}": (100, 50, 1), "de/{n}": (80, 40, 1), "spam/{n}": (100, 2, 60), "q1": (1, 0, 0), "q2": (1, 0, 0)})
    assert got["en/{n}"][0] == got["de/{n}"][0] == "/(de|en)/{n}" and got["spam/{n}"][0] == "/spam/{n}"
    assert got["q1"][0] == got["q2"][0] == "/*"
    assert got["spam/{n}"][1] > uf.REJECT > got["en/{n}"][1]


def test_smoothing_keeps_a_template_with_one_bad_label(spark):
    one, many = ({"good/{n}": (100, 60, 0), "odd": (20, 0, n)} for n in (1, 20))
    assert known(spark, one)["odd"][1] < uf.REJECT < known(spark, many)["odd"][1]


def test_siblings_that_end_differ_from_those_that_go_on(spark):
    got = known(spark, {"a": (50, 0, 0), "b/{n}": (50, 0, 0), "c/{n}": (50, 0, 0)})
    assert got["a"][0] == "/a" and got["b/{n}"][0] == got["c/{n}"][0] == "/(b|c)/{n}"
