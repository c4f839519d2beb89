import duckdb
import pytest

from stintlake.llm import license_scan, registry, url_filter

from .helpers import ODD, docs

RULES = "host string, path string, verdict string"


def test_urls(spark):
    urls = ["http://a.example.org/es/x", "https://EXAMPLE.org/en/12?q", "http://example.org/en/2", "ftp://b.com/de/#x", "x.com/fr/", None, "", "http://com/fr/a", "http://ab.com", "http://u@org/", "a://b://org/fr", "http://notexample.org/es/", "http://org?/", "http://x.org:80/", "http://w.org/\n/es/"]
    pages = spark.createDataFrame([(i % 12 if i else None, u, "z", "r") for i, u in enumerate(urls + urls[:2])], "page_id long, url string, html string, rule string")
    rules = spark.createDataFrame(list(url_filter.RULES), RULES)
    got = url_filter.judge(pages, rules).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    for r in pages.collect():
        con.execute("INSERT INTO pages VALUES (?, ?)", [r["page_id"], r["url"]])
    rel = con.sql(url_filter.ORACLE)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rel.fetchall()))
    assert {(r["verdict"], r["rule"]) for r in got if r["host"] == "a.example.org"} == {("block", "example.org/es/")}
    none = url_filter.judge(pages, spark.createDataFrame([], RULES)).collect()
    assert len(none) == len(got) and {r["verdict"] for r in none} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_wrapped_notices(spark, ends):
    import textwrap

    text = dict(license_scan.SENTENCES)
    mit = [text["mit-grant-whole"], text["mit-notice"], text["mit-as-is-whole"]]
    wrap = lambda parts, prefix="": "\n\n".join(textwrap.fill(p, 70, initial_indent=prefix, subsequent_indent=prefix) for p in parts)
    texts = {
        1: "Copyright 2020 Somebody\n\n" + wrap(mit),
        2: wrap([text["gpl-free"], text["gpl-warranty-whole"]]) + "\n\nMore.",
        3: "\n#\n".join(textwrap.fill(p, 60, initial_indent="# ", subsequent_indent="# ") for p in [text["apache-2-use"]]),
        4: "\n".join(mit),  # not wrapped: a match of the first cut alone
        5: wrap([mit[0], "Something else.", mit[1], mit[2]]),  # broken sequence
        6: wrap([text["gpl-2-free"] + " " + text["gpl-warranty-whole"]]),
        7: "\n\nLicensed under the MIT License.\n",
    }
    df = spark.createDataFrame([(d, t.replace("\n", ends)) for d, t in texts.items()] + [(8, None), (9, "")], "doc_id long, text string")
    s = spark.createDataFrame(list(license_scan.SENTENCES), "sid string, text string")
    r = spark.createDataFrame([(a, list(b)) for a, b in license_scan.RULES], "license string, sids array<string>")
    got = sorted(map(tuple, license_scan.scan(df, s, r).collect()))
    documents = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    assert got == sorted(con.sql(license_scan.ORACLE).fetchall())
    assert {(d, name, n, w) for d, name, _, n, w in got} == {(1, "MIT", 3, True), (2, "GPL-3.0-or-later", 2, True), (3, "Apache-2.0", 1, True), (4, "MIT", 3, False), (6, "GPL-2.0-or-later", 2, True), (7, "MIT", 1, False)}
    assert (1, "MIT", 1, 3, True) in got


def test_licences(spark):
    grant, as_is = (t for s, t in license_scan.SENTENCES if s in ("mit-grant", "mit-as-is"))
    short, you, copy = (t for s, t in license_scan.SENTENCES if s in ("apache-2-short", "apache-2-you", "apache-2-copy"))
    rows = ODD + [(20, f"Foo. {grant}\n{as_is} Bar."), (21, f"{grant} Something between. {as_is}"), (22, f"{short.upper()} {you.replace('You', 'Apache 2. You')}\n{copy}"), (23, f"x\n{short}\n{short}\n\n{you}  {copy}"), (None, short), (20, "Released  under, the MIT-License!")]
    df = docs(spark, rows)
    s = spark.createDataFrame(list(license_scan.SENTENCES), "sid string, text string")
    r = spark.createDataFrame([(a, list(b)) for a, b in license_scan.RULES], "license string, sids array<string>")
    got = license_scan.scan(df, s, r).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    for i, t in rows:
        con.execute("INSERT INTO documents VALUES (?, ?)", [i, t])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(license_scan.ORACLE).fetchall()))
    assert {(x["license"], x["n_sentences"]) for x in got if x["doc_id"] == 20} == {("MIT", 2), ("MIT", 1)}
    assert not [x for x in got if x["doc_id"] == 21]
    assert (23, "Apache-2.0", 2, 3) in {(x["doc_id"], x["license"], x["sentence"], x["n_sentences"]) for x in got}
    assert license_scan.scan(df.limit(0), s, r).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    assert sorted(str(tuple(r)) for r in got.select(columns).collect()) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
