import duckdb
import pytest

from docveil.llm import urls


def judged(spark, rows, rules=urls.RULES):
    df = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, host string")
    return {r.page_id: r for r in urls.judge(df, rules).collect()}


def test_parts_and_rules(spark):
    cases = [
        ("https://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("http://example.com/en", "example.com", "/en", "com/", "allow"),
        ("http://xexample.com/en/", "xexample.com", "/en/", "com/", "allow"),
        ("http://b.net/fr/", "b.net", "/fr/", "net/fr/", "block"),
        ("http://b.net?u=http://c.com/", "b.net", "", None, "allow"),
        ("http://b.net#/es/", "b.net", "", None, "allow"),
        ("no scheme.com/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("x://y://z/es/", "y:", "//z/es/", None, "allow"),
        ("http://É.COM/", "É.com", "/", "com/", "allow"),
    ]
    out = judged(spark, [(i, c[0]) for i, c in enumerate(cases)])
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, rule, verdict)


def test_tree(spark):
    rules = [("h", "/spam/", "block"), ("h", "/junk/", "block"), ("h", "/news/", "allow"), ("h", "/shop/x", "block")]
    rows = [f"http://h/{s}/{i}" for s in ("spam", "junk", "news", "talk") for i in range(30 + len(s) % 3)]
    rows += [f"http://h/shop/{'x' if i < 25 else 'y'}{i}" for i in range(30)] + [f"http://h/p{i}/a/b/c/d" for i in range(20)]
    out = judged(spark, list(enumerate(rows)), rules)
    by = {rows[k]: (v.template, v.verdict) for k, v in out.items()}
    assert by["http://h/spam/3"][0] == by["http://h/junk/4"][0] != by["http://h/news/5"][0]
    assert by["http://h/talk/5"] == ("/talk/*", "allow")
    assert by["http://h/shop/y26"] == ("/shop/*", "block")
    assert by["http://h/p4/a/b/c/d"] == ("/*/a/b/c/d", "allow")


def test_many_sections(spark):
    """Sections without labels are not judged by those with labels, however many siblings there are."""
    rows = [f"http://x.net/{s}/{i}" for s in ["es", "fr", *(f"l{k}" for k in range(40))] for i in range(12)]
    out = judged(spark, list(enumerate(rows)))
    assert {rows[k].split("/")[3] for k, v in out.items() if v.verdict == "block"} == {"es", "fr"}


def test_deep_branch(spark):
    """A branch below many levels is judged by itself; a long path of one page alone is one wildcard."""
    deep = "/a/b/c/d/e/f"
    rules = [("h", f"{deep}/bad/x", "block"), ("h", f"{deep}/good/x", "allow")]
    rows = [f"http://h{deep}/{s}/{'x' if i < 20 else 'y'}{i}" for s in ("bad", "good") for i in range(30)] + ["http://h/" + "z/" * 3000]
    out = judged(spark, list(enumerate(rows + rows[:1])), rules)
    by = {rows[k]: (v.template, v.verdict) for k, v in out.items() if k < len(rows)}
    assert by[f"http://h{deep}/bad/y25"] == (f"{deep}/bad/*", "block")
    assert by[f"http://h{deep}/good/y25"] == (f"{deep}/good/*", "allow")
    assert by[rows[-1]] == ("/*/**", "allow")
    assert out[len(rows)][1:] == out[0][1:]


def test_siblings_merge_by_evidence(spark):
    """Sections whose shares of blocked pages differ are templates of their own, however alike all others are; those that do not
    differ are one."""
    rules = [("h", f"/{s}/b", "block") for s in "abcdef"] + [("h", f"/{s}/g", "allow") for s in "abcdef"]
    blocked = {"a": 400, "b": 240, "c": 236, "d": 150, "e": 2, "f": 0}
    rows = [f"http://h/{s}/{'b' if i < n else 'g'}{i}" for s, n in blocked.items() for i in range(400)]
    rows += [f"http://h/{s}/{'b' if i < 4 else 'g'}{i}" for s in ("g", "i") for i in range(9)] + [None, "http://h/" + "y" * 200000]
    df = spark.createDataFrame([(k if k else None, u) for k, u in enumerate(rows)], "page_id long, url string")
    out = {(r.path.split("/")[1], r.template) for r in urls.judge(df, rules).collect() if r.path and len(r.path) < 100}
    of = {s: t for s, t in out if s in "abcdef"}
    assert len(out) == 8 and of["b"] == of["c"] and of["e"] == of["f"] and len(set(of.values())) == 4
    assert urls.judge(df, rules).count() == len(rows)


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_oracle(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '/root/testdata/{sf}/pages.parquet'")
    want = sorted(con.sql(f"SELECT page_id, host, path, rule, verdict, template FROM ({urls.oracle()})").fetchall(), key=str)
    assert sorted(map(tuple, urls.op4(spark, f"/root/testdata/{sf}").collect()), key=str) == want
