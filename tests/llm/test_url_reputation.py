from pyspark.sql import functions as F

from annalist.llm import url_reputation as u

PAGES, LABELS = "page_id bigint, url string, host string", "doc_id bigint, quality int, toxic int, bad int"


def test_hosts_paths_and_rules(spark):
    urls = [
        ("http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
        ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
        ("http://a.com", "a.com", "", None, "allow"),
        ("http://a.com?x/y", "a.com", "", None, "allow"),
        ("no scheme.com/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://ÄA.org/é#", "Äa.org", "/é", None, "allow"),
        ("http://a.com/://b", "a.com", "/://b", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(i, r[0], "clash") for i, r in enumerate(urls)], PAGES)
    got = {r.page_id: r for r in u.judge(pages, spark.createDataFrame([], LABELS)).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)


def test_bad_host_is_blocked_and_clean_ones_stay(spark):
    pages = [(i, f"https://{'bad' if i % 3 == 0 else 'good' + str(i % 5)}.site{i % 3}.org/p", "") for i in range(300)]
    labels = [(i, 0 if i % 3 == 0 else 1, None, 5) for i in range(0, 300)] + [(0, None, None, 1), (None, 0, 1, 1)]
    got = u.judge(spark.createDataFrame(pages + [pages[0]], PAGES), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 301
    assert {r.verdict for r in got if r.host.startswith("bad")} == {"block"}
    assert {r.verdict for r in got if r.host.startswith("good")} == {"allow"}
    assert u.judge(spark.createDataFrame([], PAGES), spark.createDataFrame(labels, LABELS)).collect() == []


def test_domains_and_suffixes(spark):
    cases = {
        "a.foo.co.uk:8080": ("a.foo.co.uk", "foo.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk", "co.uk"),
        "xco.uk": ("xco.uk", "xco.uk", "uk"),
        "u:p@www.example.org.": ("www.example.org", "example.org", "org"),
        "u@1.2.3.4": ("1.2.3.4", "1.2.3.4", u.ADDRESS),
        "1.2.3.4:80": ("1.2.3.4", "1.2.3.4", u.ADDRESS),
        "[2001:db8::1]:443": ("[2001:db8::1]", "[2001:db8::1]", u.ADDRESS),
        "one.github.io": ("one.github.io", "one.github.io", "github.io"),
        "localhost": ("localhost", "localhost", "localhost"),
        "": ("", "", ""),
    }
    df = spark.createDataFrame([(h,) for h in cases], "host string").select("host", u.site(F.col("host")).alias("site"))
    got = {r.host: (r.site, r.domain, r.suffix) for r in df.select("host", "site", *[c.alias(n) for c, n in zip(u.domain_and_suffix(F.col("site")), ("domain", "suffix"))]).collect()}
    assert got == cases


def test_strangers_under_one_suffix_do_not_share_a_domain(spark):
    """Bad neighbours under co.uk move a clean unlabelled domain by its suffix only; a bad host's other ports are as bad."""
    pages = [(i, f"https://p.bad.co.uk/{i}") for i in range(100)] + [(100 + i, f"https://good{i}.co.uk/") for i in range(100)]
    pages += [(300, "https://p.bad.co.uk:8443/x"), (301, "https://new.bad.co.uk/x"), (302, "https://new.co.uk/x")]
    labels = [(i, 0, 1, 0) for i in range(100)] + [(100 + i, 1, 0, 0) for i in range(100)]
    got = {r.page_id: r for r in u.judge(spark.createDataFrame([(i, url, "") for i, url in pages], PAGES), spark.createDataFrame(labels, LABELS)).collect()}
    assert got[300].verdict == got[0].verdict == "block" and got[300].bad_rate == got[0].bad_rate
    assert got[301].bad_rate > 0.9 and got[302].bad_rate < 0.6 and got[302].verdict == "allow"
