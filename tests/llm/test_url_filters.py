from parley.llm.url_filters import judge_urls


def test_rules(spark):
    urls = {
        1: ("http://Blog.Example.COM/en/7?x#y", "blog.example.com", "/en/7", "example.com/en/", "block"),
        2: ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        3: ("https://a.www.example.com/en/x", "a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        4: ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        5: ("http://xnet/es/1", "xnet", "/es/1", None, "allow"),
        6: ("http://my-example.com/en/1", "my-example.com", "/en/1", "com/", "allow"),
        7: ("ftp://com", "com", "", None, "allow"),
        8: ("com/en/", "", "", None, "allow"),
        9: (None, "", "", None, "allow"),
        10: ("a://b.com?q=/en/#c", "b.com", "", None, "allow"),
        11: ("a://b.org/x://y/z#c", "b.org", "/x://y/z", None, "allow"),
    }
    rows = spark.createDataFrame([(i, u[0]) for i, u in urls.items()], "page_id long, url string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(rows).collect()}
    assert found == {i: u[1:] for i, u in urls.items()}


def test_templates_block_what_rules_do_not_reach(spark):
    rows = [f"http://s.org/bad/{k}/a" for k in range(60)] + ["http://s.org/bad"] + [f"http://s.org/ok/{k}" for k in range(60)]
    rows += [f"http://s.org/worse/{k}" for k in range(60)] + ["http://s.org/worse", "http://s.org/other/1", "http://t.org/bad"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    rules = (("block", "s.org/bad/"), ("allow", "s.org/ok/"), ("block", "s.org/worse/"))
    found = {rows[r.page_id]: r for r in judge_urls(pages, rules).collect()}
    assert found["http://s.org/bad"].verdict == "block" and found["http://s.org/bad"].rule is None
    assert found["http://s.org/bad"].template == "/(bad|worse)" == found["http://s.org/worse"].template
    assert found["http://s.org/bad/7/a"].template == "/(bad|worse)/<number>/a"
    assert found["http://s.org/other/1"].verdict == "allow" and found["http://t.org/bad"].verdict == "allow"
    assert found["http://s.org/ok/3"].purity > 0.9


def test_odd_rows(spark):
    pages = spark.createDataFrame([(None, "x://y.com/"), (1, ""), (1, ""), (2, "://" + "/a" * 5000)], "page_id long, url string")
    rows = judge_urls(pages.selectExpr("*", "1 as host", "2 as n", "3 as segment", "4 as found")).collect()
    assert len(rows) == 4 and {r.verdict for r in rows} == {"allow"}
    assert judge_urls(pages.limit(0)).count() == 0


def test_pages_without_a_template_fall_back(spark):
    rows = [f"http://a.x.org/bad/{k}" for k in range(60)] + ["http://a.x.org/new/1", "http://b.x.org/bad/77", "http://b.y.org/bad/1"]
    rows += [f"http://c.z.org/1/2/3/4/{'ok' if k % 2 else 'bad'}/{k}" for k in range(120)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    rules = (("block", "a.x.org/bad/"), ("allow", "c.z.org/1/2/3/4/ok/"), ("block", "c.z.org/1/2/3/4/bad/"))
    found = {rows[r.page_id]: r for r in judge_urls(pages, rules).collect()}
    assert (found["http://a.x.org/new/1"].template, found["http://a.x.org/new/1"].verdict) == ("/", "block")
    assert (found["http://b.x.org/bad/77"].template, found["http://b.x.org/bad/77"].verdict) == ("*.x.org/bad/<number>", "block")
    assert (found["http://b.y.org/bad/1"].template, found["http://b.y.org/bad/1"].verdict) == (None, "allow")
    assert found["http://c.z.org/1/2/3/4/ok/1"].template.startswith("/<number>/<number>/<number>/<number>/ok")
