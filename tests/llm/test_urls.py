"""Rules against brute force; every unruled URL gets a verdict."""

import re

from gradeframe.llm.url_filter import RULES, judge_urls

URLS = [None, "", "no scheme", "http://a.com", "http://A.Com/x", "https://example.com/en/1", "http://www.example.com/en/",
        "http://b.example.com/en/3?q=1", "http://x.net/es/9#t", "http://x.net/fr/", "http://x.net/de/1", "http://y.org/a?b=c&d=e",
        "http://notcom/x", "http://scom/", "ftp://q.org?x://y/z"] + [f"http://h{i}.net/es/{i}" for i in range(20)]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, rate string")
    rows = judge_urls(df, trees=2).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", URLS[r.page_id] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for v, h, p in RULES if ("." + host).endswith("." + h) and path.startswith(p)]
        best = max(fit, default=(0, None, None))
        assert (r.host, r.path, r.rule) == (host, path, best[1])
        assert r.verdict in ("allow", "block") and (not fit or r.verdict == best[2])
