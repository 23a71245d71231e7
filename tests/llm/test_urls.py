"""URL rules against a plain reading, trees on what they can learn."""

import random
from urllib.parse import quote

from pavilion.llm import url_filter
from pavilion.llm.common import table

from .edge import rows, with_clashes

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def plain(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, None
    rest = url[at + 3:]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


ODD = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/x", "http://example.org/es", "http://notexample.org/es/", "http://example.org", "x://a.com/fr/#/de/",
       "http://a.com/de/?q=/fr/", "http://com/de/", "http://.com/de/", "http://Ä.com/de/é", "http://example.org/en/19", "http://example.org?x/es/", "http://a://b/c",
       "http://" + "a" * 5000 + ".com/fr/" + "1" * 50_000, "http://example.net/en/3\n/x"]


def test_table_and_odd_urls(spark):
    urls = [r["url"] for r in table(spark, "/root/testdata/sf0.01", "pages").collect()] + ODD + ODD[:3]
    pages = with_clashes(spark.createDataFrame([(i if i % 7 else None, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string"))
    found = rows(url_filter.judge(pages))
    want = sorted((*plain(u)[:3], ) for u in urls if plain(u)[3]) + [plain(u)[:3] for u in urls if not plain(u)[3]]
    assert sorted(map(str, want)) == sorted(str((r["host"], r["path"], r["rule"])) for r in found)
    verdicts = {(h, p): v for u in urls for h, p, _, v in [plain(u)] if v}
    assert all(r["verdict"] == verdicts.get((r["host"], r["path"]), r["verdict"]) for r in found)
    assert {r["verdict"] for r in found} <= {"allow", "block"} and all(0 <= r["score"] <= 1 for r in found)


def test_without_labels(spark):
    schema = "page_id long, url string, html string"
    assert url_filter.judge(spark.createDataFrame([], schema)).count() == 0
    one = url_filter.judge(spark.createDataFrame([(1, "http://x.net/", None)], schema))
    assert rows(one)[0]["verdict"] == "allow"
    blocked = url_filter.judge(spark.createDataFrame([(1, "http://a.com/de/", None), (2, "http://x.net/", None)], schema))
    assert [r["verdict"] for r in rows(blocked)] == ["block", "block"]


def test_trees_learn_lexical_features(spark):
    rng = random.Random(1)

    def clean():
        return "/" + "/".join(rng.choice(["news", "about", "story", "read"]) for _ in range(2))

    def spam():
        return "/" + "".join(rng.choice("0123456789") for _ in range(30)) + "?" + "&".join(f"p{i}={rng.random()}" for i in range(6))

    urls = [f"http://h{i}.org{clean()}" for i in range(150)] + [f"http://h{i}.com/de{spam()}" for i in range(150)]
    asked = [f"http://n{i}.net{clean()}" for i in range(40)] + [f"http://n{i}.net{spam()}" for i in range(40)]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls + asked)], "page_id long, url string, html string")
    found = {r["page_id"]: r["verdict"] for r in rows(url_filter.judge(pages))}
    right = sum(found[300 + i] == ("allow" if i < 40 else "block") for i in range(80))
    assert right >= 72
    assert found == {r["page_id"]: r["verdict"] for r in rows(url_filter.judge(pages))}


def test_unseen_hosts_are_judged_by_their_shape(spark):
    """Every host is new, a tenth of the labels is wrong: rates that held a URL's own label would be all that is learned."""
    rng = random.Random(8)

    def url(i, spam, zone, directory=""):
        path = "".join(rng.choice("0123456789") for _ in range(14)) if spam else rng.choice(["news/today", "about/us", "story/one"])
        return f"http://{''.join(rng.choice('abcdefgh') for _ in range(8))}{i}.{zone}/{directory}{path}" + ("?" + "&".join(f"k{j}={rng.randrange(99)}" for j in range(4)) if spam else "")

    rules = (url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "com", "/bad/"))
    urls = [url(i, (i % 2 == 1) != (rng.random() < 0.1), ("org", "com")[i % 2], ("", "bad/")[i % 2]) for i in range(800)]
    asked = [url(800 + i, i % 2 == 1, "net") for i in range(200)]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls + asked)], "page_id long, url string, html string")
    found = {r["page_id"]: r["verdict"] for r in rows(url_filter.judge(pages, rules))}
    assert sum(found[800 + i] == ("allow", "block")[i % 2] for i in range(200)) >= 190


def test_features_leave_out_what_rules_name(spark):
    rules = [url_filter.Rule("block", "a.com", "/x/y/1"), url_filter.Rule("allow", "org", "/"), url_filter.Rule("allow", "b.com", "/x/")]
    paths = {"/x/y/12/z": "/12/z", "/x/yy/1": "/yy/1", "/x/": "/", "/x": "/x", "": "", "/q/x/y/1": "/q/x/y/1"}
    df = spark.createDataFrame([(i, f"http://h.net{p}?a=1&b=2#/x/", None) for i, p in enumerate(paths)], "page_id long, url string, html string")
    host, path = url_filter.host_path(url_filter.F.col("url"))
    found = {r["page_id"]: r for r in url_filter.lexical(df.withColumns({"host": host, "path": path}), rules).collect()}
    for i, own in enumerate(paths.values()):
        assert found[i]["own"] == own and found[i]["counted"] == f"h.net{own}?a=1&b=2#/x/" and found[i]["parameters"] == 2


def test_statistics_and_labels_outside_the_sample(spark, monkeypatch):
    seen, folds, fitted = {}, {}, []
    plain_rates, plain_features = url_filter._rates, url_filter._features

    def rates(labelled, by, prior):
        out = plain_rates(labelled, by, prior)
        found = out.collect()
        seen[by] = {r[f"{by}_of"]: r[f"{by}_rates"][-1] for r in found}
        folds[by] = {(r[f"{by}_of"], k): rate for r in found for k, rate in enumerate(r[f"{by}_rates"][:-1])}
        return out

    def features(urls, *rest):
        fitted.append(urls)
        return plain_features(urls, *rest)

    monkeypatch.setattr(url_filter, "_rates", rates)
    monkeypatch.setattr(url_filter, "_features", features)
    urls = [f"http://h.d{i % 400}.org/s{i % 400}/{i}" for i in range(4000)] + ["http://same.org/x"] * 2000 + [f"http://q{i}.com/de/{i}" for i in range(3)]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert url_filter.judge(pages, sample=200).count() == len(urls)
    prior = 3 / len(urls)
    assert all(abs(seen["suffix"][f"d{k}.org"] - 5 * prior / 15) < 1e-12 for k in range(400))
    assert all(f"s{k}" in seen["directory"] for k in range(400)) and "de" not in seen["directory"]
    # a URL's own label is in none of the rates that it is learned with
    for i in range(3):
        own = {k: folds["directory"][str(i), k] for k in range(url_filter.FOLDS)}
        assert sum(abs(rate - prior) < 1e-12 for rate in own.values()) == 1 and seen["directory"][str(i)] > 0.1
    train = [(r["label"], r["url"]) for r in fitted[0].collect()]
    assert sum(label for label, _ in train) == 3 and len(train) < 200
    assert 0 < sum(u == "http://same.org/x" for _, u in train) < 100


def test_entropy(spark):
    texts = ["", "aaaa", "abab", "abcd", quote("ä%.*[")]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(url_filter.entropy(url_filter.F.col("t")))
    assert [round(r[0], 6) for r in df.collect()][:4] == [0.0, 0.0, 1.0, 2.0]
