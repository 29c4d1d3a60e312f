import random
import re

from llm_helpers import SF, read
from threadloom.llm import url_rules
from threadloom.llm.queries import QUERIES, URL_RULES


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return (host, path, best and best[2] + best[3], best[4] if best else default)


def test_query(spark):
    pages = dict(read(f"select page_id, url from '{SF}/pages.parquet'"))
    got = {r.page_id: tuple(r)[1:] for r in QUERIES["op9_range_join"](spark, SF).collect()}
    assert got == {p: brute(u, URL_RULES) for p, u in pages.items()}


def test_nested_rules_and_a_hot_host(spark):
    r = random.Random(4)
    labels, paths = ["a", "b", "net", "x-y", "a.b"], ["/", "/p/", "/p/q", "/p/q/r", "", "/é"]
    rules = sorted({(".".join(r.choice(labels) for _ in range(r.randint(1, 4))), r.choice(paths), r.choice(["block", "allow"])) for _ in range(60)})
    urls = [f"http{r.choice(['', 's'])}://" + ".".join(r.choice(labels).upper() for _ in range(r.randint(1, 5))) + r.choice(paths) + r.choice(["", "z?x=/p/", "#/"]) for _ in range(600)]
    urls += ["http://a.b.net/p/q/r"] * 400
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    chosen = {}
    for h, p, v in rules:
        chosen[h, p] = max(v, chosen.get((h, p), ""))
    flat = [(h, p, v) for (h, p), v in chosen.items()]
    got = {x.page_id: tuple(x)[1:] for x in url_rules.judge_urls(pages, spark.createDataFrame(rules, url_rules.RULES)).collect()}
    assert got == {i: brute(u, flat) for i, u in enumerate(urls)}


def test_odd_rows(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://X.Net", "http://x.net/", "http://x.net?/", "http://.net/", "http://é.net/" + "y" * 100_000, "a://b://c.net/"]
    rows = [(i, u, "r", "h", "v") for i, u in enumerate(urls)] + [(None, "http://x.net/", "r", "h", "v")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, host string, verdict string")
    rules = [("net", "/", "block"), (None, "/", "block"), ("net", None, "allow"), ("net", "/", "allow"), ("net", "/", None)]
    got = url_rules.judge_urls(pages, spark.createDataFrame(rules, url_rules.RULES)).collect()
    assert len(got) == len(rows)
    assert {x.page_id: tuple(x)[1:] for x in got if x.page_id is not None} == {i: brute(u, [("net", "/", "block")]) for i, u in enumerate(urls)}
    none = spark.createDataFrame([], url_rules.RULES)
    assert {x.verdict for x in url_rules.judge_urls(pages, none).collect()} == {"allow"}
    assert url_rules.judge_urls(pages.limit(0), spark.createDataFrame(rules, url_rules.RULES)).count() == 0
