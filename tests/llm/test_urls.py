import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nodetide.llm import urls as U

RULES = (U.Rule("org/", "allow"), U.Rule("example.org/es/", "block"), U.Rule("example.org/en/1", "block"), U.Rule("com/fr/", "allow"), U.Rule("com/de/", "block"))


def plain(url):
    """(host, path, rule, verdict of the rule)."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[:min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


ODD = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/1", "https://example.org", "https://org/x", "ftp://a.b.Example.org/en/12?q=/es/", "x://y://z/en", "http://notexample.org/es/",
       "http://example.org?/es/", "http://example.org#/es/", "https://É.example.com/de/ü", "a://com/fr/", "http://borg/es/", "http://h\nx.org/a\nb?c", "http://example.org/es/" + "a" * 200_000]


def table(spark, extra=()):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        host = rng.choice(["www", "blog", "spam-farm9"]) + rng.choice([".example.org", ".example.com", ".example.net", ".org"])
        rows.append((i, f"http{rng.choice(['', 's'])}://{host}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randrange(3000)}{rng.choice(['', '?a=1&b=2', '#x', '.html'])}"))
    rows += [(1000 + i, u) for i, u in enumerate(ODD)] + [(0, rows[0][1]), (None, rows[1][1]), *extra]
    return rows, spark.createDataFrame([(*r, "<p>", 3.0) for r in rows], "page_id long, url string, path string, n double")


def test_rules_and_parts(spark):
    rows, df = table(spark)
    got = U.judge(df, U.UrlConfig(RULES)).collect()
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in got) == sorted((str(i), *plain(u)[:2], str(plain(u)[2])) for i, u in rows)
    by = {r.page_id: r for r in got}
    for i, u in rows:
        if i is not None and plain(u)[3]:
            assert by[i].verdict == plain(u)[3]
    assert {r.verdict for r in got} == {"allow", "block"} and all(0 <= r.block_score <= 1 for r in got)


def test_features(spark):
    u = "https://a-b.example.com/en/12/x%20y?p=1&q=22#z"
    made = spark.createDataFrame([(u,), ("",)], "url string").select(*[v.alias(k) for k, v in U.lexical(F.col("url"), U.host_of(F.col("url")), U.path_of(F.col("url"))).items()]).collect()
    counts = Counter(u)
    assert abs(made[0].entropy + sum(n / len(u) * math.log2(n / len(u)) for n in counts.values())) < 1e-9
    assert (made[0].depth, made[0].labels, made[0].parameters, made[0].hyphens, made[0].escapes, made[0].has_fragment, made[0].is_secure) == (3, 3, 2, 1, 1, 1, 1)
    assert abs(made[0].digit_ratio - sum(c.isdigit() for c in u) / len(u)) < 1e-12 and made[1].entropy == 0 and made[1].digit_ratio == 0


def test_trees_learn_from_decided_urls(spark):
    """Blocked urls are long and full of digits: others like them are blocked too."""
    rng = random.Random(1)
    rules = (U.Rule("bad.test/", "block"), U.Rule("good.test/", "allow"))
    rows = []
    for i in range(400):
        ugly = i % 2
        tail = "".join(rng.choice("0123456789") for _ in range(40)) if ugly else "page"
        rows.append((i, f"http://{rng.choice(['bad.test' if ugly else 'good.test', 'other.net'])}/{tail}", ugly))
    df = spark.createDataFrame(rows, "page_id long, url string, ugly int")
    got = {r.page_id: r for r in U.judge(df, U.UrlConfig(rules)).collect()}
    open_ = [(got[i].verdict == "block") == bool(ugly) for i, u, ugly in rows if "other.net" in u]
    assert sum(open_) >= 0.95 * len(open_) > 50


@pytest.mark.parametrize("rules,verdict", [((), "allow"), ((U.Rule("org/", "allow"),), "allow"), ((U.Rule("org/", "block"),), "block")])
def test_nothing_to_learn_from(spark, rules, verdict):
    _, df = table(spark)
    assert {r.verdict for r in U.judge(df, U.UrlConfig(rules)).collect()} == {verdict}
    assert U.judge(df.limit(0), U.UrlConfig(rules)).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    U.judge(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), U.UrlConfig(RULES)).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_rare_class_is_in_the_sample(spark):
    rules = (U.Rule("good.org/", "allow"), U.Rule("bad.com/", "block"))
    seen = [f"https://good.org/a{i}" for i in range(1500) for _ in range(2)]
    seen += [f"http://bad.com/{'x' * 60}-{i}?q=1&r=2" for i in range(3)]
    seen += [f"http://other.com/{'x' * 60}-9?q=1&r=2", "https://other.org/a7"]
    pages = spark.createDataFrame(list(enumerate(seen)), "page_id long, url string")
    got = {r.page_id: r for r in U.judge(pages, U.UrlConfig(rules=rules, train_rows=40)).collect()}
    assert got[len(seen) - 2].block_score > got[len(seen) - 1].block_score
