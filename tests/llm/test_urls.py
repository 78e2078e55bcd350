from loomgraph.llm import urls

COLUMNS = "page_id bigint, url string, html string, verdict string, bin string"


def judged(spark, rows):
    df = spark.createDataFrame([(*r, None, "v", "b") for r in rows], COLUMNS)
    return {r.page_id: r for r in urls.judge(df).collect()}


def test_hosts_and_rules(spark):
    out = judged(
        spark,
        [
            (1, "http://A.Example.NET/en/x?q#f"), (2, "https://example.net"), (3, "x://badexample.com/de/"),
            (4, "x://www.example.com/de/1"), (5, "x://h.org/fr/"), (6, "x://org/fr/a"), (7, "no scheme"), (8, None),
            (9, "http://a.net/EN/"), (10, "a://b://c.net/x"), (11, "http://host?x=/y"), (12, "http://example.net/en"),
        ],
    )
    assert (out[1].host, out[1].path, out[1].rule, out[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (out[2].host, out[2].path, out[2].rule) == ("example.net", "", None)
    assert out[3].rule is None and (out[4].rule, out[4].verdict) == ("example.com/de/", "block")
    assert out[5].rule == out[6].rule == "org/fr/"
    assert (out[7].host, out[7].path, out[8].host, out[8].path) == ("", "", "", "")
    assert (out[9].rule, out[9].verdict) == ("net/", "block")
    assert (out[10].host, out[10].path) == ("b:", "//c.net/x")
    assert (out[11].host, out[11].path) == ("host", "")
    assert out[12].rule == "net/"


def test_models_tell_the_classes_apart(spark):
    rows = [(i, f"http://good{i}.example.net/en/story/{i}") for i in range(40)]
    rows += [(100 + i, f"http://casino{i}.net/win/now/{i}") for i in range(40)]
    rows += [(200 + i, f"http://good{i}.other.com/en/story/{i}") for i in range(5)]
    rows += [(300 + i, f"http://casino{i}.other.com/win/now/{i}") for i in range(5)]
    out = judged(spark, rows + rows[:3])
    assert {out[200 + i].verdict for i in range(5)} == {"allow"}
    assert {out[300 + i].verdict for i in range(5)} == {"block"}


def test_probabilities_sum_to_one(spark):
    """Over the characters seen after a context, smoothed mass plus the rest is one."""
    import math
    from collections import Counter

    df = spark.createDataFrame([("ab", "/x", "allow", 3, True), ("ba", "/y", "block", 1, True)], "host string, path string, verdict string, n bigint, train boolean")
    got = {r.gram: r.micros for r in urls.model(df).collect()}

    def probability(strings, gram):
        p = urls.UNIFORM
        for k in range(4):
            count, after = Counter(), {}
            for s, n in strings:
                for i in range(3, len(s)):
                    count[s[i - k : i + 1]] += n
                    after.setdefault(s[i - k : i], Counter())[s[i]] += n
            context, tail = gram[3 - k : 3], gram[3 - k :]
            if context in after:
                seen = after[context]
                p = (count[tail] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    a, r = [("\x02" * 3 + "ab/x\x03", 3)], [("\x02" * 3 + "ba/y\x03", 1)]
    for gram, micros in got.items():
        assert micros == round((math.log(probability(a, gram)) - math.log(probability(r, gram))) * 1e6)


def test_no_rows(spark):
    assert judged(spark, []) == {}
