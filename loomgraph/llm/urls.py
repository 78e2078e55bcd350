"""URL filter by the ratio of two character language models.

Rules (host and path prefix, allow or block) judge the urls they fit, the longest
rule first.  All others are judged by method: the urls that rules accept and
those that rules reject train one variable-order Markov model each, over the
characters of host and path: contexts of up to ``ORDER`` characters, smoothed by
interpolation with the next shorter context (Witten-Bell), down to a uniform
distribution.  A url's score is the difference of its log-likelihoods divided
by its length.  The cut is calibrated on ruled urls of hosts kept out of the
training (a quarter by md5): the cut with the best sum of the shares judged
right in either class.

Everything is DataFrame expressions.  Urls are folded to distinct (host, path)
with their counts first, so a hot url is scored once.  Counts of n-grams are
combined before the shuffle.  The model is one row per n-gram that occurs; it is
stored, counted, and broadcast only up to ``MAX_BROADCAST_GRAMS`` rows (a gram
is five characters at most), beyond that it is joined by shuffle with AQE's skew
handling.  Log-ratios are whole millionths, so sums do not depend on order.

Defined cases: a null url or one without ``://`` has empty host and path, fits
no rule and is scored as the empty string; an empty table gives an empty result;
without accepted or without rejected urls the missing model is uniform and the
cut is 0; rows that repeat a page_id are judged by their own url.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import settle

ORDER = 3
UNIFORM = 1 / 256
MAX_BROADCAST_GRAMS = 200_000
HELD_OUT = ("0", "1", "2", "3")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    clean = F.coalesce(url, F.lit(""))
    at = F.instr(clean, "://")
    rest = F.when(at > 0, F.substring(clean, at + 3, F.length(clean))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(clean)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # later ones win
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def grams(urls: DataFrame) -> DataFrame:
    """One row per character (and the end) of host and path, with its ``ORDER`` predecessors."""
    spelled = F.concat(F.lit("\x02" * ORDER), "host", "path", F.lit("\x03"))
    return (
        urls.withColumn("_s", spelled)
        .withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("_s") - ORDER)))
        .withColumn("gram", F.substring("_s", F.col("_i"), F.lit(ORDER + 1)))
        .drop("_s", "_i")
    )


def model(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, micros): millionths of ln P(accepted) - ln P(rejected) for every n-gram of ``urls``.

    ``urls``: host, path, verdict, n (how often), train.
    """
    weight = lambda v: F.sum(F.when(F.col("train") & (F.col("verdict") == v), F.col("n")).otherwise(0))
    counts = settle(grams(urls).groupBy("gram").agg(weight("allow").alias("a"), weight("block").alias("r")))
    probabilities = counts.select("gram", F.lit(UNIFORM).alias("pa"), F.lit(UNIFORM).alias("pr"))
    for k in range(order + 1):
        tail = F.substring("gram", order + 1 - k, k + 1)
        c = counts.groupBy(tail.alias("tail")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        context = F.substring("tail", 1, k)
        n = c.groupBy(context.alias("context")).agg(
            F.sum("ca").alias("na"), F.sum("cr").alias("nr"),
            F.sum((F.col("ca") > 0).cast("bigint")).alias("ta"), F.sum((F.col("cr") > 0).cast("bigint")).alias("tr"),
        )
        level = settle(c.join(settle(n), context == F.col("context")).drop("context"))
        blend = lambda x: (
            F.when(F.col(f"n{x}") > 0, (F.col(f"c{x}") + F.col(f"t{x}") * F.col(f"p{x}")) / (F.col(f"n{x}") + F.col(f"t{x}")))
            .otherwise(F.col(f"p{x}"))
        )
        probabilities = probabilities.join(level, tail == F.col("tail")).select(
            "gram", blend("a").alias("pa"), blend("r").alias("pr")
        )
    return probabilities.select("gram", F.round((F.log("pa") - F.log("pr")) * 1_000_000).cast("bigint").alias("micros"))


def scores(urls: DataFrame, grams_model: DataFrame) -> DataFrame:
    """(host, path, bin): the length-normalised difference in hundredths, rounded down."""
    small = grams_model.count() <= MAX_BROADCAST_GRAMS
    side = F.broadcast(grams_model) if small else grams_model
    return (
        grams(urls.select("host", "path"))
        .join(side, "gram")
        .groupBy("host", "path")
        .agg(F.sum("micros").alias("s"), F.count(F.lit(1)).alias("length"))
        .select("host", "path", F.floor(F.col("s") / (F.col("length") * 10_000)).cast("bigint").alias("bin"))
    )


def best_cut(histogram: list[tuple[int, int, int]]) -> int:
    """The cut with the best sum of shares; rows are (bin, accepted, rejected).

    Every cut above one occurring bin and up to the next is equally good: the
    middle of that gap is taken, of several best gaps the lowest.
    """
    accepted, rejected = sum(h[1] for h in histogram), sum(h[2] for h in histogram)
    if not accepted or not rejected:
        return 0
    best, cut, below, previous = -1, 0, 0, None
    at_least = accepted
    for b, a, r in sorted(histogram):
        value = at_least * rejected + below * accepted
        if value > best:
            best = value
            cut = b if previous is None else previous + 1 + (b - previous - 1) // 2
        at_least, below, previous = at_least - a, below + r, b
    return cut


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    urls = settle(
        parts.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"rule": rule, "verdict": verdict, "train": ~F.substring(F.md5(F.col("host")), 1, 1).isin(*HELD_OUT)})
    )
    scored = settle(urls.join(scores(urls, settle(model(urls))), ["host", "path"]))
    share = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0))
    judged = scored.where("verdict IS NOT NULL AND NOT train").groupBy("bin").agg(share("allow"), share("block"))
    cut = best_cut([tuple(r) for r in judged.collect()])  # one row per bin of a bounded score
    by_model = F.when(F.col("bin") >= cut, "allow").otherwise("block")
    known = scored.select("host", "path", "rule", F.coalesce("verdict", by_model).alias("verdict"))
    return parts.join(known, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH u0 AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
u1 AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u0),
u2 AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM u1),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM u2),
u AS (SELECT host, path, n, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict,
        rule, substr(md5(host), 1, 1) NOT IN ('0', '1', '2', '3') AS train
      FROM (SELECT host, path, count(*) AS n, CASE
        WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
        FROM p GROUP BY host, path)),
s AS (SELECT host, path, n, verdict, train, repeat(chr(2), 3) || host || path || chr(3) AS s FROM u),
g AS (SELECT host, path, n, verdict, train, substr(s, i, 4) AS gram FROM (SELECT *, unnest(range(1, length(s) - 2)) AS i FROM s)),
c AS (SELECT gram, sum(CASE WHEN train AND verdict = 'allow' THEN n ELSE 0 END) AS a,
        sum(CASE WHEN train AND verdict = 'block' THEN n ELSE 0 END) AS r FROM g GROUP BY gram),
k AS (SELECT k, substr(gram, 4 - k, k + 1) AS tail, sum(a) AS a, sum(r) AS r FROM c, range(4) t(k) GROUP BY ALL),
m AS (SELECT k, substr(tail, 1, k) AS ctx, sum(a) AS na, sum(r) AS nr,
        count(CASE WHEN a > 0 THEN 1 END) AS ta, count(CASE WHEN r > 0 THEN 1 END) AS tr FROM k GROUP BY ALL),
l AS (SELECT k.k, tail, a, r, na, nr, ta, tr FROM k JOIN m ON k.k = m.k AND substr(tail, 1, k.k) = ctx),
q0 AS (SELECT gram, CASE WHEN na > 0 THEN (a + ta * CAST(1 / 256.0 AS DOUBLE)) / (na + ta) ELSE CAST(1 / 256.0 AS DOUBLE) END AS pa,
         CASE WHEN nr > 0 THEN (r + tr * CAST(1 / 256.0 AS DOUBLE)) / (nr + tr) ELSE CAST(1 / 256.0 AS DOUBLE) END AS pr
       FROM (SELECT gram FROM c) JOIN l ON k = 0 AND tail = substr(gram, 4, 1)),
q1 AS (SELECT gram, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa,
         CASE WHEN nr > 0 THEN (r + tr * pr) / (nr + tr) ELSE pr END AS pr FROM q0 JOIN l ON k = 1 AND tail = substr(gram, 3, 2)),
q2 AS (SELECT gram, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa,
         CASE WHEN nr > 0 THEN (r + tr * pr) / (nr + tr) ELSE pr END AS pr FROM q1 JOIN l ON k = 2 AND tail = substr(gram, 2, 3)),
q3 AS (SELECT gram, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa,
         CASE WHEN nr > 0 THEN (r + tr * pr) / (nr + tr) ELSE pr END AS pr FROM q2 JOIN l ON k = 3 AND tail = gram),
w AS (SELECT gram, CAST(round((ln(pa) - ln(pr)) * 1000000) AS BIGINT) AS micros FROM q3),
b AS (SELECT host, path, any_value(n) AS n, any_value(verdict) AS verdict, any_value(train) AS train,
        CAST(floor(sum(micros) / (count(*) * 10000.0)) AS BIGINT) AS bin FROM g JOIN w USING (gram) GROUP BY host, path),
h AS (SELECT bin, sum(CASE WHEN verdict = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN verdict = 'block' THEN n ELSE 0 END) AS r
      FROM b WHERE verdict IS NOT NULL AND NOT train GROUP BY bin),
v AS (SELECT bin, (sum(a) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) * (sum(r) OVER ())
        + coalesce(sum(r) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * (sum(a) OVER ()) AS value,
        sum(a) OVER () AS na, sum(r) OVER () AS nr, lag(bin) OVER (ORDER BY bin) AS previous FROM h),
t AS (SELECT coalesce((SELECT coalesce(previous + 1 + (bin - previous - 1) // 2, bin) FROM v WHERE na > 0 AND nr > 0 ORDER BY value DESC, bin LIMIT 1), 0) AS cut)
SELECT page_id, p.host, p.path, u.rule,
  coalesce(u.verdict, CASE WHEN b.bin >= (SELECT cut FROM t) THEN 'allow' ELSE 'block' END) AS verdict
FROM p JOIN u ON p.host = u.host AND p.path = u.path JOIN b ON p.host = b.host AND p.path = b.path
"""
