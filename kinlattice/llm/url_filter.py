"""URL filters: host and path rules, and for URLs without a rule two character language models.

Both models are smoothed variable-order Markov models (a context that was seen little backs off, by
Witten-Bell interpolation, to its shorter one), one of accepted and one of rejected URLs. A URL is
judged by the difference of its log-likelihoods per character against a calibrated bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, Shelf, spread_join, table

#: Fixed rules: (host, start of the path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
ORDER = 5
#: One part in so many, by digest, of the labelled URLs calibrates the bound and trains nothing.
CALIBRATE = 5
#: Distinct n-grams of at most ORDER characters in a broadcast table (about 40 bytes each); more are taken in blocks.
BROADCAST_ROWS = 500_000
START, END = "\x02", "\x03"


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, UPPER.lower())
    after = F.substr(rest, F.char_length(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)) + 1)
    return host, F.regexp_extract(after, r"(?s)^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path written together) and its verdict; null without one."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ranked]
    pick = lambda what: F.coalesce(*(F.when(f, F.lit(what(r))) for f, r in zip(fits, ranked, strict=True)))
    return pick(lambda r: r[0] + r[1]), pick(lambda r: r[2])


def calibrates(url: Column) -> Column:
    """One URL in CALIBRATE, by its digest."""
    return F.conv(F.left(F.md5(url), F.lit(8)), 16, 10).cast("long") % CALIBRATE == 0


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """A row for each character of each distinct URL: the character and up to ``order`` - 1 before it."""
    padded = urls.withColumn("_p", F.concat(F.lit(START * (order - 1)), "url", F.lit(END)))
    at = F.sequence(F.lit(1), F.char_length("_p") - order + 1)
    return padded.withColumn("gram", F.explode(F.transform(at, lambda i: F.substr("_p", i, F.lit(order))))).drop("_p")


def _model(counted: DataFrame, order: int, shelf: Shelf) -> list[DataFrame]:
    """For each length k the k-grams with their counts in both classes, and those of their contexts.

    ``counted``: the full grams with counts (a, b). Shorter grams are their ends.
    """
    out = []
    for k in range(1, order + 1):
        gram = F.substr("gram", F.lit(order - k + 1), F.lit(k))
        one = counted.groupBy(gram.alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = F.substr("g", F.lit(1), F.lit(k - 1))
        total = one.groupBy(context.alias("c")).agg(
            F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count(F.when(F.col("a") > 0, 1)).alias("da"), F.count(F.when(F.col("b") > 0, 1)).alias("db")
        )
        out.append((shelf.put(one), shelf.put(total)))
    return out


def _ratios(grams: DataFrame, model: list, order: int, broadcast_rows: int) -> DataFrame:
    """(gram, ratio): log p_accepted - log p_rejected of the last character after the others, in units of 1e-9."""
    out = grams.select("gram").distinct().withColumns({"pa": F.lit(1 / 256.0), "pb": F.lit(1 / 256.0)})
    for k, (one, total) in enumerate(model, 1):
        out = out.withColumn("g", F.substr("gram", F.lit(order - k + 1), F.lit(k))).withColumn("c", F.substr("gram", F.lit(order - k + 1), F.lit(k - 1)))
        # short contexts are few, and common to most n-grams
        for side, on in ((one, "g"), (total, "c")):
            n = side.count()
            out = out.join(F.broadcast(side), on, "left") if n <= broadcast_rows else spread_join(out, side, [on], "gram", "left")
        for s in "ab":
            n, t, d = (F.coalesce(F.col(x), F.lit(0)) for x in (s, f"t{s}", f"d{s}"))
            out = out.withColumn(f"p{s}", F.when(t > 0, (n + d * F.col(f"p{s}")) / (t + d)).otherwise(F.col(f"p{s}")))
        out = out.select("gram", "pa", "pb")
    return out.select("gram", F.round((F.log("pa") - F.log("pb")) * 1e9).cast("long").alias("ratio"))


def _scores(urls: DataFrame, model: list, order: int, shelf: Shelf, broadcast_rows: int) -> DataFrame:
    """``urls`` (distinct, ``url`` among the columns) with the mean ratio of their characters.

    No character is shuffled by its n-gram: some n-grams are in every URL. The ratios are broadcast, in
    blocks where there are many, and the sums of a URL over the blocks are added.
    """
    grams = _grams(urls, order)
    ratios = shelf.put(_ratios(grams, model, order, broadcast_rows))
    blocks = max(1, -(-ratios.count() // max(1, broadcast_rows)))
    parts = []
    for k in range(blocks):
        block = F.broadcast(ratios.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == k))
        part = grams.join(block, "gram").groupBy(*urls.columns).agg(F.sum("ratio").alias("t"), F.count(F.lit(1)).alias("n"))
        parts.append(part if blocks == 1 else shelf.put(part))
    # whole numbers: the mean does not depend on the order of addition
    total, n = F.sum("t"), F.sum("n")
    return reduce(DataFrame.unionByName, parts).groupBy(*urls.columns).agg((((total - F.pmod(total, n)) / n) / 1e9).alias("score"))


def filter_urls(pages: DataFrame, rules=RULES, order: int = ORDER, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(every column of ``pages``, host, path, rule, verdict, score) with a row for each page.

    ``host`` is what follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; ``path`` goes on from
    there up to ``? #``; both empty for null urls and those without ``://``. The longest rule that
    fits decides; without one the models do: rejected if the mean log-likelihood ratio (``score``,
    null where a rule decides) is below the bound that best separates the calibration URLs. Null urls
    without a rule, and all where one class has no URL to learn from, are accepted. Repeated urls are
    learned once. Columns named like the added ones are replaced.
    """
    shelf = Shelf(pages.sparkSession)
    pages = pages.drop("host", "path", "rule", "verdict", "score")
    host, path = host_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "_fixed": verdict})
    urls = shelf.put(judged.where("url IS NOT NULL").select("url", "_fixed").distinct())
    labelled = urls.where("_fixed IS NOT NULL").select("url", (F.col("_fixed") == "allow").cast("int").alias("good"))
    part = calibrates(F.col("url"))
    counted = _grams(labelled.where(~part), order).groupBy("gram").agg(F.sum("good").alias("a"), F.sum(1 - F.col("good")).alias("b"))
    counted = shelf.put(counted)
    sizes = labelled.agg(F.sum("good"), F.sum(1 - F.col("good"))).first()
    open_ = urls.where("_fixed IS NULL").select("url")
    if not sizes[0] or not sizes[1]:
        scored, bound = open_.select(F.col("url").alias("_u"), F.lit(0.0).alias("score")), 0.0
    else:
        model = _model(counted, order, shelf)
        marked = open_.withColumn("good", F.lit(-1)).unionByName(labelled.where(part))
        scores = shelf.put(_scores(marked, model, order, shelf, broadcast_rows))
        bound = _bound(scores.where("good >= 0"))
        scored = scores.where("good < 0").select(F.col("url").alias("_u"), "score")
    out = judged.join(scored, F.col("url") == F.col("_u"), "left").drop("_u")
    learned = F.when(F.col("score") < bound, "block").otherwise("allow")
    return out.select(*pages.columns, "host", "path", "rule", F.coalesce("_fixed", learned).alias("verdict"), "score")


def _bound(scores: DataFrame) -> float:
    """The score that separates the classes best (largest balanced accuracy), of 401 steps of a fixed grid."""
    grid = F.least(F.lit(200), F.greatest(F.lit(-200), F.floor(F.col("score") * 50))).cast("int")
    rows = scores.groupBy(grid.alias("k")).agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b")).collect()
    good, bad = {r["k"]: r["g"] for r in rows}, {r["k"]: r["b"] for r in rows}
    all_good, all_bad = max(1, sum(good.values())), max(1, sum(bad.values()))
    best = (-1.0, 0.0, 0.0)
    below_good = below_bad = 0
    for k in range(-200, 202):
        balanced = (all_good - below_good) / all_good + below_bad / all_bad
        best = max(best, (round(balanced, 9), -abs(k), k / 50.0))
        below_good += good.get(k, 0)
        below_bad += bad.get(k, 0)
    return best[2]


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


def sql(rules=RULES, order: int = ORDER) -> str:
    """The same in DuckDB: rules, both models by interpolation over lengths 1 to ``order``, the grid of bounds, verdicts."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{what(h, p, v)}'" for h, p, v in ranked) + " END"
    steps, last = [], "SELECT DISTINCT gram, 1 / 256.0::DOUBLE AS pa, 1 / 256.0::DOUBLE AS pb FROM sg"
    for k in range(1, order + 1):
        steps.append(f"n{k} AS (SELECT right(gram, {k}) AS g, sum(a) AS a, sum(b) AS b FROM tr GROUP BY 1)")
        steps.append(f"t{k} AS (SELECT left(g, {k - 1}) AS c, sum(a) AS ta, sum(b) AS tb, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM n{k} GROUP BY 1)")
        steps.append(f"p{k - 1} AS ({last})")
        mix = lambda s: f"CASE WHEN coalesce(t{s}, 0) > 0 THEN (coalesce({s}, 0) + d{s} * p{s}) / (t{s} + d{s}) ELSE p{s} END AS p{s}"
        last = f"SELECT gram, {mix('a')}, {mix('b')} FROM p{k - 1} LEFT JOIN n{k} ON g = right(gram, {k}) LEFT JOIN t{k} ON c = left(right(gram, {k}), {k - 1})"
    pad = f"repeat(chr(2), {order - 1}) || url || chr(3)"
    grams = lambda source: f"SELECT *, substr({pad}, i, {order}) AS gram FROM {source}, range(1, length(url) + 2) r(i)"
    return f"""
WITH a AS (SELECT page_id, url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
j AS (SELECT *, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS fixed FROM b),
u AS (SELECT DISTINCT url, fixed, ('0x' || left(md5(url), 8))::BIGINT % {CALIBRATE} = 0 AS part FROM j WHERE url IS NOT NULL),
tr AS (SELECT gram, count(*) FILTER (fixed = 'allow') AS a, count(*) FILTER (fixed = 'block') AS b FROM ({grams("(SELECT * FROM u WHERE fixed IS NOT NULL AND NOT part)")}) GROUP BY 1),
su AS (SELECT url, fixed FROM u WHERE fixed IS NULL OR part),
sg AS ({grams("su")}),
{", ".join(steps)},
ratio AS (SELECT gram, round((ln(pa) - ln(pb)) * 1e9)::BIGINT AS r FROM ({last})),
score AS (SELECT url, fixed, ((sum(r) - ((sum(r) % count(*)) + count(*)) % count(*)) / count(*))::DOUBLE / 1e9 AS score FROM sg JOIN ratio USING (gram) GROUP BY ALL),
grid AS (SELECT least(200, greatest(-200, floor(score * 50)))::INT AS k, count(*) FILTER (fixed = 'allow') AS g, count(*) FILTER (fixed = 'block') AS b FROM score WHERE fixed IS NOT NULL GROUP BY 1),
total AS (SELECT greatest(1, coalesce(sum(g), 0)) AS g, greatest(1, coalesce(sum(b), 0)) AS b FROM grid),
cut AS (SELECT s.k, round((t.g - coalesce((SELECT sum(g) FROM grid WHERE grid.k < s.k), 0)) / t.g + coalesce((SELECT sum(b) FROM grid WHERE grid.k < s.k), 0) / t.b, 9) AS balanced FROM range(-200, 202) s(k), total t),
bound AS (SELECT k / 50.0 AS bound FROM cut ORDER BY balanced DESC, abs(k), k DESC LIMIT 1),
ok AS (SELECT count(*) FILTER (fixed = 'allow') > 0 AND count(*) FILTER (fixed = 'block') > 0 AS usable FROM u)
SELECT page_id, host, path, rule, coalesce(j.fixed, CASE WHEN usable AND score < bound THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN j.fixed IS NULL THEN CASE WHEN usable THEN score WHEN j.url IS NOT NULL THEN 0.0 END END AS score
FROM j LEFT JOIN score ON score.url = j.url AND score.fixed IS NULL, bound, ok
"""
