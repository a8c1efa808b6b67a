"""URL verdicts: rules for hosts and paths, and for the rest a logistic regression on hashed character n-grams.

A URL's host is what follows the first '://' up to '/', '?', '#' or the end, ASCII
letters lower-cased; its path is what follows up to '?', '#' or the end. A rule is text
like 'example.org/es/': it fits its host and all subdomains if the path starts with the
rule's path. Of several fitting rules the longest text wins, of equally long ones the one
with the longer host, then the least text. Rules are a list that a query states
(``MAX_RULES`` at most); they are constants of the plan.

URLs without a rule get the method's verdict. Features are the character 3- and 4-grams of
'^host$' and of the path, hashed into ``BUCKETS`` buckets, each counted and divided by the
square root of the number of grams. The model is trained by gradient descent on a small
labelled table of URLs (``MAX_LABELLED`` rows at most, those of the least hash if there
are more): its buckets, rows and steps are arrays of one row, so training is one SQL
expression. The weights, one number per bucket, are collected and become a constant of
the scoring expression. Scoring has no shuffle, join or Python.

Nulls: a null URL and one without '://' have an empty host and path, fit no rule and are
judged by the intercept alone, as empty URLs are. Very long URLs are scored whole. Rows
are judged one by one, so repeated rows, ties and ids do not matter; an empty table gives
no rows. Only page_id and url are read, other columns are ignored. A null label or URL is
not learned from; a table without labelled rows blocks nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import computed_once

GRAMS = (3, 4)
BUCKETS = 1 << 14
STEPS, RATE, PENALTY = 300, 4.0, 1e-4
MAX_LABELLED = 1000
MAX_RULES = 1000
BLOCK_FROM = 0.5
_PRIME, _FACTOR = 2147483647, 65599
_SEEDS = {"host": 17, "path": 101}

# --- labelled URLs: 1 is unwanted --------------------------------------------
LABELLED = [
    ("http://best-casino.example/play/slots", 1), ("https://www.casino-royal.example/bonus?ref=1", 1), ("http://online-casino24.example/", 1),
    ("https://poker-stars-bonus.example/win", 1), ("http://win-big-jackpot.example/index.html", 1), ("http://lucky-slots.example/free-spins", 1),
    ("https://sports-bets.example/live", 1), ("http://free-betting-tips.example/en/12", 1), ("https://bets-and-odds.example/today.html", 1),
    ("http://cheap-viagra.example/order", 1), ("https://discount-pills.example/rx/45", 1), ("http://online-pharmacy-pills.example/cheap.html", 1),
    ("http://cheap-meds.example/no-prescription", 1), ("https://weight-loss-pills.example/de/9", 1), ("http://payday-loans.example/apply", 1),
    ("https://instant-loan-cash.example/now?src=ad", 1), ("http://get-rich-quick.example/money", 1), ("https://free-money.example/claim", 1),
    ("http://ads.track-server.example/click?id=5", 1), ("https://adserver.banner-ads.example/pixel", 1), ("http://ads-network.example/track", 1),
    ("https://click-track.example/redirect/77", 1), ("http://popup-ads.example/", 1), ("http://hot-singles-dating.example/chat", 1),
    ("https://adult-xxx-video.example/watch", 1), ("http://free-porn.example/fr/3", 1), ("http://adult-chat.example/18", 1), ("https://adult-pictures.example/x", 1), ("http://replica-watches.example/rolex", 1),
    ("https://cheap-handbags-outlet.example/sale", 1), ("http://free-download-crack.example/keygen", 1), ("https://torrent-crack.example/full", 1),
    ("http://win-free-prize.example/survey", 1), ("http://buy-followers.example/cheap", 1),
    ("https://www.city-library.example/opening-hours", 0), ("https://news.daily-herald.example/en/2021/05/03", 0), ("http://museum.example/exhibitions/", 0),
    ("https://docs.compiler.example/manual/install.html", 0), ("https://en.encyclopedia.example/wiki/River", 0), ("http://blog.gardening.example/tomatoes", 0),
    ("https://university.example/faculty/physics", 0), ("http://www.weather-service.example/forecast?city=3", 0), ("https://school.example/calendar", 0),
    ("http://m.newspaper.example/sports/4471", 0), ("https://recipes.example/soup/lentil.html", 0), ("https://hospital.example/departments", 0),
    ("http://forum.photography.example/thread/9921", 0), ("https://www.parliament.example/debates/77", 0), ("https://shop.bookstore.example/item/3312", 0),
    ("http://blog.mountain-hiking.example/routes#map", 0), ("https://www.orchestra.example/concerts", 0), ("http://history-archive.example/de/1848", 0),
    ("https://m.railway.example/timetable", 0), ("http://www.town-council.example/fr/minutes/12", 0), ("https://theatre.example/es/programme", 0),
    ("http://science-journal.example/articles/118", 0), ("https://static.open-data.example/files/4.csv", 0), ("https://www.bakery.example/", 0),
    ("http://the-local-paper.example/en/8", 0), ("https://www.theriver.example/en/5501?utm_source=feed", 0), ("http://blog.thinking-aloud.example/de/71.html", 0),
    ("https://other-side.example/es/650/", 0), ("http://nation-review.example/fr/4402#top", 0), ("https://www.stationery.example/en/12?page=2&ref=x", 0),
    ("http://m.northern-lights.example/de/903/", 0), ("https://anderen.example/de/8", 0), ("http://lesheures.example/fr/77.html", 0),
    ("https://tierra.example/es/31", 0), ("http://www.thehouse.example/en/3#top", 0), ("https://blog.ontheroad.example/en/2210/", 0),
    ("http://internet-society.example/en/64.html", 0), ("https://m.weather.example/fr/9?utm_source=feed", 0), ("https://eat-well.example/en/17", 0),
    ("http://www.winter-sports.example/es/5", 0), ("https://trackandfield-club.example/results", 0), ("http://freedom-of-press.example/report/2", 0)]
# ------------------------------------------------------------------------------


class Rule(NamedTuple):
    text: str  # host and path, like 'example.org/es/'
    verdict: str  # 'allow' or 'block'


class Model(NamedTuple):
    intercept: float
    weights: dict[int, float]  # at most one number per bucket


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled URLs above as a table."""
    return spark.createDataFrame(LABELLED, "url string, label int")


def host_of(url: Column) -> Column:
    after = F.when(F.locate("://", url) > 0, F.substring_index(_rest(url), "/", 1))
    host = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    found = F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(F.locate("://", url) > 0, found), F.lit(""))


def _rest(url: Column) -> Column:
    """What follows the first '://'."""
    return F.substring(url, F.locate("://", url) + 3, F.length(url))


def split_urls(urls: DataFrame, *columns: str) -> DataFrame:
    """``columns``, host and path of each row, with the codes of both texts' characters."""
    url = F.col("url").cast("string")
    parts = computed_once(urls.select(*columns, url.alias("url")), {"host": host_of(url), "path": path_of(url)})
    codes = lambda text: F.transform(F.array_remove(F.split(text, ""), ""), lambda c: F.ascii(c).cast("long"))
    return computed_once(parts.drop("url"), {
        "host_codes": codes(F.when(F.col("host") != "", F.concat(F.lit("^"), "host", F.lit("$"))).otherwise("")), "path_codes": codes(F.col("path"))})


def _bucket(codes: str, seed: int, start: Column, size: int) -> Column:
    """Bucket of the gram of ``size`` characters that starts at ``start``, by a polynomial of its codes."""
    value = F.lit(seed * 1000 + size).cast("long")
    for k in range(size):
        value = (value * _FACTOR + F.get(codes, start + k)) % _PRIME
    return (value % BUCKETS).cast("int")


def _each_gram() -> list[tuple[str, int, int]]:
    return [(f"{field}_codes", seed, size) for field, seed in _SEEDS.items() for size in GRAMS]


def _n_grams() -> Column:
    return sum((F.greatest(F.lit(0), F.size(codes) - (size - 1)) for codes, _, size in _each_gram()), F.lit(0))


def _gram_buckets(codes: str, seed: int, size: int) -> Column:
    every = F.transform(F.sequence(F.lit(0), F.size(codes) - size), lambda i: _bucket(codes, seed, i, size))
    return F.when(F.size(codes) >= size, every).otherwise(F.array().cast("array<int>"))


def buckets() -> Column:
    """Buckets of all grams of a split URL, repeated ones included."""
    return F.concat(*[_gram_buckets(*gram) for gram in _each_gram()])


def train(labelled: DataFrame, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY, limit: int = MAX_LABELLED) -> Model:
    """Fit on ``labelled`` (url, label); one row of arrays holds the table, its inverted index and the descent."""
    rows = labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("double").alias("label")).where("url is not null and label is not null")
    chosen = rows.orderBy(F.md5("url"), "url", "label").limit(limit)
    grams = split_urls(chosen, "label").select("label", "host", "path", buckets().alias("buckets"), F.sqrt(F.greatest(F.lit(1), _n_grams())).alias("norm"))
    table = grams.groupBy().agg(F.array_sort(F.collect_list(F.struct("host", "path", "label", "buckets", "norm"))).alias("rows"))
    numbered = table.select(F.posexplode("rows").alias("i", "row"))
    values = numbered.select("i", F.explode("row.buckets").alias("bucket"), "row.norm").groupBy("i", "bucket").agg(
        (F.count(F.lit(1)) / F.first("norm")).alias("value"))
    postings = values.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("rows"))
    index = postings.groupBy().agg(F.array_sort(F.collect_list(F.struct("bucket", "rows"))).alias("index"))
    placed = index.select(F.posexplode("index").alias("k", "entry")).select("k", F.explode("entry.rows").alias("at"))
    by_row = placed.groupBy("at.i").agg(F.array_sort(F.collect_list(F.struct("k", F.col("at.value").alias("value")))).alias("terms"))
    terms = by_row.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "terms"))).alias("terms"))
    labels = table.select(F.transform("rows", lambda r: r["label"]).alias("labels"))
    three = labels.unionByName(index, allowMissingColumns=True).unionByName(terms, allowMissingColumns=True)
    one = three.groupBy().agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("labels", "index", "terms")])
    n = F.greatest(F.lit(1), F.size("labels"))

    def residuals(state: Column) -> Column:
        margin = lambda t: F.aggregate(t["terms"], state["intercept"], lambda s, x: s + x["value"] * F.get(state["weights"], x["k"]))
        return F.transform("terms", lambda t: F.get("labels", t["i"]) - 1 / (1 + F.exp(-margin(t))))

    def moved(state: Column) -> tuple[Column, Column]:
        total = F.aggregate(state["residuals"], F.lit(0.0), lambda s, r: s + r)
        weights = F.transform("index", lambda entry, k: F.get(state["weights"], k) * (1 - rate * penalty) + rate / n * F.aggregate(
            entry["rows"], F.lit(0.0), lambda s, x: s + x["value"] * F.get(state["residuals"], x["i"])))
        return state["intercept"] + rate / n * total, weights

    def step(state: Column, turn: Column) -> Column:
        # residuals and weights take turns, so that each is evaluated once a step
        intercept, weights = moved(state)
        return F.when(turn % 2 == 0, F.struct(state["intercept"].alias("intercept"), state["weights"].alias("weights"), residuals(state).alias("residuals"))).otherwise(
            F.struct(intercept.alias("intercept"), weights.alias("weights"), state["residuals"].alias("residuals")))

    zeros = lambda array: F.transform(array, lambda _: F.lit(0.0))
    start = F.struct(F.lit(0.0).alias("intercept"), zeros("index").alias("weights"), zeros("labels").alias("residuals"))
    fitted = one.select(F.aggregate(F.sequence(F.lit(0), F.lit(2 * steps - 1)), start, step).alias("model"), F.transform("index", lambda e: e["bucket"]).alias("buckets")).first()
    if not fitted.buckets:
        return Model(float("-inf"), {})
    return Model(fitted.model.intercept, dict(zip(fitted.buckets, fitted.model.weights, strict=True)))


def probability(model: Model) -> Column:
    """Probability that a split URL is unwanted."""
    dense = ",".join(repr(model.weights.get(b, 0.0)) for b in range(BUCKETS))
    weights = F.split(F.lit(dense), ",").cast("array<double>")  # one constant of the plan
    total = F.aggregate(buckets(), F.lit(0.0), lambda s, b: s + F.get(weights, b))
    margin = F.lit(model.intercept) + total / F.sqrt(F.greatest(F.lit(1), _n_grams()))
    return 1 / (1 + F.exp(-margin))


def matched_rule(rules: list[Rule]) -> Column:
    """(text, verdict) of the rule that counts, null if none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    none = F.lit(None).cast("struct<text: string, verdict: string>")
    found = none
    ranked = sorted(rules, key=lambda r: (-len(r.text), -len(r.text.partition("/")[0]), r.text))
    for rule in reversed(ranked):
        host, slash, path = rule.text.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(slash + path))
        found = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def judge(pages: DataFrame, rules: list[Rule], model: Model) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability of each URL."""
    split = split_urls(pages, "page_id")
    judged = computed_once(split, {"__rule": matched_rule(rules), "score": probability(model)})
    return judged.select(
        "page_id", "host", "path", F.col("__rule.text").alias("rule"),
        F.coalesce("__rule.verdict", F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")).alias("verdict"), F.round("score", 4).alias("score"))
