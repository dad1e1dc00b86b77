"""URL verdicts: rules first, then a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host/path) as in the contract of the query.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: The labelled table that the model is fitted on has at most so many rows.
MOST_LABELLED = 4000
DIMENSIONS, SHORTEST, LONGEST = 1 << 16, 3, 5


#: A small labelled table, made up for this library: hosts and paths of kinds that a corpus does without, and ordinary ones. The rules play no part in it.
BLOCKED = """
casino-royal-bonus.test/free-spins/now | luckyslots247.test/jackpot | best-poker-odds.test/signup?aff | bet-big-win.test/live/odds | spinpalace-casino.test/en/promo
cheap-pills-online.test/buy/now | no-prescription-meds.test/order | miracle-diet-pills.test/offer | weight-loss-secret.test/buy | discount-pharma.test/cart/checkout
xxx-cams-live.test/girls | hot-adult-videos.test/watch/free | adult-dating-tonight.test/join | sexy-singles.test/chat | free-porn-tube.test/hd
spam-links-farm.test/out/click | link-farm-seo.test/backlinks/buy | seo-spam-network.test/page/1 | buy-backlinks-cheap.test/order | doorway-farm.test/keywords/list
click-ads-cash.test/earn/fast | earn-money-fast.test/no-risk | get-rich-crypto.test/double | crypto-giveaway.test/claim/now | free-gift-cards.test/claim
warez-crack-download.test/keygen | torrent-movies-free.test/download | cracked-apps.test/apk/mod | keygen-serials.test/list | pirate-streams.test/watch
phish-login-verify.test/account/confirm | secure-bank-update.test/login.php | prize-winner-claim.test/you-won | tracking-popunder.test/ad/serve | popup-ads-server.test/banner
""".replace("\n", " | ")
ORDINARY = """
library.test/catalogue/history | blog.gardener.test/2021/05/tomatoes | news.harbour.test/world/article-12 | wiki.mountains.test/wiki/Granite | museum.test/collection/7
university.test/physics/lectures | docs.compiler.test/manual/install | recipes.kitchen.test/soup/leek | forum.cyclists.test/thread/88 | school.test/en/timetable
city-council.test/minutes/2019 | hospital.test/wards/visiting | journal.chemistry.test/vol3/paper | m.weather.test/en/forecast | shop.books.test/fiction/new
travel.islands.test/ferries | blog.astronomy.test/comets | choir.test/concerts/spring | trains.test/en/stations | archive.letters.test/1843/june
law.test/statutes/section-4 | music.test/scores/bach | www.farm-museum.test/visit | linkedlists.test/data/structures | club.chess.test/openings
help.printer.test/faq | parks.test/trails/map | theatre.test/season/plays | bakery.test/bread/rye | radio.test/schedule
language.test/de/grammar | statistics.test/es/census | poems.test/fr/sonnets | history.test/en/romans | energy.test/reports/wind
""".replace("\n", " | ")


def labelled_urls() -> list[tuple[str, str, str]]:
    """(host, path, verdict) of the labelled table."""
    rows = []
    for verdict, urls in (("block", BLOCKED), ("allow", ORDINARY)):
        for url in filter(None, (u.strip() for u in urls.split("|"))):
            host, _, path = url.partition("/")
            rows.append((host, "/" + path.partition("?")[0], verdict))
    return rows


def host_of(url: Column) -> Column:
    r"""After the first :// up to /, ?, # or end, A-Z lower-cased; "" for null or where there is no ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    r"""After the host up to ?, # or end; "" for null or where there is no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null; of equally long ones the last in code point order.

    A rule fits its host and all subdomains where the path starts with the rule's.
    """
    fits = []
    for verdict, rule in rules:
        of, slash, start = rule.partition("/")
        fit = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not fits:
        return F.expr("cast(null as struct<length:int,rule:string,verdict:string>)")
    return F.array_max(F.array(*fits))


def ngrams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, dimension) of every character n-gram of the urls, each n-gram of a url once."""
    data = np.frombuffer(b"".join(urls), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(urls)), [len(u) for u in urls])
    pairs = []
    for n in range(SHORTEST, LONGEST + 1):
        if (m := len(data) - n + 1) <= 0:
            continue
        h = np.full(m, n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                h = (h ^ data[j : j + m]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(29)
        whole = row[:m] == row[n - 1 :]
        pairs.append(row[:m][whole] * DIMENSIONS + (h[whole] % np.uint64(DIMENSIONS)).astype(np.int64))
    pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
    return pairs // DIMENSIONS, pairs % DIMENSIONS


def joined(hosts: list[bytes], paths: list[bytes]) -> list[bytes]:
    return [b"^" + h + b"$" + p for h, p in zip(hosts, paths, strict=True)]


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(urls: list[bytes], labels: np.ndarray, rounds: int = 200, rate: float = 0.5, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by gradient steps scaled per dimension; rows are the few of the labelled table."""
    w, b = np.zeros(DIMENSIONS), 0.0
    if not len(urls) or labels.min() == labels.max():
        return w, float(-4 if not len(urls) or labels.max() == 0 else 4)
    row, dim = ngrams(urls)
    scale = 1 / np.sqrt(np.bincount(row, minlength=len(urls)))
    x, seen_w, seen_b = scale[row], np.full(DIMENSIONS, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, w[dim] * x, len(urls)) + b
        error = (probability(z) - labels) / len(urls)
        g, gb = np.bincount(dim, error[row] * x, DIMENSIONS) + l2 * w, error.sum()
        seen_w += g * g
        seen_b += gb * gb
        w -= rate * g / np.sqrt(seen_w)
        b -= rate * gb / np.sqrt(seen_b)
    return w, b


def predict(urls: list[bytes], w: np.ndarray, b: float) -> np.ndarray:
    row, dim = ngrams(urls)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(urls))))
    return probability(np.bincount(row, w[dim], len(urls)) * scale + b)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """One row for each row of pages(page_id, url): page_id, host, path, rule, verdict, score.

    The longest fitting rule decides; else the model does (block where its score, the probability of block, is 0.5 or
    more). labelled(host, path, verdict) is a small table; its first MOST_LABELLED rows by hash are learnt from. Without
    it labelled_urls() is. No labelled rows: all are allowed; one verdict
    only: that verdict. Null urls and such without :// have empty host and path and are scored as such. Empty
    table: no rows. Columns beside page_id and url play no part.
    """
    spark = pages.sparkSession
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = parsed.withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = spark.createDataFrame(labelled_urls(), "host string, path string, verdict string")
    few = labelled.select("host", "path", "verdict").orderBy(F.xxhash64("host", "path", "verdict"), "host", "path", "verdict").limit(MOST_LABELLED).toPandas()
    urls = joined([x.encode() for x in few["host"].fillna("")], [x.encode() for x in few["path"].fillna("")])
    model = spark.sparkContext.broadcast(fit(urls, (few["verdict"] == "block").to_numpy(float)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            p = predict(joined(at["host"].cast(pa.binary()).to_pylist(), at["path"].cast(pa.binary()).to_pylist()), w, b)
            ruled = at["verdict"].to_pylist()
            verdict = [v or ("block" if s >= 0.5 else "allow") for v, s in zip(ruled, p, strict=True)]
            yield pa.RecordBatch.from_arrays([at["page_id"], at["host"], at["path"], at["rule"], pa.array(verdict, pa.string()), pa.array(p)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    flat = judged.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("verdict"))
    return flat.mapInArrow(score, "page_id long, host string, path string, rule string, verdict string, score double")
