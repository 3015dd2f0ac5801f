"""URL filter: listed rules, and logistic regression on hashed character n-grams for all other URLs.

A rule names a host and the start of a path and fits that host and all its subdomains; of the rules
that fit, the longest wins. A URL that no rule fits is judged by a logistic regression on hashed
character n-grams of its host and path, trained from a small labelled table of URLs. Whole labels
of a host name count apart from n-grams, so a short telling name is not lost in a long URL.

Rules are compiled into one native expression; only the model's score runs in Python.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is allowed unless
a rule fits (none does); repeated rows get the same verdict each; without labels of both kinds every
URL scores 0.5 and is allowed; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.llm.base import lower_ascii

BITS = 15
GRAMS = (3, 4, 5)
SHARE = 0.1

#: A small general table of kinds of hosts, written without regard to any given pages, with www, m and
#: blog equally often on both sides; 1 for URLs to block.
LABELLED_URLS = (
    ("https://ads.example.test/serve", 1), ("https://ads2.example.test/banner/top", 1), ("https://adserver.example.test/click", 1),
    ("https://ad-network.example.test/impression", 1), ("https://banner-ads.example.test/728x90.gif", 1), ("https://popup.example.test/open", 1),
    ("https://clicktracker.example.test/go", 1), ("https://pixel.example.test/1x1.gif", 1), ("https://casino.example.test/", 1),
    ("https://www.grand-casino.example.test/slots", 1), ("https://casino-royal.example.test/roulette", 1), ("https://poker.example.test/tables", 1),
    ("https://www.poker-room.example.test/join", 1), ("https://betting.example.test/odds", 1), ("https://bet-online.example.test/football", 1),
    ("https://bingo.example.test/jackpot", 1), ("https://m.slots.example.test/play", 1), ("https://lottery.example.test/tickets", 1),
    ("https://porn.example.test/watch/2", 1), ("https://xxx.example.test/videos", 1), ("https://adult.example.test/gallery", 1),
    ("https://m.adult-video.example.test/new", 1), ("https://sexcam.example.test/live", 1), ("https://www.escort.example.test/city", 1),
    ("https://nude.example.test/photos", 1), ("https://pills.example.test/order", 1), ("https://blog.diet-pills.example.test/offer", 1),
    ("https://viagra.example.test/buy", 1), ("https://www.online-pharmacy.example.test/cialis", 1), ("https://replica-watches.example.test/shop", 1),
    ("https://payday-loans.example.test/apply", 1), ("https://blog.get-rich.example.test/today", 1), ("https://spam.example.test/list", 1),
    ("https://mail-spam.example.test/send", 1), ("https://link-exchange.example.test/add", 1), ("https://buy-backlinks.example.test/prices", 1),
    ("https://blog.clickbait.example.test/shocking", 1), ("https://phishing.example.test/login/verify", 1), ("https://malware.example.test/setup.exe", 1),
    ("https://www.warez.example.test/keygen", 1), ("https://crack-download.example.test/serial", 1), ("https://torrent.example.test/top", 1),
    ("https://www.example.test/", 0), ("https://example.test/about", 0), ("https://blog.example.test/2019/05/a-walk", 0),
    ("https://m.example.test/index.html", 0), ("https://news.example.test/world/europe", 0), ("https://docs.example.test/guide/start", 0),
    ("https://wiki.example.test/River", 0), ("https://library.example.test/catalogue/77", 0), ("https://www.university.example.test/research/physics", 0),
    ("https://museum.example.test/collection", 0), ("https://forum.example.test/topic/981", 0), ("https://recipes.example.test/soup", 0),
    ("https://garden.example.test/plants/12", 0), ("https://blog.hiking.example.test/mountains", 0), ("https://www.history.example.test/rome", 0),
    ("https://school.example.test/class/3", 0), ("https://journal.example.test/article/10", 0), ("https://python.example.test/tutorial/loops", 0),
    ("https://weather.example.test/berlin", 0), ("https://music.example.test/album/5", 0), ("https://sports.example.test/match/8", 0),
    ("https://travel.example.test/madrid", 0), ("https://health.example.test/sleep", 0), ("https://science.example.test/stars", 0),
    ("https://city.example.test/transport", 0), ("https://cinema.example.test/film/6", 0), ("https://books.example.test/novel/41", 0),
    ("https://shop.example.test/product/12", 0), ("https://support.example.test/faq", 0), ("https://maps.example.test/street", 0),
    ("https://mail.example.test/inbox", 0), ("https://www.bakery.example.test/bread.html", 0), ("https://photos.example.test/album", 0),
    ("https://jobs.example.test/engineer", 0), ("https://art.example.test/paintings", 0), ("https://bank.example.test/branches", 0),
    ("https://hospital.example.test/visit", 0), ("https://m.railway.example.test/timetable", 0), ("https://parks.example.test/lake", 0),
    ("https://blog.teacher.example.test/notes.html", 0), ("https://www.chess.example.test/openings", 0), ("https://radio.example.test/live", 0),
)


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower-case A-Z and path; both empty for a null or a URL without ``://``."""
    url = F.coalesce(url, F.lit(""))
    cut = lambda n: F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", n)
    return lower_ascii(cut(1)), cut(2)


def matching_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """Struct of the longest rule that fits, as text, and its verdict; null where none does."""
    out = F.lit(None).cast("struct<rule string, verdict string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: the distinct n-grams of host and path share one unit of length, each part of a host label has one of its own."""
    grams = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"{path}$")):
        for n in GRAMS:
            grams.update(f"{kind}{text[i : i + n]}" for i in range(len(text) - n + 1))
    names = {f"l{part}" for label in host.split(".") for part in (label, *label.split("-"))}
    value = {}
    for group, unit in ((grams, max(len(grams), 1) ** -0.5), (names, 1.0)):
        for f in sorted(group):
            place = crc32(f.encode("utf-8", "replace")) >> (32 - BITS)
            value[place] = value.get(place, 0.0) + unit
    return np.array(list(value), int), np.array(list(value.values()))


def train(labelled: Sequence[tuple[str, str, int]], steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    """Weights and constant from ``(host, path, label)`` rows."""
    weights = np.zeros((1 << BITS) + 1)
    y = np.array([label for *_, label in labelled], float)
    if len(set(y.tolist())) < 2:
        return weights
    x = [features(h, p) for h, p, _ in labelled]
    row = np.repeat(np.arange(len(x)), [len(c) for c, _ in x])
    col, value = (np.concatenate(part) for part in zip(*x))
    for _ in range(steps):
        z = np.bincount(row, weights[col] * value, len(x)) + weights[-1]
        error = y - 1 / (1 + np.exp(-z))
        weights[:-1] += rate * (np.bincount(col, error[row] * value, 1 << BITS) - ridge * weights[:-1])
        weights[-1] += rate * error.mean()
    return weights


def block_score(host: Column, path: Column, weights: np.ndarray) -> Column:
    """Chance that a URL is one to block."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            out = np.empty(len(hosts))
            for i, (h, p) in enumerate(zip(hosts, paths)):
                place, value = features(h, p)
                out[i] = weights[place] @ value + weights[-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return score(host, path)


def split_labelled(labelled: Sequence[tuple[str, int]]) -> list[tuple[str, str, int]]:
    """Host and path of a small table, as ``parts`` takes them from a column."""
    out = []
    for url, label in labelled:
        rest = url.partition("://")[2].partition("#")[0].partition("?")[0]
        host, slash, path = rest.partition("/")
        out.append((host.lower(), slash + path, label))
    return out


def with_share(weights: np.ndarray, labelled: Sequence[tuple[str, int]], share: float) -> np.ndarray:
    """The model for URLs of which ``share`` are to be blocked, in place of the table's own share."""
    table = sum(label for _, label in labelled) / max(len(labelled), 1)
    if table in (0, 1):
        return weights
    out = weights.copy()
    out[-1] += np.log(share / (1 - share)) - np.log(table / (1 - table))
    return out


def judge_urls(
    pages: DataFrame, rules: Sequence[UrlRule], labelled: Sequence[tuple[str, int]] = LABELLED_URLS, id_column: str = "page_id", url: str = "url", limit: float = 0.5, share: float = SHARE
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict`` and ``block_score`` (null where a rule decides).

    ``share`` is the part of all URLs that is expected to be blocked; the table holds as many of either kind.
    """
    weights = with_share(train(split_labelled(labelled)), labelled, share)
    host, path = parts(F.col(url))
    rows = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    scored = rows.withColumn("score", block_score(F.col("host"), F.col("path"), weights))
    by_model = F.when((F.col("host") != "") & (F.col("score") > limit), "block").otherwise("allow")
    return scored.select(
        id_column, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_model).alias("verdict"),
        F.when(F.col("fit").isNull(), F.col("score")).alias("block_score"))
