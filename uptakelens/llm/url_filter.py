"""URL filters: rules on host and path, then logistic regression on hashed character n-grams.

A url's host is what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower
case; its path follows up to `?`, `#` or the end. A null url, or one without `://`, has an empty
host and path. The classifier is fitted on the driver from a small labelled table of urls, whose
size is a parameter, and scores every url inside the tasks: its weights (2**16 numbers) travel
with the function. Scoring needs no shuffle. Equal urls get equal results, an empty table gives
an empty result. A labelled table of one class only gives every url that class, an empty one
allows every url.

Without a table of the caller's, `labelled_urls` serves: some 3000 urls put together from words that
name gambling, adult, pharmacy, tracking and link-farm sites, and from words of ordinary sites,
both in the same forms, with the same prefixes, domains and paths, so that only the names tell
them apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uptakelens.llm import ragged

#: verdict, host, path
Rule = tuple[str, str, str]
RULES: list[Rule] = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: Most labelled urls the classifier is fitted on (those with the smallest hashes).
TRAIN_URLS = 4000
SIZES = (3, 4, 5)
BITS = 16
ROUNDS = 300
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


BLOCK_WORDS = (
    "ads adserver adult banner bets bingo bonus cams casino cheap clickbait coins crack dating "
    "escort farm free gambling jackpot keygen loans lottery nude pharmacy pills poker popunder "
    "porn prize sex slots spam torrent track tracker viagra warez win x xxx"
).split()
ALLOW_WORDS = (
    "academy archive art atlas bakery bank biology books bridge bulletin chemistry children "
    "church city climate coast college community cooking council courier culture daily desk "
    "doctors ecology economy editor energy engineering essays family fields film forest forum "
    "gallery garden gazette geography guide harbour health heritage history home hospital "
    "island journal kitchen knowledge language law learning letters library literature local "
    "magazine market mathematics medicine memory meadow morning mountain museum music nature "
    "news north notes ocean open orchard paper parish people philosophy physics planet poetry "
    "policy press project public radio railway reading recipes record research review river "
    "school science society south sport station stories street studio summer theatre times "
    "today town travel tribune university valley village voices walking weather weekly west "
    "wiki winter women words workshop world writing"
).split()


#: Words that names of both kinds have, and ordinary names with a blocked word inside.
SHARED_WORDS = "online site web shop group best top new city blog club 24".split()
HARD_WORDS = (
    "essex sussex middlesex winchester windmill adsorption analysis betsy therapist casinotheque "
    "trackside spamalot saddle badminton twins cramer embankment pillsbury"
).split()


def forms(word: str, others: list[str], number: int) -> list[str]:
    """Names that one word makes: alone, with a number, and with some others, joined or not."""
    out = [word, f"{word}{number % 100}", f"the-{word}"]
    for k, other in enumerate(others):
        pair = (word, other) if (number + k) % 2 else (other, word)
        out.append(("-" if (number + k) % 4 < 2 else "").join(pair))
    return out


def labelled_urls() -> list[tuple[str, str, bool]]:
    """The default table: host, path, and whether to block it. Names of both kinds come alone, in
    joined and in hyphenated pairs, with numbers, and beside the same shared words; a name is to
    be blocked if one of its words is."""
    prefixes, ends = ["", "www.", "m.", "blog."], ["com", "org", "net", "example.com", "example.org"]
    paths = ["/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/{}", "/page/{}", "/en/{}.html", ""]
    names = []
    for i, word in enumerate(BLOCK_WORDS):
        others = [*SHARED_WORDS, *BLOCK_WORDS[i % 5 :: 5], *ALLOW_WORDS[i % 9 :: 9]]
        names += [(name, True) for name in forms(word, others, i)]
    for i, word in enumerate([*ALLOW_WORDS, *SHARED_WORDS, *HARD_WORDS]):
        others = [*SHARED_WORDS[i % 3 :: 3], *ALLOW_WORDS[i % 23 :: 23]]
        names += [(name, False) for name in forms(word, others, i)]
    return [
        (
            f"{prefixes[i % 4]}{name}.{ends[i % 5]}",
            paths[i % 8].format(7919 * (i + 1) % 50_021),
            block,
        )
        for i, (name, block) in enumerate(names)
    ]


def with_host_and_path(frame: DataFrame, url: str = "url") -> DataFrame:
    """The frame with columns host and path, never null."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    return frame.withColumns(
        {
            "host": F.translate(F.regexp_extract(text, parts, 1), _UPPER, _LOWER),
            "path": F.regexp_extract(text, parts, 2),
        }
    )


def rule_columns(rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits host and path, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = F.expr("host").isin(host) | F.expr("host").endswith("." + host)
        fits &= F.expr("path").startswith(path)
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram, and the weight of a row's n-grams."""
    buckets, rows = [], []
    for side, column in enumerate((host, path)):
        data, at = ragged.utf8(column)
        for n in SIZES:
            value, row = ragged.gram_hashes(data, at, n)
            buckets.append(((value * np.uint64(2 * side + 1)) >> np.uint64(64 - BITS)).astype(np.int64))
            rows.append(row)
    bucket, row = np.concatenate(buckets), np.concatenate(rows)
    return bucket, row, 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(host)), 1))


@dataclass(frozen=True)
class UrlModel:
    """Weight of each bucket, and the constant."""

    weights: np.ndarray
    constant: float

    def scores(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        """Probability of `block` for each row."""
        bucket, row, scale = features(host, path)
        total = np.bincount(row, self.weights[bucket], len(host)) * scale + self.constant
        return 1 / (1 + np.exp(-total))


def fit(host: list[str], path: list[str], block: list[bool], penalty: float = 1e-5) -> UrlModel:
    """Logistic regression by accelerated gradient steps. Without both classes, the constant
    answer: 1 if all labels are block, else 0."""
    y = np.asarray(block, float)
    if not 0 < y.sum() < len(y):
        return UrlModel(np.zeros(1 << BITS), 30.0 if len(y) and y.all() else -30.0)
    bucket, row, scale = features(pa.array(host, pa.string()), pa.array(path, pa.string()))
    weights, constant = np.zeros(1 << BITS), 0.0
    ahead, ahead_constant = weights, constant
    for step in range(ROUNDS):
        total = np.bincount(row, ahead[bucket], len(y)) * scale + ahead_constant
        error = 1 / (1 + np.exp(-total)) - y
        slope = np.bincount(bucket, (error * scale)[row], 1 << BITS) / len(y) + penalty * ahead
        new, new_constant = ahead - 2.0 * slope, ahead_constant - 2.0 * error.mean()
        speed = step / (step + 3)
        ahead = new + speed * (new - weights)
        ahead_constant = new_constant + speed * (new_constant - constant)
        weights, constant = new, new_constant
    return UrlModel(weights, float(constant))


def train(labelled: DataFrame, most: int = TRAIN_URLS) -> UrlModel:
    """The classifier from a table (host, path, verdict), of which at most `most` distinct rows
    are used: those with the smallest hashes."""
    rows = (
        labelled.select("host", "path", "verdict")
        .distinct()
        .orderBy(F.xxhash64("host", "path"), "host", "path", "verdict")
        .limit(most)
        .collect()
    )
    return fit([r[0] for r in rows], [r[1] for r in rows], [r[2] == "block" for r in rows])


def with_score(frame: DataFrame, model: UrlModel) -> DataFrame:
    """The frame (host, path, ...) with the classifier's score, the likelihood of `block`."""

    @F.arrow_udf("double")
    def score(host: pa.Array, path: pa.Array) -> pa.Array:
        return pa.array(model.scores(host, path), pa.float64())

    return frame.withColumn("score", score("host", "path"))


def judge(
    pages: DataFrame, rules: list[Rule] = RULES, labelled: DataFrame | None = None
) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page. A rule decides where one
    fits, elsewhere the classifier at a score of one half. `labelled` has host, path, verdict."""
    name, by_rule = rule_columns(rules)
    split = with_host_and_path(pages.select("page_id", "url"))
    model = train(labelled) if labelled is not None else fit(*map(list, zip(*labelled_urls(), strict=True)))
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return with_score(split, model).select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(by_rule, by_model).alias("verdict"), "score"
    )
