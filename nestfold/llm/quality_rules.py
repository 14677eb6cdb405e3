"""Quality rules as weak supervision: rules vote or abstain, EM weighs the votes.

Each rule looks at one measure of a text and votes for good (+1), for bad (-1) or abstains (0).
Expectation-maximisation over the counts of vote patterns estimates how each rule votes on good
and on bad documents; a document's verdict is its posterior probability of being good. No rule
alone rejects a document, and no labels are needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bound_batches, materialize

SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\v\f\r"
#: Odd multipliers of the rolling hash over five words.
_MULTIPLIERS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1) for k in range(5)]

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper_words", "n_marks", "n_alpha_words", "n_kinds")


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of `width` words found twice or more in the text.

    Windows are compared by a 64-bit rolling hash; windows with equal hashes are compared
    word by word, so the count is exact.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += h[k : k + n] * _MULTIPLIERS[k % 5]
    order = np.argsort(total, kind="stable")
    ranked = total[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    for i in np.flatnonzero(twice).tolist():
        key = tuple(words[i : i + width])
        seen[key] = seen.get(key, 0) + 1
    covered = np.zeros(len(words) + 1, np.int64)
    for i in np.flatnonzero(twice).tolist():
        if seen[tuple(words[i : i + width])] > 1:
            covered[i] += 1
            covered[i + width] -= 1
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measures(text: str | None) -> tuple[int, ...]:
    """BASE and MORE of one whole text; a null text counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words, tokens = raw.split(), text.split()
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()] if b"\n" in raw else ([raw] if words else [])
    return (
        len(words),
        len(text) - sum(map(text.count, _WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        sum(map(str.isupper, tokens)),
        text.count("!") + text.count("?"),
        sum(map(str.isalpha, tokens)),
        len(set(words)),
    )


@dataclass(frozen=True)
class Rule:
    """Bad beyond one bound of a ratio, good within another, no vote between or on short texts."""

    name: str
    over: str
    under: str
    good: tuple[float, float]
    fair: tuple[float, float]
    least: int = 1

    def vote(self) -> Column:
        x = F.col(self.over) / F.greatest(F.col(self.under), F.lit(1))
        return (
            F.when(F.col(self.under) < self.least, 0)
            .when((x < self.fair[0]) | (x > self.fair[1]), -1)
            .when((x >= self.good[0]) & (x <= self.good[1]), 1)
            .otherwise(0)
        )


INF = math.inf
#: The production rules. Votes of one rule read: ratio of two measures, range that votes good, range outside which it votes bad.
RULES = (
    Rule("symbols", "n_symbols", "n_words", (0, 0.03), (0, 0.15)),
    Rule("upper", "n_upper_words", "n_words", (0, 0.15), (0, 0.5)),
    Rule("marks", "n_marks", "n_words", (0, 0.1), (0, 0.3)),
    Rule("length", "word_chars", "n_words", (3, 8.5), (2.2, 13)),
    Rule("lines", "n_dup_lines", "n_lines", (0, 0.05), (0, 0.4), 3),
    Rule("repeats", "n_repeat_words", "n_words", (0, 0.05), (0, 0.2), 20),
    Rule("alpha", "n_alpha_words", "n_words", (0.7, 1), (0.5, 1), 15),
    Rule("kinds", "n_kinds", "n_words", (0.25, 1), (0.12, 1), 50),
)


@dataclass(frozen=True)
class Model:
    """prior: log odds of good. weights: for each rule, the log likelihood ratios of votes -1, 0, 1."""

    prior: float
    weights: tuple[tuple[float, float, float], ...]

    def posterior(self, votes: list[Column]) -> Column:
        logit = F.lit(self.prior)
        for vote, (bad, none, good) in zip(votes, self.weights, strict=True):
            logit = logit + F.when(vote == -1, bad).when(vote == 1, good).otherwise(none)
        return 1 / (1 + F.exp(-logit))


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 100, smooth: float = 1.0, prior_good: float = 0.9) -> Model:
    """EM over counts of vote patterns (at most 3 ** n_rules of them, however many documents).

    Starts from a vote count. Held throughout: a good vote never speaks against a document and
    a bad vote never for it, so the two classes cannot change places; with no patterns, the
    prior alone decides.
    """
    if not patterns:
        return Model(math.log(prior_good / (1 - prior_good)), ((-1.0, 0.0, 1.0),) * n_rules)
    votes = np.array([p for p, _ in patterns], int).reshape(len(patterns), n_rules)
    count = np.array([c for _, c in patterns], float)
    q = 1 / (1 + np.exp(4.0 * (votes == -1).sum(1) - (votes == 1).sum(1)))
    for _ in range(rounds):
        good, bad = count * q, count * (1 - q)
        prior = math.log((good.sum() + smooth * prior_good) / (bad.sum() + smooth * (1 - prior_good)))
        weights = np.zeros((n_rules, 3))
        for r in range(n_rules):
            g = np.array([good[votes[:, r] == v].sum() for v in (-1, 0, 1)]) + smooth
            b = np.array([bad[votes[:, r] == v].sum() for v in (-1, 0, 1)]) + smooth
            weights[r] = np.log(g / g.sum()) - np.log(b / b.sum())
        weights[:, 0] = np.minimum(weights[:, 0], 0)
        weights[:, 1] = 0  # to abstain is no evidence
        weights[:, 2] = np.maximum(weights[:, 2], 0)
        logit = prior + sum(weights[r][votes[:, r] + 1] for r in range(n_rules))
        new = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return Model(prior, tuple(tuple(map(float, w)) for w in weights))


def with_measures(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of `docs` and one long column for each of BASE and MORE, named with `prefix`."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text)
    names = [prefix + n for n in (*BASE, *MORE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(t.as_py()) for t in batch.column(at)]
            new = [pa.array([x[k] for x in found], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    schema = StructType(list(docs.schema.fields))
    for name in names:
        schema = schema.add(name, "long")
    return docs.mapInArrow(run, schema)


def base_failed(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))


def fit_on(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> Model:
    """Fit on every measured document; only the counts of vote patterns reach the driver."""
    names = [f"_v{k}" for k in range(len(rules))]
    counted = measured.select(*(r.vote().alias(n) for r, n in zip(rules, names, strict=True))).groupBy(*names).count()
    return fit([(tuple(row[:-1]), row[-1]) for row in sorted(map(tuple, counted.collect()))], len(rules))


def score_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, the measures, each rule's vote (vote_<name>), p_good, base_failed and kept.

    kept: base rules hold and the posterior is at least `least`. A null text counts as empty
    (and so fails the base rules); null ids and repeated rows come out as they went in, each
    judged alone; an empty table gives an empty one; other columns are ignored, whatever
    their names. Texts are read once; the model is fitted on all documents.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    measured = materialize(with_measures(slim).drop("text"))
    model = fit_on(measured, rules)
    votes = [r.vote() for r in rules]
    p = model.posterior(votes)
    return (
        measured.withColumns({f"vote_{r.name}": v for r, v in zip(rules, votes, strict=True)})
        .withColumn("p_good", p)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
        .withColumnRenamed("doc_id", id_col)
    )


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of `docs` that `score_quality` keeps, with all their columns and repeats.

    Measures are taken once and stand beside the rows in a table; the model is fitted on it, and
    it is filtered. Columns have other names there, so that none can clash.
    """
    names = [f"_q{k}" for k in range(len(docs.columns))]
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    measured = materialize(with_measures(renamed, names[docs.columns.index(text)]))
    good = fit_on(measured, rules).posterior([r.vote() for r in rules]) >= least
    return measured.filter(~base_failed() & good).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
