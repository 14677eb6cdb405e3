"""Full-text search: an inverted index as a table, BM25 scores, boolean and fuzzy terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestfold.plans.lineage import materialize


def inverted_index(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """term, id, tf (times in the text), dl (the text's terms) and head (true in one row of each text).

    A text's words are sorted and counted inside its row, so that no word is shuffled. Texts of
    one id are one document, which `search` puts together.
    """
    words = F.sort_array(F.array_remove(F.split(F.lower(F.col(text)), r"\W+"), ""))
    split = df.select(F.col(id_col).alias("id"), words.alias("words"))  # once a document, not once a word
    starts = F.array_compact(F.transform("words", lambda w, i: F.when(~w.eqNullSafe(F.get("words", i - 1)), i)))
    cut = split.select("id", "words", starts.alias("starts"))
    length = lambda at, k: F.coalesce(F.get("starts", k + 1), F.size("words")) - at
    # Made in the array: posexplode of the starts, beside the words, was stopped at 0.1 GB after more than ten times as long.
    terms = F.transform("starts", lambda at, k: F.struct(F.get("words", at).alias("term"), length(at, k).cast("long").alias("tf"), (at == 0).alias("head")))
    return cut.select("id", F.size("words").alias("dl"), F.inline(terms)).select("term", "id", "dl", "tf", "head")


def search(index: DataFrame, must: list[str] = (), should: list[str] = (), must_not: list[str] = (), k1: float = 1.2, b: float = 0.75, fuzzy: int = 0) -> DataFrame:
    """id and score (BM25) of the documents with all of `must`, or any of `should`, and none of `must_not`.

    fuzzy: terms within this edit distance of a wanted one count as it.
    """
    wanted = sorted({*must, *should, *must_not})
    lengths = materialize(index.filter("head").groupBy("id").agg(F.sum("dl").alias("dl")))  # one row for each document, so that the index is read once for them
    docs = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    if fuzzy:
        near = F.array(*[F.when(F.levenshtein(F.col("term"), F.lit(w)) <= fuzzy, F.lit(w)) for w in wanted])
        hits = index.select("id", "tf", F.explode(F.filter(near, lambda x: x.isNotNull())).alias("term"))
    else:
        hits = index.filter(F.col("term").isin(wanted))
    hits = hits.groupBy("term", "id").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(lengths, "id").join(F.broadcast(df), "term").crossJoin(F.broadcast(docs))  # one row for each wanted term, and one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    found = scored.groupBy("id").agg(F.sum(F.when(~F.col("term").isin(list(must_not)), part) if must_not else part).alias("score"), F.collect_set("term").alias("terms"))
    for w in must:
        found = found.filter(F.array_contains("terms", w))
    if should and not must:
        found = found.filter(F.arrays_overlap("terms", F.array(*map(F.lit, should))))
    for w in must_not:
        found = found.filter(~F.array_contains("terms", w))
    return found.select("id", "score")


def scan_search(df: DataFrame, id_col: str, text: str, must: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id and BM25 score of the documents with all of `must`, without an index: one scan of the texts, no shuffle of terms.

    Times of the wanted terms are counted inside each document, without splitting it; only one
    row of statistics is broadcast.
    """
    low = df.select(F.col(id_col).alias("id"), F.lower(F.col(text)).alias("low"))
    tf = lambda term: F.regexp_count("low", F.lit(rf"(?<!\w)\Q{term}\E(?!\w)"))
    counted = low.select("id", F.regexp_count("low", F.lit(r"\w+")).alias("dl"), *[tf(w).alias(f"tf{k}") for k, w in enumerate(must)])
    filled = materialize(counted.filter("dl > 0"))  # counts only, so that texts are read once
    stats = filled.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{k}") > 0).cast("long")).alias(f"df{k}") for k in range(len(must))])
    hits = filled
    for k in range(len(must)):
        hits = hits.filter(F.col(f"tf{k}") > 0)
    hits = hits.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k in range(len(must)):
        t, d = F.col(f"tf{k}"), F.col(f"df{k}")
        score = score + F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5)) * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.select("id", score.alias("score"))
