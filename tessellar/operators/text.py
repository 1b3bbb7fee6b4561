"""Full-text search over a token table: one row for each token of each document, with its position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stop words of the analyser.
STOP_WORDS = (
    "a an and are as at be by for from has have he in is it its of on or she that the they this to was were will with you your"
).split()


def stem(token: Column) -> Column:
    """A light stemmer: one ending is taken off words that stay long enough."""
    ends = lambda s, n: token.endswith(s) & (F.length(token) > n)
    cut = lambda n: F.substring(token, F.lit(1), F.length(token) - n)
    # The endings, and the lengths that a token must exceed to lose them.
    return (
        F.when(ends("ies", 4), F.concat(cut(3), F.lit("y"))).when(ends("es", 3), cut(2)).when(ends("s", 3) & ~token.endswith("ss"), cut(1))
        .when(ends("ing", 5), cut(3)).when(ends("ed", 4), cut(2)).when(ends("ly", 4), cut(2)).otherwise(token)
    )


def _words(text_col: str) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}_]+", " ")), " ")


def word_lists(docs: DataFrame, id_col: str, text_col: str, stemmed: bool = True, stops: bool = True) -> DataFrame:
    """doc, tokens: all tokens of a document in one array, for scores that need no positions and so no shuffle."""
    words = F.array_remove(_words(text_col), "")
    if stops:
        words = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    return docs.select(F.col(id_col).alias("doc"), (F.transform(words, stem) if stemmed else words).alias("tokens"))


def tokens(docs: DataFrame, id_col: str, text_col: str, stemmed: bool = True, stops: bool = True) -> DataFrame:
    """doc, pos, token. Positions count all words, before stop words are dropped."""
    out = docs.select(F.col(id_col).alias("doc"), F.posexplode(_words(text_col)).alias("pos", "_tok")).filter("_tok != ''")
    if stops:
        out = out.filter(~F.col("_tok").isin(STOP_WORDS))
    return out.select("doc", F.col("pos").cast("long").alias("pos"), (stem(F.col("_tok")) if stemmed else F.col("_tok")).alias("token"))


def _counts(toks: DataFrame, terms: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Term counts of the documents that have any, their lengths, and the corpus's one-row statistics. Of word lists each
    row is a document and is counted where it stands; a token table is grouped by document."""
    if "tokens" in toks.columns:
        size = F.size("tokens").cast("long")
        per_doc = toks.select("doc", size.alias("len"), *[(size - F.size(F.array_remove("tokens", t))).alias(f"tf{k}") for k, t in enumerate(terms)]).filter("len > 0")
    else:
        per_doc = toks.groupBy("doc").agg(F.count("*").alias("len"), *[F.sum((F.col("token") == t).cast("long")).alias(f"tf{k}") for k, t in enumerate(terms)])
    stats = per_doc.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.sum((F.col(f"tf{k}") > 0).cast("long")).alias(f"df{k}") for k in range(len(terms))])
    return per_doc.filter(reduce(lambda a, b: a | b, [F.col(f"tf{k}") > 0 for k in range(len(terms))])), per_doc, stats


def tf_idf(toks: DataFrame, terms: list[str]) -> DataFrame:
    """doc, score: the sum over terms of tf/length * ln(N/df). Documents with any of the terms."""
    hits, _, stats = _counts(toks, terms)
    joined = hits.crossJoin(F.broadcast(stats))  # one row
    score = reduce(lambda a, b: a + b, [F.when(F.col(f"tf{k}") > 0, F.col(f"tf{k}") / F.col("len") * F.ln(F.col("n") / F.col(f"df{k}"))).otherwise(0.0) for k in range(len(terms))])
    return joined.select("doc", score.alias("score"))


def bm25(toks: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    hits, _, stats = _counts(toks, terms)
    joined = hits.crossJoin(F.broadcast(stats))  # one row
    parts = []
    for k in range(len(terms)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        parts.append(F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))).otherwise(0.0))
    return joined.select("doc", reduce(lambda x, y: x + y, parts).alias("score"))


def phrase(toks: DataFrame, terms: list[str]) -> DataFrame:
    """Documents in which the terms follow each other, with how often they do. One aggregation, no self-join."""
    starts = toks.filter(F.col("token").isin(terms)).select("doc", F.explode(F.array(*[F.when(F.col("token") == t, F.struct((F.col("pos") - k).alias("at"), F.lit(k).alias("k"))) for k, t in enumerate(terms)])).alias("s")).filter("s is not null")
    whole = starts.groupBy("doc", "s.at").agg(F.count_distinct("s.k").alias("c")).filter(F.col("c") == len(terms))
    return whole.groupBy("doc").agg(F.count("*").alias("hits"))


def prefix(toks: DataFrame, start: str) -> DataFrame:
    return toks.filter(F.col("token").startswith(start)).groupBy("doc").agg(F.count("*").alias("hits"))


def regex(toks: DataFrame, pattern: str) -> DataFrame:
    return toks.filter(F.col("token").rlike(pattern)).groupBy("doc").agg(F.count("*").alias("hits"))


def fuzzy(toks: DataFrame, term: str, most: int = 2) -> DataFrame:
    """Documents with a token within `most` edits; score 1 - distance / longer length, of the best token. Lengths are
    compared before any distance is taken."""
    near = toks.filter(F.abs(F.length("token") - len(term)) <= most).withColumn("d", F.levenshtein("token", F.lit(term))).filter(F.col("d") <= most)
    return near.groupBy("doc").agg(F.max(1 - F.col("d") / F.greatest(F.length("token"), F.lit(len(term)))).alias("score"))


def boolean(toks: DataFrame, all_of: list[str] = (), any_of: list[str] = (), none_of: list[str] = ()) -> DataFrame:
    """Documents by required, optional and forbidden terms, in one aggregation."""
    has = lambda t: F.max((F.col("token") == t).cast("int")) == 1
    conds = [has(t) for t in all_of] + [~has(t) for t in none_of]
    if any_of:
        conds.append(reduce(lambda a, b: a | b, [has(t) for t in any_of]))
    return toks.groupBy("doc").agg(reduce(lambda a, b: a & b, conds).alias("ok")).filter("ok").select("doc")


def exact_hits(toks: DataFrame, terms: list[str]) -> DataFrame:
    """A point for each exact occurrence of a term."""
    return toks.filter(F.col("token").isin(list(terms))).groupBy("doc").agg(F.count("*").cast("double").alias("score"))


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int = 0) -> DataFrame:
    """doc, chunk, text: runs of `size` words, each starting size - overlap words after the one before; the last may be
    short. Texts without words have none."""
    words = F.filter(F.split(F.coalesce(text_col, F.lit("")), r"\s+"), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("doc"), words.alias("_w")).filter(F.size("_w") > 0)
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.size("_w") - overlap) / step).cast("int"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.select("doc", F.col("chunk").cast("long").alias("chunk"), F.array_join(F.slice("_w", F.col("chunk") * step + 1, F.lit(size)), " ").alias("text"))
