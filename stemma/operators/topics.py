"""Topics of heading blocks, where a block's score depends on the topic its predecessor got.

What needs Python (difflib's ratio of a heading to aliases, hashed embeddings against the topics'
prototypes as one matrix product a batch) is computed once a block; scores are column expressions over
an array of topics, and the walk along a document's blocks is a fold over an array.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import excluded, keyword_score
from .chunks import hashed_counts

THRESHOLD, STRONG_THRESHOLD = 0.55, 0.45
NEIGHBOUR_BONUS = 0.2
#: Blocks whose embeddings are multiplied with the prototypes at a time.
PRODUCT_ROWS = 1024


def heading_match(heading: str, aliases: list[str]) -> float:
    """Best likeness of a heading to its aliases: 1 if one occurs whole, else difflib's ratio from 0.6 on."""
    h = heading.lower()
    best = 0.0
    for alias in aliases:
        a = alias.lower()
        best = max(best, 1.0 if a and a in h else SequenceMatcher(None, h, a).ratio())
    return best if best >= 0.6 else 0.0


def prototype(topic: dict) -> str:
    """The text whose embedding stands for a topic: its own, or its aliases and keywords."""
    return topic.get("prototype") or " ".join([*topic.get("aliases", ()), *topic.get("keywords", ())])


def cosines(texts: list[str], prototypes: np.ndarray, memo: dict) -> np.ndarray:
    """Text by prototype: the cosines of hashed counts, negative ones as 0; 0 where either has no tokens."""
    lengths = np.sqrt((prototypes**2).sum(axis=1))
    out = np.zeros((len(texts), len(prototypes)))
    for at in range(0, len(texts), PRODUCT_ROWS):
        x = np.array([hashed_counts(t, memo=memo) for t in texts[at : at + PRODUCT_ROWS]])
        both = np.sqrt((x**2).sum(axis=1))[:, None] * lengths
        out[at : at + PRODUCT_ROWS] = np.divide(np.maximum(x @ prototypes.T, 0), both, out=np.zeros_like(both), where=both > 0)
    return out


def likeness(heading: Column, text: Column, topics: list[dict]) -> Column:
    """For every topic the likeness of the heading to its aliases, and the cosine of heading and text to its prototype."""
    aliases = [t.get("aliases", []) for t in topics]
    prototypes = np.array([hashed_counts(prototype(t)) for t in topics])

    @F.pandas_udf("struct<heading: array<double>, cosine: array<double>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for headings, texts in batches:
            if len(memo) > 500_000:
                memo.clear()
            heads = [h or "" for h in headings]
            near = cosines([f"{h} {t or ''}" for h, t in zip(heads, texts)], prototypes, memo)
            yield pd.DataFrame({"heading": [[heading_match(h, a) for a in aliases] for h in heads], "cosine": list(near)})

    return run(heading, text)


def block_score(embedding: Column, heading: Column, keywords: Column, prior: Column, neighbour: bool) -> Column:
    """0.5 embedding + 0.3 heading or keywords + 0.2 zone prior; without an embedding 0.5 and 0.3 of the latter two.

    An unclear block gets a bonus for its predecessor's topic, a strong heading 1.2 times its score,
    and a prior under 0.2 leaves a fifth.
    """
    named = F.greatest(heading, 0.7 * keywords)
    s = F.when(embedding > 0, 0.5 * embedding + 0.3 * named + 0.2 * prior).otherwise(0.5 * named + 0.3 * prior)
    if neighbour:
        s = s + F.when((heading < 0.4) & (keywords < 0.4), NEIGHBOUR_BONUS).otherwise(0.0)
    s = F.least(F.lit(1.0), s)
    s = F.when(heading > 0.7, F.least(F.lit(1.0), 1.2 * s)).otherwise(s)
    return s * F.when(prior < 0.2, 0.2).otherwise(1.0)


def _dimension(topics: list[dict]) -> Column:
    """The topics as an array of structs."""
    words = lambda xs: F.array(*(F.lit(x.lower()) for x in xs)).cast("array<string>")
    priors = lambda p: F.create_map(*(F.lit(v) for kv in p.items() for v in kv)).cast("map<string,double>")
    return F.array(*(F.struct(words(t.get("keywords", ())).alias("keywords"), priors(t.get("priors", {})).alias("priors"), words(t.get("exclude", ())).alias("exclude")) for t in topics))


def scored(blocks: DataFrame, topics: list[dict]) -> DataFrame:
    """Adds scores: per topic, in order, plain (its score), after (if the block before had the topic) and least (its threshold); excluded topics score 0."""
    heading, text = F.coalesce("heading", F.lit("")), F.coalesce("text", F.lit(""))
    b = blocks.withColumn("_like", likeness(heading, text, topics)).withColumn("_head", F.lower(heading)).withColumn("_all", F.lower(F.concat_ws(" ", heading, text)))

    def one(t: Column, i: Column) -> Column:
        prior = F.coalesce(F.try_element_at(t["priors"], F.col("zone")), F.lit(0.5))
        parts = (F.get(F.col("_like.cosine"), i), F.get(F.col("_like.heading"), i), keyword_score(F.col("_all"), t["keywords"]), prior)
        out = excluded(F.col("_head"), t["exclude"])
        least = F.when(prior >= 0.7, STRONG_THRESHOLD).otherwise(THRESHOLD)
        return F.struct(F.when(out, 0.0).otherwise(block_score(*parts, False)).alias("plain"), F.when(out, 0.0).otherwise(block_score(*parts, True)).alias("after"), least.alias("least"))

    return b.withColumn("scores", F.transform(_dimension(topics), one)).drop("_like", "_head", "_all")


def walk(scores: Column) -> Column:
    """A document's blocks, each an array of scores, in order: for each the topic (from 1, 0 if none reaches its threshold) and the score."""
    best = "struct<score:double,topic:int,least:double>"
    state = "struct<before:int,out:array<struct<topic:int,score:double>>>"

    def chosen(block: Column, before: Column) -> Column:
        numbered = F.transform(block, lambda t, i: F.struct(F.when(i + 1 == before, t["after"]).otherwise(t["plain"]).alias("score"), (i + 1).alias("topic"), t["least"].alias("least")).cast(best))
        nothing = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("topic"), F.lit(1.0).alias("least")).cast(best)
        return F.aggregate(numbered, nothing, lambda a, t: F.when(t["score"] > a["score"], t).otherwise(a))

    def step(at: Column, block: Column) -> Column:
        # a one-element array binds the choice once
        def go_on(c: Column) -> Column:
            topic = F.when(c["score"] >= c["least"], c["topic"]).otherwise(0)
            return F.struct(topic.alias("before"), F.concat(at["out"], F.array(F.struct(topic.alias("topic"), c["score"].alias("score")))).alias("out")).cast(state)

        return F.get(F.transform(F.array(chosen(block, at["before"])), go_on), F.lit(0))

    start = F.struct(F.lit(0).alias("before"), F.array().alias("out")).cast(state)
    return F.aggregate(scores, start, step, lambda at: at["out"])


def assign(blocks: DataFrame, topics: list[dict]) -> DataFrame:
    """doc_id, block_no, topic, score of blocks (doc_id, block_no, heading, text, zone): the best topic over its threshold.

    ``topics``: key, aliases, keywords, priors (zone to weight), exclude, prototype. Each block sees the
    topic assigned before it, along a document; ties go to the topic listed first.
    """
    docs = scored(blocks, topics).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "scores"))).alias("b"))
    found = F.arrays_zip(F.transform("b", lambda x: x["block_no"]).alias("block_no"), walk(F.transform("b", lambda x: x["scores"])).alias("found"))
    one = docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.block_no", "x.found.*")
    names = F.array(*(F.lit(t["key"]) for t in topics))
    return one.select("doc_id", "block_no", F.when(F.col("topic") > 0, F.get(names, F.col("topic") - 1)).alias("topic"), F.when(F.col("topic") > 0, F.col("score")).alias("score"))


def topic_maps(assigned: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, topic, blocks, anchor_ids, confidence: the blocks of each topic and their units as evidence.

    ``members``: doc_id, block_no, para_index, anchor_id. Confidence is the mean score of the blocks.
    """
    got = assigned.filter("topic IS NOT NULL").select("doc_id", "block_no", "topic", "score")
    scores = got.groupBy("doc_id", "topic").agg(F.array_sort(F.collect_list("block_no")).alias("blocks"), F.round(F.avg("score"), 6).alias("confidence"))
    units = got.join(members, ["doc_id", "block_no"]).groupBy("doc_id", "topic").agg(F.array_sort(F.collect_list(F.struct("para_index", "anchor_id"))).alias("a"))
    return scores.join(units, ["doc_id", "topic"]).select("doc_id", "topic", "blocks", F.transform("a", lambda x: x["anchor_id"]).alias("anchor_ids"), "confidence")
