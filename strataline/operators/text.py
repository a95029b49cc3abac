"""Text search: Porter stems, BM25 over an inverted index, literal content search."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.text import sanitize
from strataline.operators import relational as R



def _form(w: str) -> str:
    """Consonant and vowel pattern: y is a vowel behind a consonant."""
    out = []
    for i, c in enumerate(w):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _m(w: str) -> int:
    return len(re.findall("v+c+", _form(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _form(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return _form(w)[-3:] == "cvc" and w[-1] not in "wxy"


# Suffixes of Porter's steps 2, 3 and 4 (public algorithm)
_STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate",
    ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


@functools.lru_cache(maxsize=1 << 16)
def stem(w: str) -> str:
    """Porter stem of a lower-case ASCII word; other words are their own stem."""
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _form(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _m(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _form(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = max((s for s in table if w.endswith(s)), key=len, default=None)
        if end and _m(w[: -len(end)]):
            w = w[: -len(end)] + table[end]
    end = max((s for s in _STEP4 if w.endswith(s)), key=len, default=None)
    if end and _m(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (_m(w[:-1]) > 1 or (_m(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def inverted_index(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(term, key, tf, length): stemmed terms of the joined fields. Only distinct words reach Python."""
    text = F.concat_ws(" ", *fields)
    w = docs.select(key, words(text).alias("w")).select(key, F.size("w").alias("length"), F.explode("w").alias("word"))
    tf = w.groupBy(key, "length", "word").agg(F.count(F.lit(1)).alias("tf"))

    def stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "term": [stem(x) for x in b["word"]]})

    table = tf.select("word").distinct().mapInPandas(stems, "word string, term string")
    return tf.join(table, "word").groupBy("term", key, "length").agg(F.sum("tf").alias("tf"))


def bm25(index: DataFrame, key: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score): documents that hold all terms of the query, the last one as a prefix.

    The query keeps ASCII letters, digits and underscores only. An empty query finds nothing.
    """
    q = [x for x in re.split(r"[^a-z0-9]+", sanitize(query).lower()) if x]
    if not q:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    spark = index.sparkSession
    docs = index.groupBy(key, "length").agg(F.lit(1).alias("one"))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg"))
    hits = None
    for i, word in enumerate(q):
        t = F.col("term")
        cond = t.startswith(stem(word)) if i == len(q) - 1 else t == stem(word)
        h = index.where(cond).groupBy(key, "length").agg(F.sum("tf").alias("tf")).withColumn("i", F.lit(i))
        hits = h if hits is None else hits.unionByName(h)
    df = hits.groupBy("i").agg(F.count(F.lit(1)).alias("df"))
    x = hits.join(F.broadcast(df), "i").crossJoin(F.broadcast(stats))  # one row of totals, one per query word
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg")))
    return x.groupBy(key).agg(F.sum(part).alias("score"), F.count_distinct("i").alias("found")).where(F.col("found") == len(set(range(len(q))))).select(key, F.round("score", 6).alias("score"))


def content_search(docs: DataFrame, key: str, text: str, literal: str, per_file: int | None = None, width: int = 200) -> DataFrame:
    """(key, line, source): lines that hold a literal text, cut to ``width``; at most ``per_file`` a document if given."""
    lines = docs.where(F.col(text).contains(literal)).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("at", "s")).where(F.col("s").contains(literal))
    out = lines.select(key, (F.col("at") + 1).alias("line"), F.substring("s", 1, width).alias("source"))
    return out if per_file is None else R.top_within(out, [key], ["line"], per_file)
