"""Evaluation texts leaking into training text, by a positional inverted index (problem 8).

The index holds every word of the corpus. It is built once, in segments of whole documents,
each sorted by term; evaluation sets are looked up in it by joins, as often as wanted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators.skew import hot_keys, lookup
from strataline.session import Stored, partitions

WORD = re.compile(r"[^\W_]+")
#: Words of one segment of the index, about; a document is never divided.
SEGMENT_WORDS = 300_000

_POSTINGS = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("docs", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("at", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
_POSTINGS_SQL = "segment long, term string, docs array<int>, n array<int>, at array<int>, ids array<long>"


def words(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits, without case."""
    return WORD.findall((text or "").lower())


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int32)))


def _segment(number: int, ids: list[int], tokens: list[str], lens: list[int]) -> pa.RecordBatch:
    """The postings of some documents, sorted by term, and a row without a term that lists them."""
    coded = pa.array(tokens, pa.string()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    term = rank[coded.indices.to_numpy()]
    doc = np.repeat(np.arange(len(ids)), lens)
    ends = np.cumsum(lens)
    at = np.arange(len(term)) - np.repeat(ends - lens, lens)
    by = np.argsort(term, kind="stable")  # documents and positions ascend within a term
    term, doc, at = term[by], doc[by], at[by]
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])  # of each term and document
    t = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])  # of each term
    per = np.r_[np.searchsorted(first, t), len(first)]
    k = len(t)
    columns = [
        pa.array(np.full(k, number, np.int64)), coded.dictionary.take(pa.array(order)), _lists(doc[first], per),
        _lists(np.diff(np.r_[first, len(term)]), per), _lists(at, np.r_[t, len(term)]), pa.nulls(k, pa.list_(pa.int64())),
    ]
    some = pa.RecordBatch.from_arrays(columns, schema=_POSTINGS)
    whole = pa.RecordBatch.from_pydict({"segment": [number], "term": [None], "docs": [None], "n": [None], "at": [None], "ids": [ids]}, schema=_POSTINGS)
    return pa.concat_batches([whole, some])


def _index(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        tokens: list[str] = []
        lens: list[int] = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(text)
                if not w:
                    continue
                ids.append(doc)
                tokens += w
                lens.append(len(w))
                if len(tokens) >= limit:
                    yield _segment(base + made, ids, tokens, np.array(lens))
                    ids, tokens, lens, made = [], [], [], made + 1
        if ids:
            yield _segment(base + made, ids, tokens, np.array(lens))

    return run


class Index:
    """Positional inverted index of all words of ``docs`` (doc_id, text).

    One pass, no shuffle: rows (segment, term, docs, n, at) hold for each term of a segment
    the documents it occurs in, how often in each, and its positions; one row of a segment
    without a term lists its document ids. Null and empty texts and rows with a null id have
    no postings; documents that share an id or a text are indexed each.
    """

    def __init__(self, docs: DataFrame, segment_words: int = SEGMENT_WORDS):
        src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
        self.stored = Stored(src.mapInArrow(_index(segment_words), _POSTINGS_SQL), "postings")

    def read(self) -> DataFrame:
        return self.stored.read()

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """(term, df): how many documents hold each of ``terms`` (term); absent ones have no row."""
        some = self.read().where(F.col("term").isNotNull()).select("term", F.size("docs").alias("k"))
        return some.join(terms.distinct(), "term", "left_semi").groupBy("term").agg(F.sum("k").alias("df"))


def _phrases(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, w) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if len(w := words(text)) >= length]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["item_id", "terms"])

    return run


def _anchors(length: int):
    """(phrase, off, term): the rarest term of every window whose terms all occur in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, terms, dfs in zip(*(c.to_pylist() for c in b.columns)):
                df = np.array([1 << 62 if d is None else d for d in dfs], np.int64)
                windows = np.lib.stride_tricks.sliding_window_view(df, length)
                offs = np.arange(len(windows)) + windows.argmin(axis=1)
                out += [(p, int(o), terms[o]) for o in np.unique(offs[windows.max(axis=1) < 1 << 62])]
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.string()))], names=["phrase", "off", "term"])

    return run


def _alignments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, doc, phrase, diag, off): the places where an anchor stands in a document."""
    for b in batches:
        cols = {c: b.column(c) for c in b.schema.names}
        seg, phrase, off = (cols[c].to_numpy() for c in ("segment", "phrase", "off"))
        k = np.diff(cols["at"].offsets.to_numpy())
        at = cols["at"].flatten().to_numpy()
        doc = np.repeat(cols["docs"].flatten().to_numpy(), cols["n"].flatten().to_numpy())
        offs = np.repeat(off, k)
        arrays = [np.repeat(seg, k), doc, np.repeat(phrase, k), (at - offs).astype(np.int32), offs]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["segment", "doc", "phrase", "diag", "off"])


def _near(at: list[np.ndarray], off: int, pos: int, slop: int) -> int:
    """Most consecutive item words in order around item word ``off`` at ``pos``, with at most
    ``slop`` other words between two of them. ``at`` has the positions of each item word."""
    n = 1
    for step in (1, -1):
        k, reached = off + step, np.array([pos])
        while 0 <= k < len(at):
            p = at[k]
            # positions from which some reached one is near enough, on the right side
            lo, hi = (reached + 1, reached + slop + 1) if step > 0 else (reached - slop - 1, reached - 1)
            some = [p[np.searchsorted(p, a) : np.searchsorted(p, b, side="right")] for a, b in zip(lo, hi)]
            reached = np.unique(np.concatenate(some))
            if not len(reached):
                break
            k, n = k + step, n + 1
    return n


def _intersect(length: int, slop: int):
    """(doc_id, item_id, run, near, start) of the segments of a task, which come sorted."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    names = ["doc_id", "item_id", "run", "near", "start"]

    def segment(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        kind = t.column("kind").to_numpy()
        ids = t.column("ids")[int(np.flatnonzero(kind == 0)[0])].as_py()
        keys: dict[str, np.ndarray] = {}  # document << 32 | position, ascending
        for r in t.filter(pa.array(kind == 1)).select(["term", "docs", "n", "at"]).to_batches():
            for term, d, n, at in zip(*(r.column(c) for c in r.schema.names)):
                docs = np.repeat(d.values.to_numpy().astype(np.int64), n.values.to_numpy())
                keys[term.as_py()] = docs << 32 | at.values.to_numpy()
        phrases = {r["phrase"]: (r["item_id"], r["terms"]) for r in t.filter(pa.array(kind == 2)).select(["phrase", "item_id", "terms"]).to_pylist()}
        c = t.filter(pa.array(kind == 3))
        doc, phrase, diag, off = (c.column(x).to_numpy().astype(np.int64) for x in ("doc", "phrase", "diag", "off"))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        none = np.zeros(0, np.int64)
        for p in np.unique(phrase):
            item, terms = phrases[int(p)]
            mine = np.flatnonzero(phrase == p)
            d, g = doc[mine], diag[mine]
            run, most, start = (np.zeros(len(mine), np.int64) for _ in range(3))
            for k, term in enumerate(terms):  # one list after the other, shifted by its place in the item
                have = keys.get(term, none)
                want = d << 32 | np.maximum(g + k, 0)
                i = np.searchsorted(have, want)
                here = (i < len(have)) & (g + k >= 0)
                here[here] = have[i[here]] == want[here]
                run = np.where(here, run + 1, 0)
                longer = run > most
                most = np.where(longer, run, most)
                start = np.where(longer, g + k - run + 1, start)
            near = most.copy()
            if slop:
                for j in np.flatnonzero(most < length):
                    lists = [keys.get(x, none) for x in terms]
                    own = [x[np.searchsorted(x, d[j] << 32) : np.searchsorted(x, (d[j] + 1) << 32)] & 0xFFFFFFFF for x in lists]
                    o = int(off[mine[j]])
                    near[j] = max(most[j], _near(own, o, int(g[j]) + o, slop))
            for j in np.flatnonzero(near >= length):
                to, row = (int(d[j]), item), (int(most[j]), int(near[j]), int(start[j]))
                if to not in best or row > best[to]:
                    best[to] = row
        cols = list(zip(*((ids[d], i, *row) for (d, i), row in best.items()))) if best else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            seg = b.column("segment").to_numpy()
            cuts = np.r_[0, np.flatnonzero(seg[1:] != seg[:-1]) + 1, len(seg)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if held and seg[s] != now:
                    yield segment(held)
                    held = []
                now = seg[s]
                held.append(b.slice(s, e - s))
        if held:
            yield segment(held)

    return run


def leaks(docs: DataFrame | Index, items: DataFrame, fields: tuple[str, ...] = ("intent", "expected"), length: int = 13, slop: int = 0) -> DataFrame:
    """(doc_id, item_id, run, near, start): documents that hold passages of the items.

    ``docs`` is a corpus or its ``Index``. A document holds an item if at least ``length``
    consecutive words of one of its ``fields`` stand in the text one after another (``run``,
    starting at word ``start``); with ``slop`` also if they stand in order with at most
    ``slop`` other words between two of them (``near``). One row per document and item, the
    longest match. Words are runs of letters and digits without case. Items shorter than
    ``length`` words match nothing; null and empty texts hold nothing; rows with a null id
    are ignored; repeated documents and items count once; other columns are not read.

    Every window of ``length`` item words is looked up by its rarest term alone; where that
    stands in a document, the lists of the item's other terms are shifted by their offset
    and intersected, segment by segment. Neither side is collected or broadcast by hand: an
    evaluation set of any size is joined with the index.
    """
    index = docs if isinstance(docs, Index) else Index(docs)
    parts = partitions(items.sparkSession)
    each = F.explode(F.array(*[F.col(f"`{f}`") for f in fields])).alias("text")
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), each).dropna(how="any").distinct()
    phrases = Stored(texts.mapInArrow(_phrases(length), "item_id long, terms array<string>").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    ph = phrases.read()
    terms = ph.select("phrase", F.posexplode("terms").alias("k", "term"))
    rarity = terms.join(index.frequencies(terms.select("term")), "term", "left")
    dfs = rarity.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("k", "df"))).alias("x")).select("phrase", F.col("x.df").alias("dfs"))
    anchors = ph.select("phrase", "terms").join(dfs, "phrase").mapInArrow(_anchors(length), "phrase long, off int, term string")

    postings = index.read()
    hits = postings.where(F.col("term").isNotNull()).join(anchors, "term").select("segment", "phrase", "off", "docs", "n", "at")
    found = hits.mapInArrow(_alignments, "segment long, doc int, phrase long, diag int, off int")
    cands = Stored(found if slop else found.groupBy("segment", "doc", "phrase", "diag").agg(F.min("off").alias("off")), "alignments")
    here = cands.read().select("segment", "phrase").distinct()
    asked = Stored(lookup(here, ph, "phrase", "inner", hot_keys(here, "phrase")), "asked")
    needed = asked.read().select("segment", F.explode("terms").alias("term")).distinct()
    lists = postings.where(F.col("term").isNotNull()).join(needed, ["segment", "term"], "left_semi")
    heads = postings.where(F.col("term").isNull()).join(here.select("segment").distinct(), "segment", "left_semi")

    columns = {"term": "string", "docs": "array<int>", "n": "array<int>", "at": "array<int>", "ids": "array<long>", "phrase": "long", "item_id": "long", "terms": "array<string>", "doc": "int", "diag": "int", "off": "int"}

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        return df.select("segment", F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])

    rows = shaped(heads, 0).unionByName(shaped(lists, 1)).unionByName(shaped(asked.read(), 2)).unionByName(shaped(cands.read(), 3))
    sorted_ = rows.repartition(parts, "segment").sortWithinPartitions("segment", "kind")
    out = sorted_.mapInArrow(_intersect(length, slop), "doc_id long, item_id long, run int, near int, start int")
    # a document id may carry several texts
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("run", "near", "start")).alias("m")).select("doc_id", "item_id", "m.run", "m.near", "m.start")
