"""Mixing sources to target weights by pivotal dependent rounding (problem 9)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.session import BROADCAST_BYTES, Stored, partitions

#: Where the public tokenizer's ranks lie, and its split pattern, unless given.
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Residuals that one node of the reduction tree combines.
FAN_IN = 256
#: Documents that one leaf of the tree rounds.
NODE_ROWS = 20_000
_EPS = 1e-12


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, source, h, tokens): size of every document in tokens of a public tokenizer.

    Whole texts; a null or empty text has no tokens. Copies of one text within a task's
    batch are counted once. The vocabulary file is read by each task from ``path``. ``h`` is
    a hash of the text.
    """
    import public_tokenizers

    path, pattern = path or tokenizer_path(), pattern or public_tokenizers.PATTERN

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or _encoding(path, pattern)
            known: dict[str, int] = {}
            out = []
            for t in b.column("text").to_pylist():
                if not t:
                    out.append(0)
                    continue
                if t not in known:
                    known[t] = _length(enc, t)
                out.append(known[t])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("h"), pa.array(out, pa.int64())], names=["doc_id", "source", "h", "tokens"])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "source")}
    rows = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(count, f"doc_id {kinds['doc_id']}, source {kinds['source']}, h long, tokens long")


def _length(enc, text: str) -> int:
    try:
        return len(enc.encode_ordinary(text))
    except UnicodeEncodeError:  # lone surrogates
        return len(enc.encode_ordinary(text.encode("utf-8", "replace").decode()))


def _pivot(sizes: np.ndarray, probs: np.ndarray, coins: np.ndarray) -> tuple[np.ndarray, int]:
    """Round ``probs`` in order: (0 or 1 of each, -1 for the one left over; its index or -1).

    Two fractional copies exchange token mass, one gaining what the other loses, until one
    of them is whole. The direction is drawn so that each keeps its expectation, and
    ``sum(sizes * probs)`` never changes.
    """
    p = probs.astype(np.float64).copy()
    held = -1
    for k in range(len(p)):
        if p[k] <= _EPS or p[k] >= 1 - _EPS:
            p[k] = round(p[k])
            continue
        if held < 0:
            held = k
            continue
        a, b = sizes[held] * p[held], sizes[k] * p[k]
        a_up, b_up = sizes[held] - a, sizes[k] - b
        up, down = min(a_up, b), min(a, b_up)  # mass that can move to held, to k
        if coins[k] * (up + down) < down:
            a, b = a + up, b - up
        else:
            a, b = a - down, b + down
        p[held], p[k] = a / sizes[held], b / sizes[k]
        fractional = [i for i in (held, k) if _EPS < p[i] < 1 - _EPS]
        for i in (held, k):
            if i not in fractional:
                p[i] = round(p[i])
        held = fractional[0] if fractional else -1
    out = np.where((p <= _EPS) | (p >= 1 - _EPS), np.round(p), -1).astype(np.int64)
    return out, held


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round the rows of a task, group by group; they come sorted by node.

    The left-over row of a group comes out with copies -1 and its new probability.
    """
    names = ["node", "source", "uid", "tokens", "p", "coin", "extra"]

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        size = t.column("tokens").to_numpy(zero_copy_only=False).astype(np.float64)
        p = t.column("p").to_numpy(zero_copy_only=False).astype(np.float64)
        coin = t.column("coin").to_numpy(zero_copy_only=False)
        mass = float((size * p).sum())
        whole, left = _pivot(size, p, coin)
        new = whole.astype(np.float64)
        if left >= 0:  # the mass not yet placed
            rest = (mass - float((size * np.maximum(whole, 0)).sum())) / size[left]
            new[left] = min(max(rest, 0.0), 1.0)
        return pa.RecordBatch.from_arrays([t.column(c) for c in names[:4]] + [pa.array(new), t.column("coin"), pa.array(whole)], names=names)

    node, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column("node").to_pylist()
        cuts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if held and keys[s] != node:
                yield done(held)
                held = []
            node = keys[s]
            held.append(b.slice(s, e - s))
    if held:
        yield done(held)


def plan_shares(totals: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, documents, wanted): tokens to draw from each source.

    ``totals`` has (source, available, documents). Without ``total_tokens`` the mix is as large as it
    can be with every source at its share: the least of max_repeats x available /
    target_share. A larger ``total_tokens`` is cut to that. A targeted source without
    tokens has no share to give: the other shares keep their proportions. Shares are
    normalised to sum 1; null or non-positive shares and repeats take no part; of repeated
    rows of one source the largest share holds.
    """
    t = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & F.col("source").isNotNull())
    t = t.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.target_share", "t.max_repeats")
    x = t.join(totals.where(F.col("available") > 0), "source")
    mass = x.agg(F.round(F.sum("target_share"), 12).alias("sum_share"))  # whatever the order of the sum
    x = x.crossJoin(F.broadcast(mass)).withColumn("share", F.col("target_share") / F.col("sum_share"))  # one row beside the few sources
    most = x.agg(F.min(F.col("max_repeats") * F.col("available") / F.col("share")).alias("most"))
    size = F.col("most") if total_tokens is None else F.least(F.col("most"), F.lit(float(total_tokens)))
    return x.crossJoin(F.broadcast(most)).select("source", "target_share", "max_repeats", "available", "documents", (F.col("share") * size).alias("wanted"))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each document is used, rows with copies > 0.

    Every document of a source is expected ``wanted / available`` times (at most
    ``max_repeats``). Its whole part is given; the fractional copies are rounded by the
    pivotal method on token mass, so the tokens of a source meet their target up to part of
    one document. Documents stay spread over tasks: they are rounded in nodes of bounded
    size, each leaving at most one fractional document, and the left-overs are combined by
    a tree with fan-in FAN_IN; the last of a source is drawn. A source with a third of all
    rows is therefore many nodes. Draws depend on ``seed``, the document's id, its text and,
    for repeated rows, the number of the repetition, never on how the rows are stored.

    Documents of sources without a target, with a null source or without tokens are not
    used; repeated rows are documents of their own. Empty tables give an empty mix.
    """
    some = token_counts(docs, path).where((F.col("tokens") > 0) & F.col("source").isNotNull())
    times = some.groupBy("doc_id", "source", "h", "tokens").agg(F.count(F.lit(1)).alias("times"))
    each = times.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    name = F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull().cast("string"), F.hex("h"), "source", F.col("nth").cast("string"))
    counts = Stored(each.select("doc_id", "source", "tokens", F.unhex(F.md5(name)).alias("uid")), "tokens")
    c = counts.read()
    totals = c.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
    shares = Stored(plan_shares(totals, targets, total_tokens), "shares")
    # one row per targeted source, however many documents there are
    wanted = shares.read().select(
        "source", F.least(F.col("wanted") / F.col("available"), F.col("max_repeats").cast("double")).alias("x"), F.ceil(F.col("documents") / NODE_ROWS).alias("nodes")
    )
    width = shares.read().agg(F.max(F.ceil(F.col("documents") / NODE_ROWS))).first()[0] or 1
    d = c.join(F.broadcast(wanted) if shares.bytes() <= BROADCAST_BYTES else wanted, "source").withColumn("base", F.floor(F.col("x") + F.lit(1e-9)))
    d = d.withColumn("p", F.greatest(F.col("x") - F.col("base"), F.lit(0.0)))
    coin = (F.pmod(F.xxhash64("uid", "tokens", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("coin")
    # neighbours in size are paired, so little mass moves; large ones first, so that a small one is left over
    parts = partitions(docs.sparkSession)
    cols = ["node", "source", "uid", "tokens", "p", "coin"]
    slot = F.pmod(F.xxhash64("uid", F.lit(seed)), F.col("nodes"))
    level = d.where(F.col("p") > 0).select(F.concat_ws("|", "source", slot.cast("string")).alias("node"), "source", "uid", "tokens", "p", coin)
    schema = "node string, source string, uid binary, tokens long, p double, coin double, extra long"
    settled = None
    while True:
        out = Stored(level.repartition(parts, "node").sortWithinPartitions("node", F.desc("tokens"), "uid").select(*cols).mapInArrow(_round, schema), "rounded")
        rows = out.read()
        whole = rows.where(F.col("extra") > 0).select("uid", "extra")
        settled = whole if settled is None else settled.unionByName(whole)
        left = rows.where(F.col("extra") < 0)
        if width <= 1:
            last = left.where(F.col("coin") < F.col("p")).select("uid", F.lit(1).cast("long").alias("extra"))
            settled = settled.unionByName(last)
            break
        width = max(1, width // FAN_IN)
        slot = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(width))
        level = left.select(F.concat_ws("|", "source", slot.cast("string")).alias("node"), "source", "uid", "tokens", "p", "coin")
    chosen = d.join(settled, "uid", "left").withColumn("copies", (F.col("base") + F.coalesce("extra", F.lit(0))).cast("int"))
    return chosen.where(F.col("copies") > 0).select("doc_id", "source", "tokens", "copies")


def shares_reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_copies) of a mix.

    Targeted sources of which nothing was drawn are listed with zeros.
    """
    got = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    whole = got.agg(F.sum("tokens").alias("all_tokens"))
    return (
        targets.groupBy("source").agg(F.max("target_share").alias("target_share")).join(got, "source", "left").crossJoin(F.broadcast(whole))
        .select(
            "source", "target_share",
            F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "most_copies")],
        )
    )
