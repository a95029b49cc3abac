"""Generated, minified, bundled and vendored files, and data stored as code (problem 3).

A Re-Pair grammar is inferred over the token sequence of every text. How much of it is
covered by rules, how much of it are literals no rule can compress, and which rules or
passages other repositories share, are the evidence of the content; notes of origin in the
leading comment and the file's place are the rest. How often rules are reused is reported
but decides nothing, as it does not separate (README). Files without a text have only their
place and size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.session import Stored

_TOKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`[^`]*`?|\d[\w.]*|[^\W\d]\w*|[^\w\s]")
#: Tokens per batch of texts whose grammars are inferred together.
BATCH_TOKENS = 400_000
#: A rule or passage counts as copied from elsewhere from so many tokens on.
LONG_RULE = 24
#: ... if so many repositories have it, and such rules or passages cover so much of a file.
SHARED_BY, SHARED_COVER = 3, 0.5
#: Part of a text's characters in literals that no rule compresses, from which it is data.
BLOB = 0.55
#: Shorter texts are too short to tell.
BLOB_CHARS = 400
#: Average characters a line from which a text is not laid out for people, and rule cover.
LINE, COVER = 200.0, 0.5
#: A file without text is taken for data or a bundle from this size on.
HUGE = 100_000

# Notes of origin in the leading comment; "automatically generated" also in other languages
_GENERATED = re.compile(
    r"\b(?:code|file|class|module|source) (?:was |is |has been )?(?:auto-?)?generated (?:by|from|with|using)\b|@generated\b|<\s*auto-?generated|\bauto-?generated\b(?: file| code|;|,|\.| by| from)|"
    r"\b(?:automatically|machine)[- ](?:created|generated|produced|written)\b|^\W*generated (?:by|from|with|on|using|automatically)\b|"
    r"\bautomatisch (?:erzeugt|generiert|erstellt)|\b(?:généré|generado|generato|gerado) (?:automatiquement|automáticamente|automaticamente)|\b(?:создан|сгенерирован)\w* автоматически|автоматически (?:создан|сгенерирован)",
    re.I | re.M,
)
_VENDORED = re.compile(
    r"\b(?:copied|vendored) (?:verbatim |unchanged )?from\b|\bimported from (?:the )?[\w.-]+ (?:distribution|release|project|repository|package|v?\d)|\bthis file is (?:a )?part of (?!this\b)|"
    r"\breleased under (?:the|an?) [\w. -]*licen[cs]e|^\W*\(c\) (?:the )?[\w.-]+ authors|\btaken from https?:",
    re.I | re.M,
)
_BANNER = re.compile(r"^/\*[!*]\s*@?(?:license\s+)?[\w@./-]+\s+v?\d+(?:\.\d+)+", re.I)
# Places for files that are not written by hand
VENDOR_DIRS = ("vendor", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "external", "externals", "bower_components", "node_modules", "site-packages", "Pods", "jspm_packages")
GENERATED_DIRS = ("generated", "__generated__", "_generated", "gen", "autogen", "auto-generated", "api-client", "fakes", "mocks")
BUILT_DIRS = ("public", "static", "assets", "out", "dist", "build", "_build", "target", ".next")
DATA_DIRS = ("fixtures", "data", "datasets")
_GENERATED_NAME = r"(?:\.(?:gen|generated|g|pb|designer|freezed)|_pb2(?:_grpc)?|[._]generated|_gen|\.pb\.gw)\.\w+$"
_BUILT_NAME = r"(?:[.-]min|[.-]bundle|\.packed|[.-]prod)\.\w+$|(?:^|/)chunk-[0-9a-f]{6,}\.\w+$|\.[0-9a-f]{8,}\.(?:js|mjs|css)$"
_DATA_NAME = r"(?:Table|Lookup|[._-]data|Data)\.\w+$"

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit content hash of the rule a b; equal pairs are one rule in all texts."""
    with np.errstate(over="ignore"):
        x = (a * _M1) ^ ((b + _M2) * _M2)
        x ^= x >> np.uint64(29)
        x *= _M1
        return x ^ (x >> np.uint64(32))


def repair(seq: np.ndarray, doc: np.ndarray, n_docs: int) -> dict[str, np.ndarray]:
    """Re-Pair grammars of many token sequences at once.

    ``seq`` holds token hashes (uint64), ``doc`` their text, ascending. Every round
    replaces, in each text, the pairs that occur at least twice there and more often than
    the pairs that overlap them; this is Re-Pair with all pairs that do not compete replaced
    in one step. It ends when no pair of any text occurs twice. Returns per text the number of rules and
    of their uses, and the final sequence with the tokens each of its symbols stands for.
    """
    size = np.ones(len(seq), np.int32)
    rules = np.zeros(n_docs, np.int64)
    uses = np.zeros(n_docs, np.int64)
    live = np.ones(n_docs, bool)
    fin: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(seq) > 1:
        same = doc[1:] == doc[:-1]
        pair = _mix(seq[:-1], seq[1:])
        with np.errstate(over="ignore"):
            key = pair ^ ((doc[:-1].astype(np.uint64) + np.uint64(1)) * _M2)
        order = np.argsort(key, kind="stable")
        sk = key[order]
        new = np.r_[True, sk[1:] != sk[:-1]]
        group = np.cumsum(new) - 1
        counts = np.bincount(group, weights=same[order]).astype(np.int64)
        n = np.empty(len(key), np.int64)
        n[order] = counts[group]
        n[~same] = 0
        # strength of a pair; ties go to the larger hash, runs of one pair to the earlier place
        rank = np.where(n >= 2, n, 0)
        left = np.r_[0, rank[:-1]]
        right = np.r_[rank[1:], 0]
        kl, kr = np.r_[np.uint64(0), key[:-1]], np.r_[key[1:], np.uint64(0)]
        take = (rank > 0) & ((rank > left) | ((rank == left) & (key > kl))) & ((rank > right) | ((rank == right) & (key >= kr)))
        run = (rank > 0) & (key == kl)  # a a a: every second place of a run
        if run.any():
            starts = np.flatnonzero((rank > 0) & ~run)
            at = np.flatnonzero(rank > 0)
            pos = at - starts[np.searchsorted(starts, at, side="right") - 1]
            cand = np.zeros(len(rank), bool)
            cand[at] = pos % 2 == 0
            take = np.where((key == kl) | (key == kr), cand & (rank >= left) & (rank >= right), take)
            take[1:] &= ~take[:-1]
        at = np.flatnonzero(take)
        if not len(at):
            break
        d = doc[at]
        k = np.unique(key[at], return_index=True)[1]
        rules += np.bincount(d[k], minlength=n_docs)
        uses += np.bincount(d, minlength=n_docs)
        seq[at] = pair[at]
        size[at] += size[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        changed = np.zeros(n_docs, bool)
        changed[d] = True
        live &= changed
        seq, doc, size = seq[keep], doc[keep], size[keep]
        out = ~live[doc]
        if out.any():  # texts whose grammar is done leave
            fin.append((seq[out], doc[out], size[out]))
            seq, doc, size = seq[~out], doc[~out], size[~out]
    fin.append((seq, doc, size))
    s, d, z = (np.concatenate(x) for x in zip(*fin))
    return {"rules": rules, "uses": uses, "seq": s, "doc": d, "size": z}


def passages(seq: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, size): each text, seq[start:end], cut into passages of LONG_RULE tokens and more.

    A text is cut where the hash of four tokens is the least among LONG_RULE places on either
    side, so equal stretches of different texts are cut alike whatever stands around them, and
    their passages are equal rules of a grammar over all texts, even where nothing repeats
    within one text. All tokens of a text are in one of its passages; shorter texts have none.
    """
    r = LONG_RULE
    long = np.flatnonzero(end - start >= r)
    cuts = np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        if len(seq) > 2 * r + 4:
            two = _mix(seq[:-1], seq[1:])
            v = _mix(two[:-2], two[2:])  # v[i] stands for seq[i : i + 4]
            least, width = v, 1
            while width < r:  # least[i]: of v[i : i + r]
                step = min(width, r - width)
                least = np.minimum(least[:-step], least[step:])
                width += step
            i = np.arange(r, len(v) - r)
            cuts = i[(v[i] < least[i - r]) & (v[i] <= least[i + 1])]
            t = np.searchsorted(start, cuts, side="right") - 1  # empty texts start where the next one does
            cuts = cuts[(t >= 0) & (cuts - start[t] >= r) & (cuts + r + 4 <= end[t])]
        a = np.sort(np.r_[start[long], cuts])
        t = np.searchsorted(start[long], a, side="right") - 1
        b = np.minimum(np.r_[a[1:], len(seq)], end[long][t]) if len(a) else a
        power, back = np.full(len(seq) + 1, _M1), np.full(len(seq) + 1, np.uint64(pow(int(_M1), -1, 1 << 64)))
        power[0] = back[0] = 1
        power, back = np.cumprod(power), np.cumprod(back)
        total = np.r_[np.uint64(0), np.cumsum(seq * power[:-1], dtype=np.uint64)]
        h = _mix((total[b] - total[a]) * back[a], (b - a).astype(np.uint64))
    return long[t], h, b - a


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grammar and header evidence of each text; see ``content``."""
    known: dict[str, int] = {}

    def code(t: str) -> int:
        h = known.get(t)
        if h is None:
            if len(known) > 500_000:
                known.clear()
            h = known[t] = _hash(t)
        return h

    def flush(held: list[tuple]) -> pa.RecordBatch:
        n = len(held)
        toks = [h[2] for h in held]
        lens = np.array([len(t) for t in toks])
        doc = np.repeat(np.arange(n), lens)
        seq = np.array([code(t) for ts in toks for t in ts], np.uint64)
        chars = np.array([len(t) for ts in toks for t in ts], np.int64)
        literal = np.array([t[0] in "\"'`0123456789" for ts in toks for t in ts], bool)
        g = repair(seq.copy(), doc, n)
        alone = g["size"] == 1
        cover = 1 - np.bincount(g["doc"][alone], minlength=n) / np.maximum(lens, 1)
        # literals left as single symbols: which they are is known by their hashes
        lit = pd.DataFrame({"doc": doc[literal], "seq": seq[literal], "c": chars[literal]}).groupby(["doc", "seq"], sort=False)["c"].max()
        loose = pd.DataFrame({"doc": g["doc"][alone], "seq": g["seq"][alone]})
        loose = loose.join(lit, on=["doc", "seq"])["c"].fillna(0).to_numpy()
        stiff = np.bincount(g["doc"][alone], weights=loose, minlength=n) / np.maximum(np.bincount(doc, weights=chars, minlength=n), 1)
        long = g["size"] >= LONG_RULE
        end = np.cumsum(lens)
        start = end - lens + np.minimum([h[5] for h in held], lens)
        parts = passages(seq, start, end)
        by: dict[int, list[dict]] = {}
        for whole, (d, s, z) in ((lens, (g["doc"][long], g["seq"][long], g["size"][long])), (end - start, parts)):
            passage = whole is not lens
            for i, rule, share in zip(d.tolist(), s.astype(np.int64).tolist(), (z / whole[d]).tolist()):
                by.setdefault(i, []).append({"rule": rule, "share": share, "passage": passage})
        reuse = g["uses"] / np.maximum(g["rules"], 1)
        rows = [
            pa.array([h[0] for h in held], pa.int64()), pa.array(lens.astype(np.int64)), pa.array([h[4] for h in held], pa.int64()), pa.array(cover), pa.array(reuse), pa.array(stiff),
            pa.array([h[3] for h in held], pa.float64()), pa.array([h[1] for h in held], pa.string()),
            pa.array([by.get(i, []) for i in range(n)], pa.list_(pa.struct([("rule", pa.int64()), ("share", pa.float64()), ("passage", pa.bool_())]))),
            pa.array([h[6] for h in held], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(rows, names=["file_id", "tokens", "chars", "cover", "reuse", "stiff", "line", "note", "long", "text_no"])

    held, size = [], 0
    number = count(TaskContext.get().partitionId() << 33)
    for b in batches:
        for fid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            lines = [x for x in text.split("\n") if x.strip()]
            head, rest = _leading(lines)
            note = "generated" if _GENERATED.search(head) else "vendored" if _VENDORED.search(head) else "bundled" if _BANNER.match(head) else None
            toks = _TOKEN.findall(text)
            held.append((fid, note, toks, len(text) / max(1, len(lines)), len(text), len(_TOKEN.findall("\n".join(lines[:rest]))), next(number)))
            size += len(toks)
            if size >= BATCH_TOKENS:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


_OPENS = re.compile(r"\s*(?:(?P<block>/\*|<!--|\"\"\"|\'\'\')|//|#|--|;)")
_CLOSES = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
# Statements that may stand before a file's leading comment
_BEFORE = re.compile(r"\s*(?:package\b|module\b|namespace\b|['\"]use strict['\"]|<\?)")


def leading_comment(lines: list[str]) -> str:
    """All comment lines a file starts with, however many; ``lines`` are not blank."""
    return _leading(lines)[0]


def _leading(lines: list[str]) -> tuple[str, int]:
    """The leading comment, and the number of lines up to its end."""
    out = []
    end = None
    rest = 0
    for i, x in enumerate(lines):
        if end is None:
            m = _OPENS.match(x)
            if not m:
                if _BEFORE.match(x):
                    continue
                break
            opened = m["block"]
            end = _CLOSES[opened] if opened else None
            if end and end in x[m.end() :]:
                end = None
        elif end in x:
            end = None
        out.append(x)
        rest = i + 1
    return "\n".join(out), rest


def _hash(t: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(t)


def content(docs: DataFrame) -> DataFrame:
    """(file_id, tokens, chars, cover, reuse, stiff, line, note, long, text_no) of the texts of files.

    ``docs`` needs file_id and text. ``cover``: part of the tokens within rules; ``reuse``:
    uses per rule; ``stiff``: part of the characters in literals outside all rules; ``line``: average
    characters of a line; ``note``: origin named in the leading comment; ``long``: hashes of long
    rules with their share of the tokens, and of passages with their share of the tokens below
    the leading comment; ``text_no``: one number per text. Null ids and null or empty texts have
    no row. Texts are not moved.
    """
    some = docs.where(F.col("file_id").isNotNull() & (F.length("text") > 0)).select(F.col("file_id").cast("long").alias("file_id"), "text")
    return some.mapInArrow(_features, "file_id long, tokens long, chars long, cover double, reuse double, stiff double, line double, note string, long array<struct<rule:long,share:double,passage:boolean>>, text_no long")


def _in_dir(path, names: tuple[str, ...]):
    return path.rlike("(?:^|/)(?:" + "|".join(re.escape(n) for n in names) + r")(?:-[\d.]+)?/")


def origins(files: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, kind, cover, reuse, stiff, shared): kind is generated, vendored, built, data or null.

    One row per path (null paths are none); of several rows of one path any evidence counts.
    A text's grammar decides on data (literals that no rule compresses) and built files
    (long lines, covered by rules); a note of origin, or long rules or passages below the
    leading comment that SHARED_BY repositories have, on generated and vendored ones; the place
    adds files whose text, if any, does not show it. Files without text and a telling place are
    judged by size alone. ``shared`` is the greater share, of rules or of passages.
    Empty tables give an empty result; other columns are not read.
    """
    found = Stored(content(docs), "content")
    c = found.read()
    f = files.where(F.col("path").isNotNull()).select(F.col("id").cast("long").alias("file_id"), "path", "size_bytes")
    repo = F.substring_index("path", "/", 1)
    rules = c.where(F.size("long") > 0).select("file_id", "text_no", F.explode("long").alias("r")).select("file_id", "text_no", "r.*")
    placed = rules.join(f.select("file_id", repo.alias("repo")).distinct(), "file_id")
    wide = placed.groupBy("rule").agg(F.count_distinct("repo").alias("repos")).where(F.col("repos") >= SHARED_BY).select("rule")
    copied = [F.sum(F.when(x, F.col("share")).otherwise(0.0)) for x in (F.col("passage"), ~F.col("passage"))]
    shared = rules.join(wide, "rule", "left_semi").groupBy("text_no").agg(F.round(F.greatest(*copied), 9).alias("shared"))
    facts = c.drop("long").join(shared, "text_no", "left").drop("text_no").withColumn("shared", F.coalesce("shared", F.lit(0.0)))
    x = f.join(facts, "file_id", "left")
    p = F.col("path")
    ordinary_test = p.rlike(r"(?:^|/)tests?/") & ~_in_dir(p, VENDOR_DIRS + GENERATED_DIRS + DATA_DIRS)
    has = F.col("tokens").isNotNull()
    data = (F.col("stiff") >= BLOB) & (F.col("chars") >= BLOB_CHARS)
    built = (F.col("line") >= LINE) & (F.col("cover") >= COVER)
    place = (
        F.when(_in_dir(p, VENDOR_DIRS), "vendored")
        .when(_in_dir(p, GENERATED_DIRS) | p.rlike(_GENERATED_NAME), "generated")
        .when(~has & p.rlike(_BUILT_NAME), "built")
        .when(~has & _in_dir(p, BUILT_DIRS) & (F.col("size_bytes") >= HUGE / 5), "built")
        .when(~has & (_in_dir(p, DATA_DIRS) | p.rlike(_DATA_NAME)) & (F.col("size_bytes") >= HUGE / 2), "data")
        .when(~has & (F.col("size_bytes") >= HUGE), "data")
    )
    kind = (
        F.when(has & data, "data")
        .when(has & built, "built")
        .when(F.col("note") == "generated", "generated")
        .when(F.col("note") == "vendored", "vendored")
        .when(ordinary_test, F.lit(None))
        .when(has & (F.col("shared") >= SHARED_COVER), "vendored")
        .otherwise(place)
    )
    return x.withColumn("kind", kind).groupBy("path").agg(
        F.max("kind").alias("kind"), *[F.max(m).alias(m) for m in ("cover", "reuse", "stiff", "shared")]
    )


def not_by_hand(files: DataFrame, docs: DataFrame) -> DataFrame:
    """(path) of the files nobody wrote by hand in their project."""
    return origins(files, docs).where(F.col("kind").isNotNull()).select("path")
