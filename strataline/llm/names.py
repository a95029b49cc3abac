"""Variant spellings of names typed by people, by canonical rewritings (problem 4).

Every identity is exploded into the forms its name and address can be rewritten to; equal
forms are joined. Forms that name one entity by themselves join identities directly; forms
that several entities may share are scored by their rarity, summed over all forms shared.
"""

from __future__ import annotations

import difflib
import re
import unicodedata as ud
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators.skew import hot_keys, lookup, pairs_within
from strataline.session import Stored

# Short forms of given names and all names each may stand for
NICKNAMES = {
    "abby": "abigail", "al": "alan albert alexander alfred", "alex": "alexander alexandra alexis", "andy": "andrew", "becky": "rebecca", "bella": "isabella", "ben": "benjamin",
    "bert": "albert robert", "bill": "william", "bob": "robert", "cathy": "catherine", "charlie": "charles charlotte", "chris": "christopher christian christina christine", "chuck": "charles",
    "dan": "daniel", "dave": "david", "deb": "deborah", "dick": "richard", "dima": "dmitri", "don": "donald", "ed": "edward edgar edwin",
    "ellie": "eleanor", "fred": "frederick alfred", "fritz": "frederick", "gabi": "gabriella", "greg": "gregory", "hank": "henry", "jack": "john",
    "jake": "jacob", "jeff": "jeffrey", "jen": "jennifer", "jim": "james", "jo": "josephine joanna", "joe": "joseph", "jon": "jonathan", "kate": "katherine",
    "ken": "kenneth", "larry": "lawrence", "leo": "leonardo leonard leopold", "liz": "elizabeth", "lou": "louis louise", "maggie": "margaret", "matt": "matthew",
    "matze": "matthias", "max": "maximilian maxwell", "meg": "margaret", "mike": "michael", "nate": "nathaniel nathan", "nick": "nicholas nicolas", "nico": "dominic nicholas",
    "paca": "francisca", "pat": "patricia patrick", "peggy": "margaret", "pepe": "jose", "pete": "peter", "phil": "philip", "priya": "priya priyanka",
    "ray": "raymond", "rick": "richard patrick", "rob": "robert", "ron": "ronald", "sam": "samuel samantha", "sasha": "alexander alexandra", "seun": "oluwaseun",
    "steve": "steven stephen", "sue": "susan", "ted": "theodore edward", "tim": "timothy", "tobi": "tobias", "tom": "thomas", "toni": "antonia",
    "tony": "anthony antonio", "vicky": "victoria", "walt": "walter", "will": "william", "zach": "zachary",
}
# Legal forms and words around an organisation's name
LEGAL = frozenset("inc incorporated ltd limited llc llp lp gmbh ag kg ug se sa sas sarl srl spa bv nv oy ab as aps plc corp corporation co company pty pte kk eu".split())
AROUND = frozenset("the team teams department dept group".split())

#: A short form's score from which it joins: the sum of the rarities of all forms shared.
LEAST = 1.0
#: Two clusters with full names are taken for one if their names differ by this many edits at most.
EDITS = 2


def fold(text: str) -> str:
    """Lower case without accents."""
    t = "".join(c for c in ud.normalize("NFKD", text.casefold()) if not ud.combining(c))
    return t.replace("ø", "o").replace("ł", "l").replace("đ", "d").replace("æ", "ae").replace("œ", "oe")


def tokens(name: str) -> list[str]:
    """Name tokens in order given .. family: remarks, nicknames in quotes and legal forms dropped."""
    t = re.sub(r"\([^()]*\)|\[[^\[\]]*\]|[\"“”«»][^\"“”«»]*[\"“”«»]", " ", name)
    legal = [w for w in re.findall(r"[\w.]+", fold(t)) if w.replace(".", "") in LEGAL]
    if "," in t and not legal:
        last, _, first = t.partition(",")
        t = f"{first} {last}"
    words = [w for w in re.split(r"[^\w]+|_", fold(t)) if w]
    core = [w for w in words if w not in LEGAL and w not in AROUND]
    return core if core else words


def long_names(given: str) -> list[str]:
    """All names a given name may stand for; itself if it is no short form."""
    return NICKNAMES.get(given, given).split()


#: The ambiguous short forms of a name.
SHORT_NAMES: dict[str, list[str]] = {}
for _short in NICKNAMES:
    if len(long_names(_short)) > 1:
        for _long in long_names(_short):
            if _long != _short:
                SHORT_NAMES.setdefault(_long, []).append(_short)


_KNOWN = frozenset(x for v in NICKNAMES.values() for x in v.split())


def formal(given: str) -> str:
    """A given name written out if there is one way to do so, else as it is."""
    some = long_names(given)
    return some[0] if len(some) == 1 else given


def pair(a: str, b: str) -> str:
    """Both names whatever their order, short forms written out."""
    return "|".join(sorted((formal(a), formal(b))))


def local_part(address: str) -> tuple[str, list[str]]:
    """(local part without tags, its name parts)."""
    local = fold(address.partition("@")[0])
    local = re.sub(r"^\d+\+(?=.)", "", local)
    local = re.sub(r"(?<=.)\+.*$", "", local)
    parts = [p for p in re.split(r"[._\-]+", local) if p and not p.isdigit()]
    if len(parts) > 2 and parts[-1] in ("dev", "work", "git", "oss", "code", "mail"):
        parts = parts[:-1]
    return "".join(parts), parts


def _shorter(w: str) -> set[str]:
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) > 2 else {w}


def edits(a: str, b: str) -> int:
    """Edit distance with transpositions of neighbours."""
    d = {(-1, -1): 0}
    for i in range(len(a)):
        d[i, -1] = i + 1
    for j in range(len(b)):
        d[-1, j] = j + 1
    for i in range(len(a)):
        for j in range(len(b)):
            c = a[i] != b[j]
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + c)
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def forms(name: str, address: str) -> list[tuple[str, str]]:
    """(kind, form) of all rewritings of one identity.

    ``same``: names one entity; ``own``: a short form that a full name can be written as;
    ``claim``: a short form that is all this identity shows; ``short``: a full name
    with a short given name that may stand for several; ``mail``: the address, ``mine`` before it
    if the name occurs in it, ``other`` if the name contradicts it; ``full``: the full name.
    """
    toks = tokens(name)
    run, parts = local_part(address)
    out: set[tuple[str, str]] = set()
    full = None
    if len(toks) >= 2 and len(toks[0]) > 1 and len(toks[-1]) > 1:
        full = (toks[0], toks[-1])
    by_mail = (parts[0], parts[1]) if len(parts) == 2 and min(map(len, parts)) > 1 else None
    for p in filter(None, (full, by_mail)):
        out.add(("same", "p:" + pair(*p)))
        for g, s in (p, p[::-1]):
            if len(long_names(g)) > 1:
                out.add(("short", f"s:{g}|{s}"))
            g = formal(g)
            out |= {("own", f"s:{x}|{s}") for x in SHORT_NAMES.get(g, ())}
            out |= {("own", "l:" + x) for x in (g[0] + s, s + g[0])}
            out.add(("own", f"i:{g[0]}|{s}"))
            out.add(("own", "l:" + g + s))
    if full and len(toks) > 2:
        out.add(("own", "l:" + "".join(toks)))
    if len(toks) == 1 and toks[0]:
        out.add(("claim", "l:" + toks[0]))
        if any(w.replace(".", "") in LEGAL for w in re.findall(r"[\w.]+", fold(name))):
            out.add(("same", "o:" + toks[0]))  # an organisation, whatever its legal form
    if toks and not full and len(toks) >= 2:
        a, b = toks[0], toks[-1]
        out.add(("claim", f"i:{a}|{b}" if len(a) == 1 else f"i:{b}|{a}"))
    if run and len(parts) == 1:
        out.add(("claim", "l:" + run))
    known = any(len(t) > 2 and (t in run or formal(t) in run) for t in toks) or bool(toks and toks[0] == run)
    close = known or not full or any(difflib.SequenceMatcher(None, t, p, False).ratio() > 0.75 for t in toks for p in [*parts, run, run[1:], run[:-1]])
    mail = f"{run}@{address.partition('@')[2].casefold()}"
    out.add(("mine" if known else "mail" if close else "other", "e:" + mail))
    if full:
        out.add(("full", pair(*full)))
    elif by_mail:
        out.add(("full", pair(*by_mail)))
    return sorted(out)


def _near_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(full, form): each full name with up to one letter left out of one of its parts."""
    for b in batches:
        out = set()
        for full in b.column(0).to_pylist():
            x, y = full.split("|")
            for g, s in ((x, y), (y, x)):
                out |= {(full, "|".join(sorted((g, z)))) for z in _shorter(s)}
        cols = list(zip(*out)) if out else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["full", "form"])


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, kinds, fs = [], [], []
        for i, n, e in zip(*(c.to_pylist() for c in b.columns)):
            for kind, form in forms(n, e):
                ids.append(i)
                kinds.append(kind)
                fs.append(form)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(fs, pa.string())], names=["id", "kind", "form"])


def components(links: DataFrame, label: DataFrame) -> Stored:
    """(id, label): the least label among all ids that ``links`` (id, form) connect.

    Labels go from ids to forms and back until none changes. Both steps aggregate map-side,
    so a form shared by a third of all ids moves one row per task on the way there, and is
    looked up by broadcast of a bounded number of forms on the way back; rounds are as many as
    the longest chain of forms within one entity, which is short. Each is stored.
    """
    held = Stored(label, "labels")
    kept = Stored(links.select("id", "form").distinct(), "links")
    hot = Stored(hot_keys(kept.read(), "form"), "hot-forms")
    while True:
        now = held.read()
        per_form = kept.read().join(now, "id").groupBy("form").agg(F.min("label").alias("label"))
        via = lookup(kept.read(), per_form, "form", "inner", hot.read()).groupBy("id").agg(F.min("label").alias("via"))
        step = Stored(
            now.join(via, "id", "left").select("id", F.least("label", F.coalesce("via", "label")).alias("label"), (F.col("via") < F.col("label")).alias("moved")), "labels"
        )
        moved = step.read().where(F.col("moved")).limit(1).count()
        held.drop()
        held = step
        if not moved:
            kept.drop()
            return held


def identities(rows: DataFrame, name: str = "author_name", address: str = "author_email") -> DataFrame:
    """Distinct (identity, name, address); rows with a null name or address are none."""
    return (
        rows.select(F.col(f"`{name}`").alias("name"), F.col(f"`{address}`").alias("address")).dropna(how="any").distinct()
        .select(F.concat("name", F.lit(" <"), "address", F.lit(">")).alias("identity"), "name", "address")
    )


def entities(rows: DataFrame, name: str = "author_name", address: str = "author_email") -> DataFrame:
    """(identity, entity, score): identities with the entity they belong to.

    ``rows`` needs a name and an address column; others are not read; rows with a null in
    either are left out, repeated rows count once, an empty table gives none. An empty name
    is a name like any other that shows nothing by itself. ``entity`` is a number common to
    all identities of one person or organisation; ``score`` is the best score of the links
    below that joined the identity's cluster to others (1 where there is none).

    1. Names, written-out addresses and personal addresses join identities. An address is
       personal if some name on it occurs in it; a shared mailbox joins nothing, and a name
       that contradicts a personal address is not joined by it.
    2. A cluster without a full name claims its short forms, one with an ambiguous short
       given name that name, which all clusters own that can be shortened to it. The rarity of a form is 1 / the number
       of clusters that own it; the score of a claim on a cluster is the sum over all forms
       they share. A claim of at least LEAST joins if it shares a form that nobody else
       owns, or if it is the best one of its cluster.
    3. Clusters with full names join if one name misses or mistypes letters of the other:
       they share a form with a letter left out, and are within EDITS edits. Not so if both
       differing parts are names in their own right, i.e. known given names or beside three other names.
       All pairs of names of a form are compared: a form has at most as many names as there
       are letters to put in. The score is 1 / the number of other names of the rarest form.
    """
    ids = Stored(identities(rows, name, address).withColumn("id", F.monotonically_increasing_id()), "identities")
    fs = Stored(ids.read().select("id", "name", "address").mapInArrow(_explode, "id long, kind string, form string"), "name-forms")
    f = fs.read()
    mails = f.where(F.col("kind").isin("mine", "mail"))
    personal = f.where(F.col("kind") == "mine").select("form").distinct()
    links = f.where(F.col("kind") == "same").select("id", "form").unionByName(mails.join(personal, "form", "left_semi").select("id", "form"))
    first = components(links, ids.read().select("id", F.col("id").alias("label")))

    c = first.read().select("id", "label")
    tagged = f.join(c, "id")
    has_full = tagged.where(F.col("kind") == "full").select("label").distinct()
    owned = Stored(tagged.where(F.col("kind").isin("own", "same")).select("label", "form").distinct(), "owned").read()
    claimed = tagged.where(F.col("kind") == "claim").select("label", "form").distinct().join(has_full, "label", "left_anti")
    claimed = Stored(claimed.unionByName(tagged.where(F.col("kind") == "short").select("label", "form")).distinct(), "claimed").read()
    owners = owned.join(claimed.select("form").distinct(), "form", "left_semi").groupBy("form").agg(F.count(F.lit(1)).alias("owners"))
    rated = Stored(lookup(claimed, owners, "form", "inner", hot_keys(claimed, "form")), "rated").read()
    # a sum of m rarities reaches LEAST only if one of the forms has at most m / LEAST owners: only those are expanded
    enough = rated.groupBy("label").agg((F.count(F.lit(1)) / LEAST).alias("m"))
    rare = rated.join(enough, "label").where(F.col("owners") <= F.col("m")).select("label", "form")
    cand = rare.join(owned.withColumnRenamed("label", "other"), "form").where(F.col("label") != F.col("other")).select("label", "other").distinct()
    shared = cand.join(rated, "label").join(owned.withColumnRenamed("label", "other"), ["other", "form"], "left_semi")
    scored = shared.groupBy("label", "other").agg(F.sum(1 / F.col("owners")).alias("score"), F.min("owners").alias("fewest")).where(F.col("score") >= LEAST - 1e-9)
    best = scored.groupBy("label").agg(F.max("score").alias("top"))
    firsts = scored.join(best, "label").where(F.col("score") > F.col("top") - 1e-9).groupBy("label").agg(F.count(F.lit(1)).alias("ties"), F.max("top").alias("top"))
    weak = scored.join(firsts, "label").where((F.col("fewest") == 1) | ((F.col("ties") == 1) & (F.col("score") > F.col("top") - 1e-9))).select("label", "other", "score")

    # mistyped names: the pairs of full names that share a shortened form
    fulls = tagged.where(F.col("kind") == "full").groupBy(F.col("form").alias("full")).agg(F.min("label").alias("label"))
    fulls = Stored(fulls, "full-names").read()
    split = F.split("full", r"\|")
    used = fulls.select(F.explode(F.arrays_zip(split.alias("a"), F.reverse(split).alias("b"))).alias("x")).groupBy(F.col("x.a").alias("part")).agg(F.count_distinct("x.b").alias("n"))
    own_right = used.where(F.col("n") >= 3).select("part")
    near = Stored(fulls.select("full").mapInArrow(_near_forms, "full string, form string"), "near-forms").read()
    near = near.join(near.groupBy("form").agg((F.count(F.lit(1)) - 1).alias("others")).where(F.col("others") > 0), "form")
    met = near.join(near.select("form", F.col("full").alias("full2")), "form").where(F.col("full") < F.col("full2"))
    cand = met.groupBy("full", "full2").agg(F.max(1 / F.col("others")).alias("score"))
    both = cand.join(fulls, "full").join(fulls.select(F.col("label").alias("other"), F.col("full").alias("full2")), "full2")
    schema = "label long, other long, score double, x string, y string"
    differing = both.select("label", "other", "score", "full", "full2").mapInArrow(_differ, schema)
    ok = (
        differing.join(own_right.select(F.col("part").alias("x"), F.lit(True).alias("rx")), "x", "left")
        .join(own_right.select(F.col("part").alias("y"), F.lit(True).alias("ry")), "y", "left")
        .where(F.col("rx").isNull() | F.col("ry").isNull())
    )
    typos = ok.select("label", "other", "score")
    more = Stored(weak.unionByName(typos).where(F.col("label") != F.col("other")), "weak-links")
    pairs = more.read().select("label", "other", F.concat_ws("~", "label", "other").alias("form"))
    links2 = pairs.select(F.col("label").alias("id"), "form").unionByName(pairs.select(F.col("other").alias("id"), "form"))
    labels = c.select(F.col("label").alias("id")).distinct().withColumn("label", F.col("id"))
    second = components(links2, labels)
    last = second.read().select(F.col("id").alias("label"), F.col("label").alias("entity"))
    ends = more.read().select(F.explode(F.array("label", "other")).alias("label"), "score")
    score = ends.groupBy("label").agg(F.max("score").alias("score"))
    return (
        ids.read().select("id", "identity").join(c, "id").join(last, "label").join(score, "label", "left")
        .select("identity", "entity", F.coalesce("score", F.lit(1.0)).alias("score"))
    )


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, other, score, x, y) where the full names agree in one part and differ little in the other (x, y)."""
    for b in batches:
        out = []
        for label, other, score, a, z in zip(*(c.to_pylist() for c in b.columns)):
            for p in (a.split("|"), a.split("|")[::-1]):
                for q in (z.split("|"), z.split("|")[::-1]):
                    if p[0] == q[0] and p[1] != q[1] and not {p[1], q[1]} <= _KNOWN and edits(p[1], q[1]) <= min(EDITS, max(1, min(len(p[1]), len(q[1])) // 3)):
                        out.append((label, other, score, p[1], q[1]))
        cols = list(zip(*set(out))) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["label", "other", "score", "x", "y"])


def same_entity(rows: DataFrame, name: str = "author_name", address: str = "author_email") -> DataFrame:
    """(identity_a, identity_b): pairs of different identities of one entity, the smaller first."""
    e = Stored(entities(rows, name, address).select("identity", "entity"), "entities")
    return pairs_within(e.read(), "entity").where(F.col("identity_a") < F.col("identity_b")).select("identity_a", "identity_b")
