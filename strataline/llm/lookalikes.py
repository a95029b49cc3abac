"""One form for texts that look alike but are stored with different characters (problem 10).

Tokens with characters beyond ASCII are looked up in tries of the corpus's own vocabulary by
a weighted edit automaton. Look-alikes, width forms, composed accents and ligatures and
invisible characters cost nothing; a letter of a foreign alphabet that the table does not
know costs ODD, so that a word with one such letter still finds its spelling; all other
edits cost more than a match may. The cheapest vocabulary word becomes the canonical
spelling. Tokens without a word in the vocabulary are normalised by table.
"""

from __future__ import annotations

import functools
import unicodedata as ud
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators.skew import hot_keys, lookup, pairs_within
from strataline.session import Stored, partitions

# Letters of other alphabets and the Latin letters they look like
LOOKS = dict(
    zip(
        "аеорсухіјѕһԁԛԝӏѵүґ" "АВЕКМНОРСТУХІЈЅԌԚԜҮӀѴ" "αοινρυϲϳγκ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ" "օհոսցզգյլքԼՕՍՏ" "ɑɡɩɪʏʋꞵ" "ᴄᴏᴜᴠᴡᴢꜱ"
        "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏃᏀᏔᏙᏚᏞᏟᏢᏦᏴ" "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ",
        "aeopcyxijshdqwlvyr" "ABEKMHOPCTYXIJSGQWYIV" "aoivpucjyk" "ABEZHIKMNOPTYXCJ" "ohnugqqjlqLOUS" "agiIyvB" "couvwzs"
        "DRTAJEWMHZGWVSLCPKB" "BPDTGKJCZFMNLSRVHWXYAEIOU",
        strict=True,
    )
)
# Latin-script letters that are look-alikes rather than letters of their own
_LATIN_TWINS = frozenset("ɑɡɩɪʏʋꞵᴄᴏᴜᴠᴡᴢꜱ")
# Format characters (Cf) that are visible
_VISIBLE = frozenset(map(chr, [*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD]))
# Invisible characters of other categories
_UNSEEN = frozenset(map(chr, [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)]))

#: Words that one task puts into a trie at a time, about.
BLOCK_WORDS = 50_000
#: Cost of a foreign letter that is no known look-alike, of any other edit, and of a match at most.
ODD, EDIT, MOST = 0.4, 1.0, 0.5
#: Letters that a token needs for one of them to be matched at a cost.
ODD_LETTERS = 4

#: A token is a run of letters, marks, digits and invisible characters.
TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}\p{Cf}ㅤﾠ]+", regex.V1)


def invisible(c: str) -> bool:
    return c in _UNSEEN or 0xE0100 <= ord(c) < 0xE01F0 or (ud.category(c) == "Cf" and c not in _VISIBLE)


@functools.lru_cache(maxsize=1 << 16)
def look(c: str) -> str:
    """What one character looks like: decomposed plain characters, or nothing."""
    if c < "\x80":
        return c
    if invisible(c):
        return ""
    if ud.category(c) == "Zs":
        return " "
    kind = ud.decomposition(c).split(" ")[0]
    if kind in ("<wide>", "<narrow>") or kind.startswith("<") and ("LIGATURE" in ud.name(c, "") or "DIGRAPH" in ud.name(c, "") or kind in ("<isolated>", "<initial>", "<medial>", "<final>")):
        return "".join(map(look, ud.normalize("NFKD", c)))
    whole = ud.normalize("NFD", c)
    return "".join(LOOKS.get(x, x) for x in whole) if whole == c else "".join(map(look, whole))


def by_table(text: str) -> str:
    """A text normalised character by character."""
    if text.isascii():
        return text
    return ud.normalize("NFC", "".join(map(look, ud.normalize("NFD", text))))


@functools.lru_cache(maxsize=1 << 16)
def _script(c: str) -> str:
    return ud.name(c, "?").split(" ")[0] if c.isalpha() else ""


def clean(token: str) -> bool:
    """Whether a token can be a canonical spelling: plain characters of one alphabet, composed."""
    if token.isascii():
        return True
    if ud.normalize("NFC", token) != token:
        return False
    scripts = set()
    for c in token:
        if invisible(c) or c in _LATIN_TWINS or ud.decomposition(c).startswith("<") or ud.category(c)[0] == "M":
            return False
        scripts.add(_script(c))
    return len(scripts - {""}) == 1


class Trie:
    """Vocabulary words by their decomposed characters, children grouped by their look."""

    def __init__(self) -> None:
        self.root: list = [{}, None]  # look -> {char -> node}, (is not ASCII, -count, word)

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in ud.normalize("NFD", word):
            node = node[0].setdefault(look(c), {}).setdefault(c, [{}, None])
        rank = (not word.isascii(), -count, word)
        if node[1] is None or rank < node[1]:
            node[1] = rank

    def search(self, token: str, most: float = 0.0, edit: float = EDIT, odd: float = ODD) -> list[tuple[float, tuple]]:
        """Cheapest vocabulary words within ``most``: (cost, rank), the best spelling of each look.

        Characters of one look and invisible characters cost 0; a foreign letter of unknown
        look (``foreign``) is replaced for ``odd``; replacing, leaving out or putting in any
        other character costs ``edit``. Of words that look the same ASCII words come first,
        then the more frequent, then the smaller by code point: rank is (is not ASCII,
        -count, word). Words of equal cost and different looks are all returned.
        """
        strange = foreign(token) if most >= odd else frozenset()

        def spread(now: dict[int, tuple[float, list]]) -> dict[int, tuple[float, list]]:
            if most < edit:
                return now
            queue = list(now.values())
            while queue:  # the word has a character more than the token
                cost, node = queue.pop()
                if cost + edit <= most:
                    for kids in node[0].values():
                        for kid in kids.values():
                            if id(kid) not in now or now[id(kid)][0] > cost + edit:
                                now[id(kid)] = (cost + edit, kid)
                                queue.append((cost + edit, kid))
            return now

        def put(to: dict[int, tuple[float, list]], cost: float, node: list) -> None:
            if cost <= most and (id(node) not in to or to[id(node)][0] > cost):
                to[id(node)] = (cost, node)

        states = spread({id(self.root): (0.0, self.root)})
        for c in ud.normalize("NFD", token):
            other = odd if c in strange else edit
            for u in look(c):  # nothing for an invisible character, several for a ligature
                to: dict[int, tuple[float, list]] = {}
                for cost, node in states.values():
                    for kid in node[0].get(u, {}).values():
                        put(to, cost, kid)
                    if cost + edit <= most:
                        put(to, cost + edit, node)
                    if cost + other <= most:
                        for kids in node[0].values():
                            for kid in kids.values():
                                put(to, cost + other, kid)
                states = spread(to)
                if not states:
                    return []
        ends = [(cost, node[1]) for cost, node in states.values() if node[1] is not None]
        if not ends:
            return []
        least = min(ends)[0]
        best: dict[str, tuple] = {}
        for cost, rank in ends:
            if cost == least:
                own = by_table(rank[2])
                best[own] = min(rank, best.get(own, rank))
        return [(least, rank) for rank in best.values()]


def foreign(token: str) -> frozenset[str]:
    """The letter of a token that is of another alphabet than all its other letters and that the
    table does not know; empty if there is none or more than one, or if the token is short."""
    letters = [c for c in ud.normalize("NFD", token) if c.isalpha()]
    if len(letters) < ODD_LETTERS or token.isascii():
        return frozenset()
    strange = [c for c in letters if c > "\x7f" and look(c) == c]
    plain = {_script(x) for c in letters if c not in strange for x in look(c) if x.isalpha()}
    return frozenset(strange) if len(strange) == 1 and len(plain) == 1 and _script(strange[0]) not in plain else frozenset()


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, look, odd, n) of the texts of a task: distinct tokens, counted before the shuffle."""

    def flush(seen: Counter) -> pa.RecordBatch:
        toks = list(seen)
        columns = [pa.array(toks, pa.string()), pa.array([by_table(t) for t in toks], pa.string()), pa.array([bool(foreign(t)) for t in toks], pa.bool_()), pa.array([seen[t] for t in toks], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["token", "look", "odd", "n"])

    seen: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            if text:
                seen.update(TOKEN.findall(text))
        if len(seen) > 200_000:
            yield flush(seen)
            seen = Counter()
    if seen:
        yield flush(seen)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, cost, rank, look): vocabulary words for the tokens asked, block by block; words come first."""
    rank_type = pa.struct([("beyond", pa.bool_()), ("less", pa.int64()), ("word", pa.string())])
    block, trie = None, None
    for b in batches:
        toks, costs, ranks, looks = [], [], [], []
        for k, ask, t, n, odd in zip(*(c.to_pylist() for c in b.columns)):
            if k != block:
                block, trie = k, Trie()
            if not ask:
                if clean(t):
                    trie.add(t, n)
                continue
            for cost, (beyond, less, word) in trie.search(t, MOST if odd else 0.0):
                toks.append(t)
                costs.append(cost)
                ranks.append({"beyond": beyond, "less": less, "word": word})
                looks.append(by_table(word))
        yield pa.RecordBatch.from_arrays([pa.array(toks, pa.string()), pa.array(costs, pa.float64()), pa.array(ranks, rank_type), pa.array(looks, pa.string())], names=["token", "cost", "rank", "look"])


def spellings(texts: DataFrame) -> DataFrame:
    """(token, canonical) for every distinct token of ``texts`` (one column) beyond ASCII.

    ASCII tokens are their own canonical spelling. The vocabulary is all tokens of all
    texts, shuffled once as distinct tokens with counts. A token meets the words that could
    match it by the length and the first half of what they look like; a token with one
    unknown foreign letter (cost ODD) also by the second half, as one of the halves is
    intact. Only words with such a half are sent to the tries. A block of more than
    BLOCK_WORDS words is split by the hash of the word and its tokens ask every part, so no
    task holds an unbounded vocabulary. A costed match counts if all words of its cost look
    the same; else, and without a match, the token is normalised by table.
    """
    parts = partitions(texts.sparkSession)
    words = texts.mapInArrow(_vocabulary, "token string, look string, odd boolean, n long")
    words = Stored(words.groupBy("token").agg(F.sum("n").alias("n"), F.first("look").alias("look"), F.first("odd").alias("odd")), "vocabulary")
    w = words.read()
    size = F.length("look")
    half = F.ceil(size / 2).cast("int")
    first = F.concat_ws(":", size, F.lit("a"), F.substring("look", F.lit(1), half))
    second = F.concat_ws(":", size, F.lit("b"), F.substring("look", half + 1, size - half))
    dirty = w.where(F.octet_length("token") != F.length("token"))
    keys = F.when(F.col("odd"), F.array(first, second)).otherwise(F.array(first))
    asked = Stored(dirty.select(F.explode(keys).alias("key"), "token", "n", "odd"), "asked")
    have = w.select(F.explode(F.array(first, second)).alias("key"), "token", "n")
    have = Stored(lookup(have, asked.read().select("key").distinct(), "key", "left_semi", hot_keys(have, "key")), "met-words")
    big = have.read().groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_WORDS).alias("k")).where(F.col("k") > 1)
    k = F.coalesce("k", F.lit(1).cast("long"))
    to_add = have.read().join(big, "key", "left").select(F.concat_ws("/", "key", F.pmod(F.xxhash64("token"), k)).alias("block"), F.lit(False).alias("ask"), "token", "n", F.lit(False).alias("odd"))
    to_ask = asked.read().join(big, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), k - 1))).select(F.concat_ws("/", "key", "part").alias("block"), F.lit(True).alias("ask"), "token", "n", "odd")
    met = to_add.unionByName(to_ask).repartition(parts, "block").sortWithinPartitions("block", "ask")
    found = met.select("block", "ask", "token", "n", "odd").mapInArrow(_match, "token string, cost double, rank struct<beyond:boolean,less:long,word:string>, look string")
    per_cost = found.groupBy("token", "cost").agg(F.min("rank").alias("rank"), F.min("look").alias("lo"), F.max("look").alias("hi"))
    best = per_cost.groupBy("token").agg(F.min_by(F.struct("rank", "lo", "hi"), "cost").alias("b")).where(F.col("b.lo") == F.col("b.hi"))
    chosen = best.select("token", F.col("b.rank.word").alias("word"))
    return dirty.select("token", "look").join(chosen, "token", "left").select("token", F.coalesce("word", "look").alias("canonical"))


def canonical(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, canonical): each text in its one form. Rows stay as many as they are.

    A null text stays null; an empty one stays empty; ASCII texts are their own form and are
    never taken apart. A null key is kept. Only the distinct non-ASCII tokens of each text
    are joined with their spellings; tokens that occur in many texts are looked up by
    broadcast of a bounded number of rows, so no task gathers them.
    """
    src = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    plain = F.octet_length("text") == F.length("text")
    rest = src.where(F.col("text").isNull() | plain).withColumn("canonical", F.col("text"))
    dirty = Stored(src.where(~plain).withColumn("uid", F.monotonically_increasing_id()), "dirty")
    table = Stored(spellings(src.select("text")), "spellings")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uids, toks = [], []
            for uid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {x for x in TOKEN.findall(t) if not x.isascii()}
                uids += [uid] * len(own)
                toks += own
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(toks, pa.string())], names=["uid", "token"])

    used = Stored(dirty.read().select("uid", "text").mapInArrow(tokens, "uid long, token string"), "used").read()
    changed = table.read().where(F.col("token") != F.col("canonical"))
    pairs = lookup(used, changed, "token", "inner", hot_keys(used, "token"))
    maps = pairs.groupBy("uid").agg(F.collect_list(F.struct("token", "canonical")).alias("m"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, m in zip(b.column("text").to_pylist(), b.column("m").to_pylist()):
                to = {x["token"]: x["canonical"] for x in m or ()}
                parts, at = [], 0
                for hit in TOKEN.finditer(t):
                    parts += [by_table(t[at : hit.start()]), to.get(hit[0], hit[0])]
                    at = hit.end()
                out.append("".join(parts) + by_table(t[at:]))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("text"), pa.array(out, pa.string())], names=["key", "text", "canonical"])

    kind = src.schema["key"].dataType.simpleString()
    done = dirty.read().join(maps, "uid", "left").select("key", "text", "m").mapInArrow(rewrite, f"key {kind}, text string, canonical string")
    return rest.select("key", "text", "canonical").unionByName(done).withColumnRenamed("key", key)


def same_look(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b) of rows whose texts differ as stored but have one canonical form.

    Rows are compared by 256-bit hashes of stored text and form; a class is only paired up
    if it holds different stored texts. A class with a large share of the rows is paired up
    by all tasks. Null texts and null keys are left out.
    """
    forms = canonical(docs, key, text).where(F.col("text").isNotNull() & F.col(key).isNotNull())
    hashed = Stored(forms.select(F.col(key).alias("k"), F.unhex(F.sha2("text", 256)).alias("stored"), F.unhex(F.sha2("canonical", 256)).alias("form")).distinct(), "forms")
    h = hashed.read()
    mixed = h.groupBy("form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where(F.col("lo") != F.col("hi")).select("form")
    few = h.join(mixed, "form", "left_semi")
    met = pairs_within(few.select("form", "k", "stored"), "form")
    return met.where((F.col("k_a") < F.col("k_b")) & (F.col("stored_a") != F.col("stored_b"))).select(F.col("k_a").alias(f"{key}_a"), F.col("k_b").alias(f"{key}_b")).distinct()
