import itertools
import random
from collections import Counter

import numpy as np
import pytest

from strataline.llm import cooccurrence, names, neighbours, provenance


# ---------------------------------------------------------------- 2: items that appear together


def brute_pairs(rows, least, lift):
    rows = {(g, b, i) for g, b, i in rows if None not in (g, b, i)}
    total = Counter(g for g, b in {(g, b) for g, b, _ in rows})
    n1 = Counter((g, i) for g, _, i in rows)
    baskets = {}
    for g, b, i in rows:
        baskets.setdefault((g, b), []).append(i)
    n2 = Counter((g, *p) for (g, _), x in baskets.items() for p in itertools.combinations(sorted(x), 2))
    return {(g, a, b, n) for (g, a, b), n in n2.items() if n >= least and n * total[g] >= lift * n1[g, a] * n1[g, b]}


@pytest.mark.parametrize("block, entries", [(4, 7), (16, 50), (2048, 2_000_000)])
def test_together_against_brute_force(spark, block, entries):
    """Any width of item blocks and any size of record blocks sum to the same Gram matrix."""
    r = random.Random(block)
    rows = []
    for b in range(120):
        g = "ab"[b % 2]
        k = r.choice([1, 2, 3, 8])
        rows += [(g, f"c{b}", f"i{(r.randrange(6) * 5 + j) % 30:02}") for j in range(k)]
    rows += [("a", f"c{b}", f"w{j}") for b in range(300, 306) for j in range(12)] + [("a", "c1", None), (None, "c1", "x"), rows[0]]
    df = spark.createDataFrame([(*x, 1) for x in rows], "grp string, bas string, itm string, n int")
    got = {(x["group"], x["item_a"], x["item_b"], x["n"]) for x in cooccurrence.together(df, "bas", "itm", "grp", 3, 2.0, block, entries).collect()}
    assert got == brute_pairs(rows, 3, 2.0) and got
    assert cooccurrence.together(df.limit(0), "bas", "itm", "grp").collect() == []


@pytest.mark.parametrize("same", [True, False])
def test_dense_and_sparse_block_products_agree(same):
    """Full slices (dense product) and thin ones (expanded) sum up to X'X."""
    rng, w = np.random.default_rng(3), 32
    x = (rng.random((40, w)) < np.where(np.arange(40) % 2, 0.9, 0.06)[:, None]).astype(np.int64)
    y = x if same else (rng.random((40, w)) < 0.5).astype(np.int64)
    csr = lambda m: (np.concatenate([np.flatnonzero(v) for v in m]), np.r_[0, np.cumsum(m.sum(axis=1))])
    cell = cooccurrence._Cells(w, same)
    cell.add(*csr(x), *csr(y))
    i, j, n = cell.done()
    want = np.triu(x.T @ x, 1) if same else x.T @ y
    got = np.zeros((w, w), np.int64)
    got[i, j] = n
    assert (got == want).all()


# ---------------------------------------------------------------- 3: provenance


def test_repair_grammar_accounts_for_all_tokens():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 4, n).astype(np.uint64) for n in (0, 1, 2, 50, 400)] + [np.zeros(33, np.uint64), np.arange(60).astype(np.uint64), np.tile(np.arange(7), 30).astype(np.uint64)]
    seq, doc = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    g = provenance.repair(seq.copy(), doc, len(texts))
    assert np.bincount(g["doc"], weights=g["size"], minlength=len(texts)).tolist() == [len(t) for t in texts]
    assert g["rules"][6] == 0 and (g["size"][g["doc"] == 6] == 1).all()
    assert g["uses"][7] / g["rules"][7] > 2 and (g["doc"] == 7).sum() < 20


def test_leading_comment_is_read_to_its_end():
    licence = "".join(f" * line {i} of a licence\n" for i in range(30))
    head = provenance.leading_comment((f"/*\n{licence} */\n// Code generated by tool v1. DO NOT EDIT.\nfunc f() {{}}\n// copied from lib").split("\n"))
    assert "Code generated" in head and "copied" not in head
    assert provenance.leading_comment(["x = 1", "# generated by y"]) == "" and provenance.leading_comment(["package a", "// b"]) == "// b"
    assert provenance.leading_comment(['"""one"""', "x", "# y"]) == '"""one"""' and provenance.leading_comment([]) == ""


def test_origins(spark):
    code = "function a%d(x) {\n  return b%d(x) + %d;\n}\n"
    body = "".join(code % (i, i * 7 % 11, i) for i in range(12))
    blob = 'export const data = "' + "".join(random.Random(1).choices("abcdefXYZ0189+/", k=3000)) + '"'
    mini = "".join(f"!function({c}){{{c}.m=\"{c}\"}}(x);" for c in "abcdefghij" * 9)
    files = [(1, "p/src/hand.js", body), (2, "p/src/blob.js", blob), (3, "p/src/mini.js", mini), (4, "p/src/gen.js", "// Code generated by tool v1. DO NOT EDIT.\n" + body), (5, "p/src/lib.js", "// Copied from lib 1.2, keep in sync with upstream\n" + body), (6, "p/src/generator.js", "// writes generated files, do not edit the list\n" + body), (7, "p/vendor/x/a.js", None), (8, "p/generated/b.js", body), (9, "p/static/app.min.js", None), (10, "p/src/codegen/c.js", None), (11, None, None), (12, "p/tests/t.js", body), (1, "p/src/hand.js", None), (13, "p/src/empty.js", "")]
    f = spark.createDataFrame([(i, p, 90_000 if p and "min" in p else 500, 0.5) for i, p, _ in files], "id long, path string, size_bytes long, cover double")
    d = spark.createDataFrame([(i, t) for i, _, t in files if t is not None] + [(None, body), (3, mini)], "file_id long, text string")
    got = {r["path"]: r["kind"] for r in provenance.origins(f, d).collect()}
    assert {k: v for k, v in got.items() if v} == {"p/src/blob.js": "data", "p/src/mini.js": "built", "p/src/gen.js": "generated", "p/src/lib.js": "vendored", "p/vendor/x/a.js": "vendored", "p/generated/b.js": "generated", "p/static/app.min.js": "built"}
    assert None not in got and len(got) == 12
    assert provenance.not_by_hand(f.limit(0), d).collect() == [] and {r["path"] for r in provenance.not_by_hand(f, d.limit(0)).collect()} >= {"p/vendor/x/a.js"}


def test_passages_are_cut_alike_wherever_they_stand():
    rng = np.random.default_rng(0)
    token = lambda n: rng.integers(1, 2**63, n).astype(np.uint64)
    body, tile = token(2_000), np.tile(token(7), 60)
    texts = [body, np.r_[token(133), body, token(55)], token(23), token(0), token(24), tile, np.r_[body, tile], token(49)]
    end = np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    start[7] += 20  # its leading comment
    doc, hashes, size = provenance.passages(np.concatenate(texts), start, end)
    assert size.min() >= provenance.LONG_RULE and np.bincount(doc, weights=size, minlength=8).tolist() == [2000, 2188, 0, 0, 24, 420, 2420, 29]
    of = lambda t: dict(zip(hashes[doc == t].tolist(), size[doc == t].tolist()))
    for t in (1, 6):
        both = of(0).keys() & of(t).keys()
        assert sum(of(0)[h] for h in both) > 1_700 and len(of(0)) > 20
    assert not of(0).keys() & of(4).keys()


def test_copies_in_several_repositories_are_vendored(spark):
    """Code that three repositories have is found though nothing repeats within it; a common licence is no copy."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=8))
    code = lambda n: "".join(f"{word()} = {word()}({word()}, {word()}).{word()}\n" for _ in range(n))
    three, two, licence = code(40), code(40), "".join(f"# {word()} {word()} {word()} {word()} {word()}\n" for _ in range(60))
    texts = {f"{p}/src/pad.py": f"# of {p}\n{code(i)}{three}" for i, p in enumerate(("a", "b", "c"))}
    texts |= {f"{p}/src/two.py": two for p in "ab"} | {f"{p}/src/own.py": licence + code(10) for p in "abcd"} | {"a/tests/pad.py": three, "a/src/again.py": two}
    texts |= {f"{p}/src/part.py": three[: len(three) // 3] + code(40) for p in "abc"}
    files = [(i, p, 500) for i, p in enumerate(texts)]
    f = spark.createDataFrame(files + files[:1], "id long, path string, size_bytes long")
    rows = [(i, texts[p]) for i, p, _ in files]
    d = spark.createDataFrame(rows + [x for x in rows if "part" in files[x[0]][1]], "file_id long, text string")  # some texts twice
    got = {x["path"]: (x["kind"], x["shared"]) for x in provenance.origins(f, d).collect()}
    assert {p for p, (k, _) in got.items() if k} == {"a/src/pad.py", "b/src/pad.py", "c/src/pad.py"} and got["b/src/pad.py"][0] == "vendored"
    assert got["a/tests/pad.py"][1] > 0.9 and 0 < got["a/src/part.py"][1] < 0.5 and got["a/src/two.py"][1] == 0 and got["a/src/own.py"][1] == 0


# ---------------------------------------------------------------- 4: names


def test_entities(spark):
    people = {
        "ada": [("Ada Lovelock", "ada.lovelock@x.example"), ("Lovelock, Ada", "ada.lovelock@x.example"), ("LOVELOCK Ada", "ada-lovelock@mail.example"), ("Ada Lovelock (on leave)", "lovelock.ada@y.example"), ("Ada Lovleock", "ada.lovelokc@x.example"), ("", "ada.lovelock@x.example")],
        "rob": [("Robert Marsh", "robert_marsh@x.example"), ("Bob Marsh", "devs@x.example"), ("R. Marsh", "robert_marsh+ci@x.example"), ("rmarsh", "77+rmarsh@users.noreply.example")],
        "cat": [("Catherine Marsh", "catherine_marsh@x.example"), ("Catherine Marsh", "devs@x.example")],
        "org": [("Acme Tooling", "builds@acme.example"), ("ACME TOOLING GmbH", "release@acme.example"), ("AcmeTooling", "builds@acme.example"), ("The Acme Tooling Team", "builds@acme.example")],
        "amb1": [("Mara Quill", "mara.quill@z.example")], "amb2": [("Milo Quill", "milo.quill@z.example")], "amb3": [("M. Quill", "mq@z.example")],
    }
    rows = [(n, e, "subject") for v in people.values() for n, e in v] + [(None, "a@b", "s"), ("a", None, "s"), ("Ada Lovelock", "ada.lovelock@x.example", "s")]
    df = spark.createDataFrame(rows, "author_name string, author_email string, entity string")
    cl = {}
    for r in names.entities(df).collect():
        cl.setdefault(r["entity"], set()).add(r["identity"])
    want = {frozenset(f"{n} <{e}>" for n, e in v) for v in people.values()}
    assert {frozenset(v) for v in cl.values()} == want
    pairs = {tuple(r) for r in names.same_entity(df).collect()}
    assert pairs == {p for v in want for p in itertools.combinations(sorted(v), 2)}
    assert names.same_entity(df.limit(0)).collect() == []


def clusters(spark, people):
    df = spark.createDataFrame(people, "author_name string, author_email string")
    out = {}
    for r in names.entities(df).collect():
        out.setdefault(r["entity"], {})[r["identity"].partition(" <")[0]] = r["score"]
    return out.values()


def test_rarity_decides_between_owners_of_short_forms(spark):
    people = [("John Doe", "jd1@a.example"), ("Jane Doe", "jd2@b.example"), ("John Davis", "jd3@c.example"), ("jdoe", "johnd@d.example"), ("Jill Ray", "q1@a.example"), ("jray", "jray@d.example"), ("June Poe", "q2@x.example"), ("Jana Poe", "q3@y.example"), ("jpoe", "jpoe@z.example")]
    got = {frozenset(c): max(c.values()) for c in clusters(spark, people)}
    assert got[frozenset({"John Doe", "jdoe"})] == 1.0  # half of each of two forms
    assert frozenset({"Jill Ray", "jray"}) in got
    assert frozenset({"jpoe"}) in got  # two owners of all it shows


def test_ambiguous_short_names_join_the_one_name_there_is(spark):
    people = [("Alex Stone", "a1@a.example"), ("Alexandra Stone", "a2@b.example"), ("Alex Gray", "b1@a.example"), ("Alexander Gray", "b2@b.example"), ("Alexandra Gray", "b3@c.example"), ("Bob Hill", "c1@a.example"), ("Robert Hill", "c2@b.example"), ("Acme Inc.", "x@acme.example"), ("ACME GmbH", "y@acme-eu.example")]
    got = {frozenset(c) for c in clusters(spark, people)}
    assert got == {frozenset(x) for x in [("Alex Stone", "Alexandra Stone"), ("Alex Gray",), ("Alexander Gray",), ("Alexandra Gray",), ("Bob Hill", "Robert Hill"), ("Acme Inc.", "ACME GmbH")]}


def test_all_mistyped_names_of_a_form_are_compared(spark):
    """csmit is least by the alphabet and no typo of the others; smith and smitt still meet."""
    people = [("Vera Csmit", "p1@a.example"), ("Vera Smith", "p2@b.example"), ("Vera Smitt", "p3@c.example")]
    got = {frozenset(c): min(c.values()) for c in clusters(spark, people)}
    assert got == {frozenset({"Vera Csmit"}): 1.0, frozenset({"Vera Smith", "Vera Smitt"}): 0.5}


def test_edits():
    assert names.edits("abc", "acb") == 1 and names.edits("abc", "abc") == 0 and names.edits("", "ab") == 2 and names.edits("kitten", "sitting") == 3


# ---------------------------------------------------------------- 5: neighbours


def planted(n, dim, groups, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for g in range(groups):
        at = rng.choice(n, 6, replace=False)
        x[at] = x[at[0]] + 0.15 * rng.standard_normal((6, dim))
    return (x * rng.uniform(0.5, 3, (n, 1))).astype(np.float32)


def top(x, k, least):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] >= least}


def test_close_neighbours_are_found(spark):
    x = planted(3000, 32, 120)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<float>")
    got = {(r["key"], r["neighbour"]) for r in neighbours.neighbours(df, "k", "v", 32, 5, 0.9).collect()}
    want = top(x, 5, 0.9)
    assert got <= want and len(got) >= 0.97 * len(want)


@pytest.mark.parametrize("span", [400, 16_384])
def test_dense_cluster_is_compared_whole(spark, monkeypatch, span):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x[::3] = x[0] / np.linalg.norm(x[0]) + 0.034 * x[::3]
    monkeypatch.setattr(neighbours, "CAP", 64)
    monkeypatch.setattr(neighbours, "SPAN", span, raising=False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<float>")
    got = {(r["key"], r["neighbour"]) for r in neighbours.neighbours(df, "k", "v", 64, 5, 0.9).collect()}
    want = top(x, 5, 0.9)
    assert len(want) > 4000 and len(got & want) / len(want) >= 0.9


def test_all_neighbours_recall(spark):
    x = planted(1500, 16, 10, 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<float>")
    got = {(r["key"], r["neighbour"]) for r in neighbours.neighbours(df, "k", "v", 16, 5).collect()}
    want = top(x, 5, -1)
    assert len(got & want) >= 0.9 * len(want)


def recall(spark, x, least, **kw):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<float>")
    got = {(r["key"], r["neighbour"]) for r in neighbours.neighbours(df, "k", "v", x.shape[1], 5, least, **kw).collect()}
    want = top(x, 5, least)
    return len(got & want) / len(want)


def test_recall_in_one_dense_cluster(spark):
    x = np.random.default_rng(0).standard_normal((12_000, 64)).astype(np.float32)
    x[:8000] = x[0] / np.linalg.norm(x[0]) + 0.034 * x[:8000]
    assert recall(spark, x, 0.9) >= 0.9


def test_recall_of_unrelated_vectors(spark):
    x = np.random.default_rng(1).standard_normal((2500, 64)).astype(np.float32)
    assert recall(spark, x, -1.0) >= 0.9
    assert recall(spark, x[:1000], -1.0, exact=True) == 1.0


def test_greedy_search_recall(spark):
    x = planted(1500, 16, 10, 7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<float>")
    c = neighbours.Collection(df, "k", "v", 16)
    g = neighbours.graph(c.codes.read(), c.n, c.mean)
    asked = x[:40] + np.float32(0.05)
    got = neighbours.search(c, g, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "q long, v array<float>"), 5)
    named = {(r["q"], r["key"]) for r in got.join(c.heads.select("id", "key"), "id").collect()}
    u, v = x / np.linalg.norm(x, axis=1, keepdims=True), asked / np.linalg.norm(asked, axis=1, keepdims=True)
    want = {(i, int(j)) for i in range(40) for j in np.argsort(-(v[i] @ u.T))[:5]}
    assert len(named & want) >= 0.9 * len(want)


def test_search_of_copies(spark):
    x = np.random.default_rng(2).standard_normal((60, 16))
    x[20] = x[10]  # a symbol asked for whose vector a smaller id bears
    x[31] = x[30]  # and one whose copy has a greater id
    x[50] = x[30] + 0.01
    meta = spark.createDataFrame([(f"s{i}", i + 90) for i in range(60)], "symbol_stable_id string, symbol_id long")
    emb = spark.createDataFrame([(i + 90, v.tolist()) for i, v in enumerate(x)], "symbol_id long, embedding array<double>")
    got = {tuple(r) for r in neighbours.search_symbols(meta, emb, 16, every=10).collect()}
    assert got == {(i + 90, j + 90) for i, j in [(20, 10), (10, 20), (30, 31), (30, 50), (50, 30), (50, 31)]}


def test_invalid_rows_copies_and_empty(spark):
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("d", None), (None, [1.0, 0.0]), ("e", [None, 1.0]), ("f", [float("nan"), 1.0])]
    rows += [(f"m{i:02}", [2.0, 2.0]) for i in range(9)] + [("n", [2.0, 2.01])]
    df = spark.createDataFrame([(k, v, 1.0) for k, v in rows], "key string, v array<float>, sim double")
    got = {}
    for r in neighbours.neighbours(df, "key", "v", 2, 3, 0.5).collect():
        got.setdefault(r["key"], []).append((round(r["sim"], 6), r["neighbour"]))
    assert set(got) == {"a", "n"} | {f"m{i:02}" for i in range(9)}
    assert sorted(n for _, n in got["m05"]) == ["m00", "m01", "m02"] and sorted(n for _, n in got["m00"]) == ["m01", "m02", "m03"]
    assert sorted(n for _, n in got["n"]) == ["m00", "m01", "m02"] and got["a"][0][0] < 0.72
    assert neighbours.neighbours(df.limit(0), "key", "v", 2).collect() == []
