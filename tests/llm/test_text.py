import itertools
import random

import numpy as np
import pytest

from strataline.llm import doc_pairs, leaks, lookalikes, mixing


# ---------------------------------------------------------------- 1: functions and documentation


@pytest.mark.parametrize("comment", ["", "//", "/** */", "/**\n * bindRoot\n */", "The bind root function.", "This method binds root.", "# bind_root()", "@param x", ":param a:\n:return:", "/** @param {any} x\n * @returns {void} */", "{@inheritDoc}", "// fmt: off", "// eslint-disable-next-line no-shadow", "TODO: add docs", "n/a", "...", "* * *", "------", '"""none"""', "@see bindRoot", None])
def test_says_nothing(comment):
    assert not doc_pairs.describes("bindRoot", comment)


@pytest.mark.parametrize("comment", ["/** Returns null when the root is cold. */", "TODO: speed up. Scans each frame twice.", "@returns null if no edge matched", "@param x - cold anchor that must outlive the call", "bindRoot: keeps at most 3 tags", "// Größere Stapel brauchen länger.", "Not safe while the panel is warm."])
def test_says_something(comment):
    assert doc_pairs.describes("bindRoot", comment)


def test_symbol_pairs_edge_cases(spark):
    rows = [
        ("1", "f", "function", "f(a)", "/** Explains it well. */", "c"), ("1", "f", "function", "f(a)", "/** Explains it well. */", "c"), ("2", "f", "method", " ", "Explains it.", "c"),
        ("3", "f", "class", "f", "Explains it.", "c"), (None, "f", "function", "f", "Explains it.", "c"), ("5", None, "function", "f(\"(\"", "// Explains it.\n// More", "c"), ("6", "f", "function", None, None, "c"),
        ("7", "f", "function", "f()", "Word " * 200_000, "c"), ("8", "f", None, "f()", "Explains.", "c"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "stable_id string, name string, kind string, signature string, doc_comment string, description string, file_id long")
    docs = spark.createDataFrame([(1, "// Explains it well.\nfunc f(a) { return }\n", "go", "x"), (None, "x", "go", "x"), (1, None, None, "x"), (2, "", "go", "x")], "file_id long, text string, language string, name string")
    got = {r["stable_id"]: r for r in doc_pairs.symbol_pairs(df, docs).collect()}
    assert set(got) == {"1", "5", "7"} and got["1"]["description"] == "Explains it well." and got["5"]["description"] == "Explains it.\nMore"
    assert (got["1"]["origin"], got["1"]["body"]) == ("source", "{ return }") and (got["5"]["origin"], got["5"]["body"]) == ("stored", None)
    assert doc_pairs.symbol_pairs(df.limit(0), docs).collect() == [] and doc_pairs.symbol_pairs(df, docs.limit(0)).count() == 3


@pytest.mark.parametrize(
    "language, text, names",
    [
        ("rust", "/// Reads.\nfn f<'a>(x: &'a str) -> Vec<&'a str> {\n let c = '{'; \n}\n/// Declared.\nfn g(&self);\n", "f g"),
        ("typescript", "// Adds.\nexport const a = async (x) => {\n return '}';\n}\n/** B */\nconst b = function (y) { return 1 }\n/** D */\n  probe(block: unknown): number\n// call\nfoo(x);\n// if\nif (x) { y }\n", "a b probe"),
        ("java", "/** Adds. */\npublic static List<Foo> add(int a, int[] b) throws A, b.C {\n return 1;\n}\n", "add"),
        ("c", "// c\nchar *name(void)\n{ return 0; }\n// call\nreturn f(x);\n", "name"),
        (None, "/** Adds. */\nint add(int a) {\n return 1;\n}\n// js\nfunction z(){ }\n", "add z"),
        ("go", "// Go.\nfunc (r *X) Y(a int) []byte\n// Z.\nfunc Z() (int, error) { return `}`, nil }\n", "Y Z"),
    ],
)
def test_shapes_of_functions(language, text, names):
    assert sorted(x[0] for x in doc_pairs.capture(text, language)) == names.split()


def test_capture_protects_strings_and_is_linear():
    ts = '/** Doc one. */\nexport function a(x: Map<string, number>): void {\n  if (x) { s = "}"; t = `{`; } // }\n}\n'
    assert [(n, d.strip(), b[-1]) for n, _, d, b in doc_pairs.capture(ts, "typescript")] == [("a", "/** Doc one. */", "}")]
    assert [x[0] for x in doc_pairs.capture("// Doc\nfunc (r *R) Do(a []byte) (int, error) {\n\treturn \"}\"\n}\n", "go")] == ["Do"]
    assert [x[0] for x in doc_pairs.capture("/// Doc\npub fn new(&self) -> Option<String> { x }\n", "rust")] == ["new"]
    py = 'class A:\n    def f(self):\n        """Doc."""\n        s = "def g(): pass"\n        return s\n\ndef h():\n    pass\n'
    assert [(x[0], x[2]) for x in doc_pairs.capture(py, "python")] == [("f", "Doc.")]
    assert doc_pairs.capture("// x\n" * 100_000, "go") == [] and doc_pairs.capture("/* " * 100_000, "rust") == [] and doc_pairs.capture(None, None) == []


# ---------------------------------------------------------------- 8: leaks


def brute_leaks(docs, items, length):
    out = set()
    for d, t in docs:
        w = leaks.words(t)
        grams = {tuple(w[i : i + length]) for i in range(len(w) - length + 1)}
        for i, *fs in items:
            for f in fs:
                q = leaks.words(f)
                if d is not None and i is not None and any(tuple(q[k : k + length]) in grams for k in range(len(q) - length + 1)):
                    out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    r = random.Random(5)
    v = ["alpha", "beta", "gamma", "delta", "the", "of"]
    text = lambda n: " ".join(r.choice(v) for _ in range(n))
    items = [(i, text(12), text(20)) for i in range(12)] + [(12, None, ""), (13, "short one", None), (None, text(20), None), (3, text(12), None)]
    docs = [(i, text(r.randrange(0, 80))) for i in range(60)] + [(60, items[2][2].upper().replace(" ", " -- ")), (61, None), (62, ""), (None, items[1][2]), (0, text(30)), (63, (text(20_000) + " " + items[4][2]))]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    q = spark.createDataFrame([(i, a, b, "x") for i, a, b in items], "item_id long, intent string, expected string, text string")
    got = {(x["doc_id"], x["item_id"]) for x in leaks.leaks(d, q, length=7).collect()}
    assert got == brute_leaks(docs, items, 7) and len(got) > 3
    assert leaks.leaks(d.limit(0), q, length=7).collect() == [] and leaks.leaks(d, q.limit(0), length=7).collect() == []


def test_one_index_answers_several_sets_and_near_matches(spark):
    phrase = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, phrase), (2, phrase.replace("w5 ", "w5 uh ")), (2, "another text " * 30)], "doc_id long, text string")
    q = spark.createDataFrame([(i, phrase, None) for i in range(3)], "item_id long, intent string, expected string")
    index = leaks.Index(d, segment_words=8)
    assert index.read().where("term IS NULL").count() > 1
    assert {(r["term"], r["df"]) for r in index.frequencies(spark.createDataFrame([("w5",), ("text",), ("absent",)], "term string")).collect()} == {("w5", 2), ("text", 1)}
    assert leaks.leaks(index, q, length=18).count() == 3
    assert leaks.leaks(index, q, length=18, slop=1).count() == 6
    other = spark.createDataFrame([(9, " ".join(["another", "text"] * 9), None)], "item_id long, intent string, expected string")
    assert [tuple(r)[:3] for r in leaks.leaks(index, other, length=18).collect()] == [(2, 9, 18)]


def test_near_tries_every_occurrence():
    at = lambda *p: np.array(p, np.int64)
    assert leaks._near([at(0), at(1, 3), at(6)], 0, 0, 2) == 3  # a b x b x x c: the second b leads on
    assert leaks._near([at(0), at(1, 3), at(6)], 2, 6, 2) == 3
    assert leaks._near([at(0), at(1), at(6)], 0, 0, 2) == 2


# ---------------------------------------------------------------- 9: mixing


def test_mix_shares_repeats_and_edges(spark):
    docs = [(i, f"word{i} " * (5 + i % 40), "a") for i in range(400)] + [(1000 + i, "tiny text here " * 3, "b") for i in range(8)] + [(2000, None, "a"), (2001, "", "b"), (2002, "x", None), (2003, "x y", "other"), (7, "again " * 9, "a")]
    d = spark.createDataFrame([(i, t, s, 1) for i, t, s in docs], "doc_id long, text string, source string, copies int")
    t = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 3), ("gone", 0.1, 2), ("bad", None, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(d, t).collect()
    assert {r["source"] for r in m} == {"a", "b"} and all(r["copies"] <= {"a": 1, "b": 3}[r["source"]] for r in m)
    tok = {s: sum(r["tokens"] * r["copies"] for r in m if r["source"] == s) for s in "ab"}
    assert abs(tok["a"] / (tok["a"] + tok["b"]) - 0.8) < 0.05
    small = mixing.mix(d, t, total_tokens=500).collect()
    assert 400 < sum(r["tokens"] * r["copies"] for r in small) < 600
    assert sorted(map(str, small)) == sorted(map(str, mixing.mix(d, t, total_tokens=500).collect()))
    rep = {r["source"]: r["actual_share"] for r in mixing.shares_reached(mixing.mix(d, t), t.where("source is not null")).collect()}
    assert rep["gone"] == 0.0 and abs(rep["a"] + rep["b"] - 1) < 1e-9
    assert mixing.mix(d.limit(0), t).collect() == [] and mixing.mix(d, t.limit(0)).collect() == []


def test_mix_does_not_depend_on_how_rows_are_stored(spark):
    docs = [(i % 90, f"text {i % 50} " * (i % 7 + 1), "ab"[i % 2]) for i in range(300)] + [(None, "no id", "a"), (1, "text 1 ", "b")] * 3
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 3)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = [sorted(map(tuple, mixing.mix(d, targets).collect()), key=str) for d in (df, df.repartition(5), df.orderBy("text").coalesce(1))]
    assert got[0] == got[1] == got[2] and got[0]


def test_pivot_keeps_mass_and_expectation():
    import numpy as np

    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 50, 60).astype(float), rng.random(60)
    mean = np.zeros(60)
    for _ in range(400):
        out, left = mixing._pivot(size, p, rng.random(60))
        taken = np.maximum(out, 0)
        rest = (size * p).sum() - (size * taken).sum()
        assert -1e-6 <= rest <= (size[left] if left >= 0 else 0) + 1e-6
        mean += np.where(out < 0, rest / size[left] if left >= 0 else 0, out)
    assert abs(mean / 400 - p).max() < 0.12


# ---------------------------------------------------------------- 10: look-alikes


def test_same_look(spark):
    base = "Plain office words naïve ёлка"
    same = ["Рlain office words naïve ёлка", "Ｐｌａｉｎ office words naïve ёлка", "Plain oﬃce words naïve ёлка", "Plain office words nai\u0308ve ёлка", "Plain\u00a0office words na\u00adïve\u200b ёлка", "Plain office words naïve ëлка"]
    other = ["plain office words naïve ёлка", "Plain office  words naïve ёлка", "Plain office words naive ёлка", "Plain office words, naïve ёлка", "", None]
    rows = [(i, t) for i, t in enumerate([base, base, *same, *other])] + [(None, base), (100, "аор"), (101, "aop"), (102, "x" * 200_000), (103, "х" + "x" * 199_999)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, form string")
    got = {tuple(x) for x in lookalikes.same_look(df).collect()}
    alike = [i for i, t in rows[:8]]
    want = {(a, b) for a, b in itertools.combinations(alike, 2) if rows[a][1] != rows[b][1]} | {(100, 101), (102, 103)}
    assert got == want
    forms = lookalikes.canonical(df)
    assert forms.count() == len(rows)
    assert {r["canonical"] for r in forms.where("doc_id < 8").collect()} == {base}
    assert lookalikes.same_look(df.limit(0)).collect() == []


def test_trie_costs():
    t = lookalikes.Trie()
    for w, n in [("cop", 3), ("сор", 9), ("file", 1)]:
        t.add(w, n)
    hit = lambda *a: [(c, r[2]) for c, r in t.search(*a)]
    assert hit("соp") == [(0.0, "cop")] and hit("ﬁle") == [(0.0, "file")] and hit("ｆ\u00adile") == [(0.0, "file")]
    assert hit("fole") == [] and hit("fole", 1.0) == [(1.0, "file")] and hit("fil", 1.0) == [(1.0, "file")] and hit("ffile", 1.0) == [(1.0, "file")]
    assert hit("fжle", 0.5) == [(0.4, "file")] and hit("fжlж", 0.5) == [] and hit("жop", 0.5) == []  # one unknown letter, of a word long enough


def test_unknown_foreign_letters_are_matched_at_a_cost(spark, monkeypatch):
    """The table alone leaves these tokens; the automaton finds the one word they can stand for."""
    texts = ["commit window commit", "сommфt", "windжw", "wiΔdow winθow", "mint tint", "ҧint", "слово", "словq", "Ωmega"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {"сommфt": "commit", "windжw": "window", "wiΔdow": "window", "winθow": "window", "ҧint": "ҧint", "слово": "слово", "Ωmega": "Ωmega"}
    for size in (50_000, 1):  # whole blocks, and every word in a part of its own
        monkeypatch.setattr(lookalikes, "BLOCK_WORDS", size)
        got = {r["token"]: r["canonical"] for r in lookalikes.spellings(df).collect()}
        assert {t: got[t] for t in want} == want


def test_a_form_with_most_texts_is_paired_in_parts(spark, monkeypatch):
    from strataline.operators import skew

    monkeypatch.setattr(skew.hot_keys, "__defaults__", (10,))
    rows = [(i, "same words here" if i % 2 else "sаme words here") for i in range(30)] + [(50, "once")]
    got = {tuple(x) for x in lookalikes.same_look(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(a, b) for a in range(30) for b in range(a + 1, 30) if (a + b) % 2}
