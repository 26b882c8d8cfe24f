"""URL templates, lexical search and whitening against plain versions and awkward rows."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from logweir.llm import catalog, heavy, lexical_search, url_templates, whitening
from tests.llm import brute
from tests.llm.test_operators import ROWS, prose, rows_of

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
RULES = [(r.verdict, r.host, r.path) for r in catalog.RULES]


def read(sf_dir, table, *columns):
    t = pq.read_table(f"{sf_dir}/{table}.parquet", columns=list(columns))
    return list(zip(*(c.to_pylist() for c in t.columns)))


# Lexical search ----------------------------------------------------------------------------


def test_terms():
    text = "Ab-cd\x7fé_X9 ÀB\x00z" + " q" * 5
    got = [t.decode() for piece in lexical_search.terms(text.encode()) for t in piece if t]
    assert got == ["ab", "cd", "é", "x9", "Àb", "z", *"qqqqq"]
    assert list(lexical_search.terms(None)) == list(lexical_search.terms(b"")) == []


def test_terms_of_a_long_text_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 7)
    text = prose(5, 400)
    pieces = list(lexical_search.terms(text.encode()))
    assert len(pieces) > 50 and [t.decode() for p in pieces for t in p if t] == text.lower().split()


@pytest.mark.parametrize("band", [8, 1_024])
def test_search_equals_brute_force(spark, monkeypatch, band):
    monkeypatch.setattr(lexical_search, "BAND", band)
    rows = [(d if d % 9 else None, t) for d, t in ROWS] + [(d, t) for d, t in ROWS[:20]]
    items = [(1, "Loop ww x"), (1, prose(1, 40)), (2, None), (3, ""), (4, "!?"), (None, prose(2, 30)), (5, prose(3, 90))]
    items += [(6 + k, prose(70 + k, 12)) for k in range(6)] + [(20, "absent"), (21, prose(40, 3_000))]
    docs = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, rank string, n int")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    got = lexical_search.search(docs.repartition(5), asked).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute.best_documents(items, rows), key=key)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical_search.search(none, asked).collect() == []
    assert lexical_search.search(docs, asked.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in lexical_search.search(docs, asked).collect()] in ([], [(1, 1, 1)])


def test_masks_are_skipped():
    """A band whose masks cannot reach the best so far is not scored."""
    best = lexical_search.Best(1)
    band = lexical_search.Band(
        np.array([0, 2, 3]), np.array([0, 1, 0]), np.array([3, 1, 1]), np.array([60, 60], np.int64)
    )
    band.search(np.array([0, 1]), np.array([500, 900]), [7, 8], best)
    assert [e[1] for e in best.heap] == [7]
    before = best.least
    band.search(np.array([0]), np.array([1]), [9, 10], best)
    assert best.least == before


# Whitening ---------------------------------------------------------------------------------


def check_whitened(got, rows, components=8):
    ids, n, deviations, plain, explained = brute.whitened(rows, components)
    take = plain.shape[1]
    assert len(got) == len(ids) * take
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    out = np.array([[by[i][k + 1].whitened for k in range(take)] for i in ids])
    signs = np.sign((out * plain).sum(0))
    assert np.abs(out - plain * signs).max() < 1e-6
    assert [by[i][1].deviation for i in ids] == deviations and {r.n for r in got} == {n}
    for k in range(take):
        assert by[ids[0]][k + 1].explained == pytest.approx(explained[k], rel=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    return out


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12))
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(rng.normal(size=(400, 12)) @ mix)]
    odd = [(900, None), (901, []), (902, [1.0] * 11), (903, [None] + [1.0] * 11), (904, [math.nan] * 12), (905, [math.inf] * 12)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, n string")
    out = check_whitened(whitening.whiten(df.repartition(7)).collect(), rows)
    assert np.abs(out.T @ out / len(out) - np.eye(8)).max() < 1e-9


def test_whitening_query(spark):
    rows = read(MEDIUM, "embeddings", "vec_id", "embedding")
    check_whitened(catalog.op13_whitening(spark, MEDIUM).collect(), rows)


def test_whitening_of_few_and_equal_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).collect() == []
    same = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(same).collect()
    assert [(r.vec_id, r.component, r.deviation, r.whitened) for r in got] == [(None, k, 0, None) for k in (1, 2)] * 2
    line = spark.createDataFrame([(k, [float(k), float(2 * k)]) for k in range(5)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got) and got[0].identity_error < 1e-12
    large = spark.createDataFrame([(k, [1e300 * k, float(k % 3)]) for k in range(5)], "vec_id long, embedding array<double>")
    assert len(whitening.whiten(large).collect()) == 10


@pytest.mark.parametrize("spread", [1e-3, 1e-9, 0.0])
def test_clustered_eigenvalues(spread):
    """Eigenvalues that single precision cannot tell apart still give their own vectors."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0].astype(np.longdouble)
    q, _ = q, 0
    for _ in range(4):  # orthonormal beyond double precision
        q = q + q @ ((np.eye(20) - q.T @ q) / 2)
    values = np.array([9, 9 - spread, 9 - 3 * spread, 5, 5 - spread, *np.linspace(3, 0.1, 15)], np.longdouble)
    a = (q * values) @ q.T
    got, vectors = whitening.eigenvectors(a)
    assert np.abs(got - values.astype(float)).max() < 1e-14
    assert np.abs(vectors.T @ vectors - np.eye(20)).max() < 1e-14
    assert np.abs(a.astype(float) @ vectors - vectors * got).max() < 1e-13
    apart = range(20) if spread else range(5, 20)
    allowed = 1e-14 if spread != 1e-9 else 1e-9
    assert max(1 - abs(float(q[:, k] @ vectors[:, k])) for k in apart) < allowed


def test_refinement_reaches_double_precision():
    a = np.cov(np.random.default_rng(1).normal(size=(40, 500)))
    values, vectors = whitening.eigenvectors(a)
    plain = np.linalg.eigh(a)
    assert np.abs(values - plain[0][::-1]).max() < 1e-13
    rough = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    off = lambda m: np.abs(np.abs((m * plain[1][:, ::-1]).sum(0)) - 1).max()
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 < np.abs(a @ rough - rough * values).max()
    assert off(vectors) < 1e-13


# URL templates -------------------------------------------------------------------------------


def urls():
    rng = random.Random(11)
    out = [None, "", "no scheme", "http://", "http://A.Com", "http://a.com?x=/en/", "HTTP://a.com#/x", "x://com/", "ftp://u@www.EXAMPLE.com:80/en/"]
    out += ["https://com/en/", "http://notcom/en", "http://b.net/es/1", "http://b.net/es", "http://www.example.com/en/x", "http://example.com/en/x"]
    for n in range(300):
        lang = rng.choice(["en", "en", "de", "es", "fr"])
        end = rng.choice(["", "/", ".html", "?q=1#x"])
        out.append(f"http://{rng.choice(['big', 'big', 'big', f's{n % 9}'])}.example.{rng.choice(['net', 'org'])}/{lang}/{rng.randrange(4000)}{end}")
    for n in range(60):
        out.append(f"https://files.net/{rng.choice(['a', 'b', 'c'])}/{rng.randrange(10**17):x}/{'x/' * rng.randrange(4)}y{n}")
        out.append(f"https://files.net/es/{rng.choice(['p', 'q'])}//{n}.HTML")
    out.append("http://deep.org/" + "s/" * 300)
    out += ["http://lit.org/=x/<number>/1"] * 4 + ["http://lit.org/" + "\n/ü"] * 4
    return [(k if k % 50 else None, u) for k, u in enumerate(out)]


@pytest.mark.parametrize("settings", [{}, {"nodes": 20, "support": 4}])
def test_urls_equal_brute_force(spark, settings):
    rows = urls()
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, rule string")
    got = url_templates.judge(df.repartition(6), catalog.RULES, url_templates.Settings(**settings)).collect()
    key = lambda r: str(tuple(r)[:5])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(brute.judged_urls(rows, RULES, **settings), key=key)


def test_url_query(spark):
    rows = read(MEDIUM, "pages", "page_id", "url")
    got = rows_of(catalog.op11_url_filter(spark, MEDIUM), "page_id", "host", "path", "rule", "verdict")
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(brute.judged_urls(rows, RULES), key=key)


def test_learned_templates(spark):
    """Unlabelled pages follow a branch that rules mostly block, and no other."""
    rows = [(n, f"http://h.net/es/{n}") for n in range(40)] + [(n, f"http://h.net/en/{n}") for n in range(40, 90)]
    rows += [(n, f"http://h.net/shop/{'es' if n % 2 else 'fr'}/{n}") for n in range(90, 140)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in url_templates.judge(df, catalog.RULES).collect()}
    assert {got[n].verdict for n in range(40)} == {"block"} and {got[n].verdict for n in range(40, 140)} == {"allow"}
    assert {got[n].template for n in range(90, 140)} == {"/shop/(es|fr)/<number>"}
    spam = [url_templates.Rule("block", "h.net", f"/buy/{n}/") for n in range(9)]
    rows = [(n, f"http://h.net/buy/{n}/x") for n in range(30)] + [(n, f"http://h.net/read/{n}/x") for n in range(30, 60)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_templates.judge(df, spam).collect()}
    assert {got[n] for n in range(30)} == {"block"} and {got[n] for n in range(30, 60)} == {"allow"}


def test_urls_of_empty_table_and_no_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_templates.judge(df, catalog.RULES).collect() == []
    one = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [tuple(r)[:5] for r in url_templates.judge(one, []).collect()] == [(1, "a.com", "/x", None, "allow")]


def test_heavy_join(spark):
    left = spark.createDataFrame([(k % 3 if k % 10 else k + 100, k) for k in range(500)] + [(None, 1)], "a long, n long")
    right = spark.createDataFrame([(0, "x", 200), (1, "y", 200), (110, "z", 1), (120, "w", 0)], "a long, s string, weight long")
    got = heavy.join_heavy(left, right, ["a"], "weight")
    plain = left.join(right.drop("weight"), "a", "left")
    key = lambda r: str(tuple(r))
    assert sorted(got.collect(), key=key) == sorted(plain.collect(), key=key)
