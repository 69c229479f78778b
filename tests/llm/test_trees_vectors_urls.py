"""Merkle manifest, whitening and URL filters against plain counterparts."""

import hashlib
import math
import os
import random
import sys
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from conftest import rows_of  # noqa: E402
from helpers import awkward, empty  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from foliospark.llm import merkle, url_cascade, whitening  # noqa: E402

# 11 Manifest ------------------------------------------------------------------------------------------


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return _h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _tree(leaves):
    """Root, and for each leaf its runs as (place, run) from below."""
    at, runs, now = list(range(len(leaves))), [[] for _ in leaves], leaves
    while len(now) > 1:
        groups = [now[k : k + 16] for k in range(0, len(now), 16)]
        for i, p in enumerate(at):
            runs[i].append((p % 16, groups[p // 16]))
        at, now = [p // 16 for p in at], [_h(*g) for g in groups]
    return now[0], runs


def _manifest(rows):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = [(r, _leaf(r, r["text"])) for r in rows if r["source"] == s]
        own.sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        trees[s] = own, *_tree([leaf for _, leaf in own])
    root, tops = _tree([trees[s][1] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        own, subroot, paths = trees[s]
        for (r, leaf), path in zip(own, paths, strict=True):
            text, now = r["text"], leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                now = _leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            proof = ""
            for place, run in path + top:
                now = _h(*run[:place], now, *run[place + 1 :])
                proof += "".join(run[:place] + run[place + 1 :])
            out.append((r["doc_id"], leaf, subroot, root, _h(proof), now, now == root))
    return sorted(out, key=str)


_COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _got(df):
    return sorted((tuple(r[c] for c in _COLUMNS) for r in df.collect()), key=str)


def test_manifest_awkward_rows(spark):
    df = awkward(spark)
    assert _got(merkle.manifest_query(df)) == _manifest(df.collect())
    assert merkle.manifest_query(empty(spark)).count() == 0
    one = awkward(spark, [(2**60 + 1, "Only One", "s")])
    (row,) = merkle.manifest_query(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == _h() and row["doc_id"] == 2**60 + 1


@pytest.mark.parametrize("n", [16, 17, 256, 257, 4096 + 5])
def test_manifest_sizes_of_trees(spark, n):
    """One hot source around the edges of runs, blocks and passes, beside many small ones."""
    rows = [(i, f"Text {i}", "hot" if i < n else f"s{i % 40}") for i in range(n + 300)]
    random.Random(n).shuffle(rows)
    df = awkward(spark, rows, ()).repartition(7)
    assert _got(merkle.manifest_query(df)) == _manifest(df.collect())


def test_manifest_equal_rows_and_many_sources(spark):
    rows = [(None, "same", "s")] * 700 + [(i, "T", f"src{i:04d}") for i in range(300)]
    df = awkward(spark, rows, ())
    assert _got(merkle.manifest_query(df)) == _manifest(df.collect())


def test_manifest_paths_verify(spark):
    df = awkward(spark, [(i, f"Text {i}", f"s{i % 3}") for i in range(900)], ())
    leaf = merkle.leaf_digest(*(F.col(c) for c in merkle.FIELDS))
    for r in merkle.manifest(df, leaf, df["source"], df["doc_id"], with_path=True).collect():
        assert merkle.fold(r["leaf"], merkle.path_of(r["path"])) == r["root"] == r["folded_root"]
        assert merkle.fold(merkle.digest("x"), merkle.path_of(r["path"])) != r["root"]


# 12 Whitening -----------------------------------------------------------------------------------------


def test_eigen():
    rng = np.random.default_rng(5)
    for a in (rng.normal(size=(30, 30)), np.outer(*[rng.normal(size=9)] * 2), np.zeros((4, 4)), np.eye(5), np.diag([1.0, 4, 2]), np.array([[3.0]])):
        a = a + a.T
        values, vectors = whitening.symmetric_eigen(a)
        size = max(1.0, np.abs(a).max())
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * size * len(a))
        assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13 and np.abs(a @ vectors - vectors * values).max() < 1e-12 * size


def test_states_merge_in_any_order():
    x = np.random.default_rng(1).integers(-300, 300, size=(500, 7))
    parts = [whitening.State(7) for _ in range(4)]
    for k, p in enumerate(parts[:3]):
        p.extend(x[k::3])
    for order in ((0, 1, 2, 3), (3, 2, 1, 0)):
        whole = whitening.State(7)
        for k in order:
            whole.merge(whitening.State.of(parts[k].row()))
        assert whole.n == 500 and whole.sums == x.sum(axis=0).tolist()
        assert np.allclose(whole.scatter / 500, np.cov(x.T, bias=True), rtol=1e-12, atol=1e-9)


def _whiten(vectors):
    """Plain: rows that are left by id, n, deviations and whitened values, signs free."""
    good = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v in good], dtype=object)
    fit = np.array(sorted({tuple(v) for v in x.tolist()}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    white = (x * n - sums).astype(float) / n @ axes / np.sqrt(values)
    return [i for i, _ in good], n, [sum(int(c) ** 2 for c in row) for row in x * n - sums], white, values


def _vector_table(spark, rows):
    return spark.createDataFrame([(i, v, -1, -1) for i, v in rows], "vec_id long, embedding array<float>, x int, n int")


def test_whitening_equals_plain(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 20)) * np.linspace(0.3, 3, 20)
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(3, rows[3][1])]
    bad = [(2000, None), (2001, []), (2002, [1.0] * 19 + [None]), (2003, [1.0] * 19 + [float("nan")]), (2004, [float("-inf")] + [1.0] * 19)]
    ids, n, deviation, white, values = _whiten(rows)
    got = whitening.whiten(_vector_table(spark, rows + bad + [(2**60 + 1, rows[9][1])]).repartition(5)).toPandas()
    assert n == 300 and len(got) == 16 * (len(rows) + 1) and set(got.n) == {n} and 2**60 + 1 in set(got.vec_id)
    signs = None
    for i, d, w in zip(ids, deviation, white, strict=True):
        own = got[got.vec_id == i].sort_values("component", kind="stable").drop_duplicates("component")
        assert own.component.tolist() == list(range(1, 17)) and set(own.deviation) == {d}
        signs = np.sign(own.whitened.to_numpy() * w) if signs is None else signs
        assert np.abs(own.whitened.to_numpy() * signs - w).max() < 1e-9
    share = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.allclose(share / share[0], values / values[0], rtol=1e-10) and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-10


def test_whitening_edges(spark):
    assert whitening.whiten(_vector_table(spark, [])).count() == 0
    one = whitening.whiten(_vector_table(spark, [(None, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in one)
    flat = whitening.whiten(_vector_table(spark, [(i, [float(i), 2.0, float(-i)]) for i in range(9)])).collect()
    assert len(flat) == 27 and {r["component"] for r in flat if r["whitened"] is None} == {2, 3}
    assert max(r["identity_error"] for r in flat) < 1e-10
    mixed = whitening.whiten(_vector_table(spark, [(i, [float(i), 1.0][: 1 + i % 2]) for i in range(8)])).collect()
    assert {(r["vec_id"] % 2, r["n"]) for r in mixed} == {(0, 4), (1, 4)}
    huge = whitening.whiten(_vector_table(spark, [(0, [3e38, 0.0]), (1, [-3e38, 0.0]), (2, [0.0, 1.0])])).collect()
    assert all(r["deviation"] is None for r in huge if r["vec_id"] < 2) and len(huge) == 6


# 13 URL filters ---------------------------------------------------------------------------------------


def _pages(spark, urls):
    return spark.createDataFrame([(i, u, 1, 1) for i, u in enumerate(urls)], "page_id long, url string, listed int, key int")


AWKWARD = [
    None, "", "no scheme.net/en/", "://", "http://", "https://A.Example.NET/en/x", "http://example.net/EN/x", "http://example.net/en",
    "http://net/", "http://net", "http://x.net?q", "http://x.net#f/en/", "http://xnet/", "ftp://a.b.org/fr/1?x=/y", "http://org/fr/",
    "http://example.com/de/..", "http://myexample.com/de/", "http://u:p@h.example.com:80/de/1", "a://b://c.net/d", "http://é.net/\nx?y",
    "http://casino-x.example.com/1", "http://www.casino-x.example.com/2/", "http://notcasino.example.com", "HTTP://ADS.Example.org/fr/", "http://a..net/" + "y" * 50000,
]


def test_urls_same_as_sql(spark):
    urls = AWKWARD * 2 + [f"http://{'hot' if i % 3 else f'h{i}'}.example.{('com', 'net', 'org')[i % 5 % 3]}/{i}/" for i in range(2000)]
    pages = _pages(spark, urls)
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": range(len(urls)), "url": urls}))
    want = rows_of(con.execute(url_cascade.SQL).df())
    assert rows_of(url_cascade.filter_query(pages).toPandas()) == want
    several = url_cascade.filter_urls(pages, url_cascade.listed_keys(pages), part_bits=256)
    assert rows_of(several.toPandas()) == want
    assert url_cascade.filter_query(_pages(spark, [])).count() == 0



def test_longest_rule_wins(spark):
    rules = [("a.net", "/x/", "block"), ("net", "/x/yz", "allow"), ("b.a.net", "/", "allow"), ("b.a.net", "/", "block"), ("net", "/", "block")]
    pages = _pages(spark, ["http://a.net/x/yz", "http://b.a.net/q", "http://c.net/x/y", "http://c.org/"])
    none = pages.select(F.lit(None).cast("string"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_cascade.filter_urls(pages, none, rules).collect()}
    assert got == {0: ("a.net/x/", "block"), 1: ("b.a.net/", "allow"), 2: ("net/", "block"), 3: (None, "allow")}


def test_cascade_is_exact(spark):
    """Every key of the universe is answered rightly, though single levels err; listed keys outside it change nothing."""
    keys = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id"))
    for every in (2, 97, 1):
        listed = keys.where(F.col("id") % every == 0).select("key").union(keys.select(F.concat(F.lit("z"), "id")))
        marked = url_cascade.mark_keys(keys.select("key").union(keys.select("key")), listed.union(listed))
        assert marked.count() == 30_000
        cascade = url_cascade.Cascade(marked)
        wrong = keys.where(cascade.has(F.col("key")) != (F.col("id") % every == 0)).count()
        assert wrong == 0 and (len(cascade.levels) > 2) == (every > 1)
    assert not url_cascade.Cascade(url_cascade.mark_keys(keys.select("key"), keys.select("key").limit(0))).levels
