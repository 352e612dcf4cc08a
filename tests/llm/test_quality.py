"""The quadratic discriminant against densities worked out the long way, and held-out accuracy."""

import zlib

import numpy as np
import pytest

from typeahead.llm import gauss_quality as q

COLUMNS = "doc_id long, text string, label int, score string, stats int, id string"


def test_statistics_of_odd_texts():
    for text in ("", "a", "\n\n\n", "é" * 5000, "A!! " * 30_000, "\x00\x01", "| | |", "日本語"):
        row = q.statistics(text.encode())
        assert len(row) == q.N_STATS and np.isfinite(row).all()


def test_log_density_is_the_gaussian_one():
    rng = np.random.default_rng(3)
    x = {0: rng.normal(size=(400, 4)) * [1, 2, 3, 40], 1: rng.normal(size=(900, 4)) + 1}
    sums = {y: (r := np.column_stack([np.ones(len(v)), v])).T @ r for y, v in x.items()}
    got = q.fit_gaussians(sums, 0.0, 0.0)
    at = rng.normal(size=(20, 4))
    for y in (0, 1):
        mean, cov = x[y].mean(0), np.cov(x[y].T, bias=True)
        d = at - mean
        want = -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1] + 4 * np.log(2 * np.pi))
        assert np.allclose(got[y].log_density(at), want)
    # full shrinkage gives both classes one spherical covariance on the pooled scale
    a, b = q.fit_gaussians(sums, 1.0, 1.0)
    assert np.allclose(a.whiten, b.whiten) and np.allclose(a.whiten, np.diag(np.diag(a.whiten)))


def test_constant_statistics_keep_a_factor():
    x = np.ones((5, 3))
    sums = {y: (r := np.column_stack([np.ones(5), x + y])).T @ r for y in (0, 1)}
    a, b = q.fit_gaussians(sums, 0.1, 0.02)
    assert np.isfinite(a.log_density(x)).all() and (a.log_density(x) > b.log_density(x)).all()


def test_curve_follows_the_counts():
    at = np.linspace(-4, 4, 81)
    p = 1 / (1 + np.exp(-(1.5 * at + 0.7)))
    slope, offset = q.fit_curve(at, 1000 * (1 - p), 1000 * p)
    assert abs(slope - 1.5) < 0.01 and abs(offset - 0.7) < 0.01


@pytest.fixture(scope="module")
def docs(spark):
    good = ["the brown fox ran home and slept well under a tree. it was late, number %d of the year" % i for i in range(60)]
    bad = ["BUY!! NOW!! CHEAP!! %d && $$ ### BUY!! NOW!!\nBUY!! NOW!! CHEAP!!" % i for i in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(100 + i, t, 0) for i, t in enumerate(bad)]
    rows += [(300, None, None), (301, "", 1), (302, "x " * 60_000, 0), (None, "no id", 1), (5, good[5], 1)]
    return spark.createDataFrame([r + ("s", 1, "i") for r in rows], COLUMNS).repartition(3)


def test_scores(spark, docs):
    labels = docs.selectExpr("doc_id", "label AS quality", "'x' AS text", "1 AS stats")
    got = q.score_quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert len(held) > 10 and all((r.score >= 0.3) == (r.doc_id < 100) for r in held)
    # labels of held-out rows have no say
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    again = q.score_quality(docs, flipped).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_scores_without_labels(spark, docs):
    labels = docs.selectExpr("doc_id", "label AS quality")
    for chosen, want in ((labels.limit(0), 0.5), (labels.filter("quality = 1"), 1.0), (labels.filter("quality = 0"), 0.0)):
        assert all(abs(r.score - want) < 1e-9 for r in q.score_quality(docs, chosen).collect())
    assert q.score_quality(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = q.score_quality(spark.read.parquet(f"{d}/documents.parquet"), labels)
    rows = got.filter("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == y] for y in (1, 0))
    auc = np.mean([np.mean([(g > b) + 0.5 * (g == b) for g in good]) for b in bad])
    right = np.mean([(r.score >= 0.3) == (r.quality == 1) for r in rows])
    assert auc > 0.9 and right > 0.9, (auc, right)
