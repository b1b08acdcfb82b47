import re
from collections import Counter

import numpy as np
from edge import no_documents, odd_documents

from quire.llm import quality


def brute(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    for r in quality.statistics(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)


def test_base_rules(spark, sf_dir):
    found = {r.doc_id: r for r in quality.op3_quality(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words, _, _, _, repeats = brute(r.text)
        row = found[r.doc_id]
        assert row.base_failed == (words < 50 or 100 * repeats > 50 * words) and (not row.kept or not row.base_failed)


def mcd(x, share=0.5, steps=12):
    """The same estimate with arrays."""
    p = x.shape[1]
    floor = np.diag(np.array(quality.FLOOR) ** 2)
    step = quality.STEP

    def median(v):
        b = np.round(v / step)
        return np.sort(b, axis=0)[int(np.ceil(len(v) * 0.5)) - 1] * step

    mean = median(x)
    cov = np.diag((median(np.abs(x - mean)) * 1.4826) ** 2)

    def d2(mean, cov):
        d = x - mean
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov + floor), d)

    before = None
    for _ in range(steps):
        b = np.floor(np.log(d2(mean, cov) + 1e-6) * quality.GRID)
        need = min(len(x), int(np.ceil(len(x) * share)) + p + 1)
        keep = b <= np.sort(b)[need - 1]
        mean, cov = x[keep].mean(0), np.cov(x[keep].T, bias=True) * share / quality._chi2(quality._quantile(share, p), p + 2)
        if before is not None and np.array_equal(before, keep):
            break
        before = keep
    outer = quality._quantile(0.975, p)
    keep = d2(mean, cov) <= outer
    return d2(x[keep].mean(0), np.cov(x[keep].T, bias=True) * 0.975 / quality._chi2(outer, p + 2))


def test_distances_equal_arrays(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)) * 0.2 + 0.3
    x[:90] += 1.5
    rows = spark.createDataFrame([("g", i, *map(float, v)) for i, v in enumerate(x)], "g string, i int, " + ", ".join(f"{c} double" for c in quality.VECTOR))
    measured = quality._measured(rows, quality.robust_fit(rows)).orderBy("i").collect()
    found, want = np.array([r.d2 for r in measured]), mcd(x)
    assert np.allclose(found, want, rtol=1e-6)
    assert found[:90].min() > quality._quantile(1 - 1e-6, 6) and (found[90:] < quality._quantile(1 - 1e-6, 6)).all()


def test_junk_goes_and_clean_stays(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 9))) for _ in range(3000)]
    docs = []
    for i in range(500):
        own = [words[j] for j in rng.integers(0, 3000, rng.integers(60, 400))]
        docs.append((i, " ".join(w + "***" for w in own) if i % 10 == 0 else " ".join(own), "en" if i % 3 else "de", f"s{i % 40}"))
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.verdicts(rows).collect()}
    assert all(kept[i] == bool(i % 10) for i in range(500))


def test_chi_square():
    assert abs(quality._quantile(0.95, 6) - 12.5916) < 1e-3 and abs(quality._quantile(0.5, 4) - 3.3567) < 1e-3


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = quality.verdicts(docs)
    assert found.count() == docs.count()
    kept = quality.drop_low_quality(docs)
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").count() == 0
    assert quality.verdicts(no_documents(spark)).count() == 0


def test_drop_keeps_rows_as_they_are(spark):
    """Columns of the same names as statistics, nulls, repeats; only rows that fail go."""
    docs = odd_documents(spark).withColumn("n_words", quality.F.lit("mine")).withColumn("d2", quality.F.lit(1)).withColumn("row", quality.F.lit(2))
    good = " ".join(f"word{i} and more" for i in range(40))
    docs = docs.unionByName(docs.limit(1).withColumn("text", quality.F.lit(good)).withColumn("doc_id", quality.F.lit(500).cast("long")))
    kept = quality.drop_low_quality(docs)
    assert kept.columns == docs.columns
    assert [(r.doc_id, r.n_words, r.text) for r in kept.collect()] == [(500, "mine", good)]


def dense_verdicts(rows, share=0.5, tail=1e-6, steps=12):
    """Outliers of one group by plain numpy: median and MAD start, concentration on the nearest half, one reweighting."""
    x = np.array([[r[c] for c in quality.VECTOR] for r in rows])
    p, n = x.shape[1], len(x)
    floor = np.diag(np.array(quality.FLOOR) ** 2)

    def distances(mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + floor), x - mean)

    mean = np.median(x, axis=0)
    cov = np.diag((1.4826 * np.median(np.abs(x - mean), axis=0)) ** 2)
    inner, outer = quality._quantile(share, p), quality._quantile(0.975, p)
    for _ in range(steps):
        near = np.argsort(distances(mean, cov), kind="stable")[: min(n, int(np.ceil(n * share)) + p + 1)]
        mean, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True) * share / quality._chi2(inner, p + 2)
    near = distances(mean, cov) <= outer
    mean, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True) * 0.975 / quality._chi2(outer, p + 2)
    return distances(mean, cov), quality._quantile(1 - tail, p)


def test_kept_equals_dense_fit(spark, sf_dir):
    """The query's verdicts against a dense fit of each group of the tables; distances near the limit may fall on either side."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stats = quality.vectors(quality.statistics(docs)).withColumn("failed", quality.base_failed()).collect()
    found = {r.doc_id: r for r in quality.op3_quality(spark, sf_dir).collect()}
    passed = [r for r in stats if not r.failed]
    assert {r.doc_id for r in stats if r.failed} == {i for i, r in found.items() if r.base_failed}
    groups = {}
    for r in passed:
        groups.setdefault(r.lang, {}).setdefault(r.source, []).append(r)
    checked = 0
    for own in groups.values():
        pooled = [r for rows in own.values() for r in rows]
        for rows in own.values():
            fitted = rows if len(rows) >= 60 else pooled if len(pooled) >= 60 else passed
            d2, limit = dense_verdicts(fitted)
            by = {r.doc_id: d for r, d in zip(fitted, d2)}
            for r in rows:
                checked += 1
                assert found[r.doc_id].kept == (by[r.doc_id] <= limit) or 0.8 < by[r.doc_id] / limit < 1.25
    assert checked == len(passed) > 100
