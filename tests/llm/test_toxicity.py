import numpy as np

from tsmill.llm import toxicity as T


def test_ordinal_fit_recovers_the_order():
    r = np.random.default_rng(1)
    w = np.array([3.0, -2.0, 0.0, 1.0])
    rows = [np.flatnonzero(r.random(4) < 0.4) for _ in range(4000)]
    z = np.array([w[x].sum() for x in rows]) + r.logistic(size=4000)
    grade = np.digitize(z, [0.5, 2.0])
    weight, cuts = T.fit_ordinal(rows, grade, 4, 3, steps=1500)
    assert np.allclose(weight, w, atol=0.35) and np.allclose(cuts, [0.5, 2.0], atol=0.3) and cuts[0] < cuts[1]


def test_gradient_by_differences():
    # the fit is a stationary point of the penalised likelihood
    r = np.random.default_rng(2)
    rows = [np.flatnonzero(r.random(3) < 0.5) for _ in range(300)]
    grade = r.integers(0, 3, 300)
    w, cuts = T.fit_ordinal(rows, grade, 3, 3, steps=4000, rate=0.02)

    def loss(w, cuts):
        z = np.array([w[x].sum() for x in rows])
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        p = T._sigmoid(edge[grade + 1] - z) - T._sigmoid(edge[grade] - z)
        return -np.log(p).sum() + 0.5 * T.DECAY * (w**2).sum()

    best = loss(w, cuts)
    for k in range(3):
        for d in (-0.05, 0.05):
            assert loss(w + d * np.eye(3)[k], cuts) > best
    for k in range(2):
        for d in (-0.05, 0.05):
            assert loss(w, cuts + d * np.eye(2)[k]) > best


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = T.rate(docs, labels)
    assert got.count() == docs.count()
    r = got.where("held_out").join(labels.withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    # over two fifths of the toxic labels lie on documents without a telling word; no reader of the text can know those
    flagged = r[r.toxic]
    assert len(flagged) > 20 and (flagged.label == 1).mean() > 0.97
    assert (r.toxic == (r.label == 1)).mean() > 0.94
    told = r.severity[(r.label == 1) & (r.severity > r.severity.median())].to_numpy()
    assert len(told) > 0.5 * (r.label == 1).sum() and r.severity[r.label == 0].quantile(0.99) < np.median(told)


def test_odd_rows(spark):
    rows = [(i, ("you idiot " if i % 2 else "fine day ") + "w" * (i % 7), 1) for i in range(60)]
    odd = [(None, None, 1), (None, "idiot", 1), (5, "", 1), (5, "", 1), (6, "idiot " * 20000, 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, i % 3 > 0 and 1 or 0, i % 2) for i in range(60)] + [(None, None, 1), (3, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = T.rate(docs, labels)
    assert got.columns == ["doc_id", "held_out", "severity", "grade", "toxic"] and got.count() == len(rows) + len(odd)
    assert got.where("doc_id = 6 and toxic").count() >= 1 and got.where("doc_id is null and toxic").count() == 1
    assert got.where("severity < 0 or severity > 2 or severity is null").count() == 0
    assert T.rate(docs.limit(0), labels).collect() == []
    none = T.rate(docs, labels.limit(0))
    assert none.count() == len(rows) + len(odd) and none.where("toxic or severity > 0.001").count() == 0
