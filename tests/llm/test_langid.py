import zlib

import numpy as np

from sluice.llm import langid as L


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = L.op7_subword_softmax(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, truth[r.doc_id][1] or "")))
    aside = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in aside]) > 0.97


def test_sample_has_no_held_out_document(spark):
    docs = spark.createDataFrame([(i, "x y", "held" if zlib.crc32(str(i).encode()) % 4 == 2 else "seen") for i in range(40)], "doc_id long, text string, lang string")
    assert L.fit(docs).langs == ["seen"]


def test_sample_is_bounded_and_has_every_language(spark):
    """A hot language, a rare one, and one id with very many rows."""
    docs = spark.range(20_000).selectExpr("if(id < 3000, 1L, id) doc_id", "concat('text ', id) text", "if(id = 19999 or id = 19998 or id = 19997, 'rare', 'hot') lang")
    got = L.sample(docs, 200).collect()
    assert len(got) <= 200 and len({r.doc_id for r in got}) == len(got) and {r.lang for r in got} == {"hot", "rare"}
    assert sum(r.lang == "hot" for r in got) == 100


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 !", "a"), (None, "words here", None), (4, "é" * 300_000, "b"), (4, "é", "b"), (5, "a", "c")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = L.identify(docs, L.fit(docs)).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and len(got) == len(rows)
    assert all(r.lang_pred != "und" for r in got[3:])
    none = docs.limit(0)
    assert L.fit(none) is None and L.identify(none, None).count() == 0
    assert L.identify(docs, None).where("lang_pred <> 'und'").count() == 0


def plain_subwords(text):
    """Buckets of n-grams of letter runs with their word edges, one by one."""
    points = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    if all(p == 32 for p in points):
        return None
    edged, out = [32, *points, 32], []
    for n in L.ORDERS:
        for k in range(len(edged) - n + 1):
            gram = edged[k : k + n]
            if 32 in gram[1:-1] or n == 2 and gram == [32, 32]:
                continue
            h = n
            for p in gram:
                h = (h * 0x01000193 + p) & 0xFFFFFFFF
                h ^= h >> 15
            out.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> 16 & (L.BUCKETS - 1))
    return out


def test_subwords_and_logits_against_plain_python():
    rng = np.random.default_rng(1)
    model = L.Model(["a", "b", "c"], rng.normal(size=(L.BUCKETS, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    for text in ("Ab", "x", "Straße 12, été!", "ǅ İ\u0307", "a" * 500, "  a  b ", "12 - 3", "語言 é\u0301"):
        want, got = plain_subwords(text), L.subwords(text)
        assert (got is None) == (want is None)
        if want:
            assert sorted(got.tolist()) == sorted(want)
            logits = [sum(float(model.table[b][k]) for b in want) / len(want) + float(model.bias[k]) for k in range(3)]
            assert np.allclose(model.logits(got), logits, atol=1e-5)
            e = np.exp(np.array(logits) - max(logits))
            assert model.predict(text)[:2] == (model.langs[int(np.argmax(logits))], model.predict(text)[1]) and abs(model.predict(text)[1] - e.max() / e.sum()) < 1e-5


def test_steps_of_training_follow_the_numeric_gradient():
    bags, langs = [L.bag("ab"), L.bag("cd e")], ["x", "y"]
    model = L.train(bags, langs, epochs=1)
    rng = np.random.default_rng(L.SEED)
    order = rng.permutation(2)
    e, w, b = rng.normal(0, 0.1, (L.BUCKETS, L.DIM)).astype(np.float32).astype(float), rng.normal(0, 0.3, (L.DIM, 2)).astype(np.float32).astype(float), np.zeros(2)
    for k in rng.permutation(order):
        (at, n), y = bags[k], k
        share = n / n.sum()

        def loss():
            z = (share @ e[at]) @ w + b
            return np.log(np.exp(z).sum()) - z[y]

        grads = []
        for a, rows in ((e, at), (w, range(L.DIM)), (b, range(2))):
            g = np.zeros_like(a)
            for i in rows:
                for j in np.ndindex(a[i].shape):
                    cell = (i, *j)
                    old = a[cell]
                    a[cell] = old + 1e-5
                    high = loss()
                    a[cell] = old - 1e-5
                    g[cell] = (high - loss()) / 2e-5
                    a[cell] = old
            grads.append(g)
        for a, g, rate in zip((e, w, b), grads, (1, 0.02, 0.002)):
            a -= rate * L.RATE * g
    used = np.unique(np.concatenate([at for at, _ in bags]))
    assert np.allclose(model.table[used], (e @ w)[used], atol=2e-3) and np.allclose(model.bias, b, atol=1e-4)
