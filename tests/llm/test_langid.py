import numpy as np

from siltstone.llm import langid


def test_gradient():
    net = langid.Network.fresh(["a", "b", "c"], hidden=3, seed=1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(0)
    x, y, w = rng.integers(97, 101, (4, 5)).astype(np.uint8), rng.integers(0, 3, 5), np.ones(5)
    _, grad = net.gradient(x, y, w)
    for name, at in [("xf", (98, 1)), ("xb", (99, 7)), ("hf", (2, 4)), ("hb", (0, 8)), ("o", (4, 1)), ("c", (2,))]:
        step, loss = 1e-3, []
        for sign in (1, -1):
            net.weights[name][at] += sign * step
            loss.append(net.gradient(x, y, w)[0])
            net.weights[name][at] -= sign * step
        assert abs((loss[0] - loss[1]) / (2 * step) - grad[name][at]) < 1e-3


def brute(net, text):
    """The pooled probabilities of a text, a window at a time and a byte after the other."""
    w, n, total = net.weights, len(net.weights["hf"]), 0
    logistic = lambda x: 1 / (1 + np.exp(-x))
    for start in range(0, len(text), langid.WINDOW):
        low, stop = max(0, start - langid.AROUND), min(len(text), start + langid.WINDOW)
        read, states = text[low : min(len(text), stop + langid.AROUND)], {}
        for way, order in (("f", range(len(read))), ("b", range(len(read) - 1, -1, -1))):
            h = np.zeros(n)
            for t in order:
                gx, gh = w[f"x{way}"][read[t]], h @ w[f"h{way}"]
                z, r = logistic(gx[:n] + gh[:n]), logistic(gx[n : 2 * n] + gh[n : 2 * n])
                h = z * h + (1 - z) * np.tanh(gx[2 * n :] + r * gh[2 * n :])
                states[way, t] = h
        for t in range(start - low, stop - low):
            e = np.exp(np.concatenate([states["f", t], states["b", t]]) @ w["o"] + w["c"])
            total = total + e / e.sum()
    return total


def test_against_brute_force(spark):
    net = langid.Network.fresh(["a", "b", "c"], seed=2)
    rng = np.random.default_rng(3)
    texts = ["日本語" * 200, "a", "ab cd", *("".join(map(chr, rng.integers(32, 500, n))) for n in (255, 256, 257, 300, 700, 1200))]
    want = np.array([brute(net, t.encode()) for t in texts])
    assert np.allclose(net.pooled([t.encode() for t in texts]), want, rtol=1e-3)
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), net).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == [net.languages[k] for k in want.argmax(1)]
    assert np.allclose([r.score for r in got], want.max(1) / want.sum(1), rtol=1e-3)


def test_held_out_accuracy(documents):
    held = langid.held_out("doc_id")
    net = langid.fit(documents.filter(~held))
    rows = langid.identify(documents.filter(held), net).collect()
    known = [r for r in rows if r.lang_pred != "und"]
    assert len(rows) > 250 and np.mean([r.lang == r.lang_pred for r in known]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(odd, empty):
    net = langid.fit(odd)
    rows = langid.identify(odd, net).collect()
    assert len(rows) == odd.count() and set(odd.columns) < set(rows[0].asDict())
    clash = langid.identify(odd.withColumnsRenamed({"fp": "_label", "_b": "score"}), net)
    assert clash.columns == ["doc_id", "text", "lang", "source", "n_chars", "_h", "_label", "id", "lang_pred", "score"]
    assert {r._label for r in clash.collect()} == {"f"}
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {2, 3, 7}
    assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "es", "und"}
    assert langid.fit(empty) is None
    assert langid.identify(empty, net).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
