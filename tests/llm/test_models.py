"""Toxicity and language: gradients against differences, held-out accuracy, edge cases."""

import numpy as np
import pytest

from rectpart.llm import langid, toxicity

BAD = ["grommel", "snarfig", "blotz"]


def sentences(rng, n, syllables):
    return [" ".join("".join(rng.choice(syllables, int(rng.integers(1, 4)))) for _ in range(int(rng.integers(8, 40)))) for _ in range(n)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    texts = sentences(rng, 900, ["ta", "no", "ri", "ke", "su", "lo"])
    y = rng.random(900) < 0.2
    texts = [f"{t} {BAD[int(rng.integers(0, 3))].capitalize()}{t[:2]} {t[::-1]}" if bad else t for t, bad in zip(texts, y)]
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int(b)) for k, b in enumerate(y)] + [(5000, 1), (5001, None)], "doc_id long, toxic int")
    return docs, labels, y


def test_toxicity_held_out(spark, labelled):
    docs, labels, y = labelled
    model = toxicity.train(docs, labels.filter("doc_id < 600"))
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    held = np.array([got[k] for k in range(600, 900)])
    assert ((held >= 0.3) == y[600:]).mean() > 0.97 and 0 <= held.min() and held.max() <= 1


def test_toxicity_edge_cases(spark, labelled):
    docs, labels, _ = labelled
    model = toxicity.train(docs, labels)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200_000 + " grommel"), (3, "x" * 200_000 + " grommel"), (None, "a")], "doc_id long, text string")
    got = toxicity.score_documents(rows, model).collect()
    assert len(got) == 5 and got[0].score == got[1].score and got[2].score == got[3].score
    assert toxicity.score_documents(rows.limit(0), model).count() == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(rows, nothing).collect()} == {0.5}
    one_class = toxicity.train(docs, labels.filter("toxic = 0"))
    assert toxicity.score_documents(rows, one_class).first().score < 0.01


def test_scores_add_up_weights_once_a_feature():
    model = toxicity.fit(["bad bad bad", "bad", "fine", "good fine"] * 5, np.array([1, 1, 0, 0] * 5))
    place = np.full(1 << toxicity.BITS, -1, np.int32)
    place[model.features] = np.arange(len(model.features))
    two = toxicity.scores(model, ["bad", "fine"], place)
    each = [toxicity.scores(model, [t], place)[0] for t in ("bad", "fine")]
    assert np.allclose(two, each) and two[0] > 0.5 > two[1]
    direct = set(np.concatenate([x for x, _ in toxicity.hashed(["bad"])]).tolist())
    assert np.isclose(np.log(two[0] / (1 - two[0])), model.bias + sum(w for f, w in zip(model.features.tolist(), model.weights) if f in direct))


def test_backpropagation_is_the_gradient():
    rng = np.random.default_rng(3)
    x, h = rng.integers(0, 256, (5, 3)), 4
    inputs, recurrent, goal = rng.normal(0, 0.5, (256, 12)), rng.normal(0, 0.5, (4, 12)), rng.normal(0, 1, (5, 3, h))
    loss = lambda a, b: float((langid._read(a, b, x)[0].astype(float) * goal).sum())
    _, kept = langid._read(inputs, recurrent, x, True)
    d_in, d_rec = langid._back(recurrent, x, kept, goal)
    for array, grad, at in ((recurrent, d_rec, (1, 2)), (recurrent, d_rec, (3, 9)), (recurrent, d_rec, (0, 6)), (inputs, d_in, (x[0, 0], 1)), (inputs, d_in, (x[3, 1], 10)), (inputs, d_in, (x[2, 2], 5))):
        up, down = array.copy(), array.copy()
        up[at] += 1e-2
        down[at] -= 1e-2
        slope = (loss(up, recurrent) - loss(down, recurrent) if array is inputs else loss(inputs, up) - loss(inputs, down)) / 2e-2
        assert abs(slope - grad[at]) < 2e-3 + 0.02 * abs(slope)


@pytest.fixture(scope="module")
def spoken(spark):
    rng = np.random.default_rng(2)
    rows = [(f, s, k) for k, (f, s) in enumerate([(t, "aa") for t in sentences(rng, 250, ["the", "ing", "er", "on"])] + [(t, "bb") for t in sentences(rng, 250, ["ñar", "ción", "que", "os"])])]
    return spark.createDataFrame([(k, t, lang, "en") for t, lang, k in rows], "doc_id long, text string, lang string, lang_pred string")


def test_language_held_out(spark, spoken):
    model = langid.train(spoken.filter("doc_id % 3 != 1"))
    held = langid.predict_languages(spoken.filter("doc_id % 3 = 1"), model).join(spoken.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "ción que " * 8000), (4, "ción que " * 8000), (None, "the")], "doc_id long, text string")
    got = langid.predict_languages(odd, model).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and [r.lang_pred for r in got[3:5]] == ["bb"] * 2 and len(got) == 6
    assert langid.predict_languages(odd.limit(0), model).count() == 0


def test_nothing_to_learn(spark, spoken):
    model = langid.train(spoken.limit(0))
    assert {r.lang_pred for r in langid.predict_languages(spoken.limit(5), model).collect()} == {"und"}


def test_windows_cover_every_byte():
    data = np.arange(300, dtype=np.uint8)
    x, size, row = langid.windowed(data, np.array([0, 10, 10, 75, 300]))
    assert size.tolist() == [10, 64, 1, 64, 64, 64, 33] and row.tolist() == [0, 2, 2, 3, 3, 3, 3]
    assert np.concatenate([a[:n] for a, n in zip(x, size)]).tolist() == data.tolist()


def squash(x):
    return x / (1 + abs(x))


def test_probabilities_by_plain_loops():
    """The network by its definition: gate by gate, byte by byte, in both directions over each window, with zeros behind the last; probabilities averaged over all positions."""
    rng = np.random.default_rng(6)
    h, langs = 3, ["aa", "bb", "cc"]
    model = langid.Model(langs, rng.normal(0, 1, (2, 256, 3 * h)).astype(np.float32), rng.normal(0, 1, (2, h, 3 * h)).astype(np.float32), rng.normal(0, 1, (2 * h, 3)).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32))

    def states(side, seq):
        state, out = [0.0] * h, []
        for byte in seq:
            x = model.inputs[side][byte]
            u = [sum(state[i] * model.recurrent[side][i][k] for i in range(h)) for k in range(3 * h)]
            reset = [0.5 + 0.5 * squash(x[k] + u[k]) for k in range(h)]
            keep = [0.5 + 0.5 * squash(x[h + k] + u[h + k]) for k in range(h)]
            new = [squash(x[2 * h + k] + reset[k] * u[2 * h + k]) for k in range(h)]
            state = [new[k] + keep[k] * (state[k] - new[k]) for k in range(h)]
            out.append(state)
        return out

    texts = [b"", b"a", bytes(rng.integers(0, 256, 150).astype(np.uint8)), "ñandú und so".encode()]
    got = langid.probabilities(model, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for text, row in zip(texts, got):
        want = np.zeros(3)
        for at in range(0, len(text), langid.WINDOW):
            part = text[at : at + langid.WINDOW]
            rear = states(1, part.ljust(langid.WINDOW, b"\0")[::-1])[::-1]
            for f, r in zip(states(0, part), rear):
                e = np.exp([model.bias[c] + sum(v * model.output[k][c] for k, v in enumerate([*f, *r])) for c in range(3)])
                want += e / e.sum() / len(text)
        assert np.allclose(row, want, atol=1e-4)


def test_language_scores_by_loops_on_a_table(spark, spoken):
    """The query's predictions are those of each text by itself, whatever the batch; ties and columns of the same names don't matter."""
    model = langid.train(spoken)
    few = spoken.filter("doc_id % 40 = 0")
    for r in langid.predict_languages(few.unionAll(few), model).join(spoken.select("doc_id", "text").distinct(), "doc_id").collect():
        alone = langid.probabilities(model, np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())]))[0]
        assert r.lang_pred == model.langs[int(alone.argmax())] and abs(r.score - alone.max()) < 1e-4


def one_hash(gram):
    """The hash of one n-gram by plain numbers."""
    x = ord(gram[0])
    for c in gram[1:]:
        x = (x * 0x01000193 + ord(c)) % 2**32
    x ^= x >> 15
    x = x * 0x2C1B3C6D % 2**32
    x ^= x >> 13
    return (x * (0x297A2D39 + 2 * len(gram)) % 2**32) >> (32 - toxicity.BITS)


def test_scores_by_a_plain_dictionary(labelled):
    """Every distinct n-gram of 3 to 5 characters, with padding at both ends, adds its weight once."""
    docs, labels, y = labelled
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + ["", "a", "É𝄞 Bad", "same same same"]
    model = toxicity.fit(texts[:60], y[:60].astype(int))
    weights = dict(zip(model.features.tolist(), model.weights))
    place = np.full(1 << toxicity.BITS, -1, np.int32)
    place[model.features] = np.arange(len(model.features))
    pad = "\0" * 4
    for text, got in zip(texts, toxicity.scores(model, texts, place)):
        whole = pad + text.lower() + pad
        # n-grams begin in the padding before the text or in the text, not in the padding behind it
        grams = {one_hash(whole[i : i + n]) for n in toxicity.SIZES for i in range(len(pad) + len(text.lower())) if i + n <= len(whole)}
        assert np.isclose(got, 1 / (1 + np.exp(-(model.bias + sum(weights.get(g, 0) for g in grams)))))


def test_toxicity_of_texts_without_common_ngrams():
    model = toxicity.fit(["hello there", "other words"], np.array([0, 1]))
    assert len(model.features) == 0 and 0 < model.bias + 1
    assert len(toxicity.fit([], np.zeros(0)).features) == 0
