"""Language identification: accuracy on held-out rows, gradients, windows, odd rows."""

import zlib

import numpy as np
import pytest

from wardpanel.llm import language
from wardpanel.llm.language import OVERLAP, PAD, WINDOW, Network, add_language, fit, gradients, predict, train, window_rows, window_starts
from wardpanel.llm.queries import QUERIES

SPEECH = {"a": "the and that with ", "b": "der die und nicht ", "c": "le la est pas "}


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(3)
    windows, labels = [], []
    for label, words in enumerate(SPEECH.values()):
        for _ in range(60):
            text = " ".join(rng.permutation(words.split() * 20)).encode()
            windows.append(window_rows(text[:WINDOW], np.array([0]))[0])
            labels.append(label)
    return fit(np.array(windows), np.array(labels), list(SPEECH))


def test_windows_cover_every_byte():
    for n in (0, 1, 8, 9, WINDOW - 1, WINDOW, WINDOW + 1, 5 * WINDOW + 3):
        starts = window_starts(n)
        assert starts[0] == 0 and starts[-1] + WINDOW >= n and all(b - a == WINDOW - OVERLAP for a, b in zip(starts, starts[1:]))
        assert (window_rows(b"x" * n, starts) != PAD).any(axis=1).all() or n == 0


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    x = rng.integers(97, 103, (4, 20)).astype(np.int16)
    labels, weight = np.array([0, 1, 1, 0]), np.ones(4, dtype=np.float32)
    mask = language.filter_mask()
    model = Network(["a", "b"], rng.standard_normal((257, 8)), rng.standard_normal(mask.shape) * mask, rng.standard_normal(48), rng.standard_normal((48, 2)), rng.standard_normal(2), True)

    def loss():
        p = language.softmax(model.pooled(x)[0] @ model.out + model.bias)
        return -np.log(p[np.arange(4), labels]).mean()

    grads = gradients(model, x, labels, weight)
    for name, at in (("table", (99, 3)), ("filters", (0, 2, 5)), ("filters", (4, 1, 40)), ("shift", (7,)), ("out", (3, 1)), ("bias", (0,))):
        value = getattr(model, name)
        value[at] += 1e-5
        up = loss()
        value[at] -= 2e-5
        down = loss()
        value[at] += 1e-5
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_narrow_filters_stay_narrow(net):
    assert (net.filters[language.filter_mask() == 0] == 0).all()


def test_score_does_not_depend_on_the_batch(net):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(SPEECH["abc"[i % 3]].split(), 3 + 40 * i)).encode() for i in range(60)]
    one = [predict(net, [t])[0] for t in texts]
    for (lang, score), (lang2, score2), i in zip(one, predict(net, texts), range(60)):
        assert lang == lang2 == "abc"[i % 3] and score == pytest.approx(score2, rel=1e-5)


def test_whole_text_counts(net):
    """The language of a long text is that of most of it, wherever the other part stands."""
    few, most = b"der die und nicht " * 30, b"le la est pas " * 400
    assert predict(net, [few + most])[0][0] == predict(net, [most + few])[0][0] == predict(net, [most + few + most])[0][0] == "c"


def test_odd_rows(spark, frame, net):
    rows = [(1, None), (2, ""), (3, " 12 .,!"), (4, "٣€"), (5, "the and that"), (5, "the and that"), (None, "der die und"), (6, "le la est pas " * 60_000), (7, "é")]
    found = add_language(frame(rows), net)
    assert found.columns == ["doc_id", "text", "id", "v", "lang_pred", "lang_score"]
    got = {(r.doc_id, r.text[:9] if r.text else r.text): (r.lang_pred, r.lang_score) for r in found.collect()}
    for key in ((1, None), (2, ""), (3, " 12 .,!"), (4, "٣€")):
        assert got[key] == ("und", 0.0)
    assert got[(5, "the and t")][0] == "a" and got[(None, "der die u")][0] == "b" and got[(6, "le la est")][0] == "c"
    assert got[(7, "é")][0] in SPEECH and all(0 <= s <= 1 for _, s in got.values())
    assert found.count() == len(rows)
    again = add_language(found.drop("lang_score"), net)
    assert again.columns == found.columns and again.where("lang_pred = 'a'").count() == 2


def test_nothing_to_learn(spark, frame):
    docs = frame([(1, "some text"), (2, None)]).withColumnRenamed("id", "lang")
    assert train(docs.withColumn("lang", docs.lang.substr(9, 1)).where("false")) is None
    assert train(docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")) is None
    assert [(r.lang_pred, r.lang_score) for r in add_language(docs, None).collect()] == [("und", 0.0)] * 2
    one = train(frame([(i, f"word {i}") for i in range(9)]).selectExpr("doc_id", "text", "'q' AS lang"))
    assert {r.lang_pred for r in add_language(docs, one).collect()} == {"q", "und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in QUERIES["op12_language_id"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0]
    assert {d.doc_id for d in held} == {r.doc_id for r in found.values() if r.held_out}
    right = [found[d.doc_id].lang_pred == d.lang for d in held]
    assert len(right) > 100 and np.mean(right) > 0.97
