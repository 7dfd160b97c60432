from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tessera.llm.language_id import WINDOW, Gru, LanguageModel, held_out, identify, train

SOUNDS = {"aa": "lano miru tesa", "bb": "krot schnu bewt", "cc": "éau çoi ètre"}


def made(n, seed):
    random.seed(seed)
    rows = []
    for i in range(n):
        lang = random.choice(list(SOUNDS))
        rows.append((i, " ".join("".join(random.choice(SOUNDS[lang].split()) for _ in range(random.randint(1, 3))) for _ in range(random.randint(3, 60))), lang))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = made(400, 1) + [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !?", "cc"), (None, "lano miru", "aa"), (1003, "krotschnu " * 30_000, None), (1004, "日", None)]
    return spark.createDataFrame([(i, t, lang, "s", 0.5) for i, t, lang in rows], "doc_id long, text string, lang string, source string, score double").repartition(4)


@pytest.fixture(scope="module")
def model(docs):
    return train(docs, steps=120)


def test_gradients_WHEN_compared_SHOULD_equal_differences():
    rng = np.random.default_rng(0)
    model = LanguageModel(["a", "b", "c"], hidden=3)
    x, y = rng.integers(0, 256, (5, 7)).astype(np.uint8), rng.integers(0, 3, 7)
    parts = [model.ahead.table, model.ahead.u, model.back.table, model.back.u, model.out, model.bias]

    def loss():
        f, b = model.ahead.forward(x)[0], model.back.forward(x[::-1])[0][::-1]
        logits = model.out @ np.concatenate((f, b), axis=1) + model.bias[:, None]
        p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        return -np.log(p[:, y, np.arange(7)].astype(np.float64)).mean()

    for part, gradient in zip(parts, model._gradients(x, y)):
        places = np.argsort(-np.abs(gradient).reshape(-1))[:4]
        for at in places:
            flat, h = part.reshape(-1), 1e-2
            old = flat[at]
            flat[at] = old + h
            up = loss()
            flat[at] = old - h
            down = loss()
            flat[at] = old
            assert gradient.reshape(-1)[at] == pytest.approx((up - down) / (2 * h), rel=0.05, abs=2e-4)


def test_prediction_WHEN_in_lanes_SHOULD_equal_one_window_at_a_time(model):
    texts = [b"", b"a", "éau çoi".encode(), b"krot schnu " * 40, b"x" * WINDOW, b"y" * (WINDOW + 1)]
    got = model.predict(texts)
    for text, p in zip(texts, got):
        total = np.zeros(len(model.languages))
        for i in range(0, len(text), WINDOW):
            x = np.frombuffer(text[i : i + WINDOW], np.uint8)[:, None]
            f, b = model.ahead.forward(x)[0], model.back.forward(x[::-1])[0][::-1]
            e = np.exp(model.out @ np.concatenate((f, b), axis=1) + model.bias[:, None])
            total += (e / e.sum(axis=1, keepdims=True)).sum(axis=(0, 2))
        np.testing.assert_allclose(p, total / max(1, len(text)), atol=2e-4)


def test_accuracy_WHEN_held_out_SHOULD_be_high(docs, model):
    rows = {r.doc_id: r for r in identify(docs, model).collect()}
    out = [r for r in rows.values() if r.lang and r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(out) > 60 and np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert all((rows[i].lang_pred, rows[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert rows[1003].lang_pred == "bb" and rows[1004].lang_pred in SOUNDS and rows[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_held_out_WHEN_remainder_is_two_SHOULD_say_so(spark):
    df = spark.createDataFrame([(i,) for i in [*range(50), -3, None]], "doc_id long")
    got = {r.doc_id: r.h for r in df.select("doc_id", held_out(df.doc_id).alias("h")).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in [*range(50), -3, None]}


def test_training_WHEN_held_out_or_other_columns_change_SHOULD_not_change(spark, docs, model):
    changed = docs.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 'zzzz' ELSE text END AS text", "lang", "'other' AS source")
    again = train(changed, steps=120)
    assert np.array_equal(again.ahead.table, model.ahead.table) and np.array_equal(again.out, model.out)


def test_model_WHEN_nothing_is_labelled_SHOULD_say_und(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert train(df) is None and identify(df, train(df)).first().lang_pred == "und"
    assert identify(df.limit(0), LanguageModel(["a"]).freeze()).count() == 0


def test_model_WHEN_labels_are_many_SHOULD_know_them_all(spark):
    names = [f"l{i:02}" for i in range(40)]
    df = spark.createDataFrame([(i, f"{name} text", name) for i, name in enumerate(names * 8)], "doc_id long, text string, lang string")
    model = train(df, steps=1)
    assert model.languages == names and {len(p) for p in model.predict([b"text " * 15_000, b""])} == {40}
    assert identify(df, model).filter("lang_pred <> 'und'").count() == 320


def test_gru_WHEN_state_is_zero_SHOULD_stay_bounded():
    states, _ = Gru(np.random.default_rng(1), 4).forward(np.full((50, 3), 7, np.uint8))
    assert np.abs(states).max() <= 1
