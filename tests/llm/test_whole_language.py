"""Foreign texts of any length are rejected; short texts of known languages stay."""

import numpy as np
import pandas as pd
import pytest

from quillspark.llm import langid

from ..compare import DATA

FOLDER = DATA.replace("sf0.001", "sf0.01")
FOREIGN = ["Съешь ещё этих мягких французских булок, да выпей чаю.", "Zażółć gęślą jaźń, w Szczebrzeszynie chrząszcz brzmi w trzcinie.", "Az emberek szabadon születnek, egyenlő méltóságuk és joguk van.", "xq zzkj wvv qqpl kjhg zxcv bnmq wrtp xq zzkj wvv qqpl", "Все люди рождаются свободными"]


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_short_foreign_texts_are_rejected(model):
    assert all(langid.counts([t]).sum() < langid.REJECT_GRAMS for t in FOREIGN)
    assert all(model.predict(FOREIGN)[2])


def test_short_known_texts_stay(model):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet").dropna(subset=["text", "lang"])
    texts = [" ".join(t.split()[4 : 4 + n]) for t in docs.text for n in (3, 8, 20) if len(t.split()) > 30]
    assert np.mean(model.predict(texts)[2]) < 0.02


def test_bound_is_continuous_and_looser_for_short_texts(model):
    assert list(model.grams) == sorted(model.grams) and (model.least <= model.least[-1]).all() and (model.least[2:] > 0).all()


def brute_prediction(model, text):
    """Plain counts of byte trigrams, weights and cosines, without the vectors of the operator."""
    grams, folded = {}, b" " + b" ".join("".join(c if c.isascii() and c.isalpha() or not c.isascii() else " " for c in text.lower()).encode().split()) + b" "
    for k in range(len(folded) - 2):
        h = int.from_bytes(folded[k : k + 3]) * 2654435761 % 2**32 >> 20
        grams[h] = grams.get(h, 0) + 1
    own = {h: n * float(model.idf[h]) for h, n in grams.items()}
    size = sum(v * v for v in own.values()) ** 0.5
    cosines = [sum(v * float(c[h]) for h, v in own.items()) / size for c in model.centroids]
    return model.languages[max(range(len(cosines)), key=cosines.__getitem__)], max(cosines)


def test_predictions_are_those_of_brute_force(model):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet").dropna(subset=["text"])
    texts = [t for t in docs.text[:150] if langid.has_letter(t)] + FOREIGN
    languages, scores, _ = model.predict(texts)
    for t, lang, score in zip(texts, languages, scores, strict=True):
        expected, cosine = brute_prediction(model, t)
        assert lang == expected and score == pytest.approx(cosine, abs=1e-6), t[:60]


def test_scores_do_not_depend_on_the_rows_beside(model):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    texts = list(docs.text[:300])
    assert [model.predict([t])[1][0] for t in texts] == list(model.predict(texts)[1])


def test_signs_are_no_letters(model):
    assert model.predict(["½ ²", "5 ³ ¼ _", "ª", "x²"])[0][:2] == ["und", "und"] and not langid.has_letter("½ ²") and langid.has_letter("½x")
