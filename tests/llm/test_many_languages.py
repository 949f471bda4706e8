"""More languages than the sample has room for."""

import random

import numpy as np

from clausegrid.llm import language_id


def test_more_languages_than_the_sample_holds(spark):
    rng = random.Random(6)
    sounds = {f"l{k}": [c + v for c in "bcdfghklmnprstvwz"[3 * k : 3 * k + 3] for v in "aeiou"] for k in range(5)}
    rows = [(k, " ".join("".join(rng.choices(sounds[f"l{k % 5}"], k=3)) for _ in range(20)), f"l{k % 5}") for k in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, sample=60)
    assert model.languages == sorted(sounds)
    got = language_id.identify(df, model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
