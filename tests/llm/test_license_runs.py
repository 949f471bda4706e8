"""Licences in long and mixed runs of lines."""

import random

import pytest

from clausegrid.llm import license_scan as L
from clausegrid.llm.license_templates import TEMPLATES


def wrapped(notice, n=5):
    words = notice.split(" ")
    return [" ".join(words[k : k + n]) for k in range(0, len(words), n)]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(8)
    words = "river mill boat street cloud window paper garden winter teacher music bread".split()
    return L.fit([" ".join(rng.choices(words, k=14)) for _ in range(600)])


def families(text, model):
    return sorted({m["family"] for m in L.find(text, model)[1] if m["confirmed"]})


def test_licences_in_runs(model):
    mit, bsd = TEMPLATES["MIT"][2], TEMPLATES["BSD-3-Clause"][0]
    mpl = TEMPLATES["MPL-2.0"][0]
    assert families("\n".join(wrapped(mpl) + wrapped(bsd)), model) == ["BSD-3-Clause", "MPL-2.0"]
    assert families("\n".join(["Licensed under the ISC License.", *wrapped(bsd)]), model) == ["BSD-3-Clause", "ISC"]
    like = ["the use of this or any other"] * 33
    found = L.find("\n".join(like + wrapped(mit)), model)[1]
    assert any(m["family"] == "MIT" and m["confirmed"] and m["first_line"] >= 30 for m in found)
