"""License scans: a trained paragraph classifier whose predictions a template comparison confirms.

The classifier is a sparse multinomial logistic regression over word n-grams, with one class for each licence
family and one for everything else. It is trained on variants of the families' notices (words dropped, holders
and years added, notices set in other prose) against a bounded sample of the corpus' own paragraphs that share
nothing with a notice, and against such prose with licence words in it. Variants kept out of the fit give the temperature of the
probabilities. A paragraph is of the unknown class if that class has the most probability or the best family has less
than LEAST_PROBABILITY. What remains is confirmed if enough of a notice of the predicted family is in the paragraph,
or of the paragraph in the notice; the notices' word n-grams decide. In runs of lines that look like wrapped notices every
start is tried with the length of every notice, and the lines that no match has taken are tried again.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from clausegrid.llm.common import hash_bound, map_columns, texts_of
from clausegrid.llm.language_id import Ftrl, softmax, temperature
from clausegrid.llm.license_templates import TEMPLATES

UNKNOWN = "unknown"
LONGEST_GRAM, TEMPLATE_GRAM = 3, 3
#: Corpus documents whose paragraphs the unknown class is trained on, at most, and altered copies of each notice.
SAMPLE, VARIANTS = 300, 40
LEAST_PROBABILITY, LEAST_SIMILARITY = 0.5, 0.6
#: Lines are joined to a paragraph while this share of their words occurs in notices.
WRAPPED_SHARE = 0.75

_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(words: list[str], longest: int = LONGEST_GRAM) -> list[str]:
    return [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


#: The lengths of the notices in words, each once.
_LENGTHS = sorted({len(words_of(n)) for notices in TEMPLATES.values() for n in notices})
_NOTICE_WORDS = {w for notices in TEMPLATES.values() for n in notices for w in words_of(n)}


def paragraphs(text: str) -> list[tuple[int, int, list[str]]]:
    """(first line, lines, words): each line with a word, and each run of lines that look like a wrapped notice."""
    words = [words_of(x) for x in text.split("\n")]
    out = [(k, 1, w) for k, w in enumerate(words) if w]
    like = [len(w) > 3 and sum(map(_NOTICE_WORDS.__contains__, w)) >= WRAPPED_SHARE * len(w) for w in words]
    at = 0
    while at < len(words):
        end = at
        while end < len(words) and like[end]:
            end += 1
        if end - at > 1:
            out.append((at, end - at, [w for x in words[at:end] for w in x]))
        at = max(at + 1, end)
    return out


class Templates:
    """How much of a notice is in a paragraph, or of the paragraph in a notice."""

    def __init__(self, families: dict[str, list[str]] = TEMPLATES):
        self.grams = {f: [self._grams(words_of(n)) for n in notices] for f, notices in families.items()}

    @staticmethod
    def _grams(words: list[str]) -> set[str]:
        n = min(TEMPLATE_GRAM, max(1, len(words)))
        return {" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}

    def shared(self, words: list[str], family: str) -> int:
        """N-grams that the paragraph has in common with a notice of the family, at most."""
        here = self._grams(words)
        return max(len(here & notice) for notice in self.grams[family])

    def similarity(self, words: list[str], family: str) -> float:
        here, best = self._grams(words), 0.0
        for notice in self.grams[family]:
            both = len(here & notice)
            best = max(best, both / max(1, len(notice)), both / len(here) if len(here) >= 8 else 0.0)
        return best


class Model:
    def __init__(self, families: list[str], features: dict[str, int], weights: np.ndarray, bias: np.ndarray, t: float):
        self.families, self.features, self.weights, self.bias, self.temperature = families, features, weights, bias, t
        self.templates = Templates()
        self.none = softmax(bias / t)
        # every n-gram that speaks for a family has one of these words; without them the unknown class only gains
        speaks = (weights[:, :-1] > weights[:, -1:]).any(axis=1) if len(weights) else np.zeros(0, bool)
        common: dict[str, int] = {}
        for g in features:
            for w in g.split(" "):
                common[w] = common.get(w, 0) + 1
        self.triggers = {min(g.split(" "), key=lambda w: (common[w], w)) for g, k in features.items() if speaks[k]}

    def classify(self, words: list[str]) -> tuple[str, float]:
        if self.triggers.isdisjoint(words) and self.none[-1] >= 1 - LEAST_PROBABILITY:
            return UNKNOWN, float(self.none[-1])
        at = sorted({self.features[g] for g in grams_of(words) if g in self.features})
        if not at:
            p = self.none
        else:
            p = softmax((self.weights[at].sum(axis=0) / np.sqrt(len(at)) + self.bias) / self.temperature)
        best = int(p.argmax())
        if best == len(self.families) or p[best] < LEAST_PROBABILITY:
            return UNKNOWN, float(p[-1])
        return self.families[best], float(p[best])


def _variants(notice: str, rng: np.random.Generator, prose: list[list[str]]) -> list[str]:
    """One altered copy of a notice as words."""
    words = words_of(notice)
    keep = rng.random(len(words)) > rng.choice([0.0, 0.03, 0.08])
    out = [w for w, k in zip(words, keep) if k] or words
    kind = rng.integers(4)
    if kind == 1:
        out = ["copyright", str(1990 + rng.integers(40)), "the", "authors"] + out
    elif kind == 2 and prose:
        around = prose[rng.integers(len(prose))][:12]
        out = around + out if rng.random() < 0.5 else out + around
    return out


def fit(prose: list[str], variants: int = VARIANTS) -> Model:
    """Trains on the notices and on paragraphs of the corpus; those that share much with a notice are left out."""
    templates, rng = Templates(), np.random.default_rng(5)
    plain = [w for w in map(words_of, prose) if w and all(templates.similarity(w, f) < 0.3 for f in TEMPLATES)]
    families = sorted(TEMPLATES)
    rows = [(_variants(n, rng, plain), k) for k, f in enumerate(families) for n in TEMPLATES[f] for _ in range(variants)]
    rows += [(w, len(families)) for w in plain]
    licence_words = sorted(_NOTICE_WORDS)
    rows += [(list(rng.permutation([*w[:30], *rng.choice(licence_words, min(6, len(licence_words)), replace=False)])), len(families)) for w in (plain or [[]] * 200)[:1500]]
    counts: dict[str, int] = {}
    for w, _ in rows:
        for g in set(grams_of(w)):
            counts[g] = counts.get(g, 0) + 1
    features = {g: k for k, g in enumerate(sorted(g for g, n in counts.items() if n >= 5))}
    coded = []
    for w, y in rows:
        at = np.array(sorted({features[g] for g in grams_of(w) if g in features}), np.int64)
        coded.append((at, np.full(len(at), 1 / np.sqrt(max(1, len(at)))), y))
    order = rng.permutation(len(coded)).tolist()
    kept_out, fitted = order[: len(order) // 6], order[len(order) // 6 :]
    model = Ftrl(len(features), len(families) + 1, alpha=0.5, l1=0.05, l2=0.01)
    for _ in range(3):
        for k in fitted:
            model.learn(*coded[k])
    w = model.weights()
    z = np.array([coded[k][1] @ w[coded[k][0]] + w[-1] for k in kept_out])
    t = temperature(z, np.array([coded[k][2] for k in kept_out], int))
    used = np.flatnonzero(np.abs(w[:-1]).sum(axis=1))
    names = list(features)
    return Model(families, {names[k]: j for j, k in enumerate(used.tolist())}, w[used], w[-1], t)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Fits on paragraphs of at most `sample` documents of the corpus, those with the smallest hashed ids.

    Of each of them at most 10 lines, those with the smallest hashes, travel to the driver.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    mark = F.xxhash64("id", F.lit(3))
    # hash_bound leaves more room than the estimate's error takes
    ids = rows.agg(F.approx_count_distinct("id", 0.02).alias("n")).first()["n"]
    chosen = rows.select("id").where(mark <= F.lit(hash_bound(sample, ids))).distinct().orderBy(mark, "id").limit(sample)
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x).between(1, 2000))
    few = F.slice(F.array_sort(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("line")))), 1, 10)
    texts = rows.join(F.broadcast(chosen), "id", "left_semi").dropDuplicates(["id"])
    found = texts.select("id", F.explode(few).alias("x")).select("id", "x.line").collect()  # at most 10 lines of `sample` documents
    return fit([r["line"] for r in sorted(found, key=lambda r: (r["id"], r["line"]))])


MATCH = T.ArrayType(T.StructType([
    T.StructField("first_line", T.IntegerType()), T.StructField("n_lines", T.IntegerType()), T.StructField("family", T.StringType()),
    T.StructField("probability", T.DoubleType()), T.StructField("similarity", T.DoubleType()), T.StructField("confirmed", T.BooleanType())]))


def _match(first: int, n: int, words: list[str], model: Model) -> dict | None:
    family, p = model.classify(words)
    if family == UNKNOWN:
        return None
    s = model.templates.similarity(words, family)
    return {"first_line": first, "n_lines": n, "family": family, "probability": p, "similarity": s, "confirmed": s >= LEAST_SIMILARITY}


def _windows(lines: list[list[str]]) -> list[tuple[int, int]]:
    """(start, end) of two lines or more: from every start as many lines as each of the notices has words, and the whole run."""
    ends = np.cumsum([len(w) for w in lines])
    out = {(0, len(lines))}
    for start in range(len(lines) - 1):
        before = int(ends[start - 1]) if start else 0
        for end in np.searchsorted(ends, before + np.array(_LENGTHS)):
            out.add((start, max(start + 2, min(int(end) + 1, len(lines)))))
    return sorted(out)


def _in_run(first: int, lines: list[list[str]], model: Model) -> list[dict]:
    """Matches in a run of lines: confirmed windows without common lines, those that share most with a notice first."""
    known: dict[tuple, tuple] = {}
    found = []
    for start, end in _windows(lines):
        words = tuple(w for x in lines[start:end] for w in x)
        if words not in known:
            m = _match(0, 0, list(words), model)
            known[words] = (m, model.templates.shared(list(words), m["family"]) if m and m["confirmed"] else 0)
        m, shared = known[words]
        if m and m["confirmed"]:
            found.append((-shared, end - start, start, m))
    free, out = np.ones(len(lines), bool), []
    for _, n, start, m in sorted(found, key=lambda x: x[:3]):
        if free[start : start + n].all():
            free[start : start + n] = False
            out.append(m | {"first_line": first + start, "n_lines": n})
    at = 0
    while out and at < len(lines):
        end = at
        while end < len(lines) and free[end]:
            end += 1
        if end - at > 1:
            out += [m for m in _in_run(first + at, lines[at:end], model) if m["confirmed"]]
        at = max(at + 1, end)
    if not out and (m := known[tuple(w for x in lines for w in x)][0]):
        out.append(m | {"first_line": first, "n_lines": len(lines)})
    return sorted(out, key=lambda m: m["first_line"])


def find(text: str, model: Model) -> tuple[int, list[dict]]:
    """(paragraphs, those predicted to belong to a family); lines that are confirmed alone are not part of a run."""
    out, seen = [], paragraphs(text)
    taken: set[int] = set()
    alone: dict[int, list[str]] = {}
    for first, n, words in seen:
        if n == 1:
            alone[first] = words
            if m := _match(first, 1, words, model):
                out.append(m)
                if m["confirmed"]:
                    taken.add(first)
            continue
        at = first
        while at < first + n:
            end = at
            while end < first + n and end not in taken:
                end += 1
            if end - at > 1:
                out += _in_run(at, [alone[k] for k in range(at, end)], model)
            at = max(at + 1, end)
    return len(seen), out


def scan(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_paragraphs, matches (array of first_line, n_lines, family, probability, similarity, confirmed) and licences.

    licences: the distinct families of confirmed matches, in alphabetical order. Null and empty texts have no
    paragraphs. Very long texts are scanned line by line. An empty table gives an empty table. Repeated rows get equal results; columns with the names of results are replaced; keep: columns that stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(texts):
            found = [find(x, m) for x in texts_of(texts)]
            return [[n for n, _ in found], [x for _, x in found], [sorted({y["family"] for y in x if y["confirmed"]}) for _, x in found]]

        return f

    fields = [T.StructField("n_paragraphs", T.LongType()), T.StructField("matches", MATCH), T.StructField("licences", T.ArrayType(T.StringType()))]
    return map_columns(docs, [text], docs.columns if keep is None else keep, fields, make)
