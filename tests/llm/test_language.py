"""Character models against plain dictionaries, and held-out accuracy."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from textrill.llm import language_id as lid
from textrill.llm.common import table


def plain_letters(text):
    return "".join(w + " " for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()))


def plain_model(texts, alphabet):
    """P(c | h) of interpolated Kneser-Ney, by the book."""
    counts = {4: Counter()}
    for text in texts:
        s = "   " + plain_letters(text)
        counts[4].update(s[i : i + 4] for i in range(len(s) - 3))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut, total, kinds = {}, defaultdict(int), defaultdict(int)
    for k, found in counts.items():
        ones, twos = sum(c == 1 for c in found.values()), sum(c == 2 for c in found.values())
        cut[k] = ones / (ones + 2 * twos) if ones and twos else 0.5
        for g, c in found.items():
            total[k, g[:-1]] += c
            kinds[k, g[:-1]] += 1

    def p(g):
        if not g:
            return 1 / (alphabet + 1)
        k, h = len(g), g[:-1]
        if not total[k, h]:
            return p(g[1:])
        return max(counts[k][g] - cut[k], 0) / total[k, h] + cut[k] * kinds[k, h] / total[k, h] * p(g[1:])

    return p


def plain_entropy(p, text):
    s = "   " + plain_letters(text)
    return -sum(math.log(p(s[i : i + 4])) for i in range(len(s) - 3)) / max(1, len(s) - 3)


@pytest.fixture(scope="module")
def learned(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text", "lang")
    rows = docs.where(lid.fold(F.col("doc_id")) != 2).select("lang", "text", (lid.fold(F.col("doc_id")) == 3).cast("int").alias("part"))
    return docs, rows, lid.train(rows)


def test_entropies_equal_the_plain_models(learned):
    docs, rows, found = learned
    by_lang = defaultdict(list)
    for r in rows.collect():
        by_lang[r["lang"]].append(r["text"])
    alphabet = len({c for texts in by_lang.values() for t in texts for c in plain_letters(t)})
    assert found.models.langs == sorted(by_lang)
    models = [plain_model(by_lang[lang], alphabet) for lang in found.models.langs]
    some = [r["text"] for r in docs.where("length(text) < 1500").orderBy("doc_id").limit(25).collect()] + ["日本 unseen ßz", "q", ""]
    frame = docs.sparkSession.createDataFrame(list(enumerate(some)), "i long, text string")
    for r in found.models.entropies(frame).collect():
        assert r["size"] == len(plain_letters(some[r["i"]]))
        assert np.allclose(r["h"], [plain_entropy(p, some[r["i"]]) for p in models], atol=1e-9)


def test_groups_of_languages_give_the_same(learned):
    docs, rows, found = learned
    most = max(r["n"] for r in found.models.found.groupBy("lang").agg(F.count("*").alias("n")).collect()) * lid.ENTRY_BYTES
    apart = lid.Models(found.models.found, 1, most)
    assert len(apart.groups) > 1 and apart.langs == found.models.langs
    frame = docs.select("doc_id", "text")
    one, two = ({r["doc_id"]: (r["size"], r["h"]) for r in m.entropies(frame).collect()} for m in (found.models, apart))
    assert one == two
    with pytest.raises(ValueError, match="entries"):
        lid.Models(found.models.found, 1, 100)


def test_held_out_accuracy(spark, small):
    got = lid.op11_kneser_ney_language(spark, small).join(table(spark, small, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == table(spark, small, "documents").count() and 30 < len(held) < len(got) / 2
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got) and np.mean([r["rejected"] for r in held]) < 0.1


def test_odd_rows(learned, spark):
    _, rows, found = learned
    texts = [None, "", "12 -- \n", "ß", "the " * 400_000, "жук " * 50, "x" * 1_300_000]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in found.predict(docs, "doc_id").collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and got[0]["score"] == 0 and got[0]["entropy"] is None
    assert got[None]["lang_pred"] in found.models.langs and got[5]["rejected"] and got[6]["lang_pred"] != "und"
    assert found.predict(docs.limit(0), "doc_id").count() == 0
    nothing = lid.train(rows.limit(0)).predict(docs, "doc_id").collect()
    assert len(nothing) == len(texts) and {r["lang_pred"] for r in nothing} == {"und"}
    lone = lid.train(rows.where("part = 1")).predict(docs, "doc_id").count()
    assert lone == len(texts)


def test_pieces_and_parts_of_a_run(monkeypatch):
    text = "Ça va bien, merci; 日本 " * 40
    whole = "".join(lid.letters(text))
    monkeypatch.setattr(lid, "PIECE", 16)
    assert "".join(lid.letters(text)) == whole == plain_letters(text)
    runs = lid._halves(lid._CONTEXT + whole)
    (one,) = lid.distinct([lid._CONTEXT + whole])
    seen = lambda run: Counter(map(tuple, run.grams[run.at].tolist()))
    assert seen(runs[0]) == seen(one) and runs[0].ends[-1] == one.ends[-1]
