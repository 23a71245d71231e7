"""Language identification: exact code lengths, held-out accuracy, odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from pavilion.llm import language
from pavilion.llm.common import table
from pavilion.llm.words import text_bytes

from .edge import documents, empty_documents, odd_documents, rows


def trees(texts, order=language.ORDER):
    """Straightforward counts: context -> Counter of next bytes, for one language."""
    out = defaultdict(Counter)
    for text in texts:
        data = bytes(order) + text.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                out[data[i - k:i]][data[i]] += 1
    return out


def code_length(tree, data, order=language.ORDER):
    data, bits = bytes(order) + data, 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = tree.get(data[i - k:i])
            if not seen:
                continue
            weight = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / weight)
                break
            bits -= math.log2(len(seen) / weight)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    import pyarrow as pa

    learned = {"de": ["der die das und über alle", "ein haus und ein baum"], "en": ["the house and the tree", "over all of the world and"]}
    grams = {}
    for order in range(language.ORDER + 1):
        known, lang, count = [], [], []
        for n, texts in enumerate(learned.values()):
            data, offsets = text_bytes(pa.array(texts))
            k, c = np.unique(language.keys(data, offsets, order), return_counts=True)
            known, lang, count = [*known, *k], [*lang, *[n] * len(k)], [*count, *c]
        grams[order] = (np.array(known, dtype=np.uint32), np.array(lang), np.array(count))
    model = language.learn(list(learned), grams)
    texts = ["the haus", "über the world", "xyz 東京 qq", "", "a", "und und und"]
    data, offsets = text_bytes(pa.array(texts))
    bits = model.bits(data, offsets)
    for i, text in enumerate(texts):
        for n, lang in enumerate(learned):
            assert abs(bits[offsets[i]:offsets[i + 1], n].sum() - code_length(trees(learned[lang]), text.encode())) < 1e-3 * (len(text) + 1)


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    label = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = rows(language.predict(docs))
    assert len(found) == len(label)
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert sum(r["lang_pred"] == label[r["doc_id"]] for r in held) / len(held) > 0.97


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = rows(language.predict(docs))
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    for doc_id in (1, 2, 3):
        assert by_id[doc_id]["lang_pred"] == "und" and by_id[doc_id]["score"] == 0
    assert by_id[4]["lang_pred"] == "en" and by_id[8]["lang_pred"] == "fr"
    assert language.predict(empty_documents(spark)).count() == 0
    unlabelled = documents(spark, [(1, "some words", None, "a", 1)])
    assert rows(language.predict(unlabelled))[0]["lang_pred"] == "und"


def test_filter_keeps_columns_and_clean_rows(spark):
    docs = odd_documents(spark)
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 4 in ids and 8 in ids and 1 not in ids and 3 not in ids


PROSE = [
    "The committee met on Thursday to review the annual budget, and members voted unanimously to approve it.",
    "Mitochondria are organelles that generate most of the chemical energy needed to power a cell's reactions.",
    "Q1 2023 revenue 14.2 17.9 (3.1) 22.4 | Q2 15.0 18.8 (2.2) 24.9 | Q3 16.1 19.7 (1.9) 27.3 | Q4 16.6 20.2 (1.4) 28.8",
    "def fold(xs: list[int]) -> int:\n    total = 0\n    for x in xs:\n        total += x * x  # squares\n    return total\n",
    "Kia ora koutou, ko te reo Māori te reo taketake o Aotearoa.", "1,024 2,048 4,096 8,192 16,384 rows", "OK", "<a href='x.html'>§ 7 – naïve façade…</a>",
    "Zażółć gęślą jaźń, rzekł żółw do źdźbła.", "x = 東京 and the rest of this line is plain words about a city"]


def test_unusual_texts_stay_and_other_scripts_go(spark):
    """Texts unlike anything learned are kept whatever they cost; those in a script that nobody wrote are not."""
    learned = table(spark, "/root/testdata/sf0.001", "documents")
    strange = ["Комитет собрался в четверг, чтобы рассмотреть бюджет.", "東京は日本の首都です。", "12 34 :: --", "Η επιτροπή συνεδρίασε (EU) την Πέμπτη."]
    extra = documents(spark, [(10**6 + i, t, "en" if i % 2 else None, "new", len(t)) for i, t in enumerate(PROSE)] +
                      [(2 * 10**6 + i, t, None, "new", len(t)) for i, t in enumerate(strange)]).select(*learned.columns)
    kept = {r["doc_id"] for r in language.keep_known(learned.unionByName(extra)).collect()}
    assert {10**6 + i for i in range(len(PROSE))} <= kept
    assert not kept & {2 * 10**6 + i for i in range(len(strange))}


def test_clean_rows_that_were_not_learned_from_stay(spark):
    """The trees of few documents keep all of a larger table; a language of few rows stays as well."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    few = docs.where("doc_id < 30")
    rare = documents(spark, [(10**6 + i, f"Saluton mondo, ĉu vi ŝatas ĝardenojn numero {i}?", "eo", "rare", 1) for i in range(3)]).select(*docs.columns)
    model = language.train(few.unionByName(rare))
    found = language.classify(docs.where("text IS NOT NULL AND text RLIKE '[A-Za-z]'").unionByName(rare), model, ["doc_id"])
    kept = found.where((found["_lang"] != language.UNKNOWN) & (found["_unseen"] <= language.MOST_UNSEEN)).count()
    assert kept >= 0.999 * found.count() and found.where("_lang = 'eo'").count() == 3


def test_labels_learned_are_bounded(spark):
    dirty = documents(spark, [(i, f"label number {i} has its own text", f"x{i}", "a", 1) for i in range(40)] + [(100 + i, "und der die das", "de", "a", 1) for i in range(9)])
    model = language.train(dirty, most_labels=5)
    assert len(model.languages) == 5 and "de" in model.languages
    assert len(language.train(dirty, most_labels=100).languages) > 20


def test_model_travels_by_value(spark):
    import pickle
    import subprocess
    import sys

    from pyspark import cloudpickle

    model = language.train(documents(spark, [(1, "the house", "en", "a", 1), (2, "das haus", "de", "a", 1), (6, "ein haus", "de", "a", 1)]))
    code = "import pickle, sys; m = pickle.loads(sys.stdin.buffer.read()); print(type(m).__name__, len(m.languages))"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(model), capture_output=True, cwd="/", env={"PYTHONPATH": ""})
    assert done.stdout.split()[0] == b"Model", done.stderr
    assert pickle.loads(cloudpickle.dumps(model)).languages == model.languages


def test_table_of_keys():
    rng = np.random.default_rng(1)
    known = np.unique(rng.integers(0, 2**32, 5000, dtype=np.uint32))
    found = language.Table(known, np.zeros((len(known), 1)))
    assert (found.find(known) == np.arange(len(known))).all()
    other = np.setdiff1d(rng.integers(0, 2**32, 5000, dtype=np.uint32), known)
    assert (found.find(other) == -1).all()
