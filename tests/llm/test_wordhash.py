"""Hashed sentences and terms against a plain reading of the same rules."""

import random
import re

import numpy as np

from tagloom.llm import subjects, wordhash

SPLIT = re.compile(r"[\r\n]+|(?<=[.!?…])[\"”»)]{0,2}\s+|(?<=[。！？])")
EAST = re.compile(r"[぀-ヿ㐀-鿿]")
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def plain(text):
    found = []
    for s in SPLIT.split(re.sub(r"\d+", "0", text.lower())):
        words, terms = WORD.findall(s), set()
        for i, w in enumerate(words):
            if EAST.search(w):
                terms.update(w[k : k + n] for n in (2, 3, 4) for k in range(len(w) - n + 1))
            else:
                terms.add(w)
                if i + 1 < len(words) and not EAST.search(words[i + 1]):
                    terms.add((w, words[i + 1]))
        if words:
            found.append(terms)
    return found


def test_sentences_and_terms():
    rng = random.Random(2)
    atoms = ["fugue", "don't", "x", "12", "3", " ", " ", ". ", "! ", ".) ", "\n", "\r\n", "…", "東京タワー", "。", "é", "-", "_", "rock-pop", "?\" ", "Ünder", ","]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", "\n", "word " * 3000]
    ids = {}
    t = wordhash.terms(texts)
    want = [plain(x) for x in texts]
    assert np.bincount(t.sent_doc, minlength=len(texts)).tolist() == [len(w) for w in want]
    flat = [w for d in want for w in d]
    assert len(wordhash.once(t.term_sent, t.term_hash)) == sum(map(len, flat))
    got = [set() for _ in flat]
    for s, h in zip(t.term_sent.tolist(), t.term_hash.tolist()):
        got[s].add(h)
    assert [len(g) for g in got] == [len(f) for f in flat]
    # one hash for each term, wherever it stands
    for g, f in zip(got, flat):
        for x in f:
            ids.setdefault(x, set(g)).intersection_update(g)
    assert all(ids.values())
    assert [sum(h & 1 for h in g) for g in got] == [sum(isinstance(x, tuple) for x in f) for f in flat]


def test_long_text_is_cut_at_line_ends(monkeypatch):
    text = "\n".join(f"line {chr(97 + i % 26)} of many." for i in range(200))
    whole = wordhash.terms([text])
    monkeypatch.setattr(wordhash, "CHUNK", 100)
    parts = [(doc, wordhash.terms(texts)) for texts, doc in wordhash.pieces([None, text, "end"])]
    assert np.concatenate([t.sent_hash for _, t in parts]).tolist()[:-1] == whole.sent_hash.tolist()
    assert {d for docs, _ in parts for d in docs.tolist()} == {0, 1, 2}


def test_no_areas_without_leaves(spark, monkeypatch):
    """Areas come through the leaves only."""
    words = [["fugue", "cadence", "bass line", "choir", "score sheet", "aria"], ["insulin", "vaccine", "fracture", "scan", "dosage", "clinic"], ["plaintiff", "verdict", "statute", "jury box", "appeal", "bail"]]
    rng = random.Random(3)
    line = lambda w: f"{''.join(rng.choice('qzxw') for _ in range(5))} about the {w} {''.join(rng.choice('kjvy') for _ in range(5))}."
    docs = spark.createDataFrame([(i, "\n".join(line(w) for w in rng.sample(words[i % 3], 3) * 2)) for i in range(150)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 + 1) for i in range(120)], "doc_id long, area_id int")
    assert subjects.document_areas(docs, labels).count() >= 120
    monkeypatch.setattr(subjects, "_leaf_terms", lambda *a: {})
    assert subjects.document_areas(docs, labels).count() == 0
