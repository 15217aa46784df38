import random
import zlib

import numpy as np

from tessera.llm import langmask as L


def corpus(n=300, seed=0):
    """Texts of three made-up languages, shouted and littered now and then."""
    rng = random.Random(seed)
    syllables = {"aa": ["the", "ing", "ou", "er", "th"], "bb": ["ção", "mente", "que", "ado", "ll"], "cc": ["sch", "ung", "ä", "heit", "ein"]}
    data = []
    for i in range(n):
        lang = rng.choice(sorted(syllables))
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40)))
        text = text.upper() if i % 11 == 0 else text.replace(" ", "%%% ") if i % 13 == 0 else text
        data.append((i, text, lang, "s", len(text), None, None))
    return data


def test_held_out_accuracy(spark, make):
    data = corpus()
    got = {r.doc_id: r for r in L.query(spark, make(data)).collect()}
    assert len(got) == len(data)
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in data)
    held = [r for r in data if got[r[0]].held_out]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_a_probe_gives_all_languages_and_no_false_negative():
    f = L.Filters([f"l{k:02}" for k in range(11)], slots=1 << 12)
    rng = np.random.default_rng(1)
    own = {k: rng.integers(0, 1 << 32, 50).astype(np.uint32) for k in range(11)}
    for k, codes in own.items():
        f.add(k, codes)
    f.finish()
    for k, codes in own.items():
        assert (f.masks(codes, k // 8) >> np.uint8(k % 8) & 1).all()
    unknown = rng.integers(0, 1 << 32, 20_000).astype(np.uint32)
    counts = f.counts(unknown, np.array([len(unknown)]))
    assert (counts < 0.01 * len(unknown)).all()  # what filters answer by chance is taken off
    both = np.concatenate([own[3], own[10]])
    assert sorted(np.argsort(f.counts(both, np.array([100]))[0])[-2:]) == [3, 10]


def test_grams_do_not_cross_texts():
    codes, lens = L.gram_codes(["ab", "", None, "A1b"])
    alone = [L.gram_codes([x])[0].tolist() for x in ("ab", "", None, "A1b")]
    assert codes.tolist() == sum(alone, []) and lens.tolist() == list(map(len, alone))


def test_odd_rows(spark, odd, empty, make):
    got = L.query(spark, odd).collect()
    assert len(got) == odd.count()
    assert all(r.lang_pred in ("en", "fr", "und") for r in got)
    assert L.query(spark, empty).collect() == []
    none = L.query(spark, make([(1, "words", None, None, None, None, None), (2, "12 %", "en", None, None, None, None), (3, None, "en", None, None, None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in sorted(none)][1:] == [("und", 0.0), ("und", 0.0)]


def test_language_and_id_are_no_inputs(spark, make):
    data = corpus(120, 3)
    f = L.train(spark, make(data))
    one = {r.doc_id: r.lang_pred for r in L.predict(spark, make(data), f).collect()}
    two = {r.doc_id - 1000: r.lang_pred for r in L.predict(spark, make([(r[0] + 1000, r[1], "zz", "other", 0, None, None) for r in data]), f).collect()}
    assert one == two


def test_one_letter_has_an_n_gram():
    codes, lens = L.gram_codes(["a", "5 g", "", "12", "ab"])
    assert lens.tolist() == [1, 1, 0, 0, 1]
    assert [int(c).to_bytes(4, "big") for c in codes] == [b" a  ", b" g  ", b" ab "]


def test_the_sample_is_the_first_by_hash_though_ids_repeat(spark, make):
    ids = [k for k in range(60)] + [60] * 3000 + [None] * 5
    labelled = make([(i, "words", "en" if i is None or i % 2 == 0 else "fr", "s", None, None, None) for i in ids]).select("doc_id", "text", "lang").where("doc_id is not null")
    got = {(r.lang, r.doc_id) for r in L._first_by_hash(spark, labelled, 20).collect()}
    want = set()
    for lang in ("en", "fr"):
        own = labelled.where(f"lang = '{lang}'").select("doc_id", L.F.xxhash64("doc_id").alias("h")).distinct().orderBy("h").limit(20)
        want |= {(lang, r.doc_id) for r in own.collect()}
    assert got == want
