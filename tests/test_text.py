import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vocabulary as V

SCHEMA = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def clean(spark):
    def run(*rows):
        return {r.entity_id: r for r in T.preprocess(spark.createDataFrame([(str(k), *r) for k, r in enumerate(rows)], SCHEMA)).collect()}

    return run


NAMES = [
    ("Marina École France Sàrl", "France", "marina ecole france", "sarl"),
    ("राम मार्केटिंग (प्राइवेट) लिमिटेड", "India", "राम मार्केटिंग", "pvt ltd"),
    ("श्री Sai Infratech Co.", "India", "श्री sai infratech", "co"),
    ("Apple Inc.", "US", "apple", "inc"), ("Microsoft Corporation", "US", "microsoft", "corp"), ("Amazon.com Services LLC", "US", "amazon com services", "llc"),
    ("Acme Co Ltd", "US", "acme", "ltd"), ("Holloway Peak Inc Seafood", "US", "holloway peak inc seafood", ""),
    ("Tata Consultancy Services Pvt. Ltd.", "India", "tata consultancy services", "pvt ltd"), ("TotalEnergies SE", "France", "totalenergies se", ""),
    ("L'Oreal SA", "France", "l oreal", "sa"), ("The Company", None, "the company", ""), ("Inc.", None, "inc", ""), (None, "US", "", ""), ("  \t", "US", "", ""),
    ("ﬁnancial ＡＢＣ Ｃｏｒｐ", "US", "financial abc", "corp"), ("Alpha Group Holdings", "US", "alpha", ""), ("Beta Private Limited Company", "US", "beta", "pvt ltd"),
    ("Société Générale société anonyme", "France", "societe generale", "sa"),
]


def test_names(clean):
    got = clean(*[(n, "", c) for n, c, _, _ in NAMES])
    assert [(got[str(k)].name_normalized, got[str(k)].name_corporate_suffix) for k in range(len(NAMES))] == [(n, s) for _, _, n, s in NAMES]
    assert got["0"].name_conservative == "marina école france sàrl" and got["0"].name_tokens == ["marina", "ecole", "france"]
    assert got["13"].name_tokens == []


ADDRESSES = [
    ("63 R. DE DIEPPE, LILLE, Hauts-de-France", "63 r de dieppe lille hauts de france"), ("KH NO. -570/13, NEW DELHI, WEST DELHI, DELHI", "kh no 570 13 new delhi west delhi delhi"),
    ("12 Boulevard Road, Suite 4", "12 bd rd ste 4"), ("3 Allée Blvd", "3 allee blvd"), ("3 allee", "3 all"), ("boul x", "blvd x"), ("street Street", "st st"),
]


def test_addresses(clean):
    got = clean(*[("x", a, "US") for a, _ in ADDRESSES], ("x", None, "US"), ("x", "  \t", "US"), ("x", "---", "US"))
    assert [got[str(k)].addr_normalized for k in range(len(ADDRESSES))] == [a for _, a in ADDRESSES]
    for k in range(len(ADDRESSES), len(ADDRESSES) + 3):
        r = got[str(k)]
        assert r.addr_is_empty and r.addr_normalized == "" and r.addr_tokens == [] and r.addr_conservative == ""


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]


def test_punctuation_stops_at_the_basic_plane(spark):
    assert one(spark, T.punctuation, "x 😀 & € ।राम") == "x 😀 and राम"
    assert one(spark, lambda c: T.punctuation(c, True), "a & b") == "a & b"
    assert one(spark, T.punctuation, "Johnson & Johnson & Co.") == "Johnson and Johnson and Co"


def test_accents_equal_decomposition(spark):
    for text in ("École ßœ", "Ångström Ǖ", "राम क़", "ё й Ώ", "éä", "Việt"):
        marks = {c for lo, hi in V.MARK_RANGES for c in range(lo, hi + 1)}
        nfkc = unicodedata.normalize("NFKC", text)
        want = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", nfkc) if ord(c) not in marks))
        assert one(spark, lambda c: T.strip_accents(T.nfkc(c)), text) == want


@pytest.mark.parametrize("text", ["राम मार्केटिंग", "marina ecole", "a  b  c", "63 r de dieppe"])
def test_repeating_changes_nothing(spark, text):
    for f in (T.whitespace, T.punctuation, T.strip_accents, T.lower):
        once = one(spark, f, text)
        assert one(spark, f, once) == once


def test_longer_forms_come_first():
    """Of two forms that can end the same words the longer is tried first."""
    for country in ("France", "India", None):
        forms = [s.split() for s in T.suffixes(country)]
        for i, a in enumerate(forms):
            for b in forms[i + 1 :]:
                assert not (len(b) > len(a) and b[-len(a) :] == a)


def test_honorifics(spark):
    for text, want in (("dr rao clinic", "rao clinic"), ("shri-sai", "sai"), ("drum shop", "drum shop"), ("messrs. x", "x"), ("m/s abc", "abc"), ("mr mr x", "mr x")):
        assert one(spark, T.without_honorific, text) == want


def test_tables_of_letters_give_what_decomposition_gives():
    texts = ["École ßœ ½ µ", "".join(map(chr, range(256))), "Ångström ﬁ ２ Ǖ", "İΣΑΣ Σ’s", "é ậ ́x", "राम क़ 각", "Œuvre – 5 €", "", "\x85a\xa0b　c", "A&B & é"]
    marks = {c for lo, hi in V.MARK_RANGES for c in range(lo, hi + 1)}
    for text in texts:
        spaced = unicodedata.normalize("NFKC", text).lower().replace("&", " and ")
        cons = " ".join("".join(" " if c.isspace() or ord(c) < 0x10000 and unicodedata.category(c)[0] in "PS" else c for c in spaced).split())
        assert T.plain(text) == cons
        short = " ".join(V.ADDRESS_SHORT.get(w, w) for w in cons.split())
        bare = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", short) if ord(c) not in marks))
        assert T.shortened(T.plain_words(text)) == " ".join(bare.split())


def test_records_for_keys_are_those_of_preprocess(spark):
    rows = [(str(k), n, a, c) for k, (n, a, c) in enumerate([("Marina École Sàrl", "12 Boulevard Road é", "France"), ("x", None, None), (None, "́", "US"), ("Apple Inc.", "---", ""), ("Apple Inc.", "3 Allée Blvd", "US"), ("Apple", "3 Allée Blvd", "US")])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = T.for_keys(df)
    assert not {"addr_conservative", "addr_raw", "name_raw", "business_address"} & set(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, T.preprocess(df).select(got.columns).collect()))
