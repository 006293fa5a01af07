import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from tallyweave.functions import fuzzy, phonetic, text


@pytest.mark.parametrize(
    "raw, form",
    [
        ("Delta Telecommunication Inc", "delta telecommunication incorporated"),
        ("Lee & Lawson", "lee lawson"),
        ("राम", "raama"),
        ("  Café   CORP ", "cafe corporation"),
        ("ACME Pvt. Ltd.", "acme private limited"),
        (None, ""),
        ("&&", ""),
    ],
)
def test_names(raw, form):
    assert text.name_form(raw) == form


def test_ampersand_as_a_word():
    assert text.name_form("Lee & Lawson", ampersand=True) == "lee and lawson"


def test_addresses():
    assert text.address_form("914 PIERPONT AVE, CLEVELAND, OH") == "914 pierpont avenue, cleveland, oh"
    assert text.address_form("Near Park, 12 rue X", "french") == "park, 12 street x"


def test_baseline_keeps_other_scripts_and_second_marks():
    assert text.fold("É", "baseline") == "e"
    assert text.fold("Éa", "baseline") == "ea"
    assert "र" in text.fold("राम", "baseline")


def test_french_forms():
    assert text.name_form("Dupont SARL", "french") == "dupont societe a responsabilite limitee"


def test_transliteration_of_digits_and_signs():
    table = text.transliteration()
    assert table[0x0967] == "1" and table[0x0902] == "n" and table[0x094D] == "" and table[0x0950] == "om"


def test_metaphone_sounds_alike():
    for a, b in (("catherine", "katherine"), ("smythe", "smith"), ("phone", "fone"), ("knight", "night")):
        assert phonetic.metaphone(a) == phonetic.metaphone(b)
    assert phonetic.sound("12") == "12"


def test_ratios():
    assert fuzzy.ratio("", "") == 1
    assert fuzzy.ratio("this is a test", "this is a test!") == pytest.approx(28 / 29)
    assert fuzzy.partial_ratio("this is a test", "this is a test!") == 1
    assert fuzzy.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 1
    assert fuzzy.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1
    assert fuzzy.weighted_ratio("", "a") == 0
    assert fuzzy.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert fuzzy.lcs("abcde", "ace") == 3


def test_scores_are_symmetric_and_bounded():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    words = st.text("abc de", max_size=14)

    @settings(max_examples=150, deadline=None)
    @given(words, words)
    def holds(a, b):
        for f in (fuzzy.ratio, fuzzy.partial_ratio, fuzzy.token_sort_ratio, fuzzy.token_set_ratio, fuzzy.weighted_ratio, fuzzy.lcs_ratio):
            assert 0 <= f(a, b) <= 1
            assert f(a, b) == pytest.approx(f(b, a))
        if a.strip():
            assert fuzzy.ratio(a, a) == fuzzy.jaro_winkler(a, a) == 1

    holds()


def test_normalized_records(spark):
    raw = spark.createDataFrame([("S1-1", "Delta Inc", None, " US ", 1), ("S2-1", None, "5 Main St", None, 2)], "entity_id string, business_name string, business_address string, country string, name_norm int")
    rows = {r.entity_id: r for r in text.normalize_records(raw, "french").collect()}
    assert rows["S1-1"].name_norm == "delta incorporated" and rows["S1-1"].core_name == "delta" and rows["S1-1"].country_norm == "us"
    assert rows["S2-1"].name_norm == "" and rows["S2-1"].addr_norm == "5 main street" and rows["S2-1"].country_norm == "unknown"


def test_transliteration_follows_unicode_names():
    scripts = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")
    table = text.transliteration()
    of = lambda name: table[ord(unicodedata.lookup(name))]
    for script in scripts:
        assert [of(f"{script} {n}") for n in ("LETTER KA", "LETTER AA", "VOWEL SIGN II", "LETTER TTA")] == ["ka", "a", "i", "ta"]
        assert [of(f"{script} DIGIT {n}") for n in ("ONE", "NINE")] == ["1", "9"]
        assert of(f"{script} SIGN VIRAMA") == ""
    assert of("DEVANAGARI SIGN ANUSVARA") == of("DEVANAGARI SIGN CANDRABINDU") == of("SINHALA SIGN ANUSVARAYA") == "n"
    assert of("DEVANAGARI SIGN VISARGA") == "h" and of("DEVANAGARI OM") == "om" and of("DEVANAGARI LETTER VOCALIC R") == "ri"
    assert table[0x200C] == table[0x200D] == ""


def test_scores_of_many_pairs_equal_those_of_one(monkeypatch):
    """Texts of one word of bits, of two and of more; no pair of ordinary lengths is compared by a scalar loop or combed."""
    rng = random.Random(5)
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    pairs = [("", ""), ("", "a"), ("a b", "b a"), ("a a", "a"), (" ", "a"), ("\ud800x", "x\ud800")]
    for of in ("ab ", "abcdefgh ", "aé漢🙂 "):
        for size in (1, 5, 40, 63, 64, 65, 119, 128, 140):
            for _ in range(12):
                a = letters(size, of)
                b = letters(rng.randint(0, 150), of) if rng.random() < 0.5 else a[: size // 3] + letters(2, of) + a[rng.randint(0, size) :]
                pairs.append(rng.choice([(a, b), (b, a)]))
    plain = {"ratio": fuzzy.ratio, "partial_ratio": fuzzy.partial_ratio, "token_sort": fuzzy.token_sort_ratio, "token_set": fuzzy.token_set_ratio, "WRatio": fuzzy.weighted_ratio, "lcs_ratio": fuzzy.lcs_ratio, "jw": fuzzy.jaro_winkler}
    assert set(plain) == set(fuzzy.SCORES)
    want = {name: [f(*p) for p in pairs] for name, f in plain.items()}
    for name in ("lcs", "_slide"):
        monkeypatch.setattr(fuzzy, name, None)
    found = fuzzy.Scores(pairs)
    for name, values in want.items():
        assert list(getattr(found, name)) == pytest.approx(values, abs=1e-12), name
        assert len(getattr(fuzzy.Scores([]), name)) == 0
    monkeypatch.setattr(fuzzy, "_combed", None)
    ordinary = [p for p in pairs if all(50 <= len(x) <= 120 for x in p)]
    assert ordinary and len(fuzzy.partial_ratios(ordinary)) == len(ordinary)


def test_partial_ratios_of_many_pairs_equal_sliding():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé🙂") for _ in range(rng.randint(1, 7)))
    make = lambda: " ".join(word() for _ in range(rng.randint(0, 12)))
    pairs = [(make(), make()) for _ in range(400)] + [("", ""), ("", "a"), ("abc", "abc"), ("ab", "ba"), ("a", "xxaxx")]
    found = fuzzy.partial_ratios(pairs)
    for pair, value in zip(pairs, found, strict=True):
        assert value == pytest.approx(fuzzy.partial_ratio(*pair), abs=1e-12), pair
    assert fuzzy._all_weighted(pairs) == pytest.approx([fuzzy.weighted_ratio(*p) for p in pairs], abs=1e-12)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh i", "aé😀 "])
def test_scores_of_long_texts_equal_those_of_short_ones(monkeypatch, letters):
    """Where texts are taken one by one, and where characters of a table are few."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    pairs = [(word(90), word(90)) for _ in range(150)] + [(x, x[: rng.randint(0, 40)] + word(9) + x[rng.randint(0, 90) :]) for x in (word(90) for _ in range(100))]
    plain = {"ratio": fuzzy.ratio, "partial_ratio": fuzzy.partial_ratio, "token_sort": fuzzy.token_sort_ratio, "token_set": fuzzy.token_set_ratio, "WRatio": fuzzy.weighted_ratio, "jw": fuzzy.jaro_winkler, "lcs_ratio": fuzzy.lcs_ratio}
    monkeypatch.setattr(fuzzy, "LONG", 30)
    monkeypatch.setattr(fuzzy, "CELLS_AT_ONCE", 500)
    monkeypatch.setattr(fuzzy, "CHARS_AT_ONCE", 1000)
    got = [np.concatenate(x) for x in zip(*([np.asarray(getattr(fuzzy.Scores(part), n)) for n in plain] for part in fuzzy._parts(pairs)), strict=True)]
    for own, f in zip(got, plain.values(), strict=True):
        assert own.tolist() == pytest.approx([f(*p) for p in pairs], abs=1e-12)


def test_edit_distances():
    rng = random.Random(12)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 80))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        assert fuzzy.edit_distance(a, b) == row[-1]


@pytest.mark.parametrize("once", [1, 50, 1000])
def test_scores_do_not_depend_on_how_many_rows_are_taken_at_once(monkeypatch, once):
    monkeypatch.setattr(fuzzy, "CHARS_AT_ONCE", once)
    rng = random.Random(13)
    a = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None]
    ratios, weighted = fuzzy._scored(("ratio", "WRatio"), pa.array(a), pa.array(a[::-1]))
    pairs = [(x or "", y or "") for x, y in zip(a, a[::-1], strict=True)]
    assert ratios.to_pylist() == [fuzzy.ratio(*p) for p in pairs]
    assert weighted.to_pylist() == pytest.approx([fuzzy.weighted_ratio(*p) for p in pairs], abs=1e-12)
    assert [len(x) for x in fuzzy._scored(("ratio",), pa.array([], pa.string()), pa.array([], pa.string()))] == [0]
