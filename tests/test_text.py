import random
import time

import pytest
from pyspark.sql import functions as F

from almanac.functions import text as T


def say(one, function, *texts):
    schema = ", ".join(f"c{i} string" for i in range(len(texts)))
    return one(function(*[f"c{i}" for i in range(len(texts))]), schema, texts)


@pytest.mark.parametrize("function, given, expected", [
    (T.remove_punctuation, "Kühl, trüb; nass. Wirklich? Ja: sehr!", "Kühl trüb nass Wirklich Ja sehr"),
    (T.collapse_spaces, "Ein   Tag  in Kiel", "Ein Tag in Kiel"),
    (T.collapse_spaces, "Ein Tag", "Ein Tag"),
    (T.join_minus, "Es wird - 15 <degC>.", "Es wird -15 <degC>."),
    (T.join_minus, "Es wird -15 <degC>.", "Es wird -15 <degC>."),
    (T.join_minus, "Es wird 15 <degC>.", "Es wird 15 <degC>."),
    (T.strip, " \t \n Kiel  ", "Kiel"),
    (T.tidy, "  Frost   bei  - 7 <degC>  ", "Frost bei -7 <degC>"),
    (T.unit_tokens, "5°C 10l/m² 30km/h 5%", "5 <degC> 10 <l_per_sqm> 30 <kmh> 5 <percent>"),
    (T.drop_gust_sentences, "Sonne. Böen bis 90 km/h. Wolken.", "Sonne. Wolken."),
    (T.drop_gust_sentences, "Böen", ""),
    (T.mask_dates, "Am 1.2.2024 und 31.12.2024, nicht 1.2.24", "Am <date> und <date>, nicht 1.2.24"),
    (T.title_case, "SAO-TOMÉ o'neil 3abc", "Sao-Tomé O'Neil 3Abc"),
    (T.file_identifier, "day/Bad-Ort-DE123_standardised.json", "DE123"),
])
def test_one_text(one, function, given, expected):
    assert say(one, function, given) == expected


def test_null_passes_through(one):
    for function in (T.tidy, T.unit_tokens, T.drop_gust_sentences, T.remove_punctuation, T.mask_dates):
        assert say(one, function, None) is None
    assert say(one, T.clean_rewritten, None, "Kiel") is None


def test_words_split_on_unicode_space(one):
    assert say(one, T.words, " a b\n\nc\x1cd  ") == ["a", "b", "c", "d"]
    assert say(one, T.words, "") == []


def test_plain_city_mask(one):
    assert say(one, T.mask_city, "In Ulm und Ulmen", "Ulm") == "In <city> und <city>en"
    assert say(one, T.mask_city, "In Ulm", "") == "In Ulm"
    assert say(one, T.mask_city, "In Addis Abeba", "Addis Ababa") == "In Addis Abeba"
    assert say(one, T.unmask_city, "In <city>", "Ulm") == "In Ulm"


@pytest.mark.parametrize("city, given, expected", [
    ("Ulm", "Ulm, Ulmen und Neu-Ulm", "<city>, Ulmen und Neu-<city>"),
    ("Köln", "Köln Kölner xKöln", "<city> Kölner xKöln"),
    ("Örs", "Örs äÖrs", "<city> äÖrs"),
    ("A+B", "A+B AAB", "<city> AAB"),
    ("St. Gal", "St. Gal und Stx Gal", "<city> und Stx Gal"),
    ("a\\Eb", "x a\\Eb y", "x <city> y"),
])
def test_word_city_mask(one, city, given, expected):
    assert say(one, T.mask_city_and_units, given, city) == expected


def test_unit_tags_and_cleanup(one):
    given = "**7 °  C** oder 7 Grad bei 30 km/h, 5  %  und 3 l/m² .\n\n Ende"
    assert say(one, T.mask_city_and_units, given, "X") == (
        "7 <temp> oder 7 <temp> bei 30 <velocity>, 5 <percentile> und 3 <rainfall>.\nEnde")


@pytest.mark.parametrize("given, expected", [
    ("20 ° C", "20°C"),
    ("20 °  warm", "20°Cwarm"),
    ("a–b", "a — b"),
    ("a – b", "a  —  b"),
    ("a - b", "a — b"),
    ("10-15", "10 bis 5"),
    ("😀 Sonne ☀ und ⛈", "Sonne und"),
    ("Hier ist dein Bericht:\n\nSonne\n\nRegen", "Sonne\n\nRegen"),
    ("Hier scheint die Sonne\n\nRegen", "Hier scheint die Sonne\n\nRegen"),
    ("Hier ist alles:", "Hier ist alles:"),
    ("ein 'Wort' hier", 'ein  ""Wort""  hier'),
    ("Regen- und Wind", "Regen-und Wind"),
    ("gut -Wetter", "gut-Wetter"),
    ("„kalt“", "kalt"),
    ("a_b\\c", 'a"b"c'),
    ('nun "sehr kalt"-Wetter', "nun sehr kalt Wetter"),
    ("<<a>> b", 'a" b'),
])
def test_clean_steps(one, given, expected):
    assert say(one, T.clean_rewritten, given, "Kiel") == expected


def test_clean_range_flag_and_city(one):
    fixed = T.clean_rewritten("c0", "c1", fix_ranges=True)
    assert one(fixed, "c0 string, c1 string", ("10-15 in Kiel_Ort", "Kiel_Ort")) == "10 bis 15 in Kiel_Ort"


def test_prepared_texts(one):
    assert say(one, T.profiling_text, "In Ulm, 5°C. Ja!", "Ulm") == "In <city> 5 <degC> Ja"
    assert say(one, T.similarity_text, "In Ulm, -5°C und 12. Ja!", "Ulm") == "In <city> <number> und <number> Ja"
    assert say(one, T.display_text, " In <city>  - 3 <degC>", "Ulm") == "In Ulm -3°C"


def test_ngrams_of_short_texts(one):
    tokens = F.array(F.lit("a"), F.lit("b"))
    assert one(T.ngrams(tokens, 2)) == ["a b"]
    assert one(T.ngrams(tokens, 3)) == []


def test_the_clean_looks_back_as_it_matched(spark):
    """Steps that look back give what the patterns they stand for give, and long words cost no square of their length."""
    def whole(fix):
        return [(r"([0-9]+)( +)°C", "$1°C"), (r"([A-Za-z0-9]+)'( +)", r'$1\\" $2'), ("([0-9]+)-([0-9]+)" if fix else "([0-9]+)-([0-9])+", "$1 bis $2"),
                (r"([A-Za-z]+)-( +)", "$1-"), (r"([a-z]+)'-([A-Za-z]+)", r'$1\\"-$2')]

    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "B", "'", "-", " ", "  ", "1", "23", "°C", "'-", "é"]) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for fix in (False, True):
        steps = [T.clean_steps(F.lit("Ort"), fix)[i] for i in (10, 19, 20, 22, 23)]
        for (old, new), step in zip(whole(fix), steps):
            was, now = F.regexp_replace("t", old, new), step(F.col("t"))
            assert df.filter(was != now).first() is None, old
            assert df.filter(now != F.col("t")).count() > 20
    begin = time.time()
    long = spark.range(1).select(T.clean_rewritten(F.repeat(F.lit("a"), 100_000), F.lit("Ort")).alias("t"))
    assert long.select(F.length("t")).first()[0] == 100_000 and time.time() - begin < 15
