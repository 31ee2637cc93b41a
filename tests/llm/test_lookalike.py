import pytest
from pyspark.sql import functions as F

from lodestream.llm.lookalike import LOOK_ALIKES, Speller, alike_classes, alike_pairs, alphabet, bigrams_of, consistent, count_bigrams, from_unicode, script, visible

#: Each line looks the same throughout.
SAME = [
    ["The cap café 12", "Ｔｈｅ　ｃａｐ　ｃａｆé　１２", "The cap café 12", "Тһе сар саfé 12", "T​he c­ap ca﻿fé 1⁠2", "Τhе cаp cаfé 12"],
    ["Первый писарь", "Пepвый пиcapь", "Первый писарь"],
    ["KV-68", "KV‑68", "ＫＶ－６８", "KV-68"],
    ["ラムプ", "ﾗﾑﾌﾟ", "ラムプ"],
    ["水車 flag", "水⾞ ﬂag"],
    ["người", "người"],
]
#: Each line looks different throughout.
DIFFERENT = [["cap", "Cap", "càp", "cap.", "cap ;", "c ap", "pac"], ["12", "13", "1²"], ["й", "и"], ["№ 5", "No 5"], ["👩‍🔧", "👩🔧"], ["l1", "I1", "11"], ["a-b", "a–b", "a—b"]]


#: Letters of scripts beyond the fixed list.
MORE_SAME = [["vat AO Ag u", "νat ꓮⲞ Ꭺց ս", "νat AO Ag u"]]


def speller(texts, more=()):
    counts, letters = {}, alphabet(more)
    for text in texts:
        for token in letters.token.findall(visible(text)):
            for pair in bigrams_of(token, letters):
                counts[pair] = counts.get(pair, 0) + 1
    return Speller(counts, more)


@pytest.mark.parametrize("unicode", [False, True])
@pytest.mark.parametrize("texts", [[], [t for line in SAME for t in line], ["the quick brown fox jumps over a lazy dog"]])
def test_equal_exactly_for_texts_that_look_alike(spark, texts, unicode):
    s = speller(texts, from_unicode(spark) if unicode else ())
    if unicode:
        assert all(len({s.text(t) for t in line}) == 1 for line in MORE_SAME)
    forms = [{s.text(t) for t in line} for line in SAME]
    assert all(len(f) == 1 for f in forms) and len(set.union(*forms)) == len(SAME)
    for line in DIFFERENT:
        assert len({s.text(t) for t in line}) == len(line), line
    for f in forms:
        assert s.text(next(iter(f))) == next(iter(f))  # the form is its own form


def test_the_script_that_fits_is_chosen():
    s = speller(["the captain of the trap cut the map, the carpet and the strap", "первый писарь ночной пекарь сорок"])
    assert s.text("Тһе сар") == "The cap" and s.text("Пepвый пиcapь") == "Первый писарь"
    assert s.text("cop") == s.text("сор") == s.text("сoр")


def test_classes_are_apart():
    letters = [c for group in LOOK_ALIKES for c in group]
    assert len(letters) == len(set(letters)) == len(alphabet().classes)


def test_classes_from_unicode(spark):
    more = from_unicode(spark)
    known = alphabet(more).classes
    assert len(known) > len(alphabet().classes) + 80
    assert known["ν"] == known["v"] and known["Ꭺ"] == known["A"] == known["А"] and "ס" not in known and known.get("σ") != known["o"]
    for group in more:  # no two letters of a script, and each case on its own
        added = group[1:]
        assert len({script(c) for c in added}) == len(added) and not any(c.isupper() != group[0].isupper() for c in added if c.isupper() or c.islower())


def test_plain_texts_of_many_scripts_keep_apart(spark):
    words = ["αυτός", "αυτοσ", "νους", "ουρα", "σοφος", "սա", "ցա", "ꓮꓰ", "ꓰꓮ", "ᎪᎵ", "ᎵᎪ", "под", "пол", "ποδ", "ⲞⲚ", "ⲚⲞ", "Ⅽat", "ɑcte", "aсte"]
    s = speller(words, from_unicode(spark))
    assert len({s.text(w) for w in words}) == len(words)


def test_classes_of_documents(spark):
    rows = [(5, "The cap"), (2, "Тһе сар"), (3, "The cap"), (7, "other"), (8, None), (9, " "), (7, "other")]
    got = sorted(tuple(r) for r in alike_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(2, 2, 2), (3, 2, 2), (5, 2, 2), (7, 7, 1)]


def test_pairs(spark):
    rows = [(1, "The cap"), (2, "Тһе сар"), (3, "The cap"), (4, "The cap"), (5, "the cap"), (6, None), (7, ""), (8, " ​"), (9, "　"), (None, "The cap"), (2, "Тһе сар"), (10, "x" * 100_000), (11, "х" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_form", F.lit(1)).withColumn("consistent", F.lit("c"))
    got = [tuple(r) for r in alike_pairs(df).collect()]
    assert sorted(got) == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (10, 11)]
    assert alike_pairs(df.limit(0)).collect() == []


def test_nulls_stay_and_counts_cover_all_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "the сар")], "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.consistent for r in consistent(df).collect()} == {1: None, 2: "the cap"}
    assert count_bigrams(df)["t", "h"] == 1
