"""One consistent form for texts that look alike.

A text is first rid of what cannot be seen: compatibility forms are taken back to their plain characters, kinds of
space to the space, and ignorable characters are deleted. Then each token becomes a lattice: every letter that has
look-alikes in other scripts offers them all, whichever of them was written. Viterbi picks the path with the best
bigram score, each script change costing a penalty, so "раypal" comes out in Latin and "Портовый" with a Latin o in
Cyrillic. The lattice depends only on how the token looks, and the output only on the lattice: tokens that look alike
get the same form, and tokens that don't can't.

Which letters look alike: a fixed list for Latin, Cyrillic, Greek and Armenian, and for all other scripts Unicode's confusables
data, which Spark's jars bring along (see from_unicode). Of these a class takes no second letter of a script: letters that an alphabet
tells apart are read apart. Upper and lower case stay apart, and so do digits and signs.

Bigrams are counted over all documents, in each partition first; their table is bounded by the square of the
alphabets and is the only thing collected.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.runtime import salted_join, staged

#: Letters that look the same in common fonts, by class.
LOOK_ALIKES = [
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "FϜ", "GԌ", "HНΗ", "IІΙӀ", "JЈͿ", "KКΚ", "MМΜ", "NΝ", "OОΟՕ", "PРΡ", "QԚ", "SЅՏ", "TТΤ", "VѴ", "WԜ", "XХΧ", "YΥҮУ", "ZΖ",
    "aа", "cсϲ", "dԁ", "eе", "gɡ", "hһհ", "iі", "jјϳ", "lӏ", "nո", "oоοօ", "pрρ", "qԛ", "sѕ", "vѵ", "wԝ", "xх", "yуү",
    "ГΓ", "ПΠ", "ФΦ", "ÆӔ", "æӕ", "əә", "ƏӘ",
]
#: Hyphens that look like the plain one.
HYPHENS = "\u2010\u2011"
#: Compatibility forms that read like their plain characters; raised, circled and squared forms do not.
PLAIN_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>", "<vertical>"}
#: Compatibility characters whose look is their own (letters raised or set in one sign).
OWN_LOOK = set("№℀℁℅℆℡℻㏂㏇㏘")
JOINERS = "\u200c\u200d"

#: What a script change within a token costs, in nats: more than any bigram can win back.
SWITCH = 25.0


@functools.lru_cache(1 << 16)
def script(c: str) -> str:
    o = ord(c)
    if 0x370 <= o < 0x400 or 0x400 <= o < 0x530 or 0x530 <= o < 0x590 or o < 0x300:
        return "greek" if 0x370 <= o < 0x400 else "cyrillic" if 0x400 <= o < 0x530 else "armenian" if o >= 0x530 else "latin"
    return unicodedata.name(c, "").split(" ")[0].lower() if c.isalpha() else ""


def from_unicode(spark: SparkSession) -> tuple[str, ...]:
    """Classes of the letters that Unicode's confusables data (of the ICU in Spark's jars) shows as one ASCII letter: the ASCII letter
    first. Letters of right-to-left scripts, which join, second letters of a script, and the scripts beyond U+FFFF, all of them
    historic or of very few users, are left out."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    letters = [c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) in ("Lu", "Ll", "Lo", "Lt") and not unicodedata.decomposition(c)]
    looks = checker.getSkeleton("\n".join(letters)).split("\n")
    listed = {c: group for group in LOOK_ALIKES for c in group}
    found: dict[str, list[str]] = defaultdict(list)
    for c, look in zip(letters, looks, strict=True):
        if c in listed or len(look) != 1 or not (look.isascii() and look.isalpha()) or unicodedata.bidirectional(c) in ("R", "AL"):
            continue
        upper = unicodedata.category(c) in ("Lu", "Lt")
        look = "I" if upper and look == "l" else look
        if look.isupper() != upper and unicodedata.category(c) != "Lo":
            continue
        if script(c) not in {script(x) for x in [*listed.get(look, look), *found[look]]}:
            found[look].append(c)
    return tuple(look + "".join(more) for look, more in sorted(found.items()) if more)


def _ranges(points: list[int]) -> str:
    """A regular expression's class of code points."""
    out: list[list[int]] = []
    for o in points:
        if out and out[-1][1] == o - 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


_MARKS = _ranges([o for o in range(0x20000) if unicodedata.combining(chr(o))])
_MARK = re.compile(f"[{_MARKS}]")


class Alphabet:
    """Letters by class: the fixed list, and more classes that go into those of their first letters."""

    def __init__(self, more: tuple[str, ...] = ()):
        groups = {group[0]: group for group in LOOK_ALIKES}
        listed = {c: group[0] for group in LOOK_ALIKES for c in group}
        for group in more:
            first = listed.get(group[0], group[0])
            groups[first] = groups.get(first, group[0]) + group[1:]
        self.classes = {c: group for group in groups.values() for c in group}
        letters = {o for o in range(0x590) if chr(o).isalpha() and script(chr(o))} | {ord(c) for c in self.classes}
        known = _ranges(sorted(letters))
        #: A token: letters of the scripts of the list, and those that look like them, with their marks.
        self.token = re.compile(f"[{known}][{known}{_MARKS}]*")
        self.parts = re.compile(f"({self.token.pattern})")
        #: All spellings of a look have one key: the first letter of each class stands for the class.
        self.look = {ord(c): group[0] for c, group in self.classes.items()}


_LISTED = {c for group in LOOK_ALIKES for c in group}


@functools.lru_cache(4)
def alphabet(more: tuple[str, ...] = ()) -> Alphabet:
    return Alphabet(more)


class _Plain(dict):
    """Translation of single characters to what is seen of them, made as they come."""

    def __missing__(self, o: int):
        c = chr(o)
        kind = unicodedata.category(c)
        if kind in ("Zs", "Zl", "Zp") or c in "\t\n\r\x0b\x0c\x85":
            out = " "
        elif o == 0xAD:
            out = None
        elif c in HYPHENS:
            out = "-"
        elif c in JOINERS:
            out = c  # settled by context
        elif kind in ("Cf", "Cc", "Co", "Cs") or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5, 0x2800):
            out = None if o != 0x2800 else " "
        else:
            tag = unicodedata.decomposition(c).split(" ")[0]
            out = unicodedata.normalize("NFKC", c) if tag in PLAIN_TAGS and c not in OWN_LOOK else c
            if out != c and unicodedata.category(c) not in ("Lm",) and " " in out and kind == "Sk":
                out = c  # spacing accents keep their own look
        self[o] = out
        return out


_PLAIN = _Plain()


def _joins(c: str) -> bool:
    """Whether joiners next to c change what is seen: pictures, and scripts whose letters join."""
    o = ord(c)
    return unicodedata.category(c) in ("So", "Sk") or 0x600 <= o < 0x1000 or 0x1780 <= o < 0x1800


def visible(text: str) -> str:
    """The text in canonical decomposition, without what cannot be seen."""
    if text.isascii() and text.isprintable():
        return text
    plain = text.translate(_PLAIN)
    if plain.isascii():
        return plain
    if any(c in plain for c in JOINERS):
        kept = []
        for i, c in enumerate(plain):
            if c in JOINERS and not (0 < i < len(plain) - 1 and _joins(plain[i - 1]) and _joins(plain[i + 1])):
                continue
            kept.append(c)
        plain = "".join(kept)
    return unicodedata.normalize("NFD", plain)


def bigrams_of(token: str, letters_of: Alphabet) -> Iterator[tuple[str, str]]:
    """Bigrams of the base letters of a token that is in one script beyond doubt, with "" for both ends."""
    letters = _MARK.sub("", token)
    if len({script(c) for c in letters}) == 1 and any(c not in letters_of.classes for c in letters):
        yield from zip(["", *letters], [*letters, ""], strict=True)


def count_bigrams(documents: DataFrame, text: str = "text", more: tuple[str, ...] = ()) -> dict[tuple[str, str], int]:
    """Bigram counts over all texts, bounded by the square of the alphabets. Counts that are kept and handed to consistent()
    make the forms of several corpora, or of batches of one, comparable."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = alphabet(more)
        tokens: Counter = Counter()
        counts: Counter = Counter()

        def settle() -> None:
            for token, n in tokens.items():
                for pair in bigrams_of(token, known):
                    counts[pair] += n
            tokens.clear()

        for batch in batches:
            for value in batch.column(0).to_pylist():
                tokens.update(known.token.findall(visible(value)))
                if len(tokens) > 200_000:
                    settle()
        settle()
        if counts:
            yield pa.RecordBatch.from_pydict({"a": [a for a, _ in counts], "b": [b for _, b in counts], "n": list(counts.values())})

    found = documents.select(F.col(f"`{text}`").cast("string")).dropna().mapInArrow(over, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return {(r.a, r.b): r.n for r in found.collect()}


class Speller:
    """Picks the letters of tokens; made from bigram counts."""

    def __init__(self, counts: dict[tuple[str, str], int], more: tuple[str, ...] = ()):
        self.letters = alphabet(more)
        seen = {b for _, b in counts}
        # letters beyond the fixed list are spelled as they are only where the texts have their script
        self.options = {group[0]: "".join(c for c in group if c in _LISTED or c in seen) or group[0] for group in self.letters.classes.values()}
        starts: defaultdict = defaultdict(int)
        for (a, _), n in counts.items():
            starts[a] += n
        self.score = {pair: math.log((n + 0.5) / (starts[pair[0]] + 100)) for pair, n in counts.items()}
        self.unseen = {a: math.log(0.5 / (n + 100)) for a, n in starts.items()}
        self.steps: dict[tuple[str, str], float] = {}
        self.known: dict[str, str] = {}

    def step(self, a: str, b: str) -> float:
        if (found := self.steps.get((a, b))) is None:
            change = SWITCH if a and b and script(a) != script(b) else 0.0
            found = self.steps[a, b] = self.score.get((a, b), self.unseen.get(a, math.log(0.5 / 100))) - change
        return found

    def token(self, token: str) -> str:
        """The best path through the token's lattice; of equal paths that of the first letters in their classes."""
        letters = [i for i, c in enumerate(token) if not _MARK.match(c)]
        choices = [self.options.get(token[i], token[i]) for i in letters]
        step = self.step
        scores, back = {"": 0.0}, []
        for choice in [*choices, ("",)]:
            new, came = {}, {}
            for b in choice:
                best, best_a = -math.inf, ""
                for a, s in scores.items():
                    if (v := s + step(a, b)) > best + 1e-9:
                        best, best_a = v, a
                new[b], came[b] = best, best_a
            scores = new
            back.append(came)
        out, at = list(token), ""
        for came, i in zip(reversed(back), [None, *reversed(letters)], strict=True):
            if i is not None:
                out[i] = at
            at = came[at]
        return "".join(out)

    def spell(self, token: str) -> str:
        if len(self.known) > 200_000:
            self.known.clear()
        look = token.translate(self.letters.look)
        found = self.known[token] = self.known[look] = self.known.get(look) or self.token(look)
        return found

    def text(self, text: str) -> str:
        parts = self.letters.parts.split(visible(text))  # every second one is a token
        known = self.known
        parts[1::2] = [known.get(token) or self.spell(token) for token in parts[1::2]]
        plain = "".join(parts)
        return plain if plain.isascii() else unicodedata.normalize("NFC", plain)


def consistent(documents: DataFrame, text: str = "text", into: str = "consistent", counts: dict | None = None) -> DataFrame:
    """documents with the column into: the text in the form that is equal exactly for texts that look alike.

    Letter case, accents, digits, punctuation and order stay; every kind of space becomes a space, and their number
    stays. Defined results: null stays null; a text showing nothing gives blanks or an empty text; joiners stay
    between pictures and between letters of joining scripts, where they are seen; texts of any length are taken
    whole. The choice of letters (not which texts are equal) depends on the bigrams of the documents at hand.
    """
    more = from_unicode(documents.sparkSession)
    counts = count_bigrams(documents, text, more) if counts is None else counts
    shared = documents.sparkSession.sparkContext.broadcast(counts)  # bounded by the alphabets

    @F.pandas_udf("string")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        speller = Speller(shared.value, more)
        for batch in batches:
            yield pd.Series([None if t is None else speller.text(t) for t in batch.to_numpy(object)], dtype=object)

    return documents.withColumn(into, spell(F.col(f"`{text}`").cast("string")))


def _forms(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Written once: _doc and digests of its text and form; without null ids and texts, and texts showing nothing."""
    picked = documents.select(F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{text}`").cast("string").alias("_text")).dropna()
    key = lambda c: F.unhex(F.md5(F.encode(c, "UTF-8")))
    return staged(consistent(picked, "_text", "_form").where("trim(_form) != ''").select("_doc", key("_text").alias("_text"), key("_form").alias("_form")).distinct(), "forms")


def alike_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, class_id (the least doc_id of those that look alike) and n_texts, the number of different texts in
    the class. Null ids and texts, and texts showing nothing, take no part; repeated rows count once."""
    forms = _forms(documents, doc_id, text)
    classes = forms.groupBy("_form", "_text").agg(F.min("_doc").alias("_least")).groupBy("_form").agg(F.min("_least").alias("class_id"), F.count(F.lit(1)).alias("n_texts"))
    return salted_join(forms.select("_doc", "_form").distinct(), classes, ["_form"]).select(F.col("_doc").alias(doc_id), "class_id", "n_texts")


def alike_pairs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id_a < doc_id_b of documents with different texts that look alike; alike_classes() gives classes instead.

    Texts with the same form are paired text by text first, so copies of a text are never compared with each other;
    only texts with a look-alike are expanded to their documents, of which crowded texts are spread. Null ids and texts, and texts
    showing nothing, take no part; repeated rows count once.
    """
    forms = _forms(documents, doc_id, text)
    texts = forms.select("_form", "_text").distinct()
    several = texts.groupBy("_form").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    texts = texts.join(several, "_form")
    pairs = texts.withColumnRenamed("_text", "_a").join(texts.withColumnRenamed("_text", "_b"), "_form").where("_a < _b").select("_a", "_b")
    members = forms.join(several, "_form", "left_semi").select("_text", "_doc")
    first = salted_join(members.withColumnsRenamed({"_text": "_a", "_doc": "_doc_a"}), pairs, ["_a"])
    return (
        first.join(members.withColumnsRenamed({"_text": "_b", "_doc": "_doc_b"}), "_b")
        .select(F.least("_doc_a", "_doc_b").alias("doc_id_a"), F.greatest("_doc_a", "_doc_b").alias("doc_id_b"))
        .where("doc_id_a < doc_id_b")
        .distinct()
    )
