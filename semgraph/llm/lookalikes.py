"""One consistent form for texts that look the same.

Ignorable characters are deleted, blanks become spaces, wide, narrow and
joined forms their ordinary characters.  Every token is then a lattice: a
letter that has the shape of letters of other scripts may be any of them.
The Viterbi path of the best character bigram score, under bigrams counted
in the tokens of one script of all texts, is the form of the token.  Marks go
with the letter before them: a letter follows the last letter, and a mark is
scored by the letter that bears it.  A word that could be one of several
scripts throughout goes with the script of the word before it unless its
bigrams say otherwise.  The score looks only at shapes, never at
the letters that stood there, so texts that look the same get the same form,
and every letter keeps its shape, so others do not: forms are equal exactly if
shapes are, and the search decides which of the equal spellings the form is.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of several scripts that have one shape. Accented letters are taken apart before.
SHAPES = (
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "HНΗ", "IІΙӀ", "JЈͿ", "KКΚ", "MМΜ", "NΝ", "OОΟՕ", "PРΡ", "QԚ", "SЅՏ", "TТΤ", "UՍ", "VѴ", "WԜ", "XХΧ", "YΥҮ", "ZΖ",
    "aа", "cсϲ", "dԁ", "eе", "gɡց", "hһհ", "iі", "jјϳ", "lӏ", "oоοօ", "pр", "qԛ", "sѕ", "wԝ", "xх", "yу", "ГΓ", "ПΠ", "ФΦ", "へヘ",
)
_OPTIONS = {c: s for s in SHAPES for c in s}
#: letters that tokens are made of: Latin, Greek, Cyrillic, Armenian and kana, with their marks
_TOKEN = re.compile("[A-Za-zªºµ-ʯ\u0300-\u036fͰ-֏ぁ-\u309aァ-ヺ]+")
_CUT = re.compile(f"({_TOKEN.pattern})")
#: a bigram table has at most the square of this many letters, whatever the texts
LETTERS = 26 * 2 + 0x058F - 0x00AA + 1 + 0x30FA - 0x3041 + 3
UNSEEN, FOREIGN = -14.0, -20.0
#: what a word gains that stays in the script of the word before it
STAY = 8.0
_MEMO = 200_000


def _script(c: str) -> str:
    o = ord(c)
    if 0x0300 <= o <= 0x036F or 0x3099 <= o <= 0x309A:
        return ""
    if o < 0x02B0:
        return "Latin"
    if o < 0x0400:
        return "Greek"
    if o < 0x0530:
        return "Cyrillic"
    if o < 0x0590:
        return "Armenian"
    return "Hiragana" if o < 0x30A0 else "Katakana"


def _last_script(token: str) -> str:
    """The script of a token's last letter; marks have none."""
    return _script(token[-1]) or next((s for c in reversed(token) if (s := _script(c))), "")


#: decompositions that leave a character's look: the others (raised, circled, fractions ...) change it
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")


def _joined(c: str) -> bool:
    """Compatibility characters that look as their parts do: ligatures, digraphs, Roman numerals, radicals, letter-like signs."""
    o = ord(c)
    return (
        0xFB00 <= o <= 0xFB4F or 0x2160 <= o <= 0x217F or 0x2E80 <= o <= 0x2FDF or 0x3131 <= o <= 0x318E or o in (0xB5, 0x132, 0x133, 0x13F, 0x140, 0x149)
        or 0x1C4 <= o <= 0x1CC or 0x1F1 <= o <= 0x1F3 or 0x2024 <= o <= 0x2026 or o == 0x587
    )


def _plain(c: str) -> str:
    """What one character is in the consistent form, taken apart."""
    o, kind = ord(c), unicodedata.category(c)
    if c in "\n\x85\u2028\u2029":
        return "\n"
    if c == "\r":
        return "\r"
    if kind == "Zs" or c in "\t\x0b\x0c\u2800":
        return " "
    if kind in ("Cc", "Cf", "Cs") or o == 0x034F or 0x115F <= o <= 0x1160 or o in (0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0000 <= o <= 0xE0FFF:
        return ""
    d = unicodedata.decomposition(c)
    if not d:
        # Hangul syllables have no entry of their own
        return unicodedata.normalize("NFD", c)
    if d[0] != "<":
        return "".join(map(_plain, unicodedata.normalize("NFD", c))) if unicodedata.normalize("NFD", c) != c else c
    tag, *codes = d.split()
    if tag in _SAME_LOOK or (tag == "<compat>" and _joined(c)):
        return "".join(_plain(chr(int(x, 16))) for x in codes)
    return c


class _Plain(dict):
    def __missing__(self, o: int) -> str:
        self[o] = out = _plain(chr(o))
        return out


_TABLE = _Plain()
#: characters that are the same in the consistent form or only taken apart by it; all others are looked up one by one
_SAFE = (
    "\n -~\u00a1-\u00ac\u00ae-\u00b4\u00b6-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u01c3\u01cd-\u01f0\u01f4-\u034e\u0350-\u0377\u037a-\u037f\u0384-\u038a\u038e-\u03a1\u03a3-\u052f\u0531-\u0556"
    "\u0561-\u0586\u2010\u2012-\u2015\u2018-\u2023\u2030-\u203a\u2190-\u21ff\u2200-\u22ff\u3001-\u3035\u3041-\u3096\u3099-\u30fe\u4e00-\u9fff\uac00-\ud7a3"
)
_OTHER = re.compile(f"[^{_SAFE}]")


def plain(text: str) -> str:
    """Without ignorable characters and taken apart, line breaks as ``\\n``."""
    text = _OTHER.sub(lambda m: _TABLE[ord(m[0])], text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text if text.isascii() else unicodedata.normalize("NFD", text)


def shapes(text: str) -> str:
    """The text with the first letter of each shape: an exact key of how a text looks."""
    return "".join(_OPTIONS.get(c, c)[0] for c in plain(text))


def count_bigrams(tokens: dict[str, int]) -> Counter:
    """Bigrams of the tokens whose letters are of one script, ``^`` before and ``$`` after; a mark pairs with its letter and is skipped otherwise."""
    out: Counter = Counter()
    for t, n in tokens.items():
        if len({_script(c) for c in t} - {""}) == 1:
            last = "^"
            for c in t:
                out[last + c] += n
                if _script(c):
                    last = c
            out[last + "$"] += n
    return out


class Model:
    """Log probabilities of a letter or mark after a letter, and the Viterbi search with them."""

    def __init__(self, counts: dict[str, int]):
        # each letter is followed once by another letter or the end
        total: Counter = Counter()
        for pair, n in counts.items():
            if pair[1] == "$" or _script(pair[1]):
                total[pair[0]] += n
        self.score = {p: math.log(n / total[p[0]]) for p, n in counts.items()}
        self.single: dict[str, str] = {}
        self.several: dict[str, tuple] = {}
        self.shapes: dict[str, tuple] = {}

    def step(self, a: str, b: str) -> float:
        s = self.score.get(a + b)
        if s is not None:
            return s
        x, y = _script(a) if a != "^" else "", _script(b) if b != "$" else ""
        return FOREIGN if x and y and x != y else UNSEEN

    def search(self, shape: str, script: str | None = None) -> tuple[float, str] | None:
        """The best path through the lattice of a token's shapes and its score, of one script if it is given; none if the token has no such reading.

        Ties go to the letter that stands first in its shape.
        """
        # states are the last letters; marks leave them as they are
        paths = {"^": (0.0, "")}
        for c in shape:
            if not _script(c):
                paths = {a: (s + self.step(a, c), path + c) for a, (s, path) in paths.items()}
                continue
            after = {}
            for b in _OPTIONS.get(c, c):
                if script and _script(b) != script:
                    continue
                best = None
                for a, (s, path) in paths.items():
                    s += self.step(a, b)
                    if best is None or s > best[0]:
                        best = (s, path)
                after[b] = (best[0], best[1] + b)
            if not after:
                return None
            paths = after
        return max(((s + self.step(a, "$"), path) for a, (s, path) in paths.items()), key=lambda x: x[0])

    def best(self, token: str) -> str:
        """The best reading of a token by itself."""
        return self.search("".join(_OPTIONS.get(c, c)[0] for c in token))[1]

    def _readings(self, token: str) -> tuple:
        """``(script, reading, score)`` of a token: the best one, or one for each script that it could be in throughout if there are several."""
        shape = "".join(_OPTIONS.get(c, c)[0] for c in token)
        found = self.shapes.get(shape)
        if found is None:
            letters = [{_script(b) for b in _OPTIONS.get(c, c)} for c in shape if _script(c)]
            scripts = sorted(set.intersection(*letters)) if letters else []
            if len(scripts) > 1:
                found = tuple((s, r[1], r[0]) for s in scripts if (r := self.search(shape, s)))
            else:
                score, path = self.search(shape)
                found = ((_last_script(path), path, score),)
            if len(self.shapes) >= _MEMO:
                self.shapes.clear()
            self.shapes[shape] = found
        return found

    def read(self, tokens: list[str]) -> list[str]:
        """The readings of the tokens of one text; one of several scripts goes with the script of the token before."""
        out = list(map(self.single.get, tokens))
        at = -1
        while True:
            try:
                at = out.index(None, at + 1)
            except ValueError:
                return out
            token = tokens[at]
            found = self.several.get(token) or self._readings(token)
            if len(found) == 1:
                if len(self.single) >= _MEMO:
                    self.single.clear()
                self.single[token] = out[at] = found[0][1]
                continue
            if len(self.several) >= _MEMO:
                self.several.clear()
            self.several[token] = found
            before = _last_script(out[at - 1]) if at else ""
            best = None
            for script, reading, score in found:
                score += STAY if script == before else 0.0
                if best is None or score > best:
                    best, out[at] = score, reading

    def form(self, text: str) -> str:
        text = plain(text)
        tokens = _TOKEN.findall(text)
        read = self.read(tokens)
        if read != tokens:
            # what stands between two tokens, and the tokens at odd places
            cut = _CUT.split(text)
            cut[1::2] = read
            text = "".join(cut)
        return text if text.isascii() else unicodedata.normalize("NFC", text)


def train(df: DataFrame, text: str) -> dict[str, int]:
    """Bigram counts of all texts. At most ``(LETTERS + 2) ** 2`` of them exist, so the table is small whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter = Counter()
        pairs: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    tokens.update(_TOKEN.findall(plain(t)))
                    if len(tokens) > _MEMO:
                        pairs += count_bigrams(tokens)
                        tokens.clear()
        pairs += count_bigrams(tokens)
        yield pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.string()), pa.array(list(pairs.values()), pa.int64())], names=["pair", "n"])

    rows = df.select(text).mapInArrow(count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r["pair"]: r["n"] for r in rows.collect()}


def recovery(df: DataFrame, doc_id: str, text: str, parts: int = 10) -> DataFrame:
    """How well the search finds the spelling of words that it was not trained on: ``script, n_tokens, n_ambiguous, n_found``.

    Bigrams are counted in the texts of all parts but one (by ``doc_id``), and
    the tokens of one script in the last part are read by their shapes and
    those of the words before them.  Tokens are counted as often as they occur; the ambiguous ones have
    a letter that another script has, too.
    """
    own = F.pmod(F.xxhash64(doc_id), F.lit(parts)) == 0
    counts = df.sparkSession.sparkContext.broadcast(train(df.where(~own), text))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, out = Model(counts.value), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                tokens = _TOKEN.findall(plain(t)) if t else []
                for token, read in zip(tokens, model.read(tokens)):
                    scripts = {_script(c) for c in token} - {""}
                    if len(scripts) == 1:
                        script = scripts.pop()
                        out[script, "n_tokens"] += 1
                        if any(c in _OPTIONS for c in token):
                            out[script, "n_ambiguous"] += 1
                            out[script, "n_found"] += read == token
        rows = [(s, *(out[s, k] for k in ("n_tokens", "n_ambiguous", "n_found"))) for s in {s for s, _ in out}]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["script", "n_tokens", "n_ambiguous", "n_found"])

    found = df.where(own).select(text).mapInArrow(search, "script string, n_tokens bigint, n_ambiguous bigint, n_found bigint")
    return found.groupBy("script").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_ambiguous", "n_found")])


def consistent_forms(df: DataFrame, doc_id: str, text: str, digests_only: bool = False) -> DataFrame:
    """``doc_id, form`` of every row, or ``doc_id, form_key, text_key`` (128-bit digests of the form and the text, null for a null or empty text).

    Defined cases: a null text has a null form, an empty one an empty form;
    a text of only ignorable characters has an empty form; equal rows get
    equal forms each.
    """
    counts = train(df, text)
    counts = df.sparkSession.sparkContext.broadcast(counts)
    id_type = df.schema[doc_id].dataType.simpleString()

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(counts.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            made = [None if t is None else model.form(t) for t in texts]
            if digests_only:
                key = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                cols = [pa.array([key(f) if t else None for f, t in zip(made, texts)], pa.binary()), pa.array([key(t) if t else None for t in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "form_key", "text_key"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=["doc_id", "form"])

    out = f"doc_id {id_type}, " + ("form_key binary, text_key binary" if digests_only else "form string")
    return df.select(doc_id, text).mapInArrow(forms, out)


def look_classes(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, form_key, text_key)`` -> classes of documents that look the same, and who is in them.

    Classes: ``class_id`` (least document of the form), ``n_texts`` (different
    texts), ``n_docs``.  Members: ``doc_id, class_id, text_id`` (least document
    of the same text).  Only forms of several texts make a class.  Every table
    has at most a row per document, however many copies there are; a form of
    very many copies is combined before it is shuffled and not gathered.
    """
    docs = forms.where("form_key is not null")
    texts = docs.groupBy("form_key", "text_key").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("n"))
    classes = texts.groupBy("form_key").agg(F.min("text_id").alias("class_id"), F.count("*").alias("n_texts"), F.sum("n").alias("n_docs")).where("n_texts > 1")
    named = texts.join(classes.select("form_key", "class_id"), "form_key").select("form_key", "text_key", "class_id", "text_id")
    return classes.drop("form_key"), docs.join(named, ["form_key", "text_key"]).select("doc_id", "class_id", "text_id")


def same_looking_pairs(forms: DataFrame) -> DataFrame:
    """``(doc_id, form_key, text_key)`` -> pairs of documents of one form and different texts, ``doc_id_a < doc_id_b``.

    Texts of one form are first told apart as classes; only classes of one
    form are paired, so copies of a text are never compared with each other
    and the work follows the number of pairs that come out.  Where copies are
    many, ``look_classes`` tells the same in a row per document.
    """
    docs = forms.where("form_key is not null")
    classes = docs.groupBy("form_key", "text_key").agg(F.count("*").alias("n"))
    mixed = classes.groupBy("form_key").agg(F.count("*").alias("k")).where("k > 1").select("form_key")
    classes = classes.join(mixed, "form_key", "left_semi").select("form_key", "text_key")
    pairs = classes.withColumnRenamed("text_key", "ta").join(classes.withColumnRenamed("text_key", "tb"), "form_key").where("ta < tb")
    members = docs.select(F.col("doc_id"), F.col("form_key").alias("f"), F.col("text_key").alias("t"))
    a = members.select(F.col("doc_id").alias("x"), F.col("f").alias("fx"), F.col("t").alias("tx"))
    b = members.select(F.col("doc_id").alias("y"), F.col("f").alias("fy"), F.col("t").alias("ty"))
    rows = pairs.join(a, (F.col("form_key") == F.col("fx")) & (F.col("ta") == F.col("tx"))).join(b, (F.col("form_key") == F.col("fy")) & (F.col("tb") == F.col("ty")))
    found = rows.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    return found.where("doc_id_a < doc_id_b").distinct()
