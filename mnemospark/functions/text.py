"""Tokenising and other text functions.

Index and query share one tokenizer.  Whole columns go through ``term_rows``, an
Arrow map that turns each row's text into its (term, tf, length) rows where the
row already is: no shuffle, and each distinct raw word is analysed once a task.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.shipping import ship

#: English words that are no index terms.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from has have if in into is it its of on or that the their "
    "then there these they this to was were will with".split()
)
#: Letters that do not decompose into a base letter and marks.
FOLDED_LETTERS = {
    "đ": "d", "Đ": "d", "ø": "o", "Ø": "o", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe",
    "ß": "ss", "ł": "l", "Ł": "l", "ð": "d", "Ð": "d", "þ": "th", "Þ": "th",
}
_FOLD = str.maketrans(FOLDED_LETTERS)
#: Scripts written without spaces (kana, Han, compatibility Han, Hangul).
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7af]")
_LOWER_NUMBER, _UPPER = frozenset(("Ll", "Nd", "Nl", "No")), "Lu"
_HUMP = re.compile("(?<=[a-z0-9])(?=[A-Z])")  # within ASCII
MEMORY_LIMIT = 100_000


def fold(text: str) -> str:
    """Text without accents: hand-mapped letters, then decomposed and unmarked."""
    if text.isascii():
        return text
    if _LATIN and not _FAR.search(text):
        return text.translate(_LATIN)
    bare = unicodedata.normalize("NFD", text.translate(_FOLD))
    return unicodedata.normalize("NFC", "".join(c for c in bare if not unicodedata.category(c).startswith("M")))


#: Letters up to here decompose into one base letter and marks, and base letters never compose
#: again: such text folds letter by letter.
_FAR = re.compile("[\u0250-\U0010ffff]")
_LATIN: dict[int, str] = {}
_LATIN.update({c: fold(chr(c)) for c in range(0x80, 0x250)})


def stem(word: str) -> str:
    """Light suffix stripping for English words."""
    if word[-1:] not in "sgd":
        return word
    n = len(word)
    if n > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if n > 4 and word.endswith("sses"):
        return word[:-2]
    if n > 3 and word.endswith("s"):
        if word.endswith("ss"):
            return word
        if not word.endswith("us"):
            word = word[:-1]
    if len(word) > 5 and word.endswith("ing"):
        return word[:-3]
    return word[:-2] if len(word) > 4 and word.endswith("ed") else word


def split_identifier(word: str) -> list[str]:
    """Lower-case parts of a camelCase or snake_case identifier."""
    if word.isascii():
        if word[1:].islower() and "_" not in word:
            return [word.lower()]
        return _HUMP.sub(" ", word).replace("_", " ").lower().split()
    out = []
    for before, ch in zip(" " + word, word, strict=False):
        if unicodedata.category(ch) == _UPPER and unicodedata.category(before) in _LOWER_NUMBER:
            out.append(" ")
        out.append(" " if ch == "_" else ch)
    return "".join(out).lower().split()


def _raw_words(text: str) -> list[str]:
    if text.isascii():
        return re.findall(r"\w+", text)
    # \w also has marks and connectors; words are letters, numbers and underscores
    return [w for part in re.findall(r"\w+", text) for w in _letters_only(part)]


def _letters_only(word: str) -> list[str]:
    if not _FAR.search(word) or all(c == "_" or unicodedata.category(c)[0] in "LN" for c in word):
        return [word]
    return "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in word).split()


def terms_of_word(raw: str) -> list[str]:
    """Index terms of one raw word."""
    english = raw.isascii()
    if english and raw[1:].islower() and "_" not in raw:  # most words: one part, of two letters at least
        low = raw.lower()
        return [] if low in STOP_WORDS else [stem(low)]
    far = None if english else _FAR.search(raw)
    if not english and not far and raw[1:].islower() and "_" not in raw:  # the same of most words with accents
        bare = raw.translate(_LATIN)
        if bare.isascii() and bare[1:].islower():
            return [bare.lower(), raw.lower()]
    if far and _UNSPACED.search(raw):
        return [raw] if len(raw) == 1 else [raw[i : i + 2] for i in range(len(raw) - 1)]
    bare = raw if english else fold(raw)
    parts = split_identifier(bare)
    out = [bare.lower()] if len(parts) > 1 else []
    for part in parts:
        if len(part) > 1 and not (english and part in STOP_WORDS):
            out.append(stem(part) if english else part)
    if not english:
        marked = raw.lower()
        if len(marked) > 1 and marked != bare.lower():
            out.append(marked)
    return out


class Terms(dict):
    """raw word -> its terms, remembering recent words within a fixed bound."""

    def __missing__(self, raw: str) -> list[str]:
        if len(self) >= MEMORY_LIMIT:
            self.clear()
        found = self[raw] = terms_of_word(raw)
        return found


def _terms_of_part(part: str) -> list[str]:
    return [t for raw in _letters_only(part) for t in terms_of_word(raw)] if _FAR.search(part) else terms_of_word(part)


class PartTerms(Terms):
    r"""\w+ match -> the terms of all its words."""

    def __missing__(self, part: str) -> list[str]:
        if len(self) >= MEMORY_LIMIT:
            self.clear()
        found = self[part] = _terms_of_part(part)
        return found


def term_counts(text: str | None, known: PartTerms) -> tuple[dict[str, int], int]:
    """(term -> times, number of terms) of a text: as ``tokenize``, word by distinct word."""
    out: dict[str, int] = {}
    n = 0
    for part, times in Counter(re.findall(r"\w+", text or "")).items():
        found = known[part]
        n += times * len(found)
        for t in found:
            out[t] = out.get(t, 0) + times
    return out, n


_NO: tuple[int, tuple[int, ...]] = (0, ())
_ONE: tuple[int, tuple[int, ...]] = (1, ())


class NumberedTerms(dict):
    r"""\w+ match -> (how many terms it has, the numbers of those that are wanted)."""

    def __init__(self, wanted: dict[str, int]):
        self.wanted = wanted

    def __missing__(self, part: str) -> tuple[int, tuple[int, ...]]:
        if len(self) >= MEMORY_LIMIT:
            self.clear()
        found = self[part] = self.of(part)
        return found

    def of(self, part: str) -> tuple[int, tuple[int, ...]]:
        if part.isascii() and part[1:].islower() and "_" not in part:  # as in terms_of_word
            low = part.lower()
            number = None if low in STOP_WORDS else self.wanted.get(stem(low))
            return (_NO if low in STOP_WORDS else _ONE) if number is None else (1, (number,))
        terms = _terms_of_part(part)
        numbers = tuple(self.wanted[t] for t in terms if t in self.wanted)
        return (len(terms), numbers) if numbers or len(terms) != 1 else _ONE


#: Bytes of UTF-8 text: ASCII that ends a word becomes a space, all other bytes stay.
_BREAKS = bytes(c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in range(256))


class ChunkKinds(dict):
    """Bytes between two ASCII breaks -> the place in ``kinds`` of what they hold: (how many terms, the numbers
    of those that are wanted).  Most chunks share a kind, so a text is counted by kinds and not by words.

    Chunks are remembered for two generations; ``trim``, between two texts, keeps all within a fixed bound."""

    def __init__(self, wanted: dict[str, int]):
        self.wanted, self.of, self.old = wanted, NumberedTerms(wanted).of, {}
        self.forget()

    def forget(self) -> None:
        self.old, self.kinds, self.places = {}, [_NO, _ONE], {_NO: 0, _ONE: 1}
        self.clear()

    def __missing__(self, chunk: bytes) -> int:
        place = self.old.get(chunk)
        if place is None:
            word = chunk.decode()
            if word.isascii() and word[1:].islower() and "_" not in word:  # as in terms_of_word
                low = word.lower()
                number = self.wanted.get(stem(low) if low[-1] in "sgd" else low)
                place = 0 if low in STOP_WORDS else 1 if number is None else self.place((1, (number,)))
            elif word.isascii():
                place = self.place(self.of(word))
            else:  # other breaks may stand in it
                found = [self.of(part) for part in re.findall(r"\w+", word)]
                place = self.place(found[0] if len(found) == 1 else (sum(n for n, _ in found), tuple(t for _, ts in found for t in ts)))
        self[chunk] = place
        return place

    def place(self, kind: tuple[int, tuple[int, ...]]) -> int:
        place = self.places.get(kind)
        if place is None:
            place = self.places[kind] = len(self.kinds)
            self.kinds.append(kind)
        return place

    def trim(self) -> None:
        if len(self.kinds) > MEMORY_LIMIT:
            self.forget()
        elif len(self) > MEMORY_LIMIT:
            self.old = dict(self)
            self.clear()

    def counts(self, text: bytes | None) -> tuple[dict[int, int], int]:
        """(number of a wanted term -> times, number of terms) of a text."""
        self.trim()
        out: dict[int, int] = {}
        n = 0
        for place, times in Counter(map(self.__getitem__, (text or b"").translate(_BREAKS).split())).items():
            own, numbers = self.kinds[place]
            n += times * own
            for t in numbers:
                out[t] = out.get(t, 0) + times
        return out, n


def tokenize(text: str | None, known: Terms | None = None) -> list[str]:
    known = Terms() if known is None else known
    return [t for raw in _raw_words(text) for t in known[raw]] if text else []


def term_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, doc_len) of each row with a term; doc_len counts all its terms."""
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PartTerms()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                keys, terms, tfs, lengths = [], [], [], []
                for k, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts, length = term_counts(body, known)
                    keys += [k] * len(counts)
                    terms += counts
                    tfs += counts.values()
                    lengths += [length] * len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, part.schema.field(0).type), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(lengths, pa.int64())],
                    names=[key, "term", "tf", "doc_len"],
                )

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, term string, tf long, doc_len long")


def wanted_rows(df: DataFrame, key: str, text: str, wanted: dict[str, int]) -> DataFrame:
    """(key, doc_len, ts, tfs) of each row with a term: the numbers of the wanted terms that
    it has, and how often.  No other term leaves the task; doc_len counts them all."""
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkKinds(wanted)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                keys, lengths, ends, ts, tfs = [], [], [0], [], []
                for k, body in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    counts, n = known.counts(body)
                    if n:
                        keys.append(k)
                        lengths.append(n)
                        ts += counts
                        tfs += counts.values()
                        ends.append(len(ts))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, part.schema.field(0).type), pa.array(lengths, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(ts, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))],
                    names=[key, "doc_len", "ts", "tfs"],
                )

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, doc_len long, ts array<int>, tfs array<long>")


# ---------------------------------------------------------------- the same as columns


def stem_column(word: Column) -> Column:
    """``stem`` as built-in column functions."""
    n = F.length(word)
    single = F.when((n > 3) & word.endswith("s") & ~word.endswith("us"), F.left(word, n - 1)).otherwise(word)
    m = F.length(single)
    bare = (
        F.when((m > 5) & single.endswith("ing"), F.left(single, m - 3))
        .when((m > 4) & single.endswith("ed"), F.left(single, m - 2))
        .otherwise(single)
    )
    return (
        F.when((n > 4) & word.endswith("ies"), F.concat(F.left(word, n - 3), F.lit("y")))
        .when((n > 4) & word.endswith("sses"), F.left(word, n - 2))
        .when((n > 3) & word.endswith("ss"), word)
        .otherwise(bare)
    )


def split_column(word: Column) -> Column:
    """``split_identifier`` as built-in column functions."""
    spaced = F.regexp_replace(word, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    return F.filter(F.split(F.lower(F.replace(spaced, F.lit("_"), F.lit(" "))), r"\s+"), lambda p: p != "")


def snippet_column(body: Column, query: Column, width: int = 220) -> Column:
    """A window of the body around the first query word of more than two letters."""
    flat = F.regexp_replace(F.regexp_replace(body, r"(?U)\s+", " "), "^ | $", "")
    word = F.get(F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda w: F.length(w) > 2), F.lit(0))
    at = F.coalesce(F.instr(F.lower(flat), word), F.lit(0))
    start = F.greatest(F.lit(0), at - 1 - width // 3)
    cut = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), F.substring(flat, start + 1, F.lit(width)), F.lit("..."))
    return F.when(F.length(flat) <= width, flat).when(at < 1, F.concat(F.left(flat, F.lit(width)), F.lit("..."))).otherwise(cut)
