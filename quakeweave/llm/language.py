"""Language of texts and of the lines of mixed texts, by language-bitmask n-gram filters.

All languages share one bit-sliced Bloom filter: each slot holds a bit per language, and
the AND over an n-gram's slots gives all languages containing it at once. The number of
n-grams found per language, corrected for false positives, decides. The filter is fitted
on labelled texts of the corpus, whose labels may be partly wrong: after a first fit the
lines are labelled anew by the filter itself and it is fitted once more.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ISO 639-1 codes with the other codes and the English name of the language.
LANGUAGES = {
    "ar": ("ara", "arabic"),
    "bg": ("bul", "bulgarian"),
    "ca": ("cat", "catalan"),
    "cs": ("ces", "cze", "czech"),
    "da": ("dan", "danish"),
    "de": ("deu", "ger", "german", "deutsch"),
    "el": ("ell", "gre", "greek"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish", "castilian", "español"),
    "et": ("est", "estonian"),
    "fa": ("fas", "per", "persian"),
    "fi": ("fin", "finnish"),
    "fr": ("fra", "fre", "french", "français"),
    "he": ("heb", "hebrew"),
    "hi": ("hin", "hindi"),
    "hr": ("hrv", "croatian"),
    "hu": ("hun", "hungarian"),
    "id": ("ind", "indonesian"),
    "it": ("ita", "italian", "italiano"),
    "ja": ("jpn", "japanese"),
    "ko": ("kor", "korean"),
    "lt": ("lit", "lithuanian"),
    "lv": ("lav", "latvian"),
    "nl": ("nld", "dut", "dutch", "nederlands"),
    "no": ("nor", "nb", "nob", "nn", "nno", "norwegian"),
    "pl": ("pol", "polish"),
    "pt": ("por", "portuguese", "português"),
    "ro": ("ron", "rum", "romanian"),
    "ru": ("rus", "russian"),
    "sk": ("slk", "slo", "slovak"),
    "sl": ("slv", "slovenian"),
    "sr": ("srp", "serbian"),
    "sv": ("swe", "swedish"),
    "th": ("tha", "thai"),
    "tr": ("tur", "turkish"),
    "uk": ("ukr", "ukrainian"),
    "vi": ("vie", "vietnamese"),
    "zh": ("zho", "chi", "chinese"),
}


def language_code(label: Column) -> Column:
    """ISO 639-1 code of a language label in any usual spelling; NULL if it names none.

    ``EN``, ``en-US``, ``eng`` and ``English`` are all ``en``.
    """
    known = {code: code for code in LANGUAGES} | {other: code for code, others in LANGUAGES.items() for other in others}
    base = F.regexp_extract(F.lower(F.btrim(label, F.lit(" \t\r\n "))), r"^([\p{L}]+)(?:[-_. (].*)?$", 1)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.try_element_at(table, base)


ORDERS = (3, 5)
# Characters that make a chunk of ASCII code rather than words, wherever they stand in it.
_CODE = "0123456789_/\\{}<>=|@#$"
_BREAK = 10


def _mended(text: str) -> str:
    """Undo UTF-8 that was read as Windows-1252 or Latin-1, where that is possible throughout a line."""
    out = []
    for line in text.split("\n"):
        for wrong in ("cp1252", "latin-1"):
            try:
                line = line.encode(wrong).decode("utf-8")
                break
            except UnicodeError:
                pass
        out.append(line)
    return "\n".join(out)


_SUSPECT = regex.compile(r"[ÂÃÐÑãâæçåìí][\u0080-¿ŒœŠšŸŽžƒˆ˜–-™]")


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point whether it is a letter, and whether it is a mark that combines with the one before."""
    every = [unicodedata.category(chr(c)) for c in range(0x110000)]
    return np.array([k[0] == "L" for k in every]), np.array([unicodedata.combining(chr(c)) > 0 for c in range(0x110000)])


def plain(texts: list[str | None]) -> np.ndarray:
    """All texts as code points: lower case, without accents, only letters, single spaces and line breaks; each ends with 0.

    Chunks of ASCII with digits, slashes and the like, or with quotes or colons between
    letters, are code and become a space.
    """
    parts = []
    for t in texts:
        t = (t or "").replace("\x00", " ")
        if not t.isascii() and _SUSPECT.search(t):
            t = _mended(t)
        parts.append(t)
    s = ("\x00".join(parts) + "\x00").lower()
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s)
    letter, mark = _letters()
    c = np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)
    if not s.isascii():
        c = c[~mark[c]]
    solid = (c > 32) & (c < 127)
    run = np.cumsum(np.r_[True, solid[1:] != solid[:-1]]) - 1
    code = np.isin(c, np.frombuffer(_CODE.encode("utf-32-le"), np.uint32))
    word = ((c >= 97) & (c <= 122)) | (c == 34)
    code[1:-1] |= ((c[1:-1] == 34) | (c[1:-1] == 58)) & word[:-2] & word[2:]
    dropped = np.zeros(run[-1] + 1, bool)
    dropped[run[code & solid]] = True
    end = (c == _BREAK) | (c == 0)
    kept = end | (letter[c] & ~(solid & dropped[run]))
    # Of what goes, the first character of each stretch becomes the space.
    first = ~kept & np.r_[True, kept[:-1]]
    out = np.where(kept, c, np.uint32(32))
    return out[kept | first]


@dataclass
class Lines:
    """Lines of a batch: ``text`` and ``number`` (from 1, blank lines not counted, 0 for those), and the code points with their line."""

    text: np.ndarray
    number: np.ndarray
    chars: np.ndarray
    line: np.ndarray


def split_lines(texts: list[str | None]) -> Lines:
    chars = plain(texts)
    ends = (chars == _BREAK) | (chars == 0)
    line = np.r_[0, np.cumsum(ends)[:-1]]
    stops = np.flatnonzero(ends)
    text = np.r_[0, np.cumsum(chars[stops] == 0)[:-1]]
    # Blank lines are told from the text itself: here also lines of digits have become blank.
    filled = [[bool(x.strip(" \t\r")) for x in (t or "").split("\n")] for t in texts]
    flat = np.array([f for t in filled for f in t], bool)
    count = np.cumsum(flat)
    start = np.r_[0, np.cumsum([len(t) for t in filled])[:-1]].astype(np.int64)
    before = np.r_[0, count][start]
    number = np.where(flat, count - np.repeat(before, [len(t) for t in filled]), 0)
    return Lines(text, number, chars, line)


def ngrams(chars: np.ndarray, line: np.ndarray, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams and their lines. A line's ends count as a space; blanks alone are no n-gram."""
    end = (chars == _BREAK) | (chars == 0)
    c = np.where(end, np.uint32(32), chars).astype(np.uint64)
    inner = np.r_[0, np.cumsum(end)]
    space = np.r_[0, np.cumsum(c == 32)]
    keys, lines = [], []
    for n in orders:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(n):
            h = (h ^ c[k : k + m]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        ok = inner[n - 1 : n - 1 + m] - inner[1 : 1 + m] == 0
        ok &= space[n : n + m] - space[:m] < n - 1
        keys.append(h[ok])
        lines.append(line[1 : 1 + m][ok])
    return (np.concatenate(keys), np.concatenate(lines)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _bit(mask: np.ndarray, language: int) -> np.ndarray:
    return (mask >> mask.dtype.type(language % 64)) & mask.dtype.type(1) != 0


def _dense(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of a narrow array and their places, without sorting it."""
    there = np.zeros(1 << (8 * mask.dtype.itemsize), bool)
    there[mask] = True
    uniq = np.flatnonzero(there).astype(mask.dtype)
    place = np.cumsum(there) - 1
    return uniq, place[mask]


class Filters:
    """Bit-sliced Bloom filters of all languages, however many."""

    def __init__(self, languages: list[str], slots: int, hashes: int = 3):
        self.languages, self.hashes = languages, hashes
        self.bits = max(10, int(np.ceil(np.log2(max(2, slots)))))
        # One array of masks for each 64 languages; those of up to 64 are as narrow as they can be.
        groups = [languages[k : k + 64] for k in range(0, len(languages), 64)]
        kinds = [next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= len(g)) for g in groups]
        self.masks = [np.zeros(1 << self.bits, kind) for kind in kinds]
        self.false_rate = np.zeros(len(languages))

    def _slots(self, keys: np.ndarray, k: int) -> np.ndarray:
        h = (keys + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ (h >> np.uint64(32))) >> np.uint64(64 - self.bits - 8) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def add(self, keys: np.ndarray, language: int) -> None:
        mask = self.masks[language // 64]
        for k in range(self.hashes):
            mask[self._slots(keys, k)] |= mask.dtype.type(1 << language % 64)

    def close(self) -> Filters:
        for k in range(len(self.languages)):
            self.false_rate[k] = float(_bit(self.masks[k // 64], k).mean()) ** self.hashes
        return self

    def languages_of(self, keys: np.ndarray) -> list[np.ndarray]:
        """Bitmasks of the languages containing each n-gram."""
        slots = self._slots(keys, 0)
        out = [mask[slots] for mask in self.masks]
        for k in range(1, self.hashes):
            slots = self._slots(keys, k)
            for found, mask in zip(out, self.masks):
                found &= mask[slots]
        return out

    @staticmethod
    def _by_mask(line: np.ndarray, mask: np.ndarray, lines: int, languages: int, room: int = 20_000_000) -> np.ndarray:
        """n-grams per line and language: counted per line and different mask, then added up over the masks with a language's bit."""
        uniq, dense = np.unique(mask, return_inverse=True) if mask.dtype.itemsize > 2 else _dense(mask)
        bits = ((uniq[:, None] >> np.arange(languages, dtype=uniq.dtype)) & uniq.dtype.type(1)).astype(float)
        out = np.zeros((lines, languages))
        # As many lines at a time as there is room for.
        step = max(1, room // max(1, len(uniq)))
        if lines > step:
            order = np.argsort(line, kind="stable")
            line, dense = line[order], dense[order]
        for a in range(0, lines, step):
            i, j = np.searchsorted(line, [a, a + step]) if lines > step else (0, len(line))
            n = min(step, lines - a)
            out[a : a + n] = np.bincount((line[i:j] - a) * len(uniq) + dense[i:j], minlength=n * len(uniq)).reshape(n, -1) @ bits
        return out

    def scores(self, keys: np.ndarray, line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
        """n-grams per line, and those found per language, less the false ones expected.

        Each n-gram counts as often as it occurs; one that all of several languages share
        tells nothing and is left out.
        """
        masks = self.languages_of(keys)
        every = len(self.languages)
        tells = np.full(len(keys), every == 1)
        for g, mask in enumerate(masks):
            tells |= mask != mask.dtype.type((1 << min(64, every - 64 * g)) - 1)
        total = np.bincount(line[tells], minlength=lines)
        hits = np.empty((lines, every))
        for g, mask in enumerate(masks):
            # Most n-grams that no language has are left behind before the languages are gone through.
            own = np.flatnonzero(tells & (mask != 0))
            of, mask = line[own], mask[own]
            langs = np.arange(64 * g, min(every, 64 * g + 64))
            got = self._by_mask(of, mask, lines, len(langs))
            p = self.false_rate[langs]
            hits[:, langs] = np.maximum(0, got - total[:, None] * p) / (1 - p)
        return total, hits


@dataclass(frozen=True)
class Rules:
    """What makes a line sure of its language.

    At least ``least`` n-grams that tell languages apart (a word of seven letters), of which
    the language has a share of ``cover``, and ``margin`` more than the second. A text is mixed
    if a sure line is in another language than most of the text. A line that isn't sure has
    a language all the same: its own n-grams decide, with as many as ``prior`` more shared
    out by what the text's other lines and above all the lines around it are in.
    """

    least: int = 12
    cover: float = 0.5
    margin: float = 0.12
    prior: float = 3.0


def _best(every: np.ndarray, hits: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language of most n-grams, its lead over the second as a share of all, and whether that is sure."""
    best = hits.argmax(1)
    top = np.sort(np.c_[np.zeros(len(hits)), hits], axis=1)
    every1 = np.maximum(every, 1)
    lead = (top[:, -1] - top[:, -2]) / every1
    return best, lead, (top[:, -1] >= rules.least) & (top[:, -1] >= rules.cover * every1) & (lead >= rules.margin)


def fit(texts: list[str], labels: list[str], *, rare: int = 3, share: float = 0.1, rules: Rules = Rules()) -> Filters:
    """Filters from labelled texts, some of whose labels may be wrong.

    A language contains an n-gram if at least ``rare`` of its units do (1 in the second
    round) and their share among its units is at least ``share`` of the greatest share that
    any language has. Units are texts at first, then lines with the language found for them.
    """
    languages = sorted(set(labels))
    if not languages:
        return Filters(["und"], 2).close()
    parts = split_lines(texts)
    keys, line = ngrams(parts.chars, parts.line)
    code = np.array([languages.index(x) for x in labels])
    unit, group = parts.text[line], code
    kept = languages
    for round_ in range(3):
        made = _filters(keys, unit, group, kept, rare if round_ == 0 else 1, share)
        if round_ == 2:
            break
        total, hits = made.scores(keys, line, len(parts.text))
        best, _, sure = _best(total, hits, rules)
        # Languages that no text turns out to be in go.
        found = np.unique(best[sure])
        if not len(found):
            break
        names = [kept[k] for k in found]
        group = np.where(sure, np.searchsorted(found, best), -1)
        kept, unit = names, line
    return made


def _filters(keys: np.ndarray, unit: np.ndarray, group: np.ndarray, languages: list[str], rare: int, share: float) -> Filters:
    own = group[unit] >= 0
    keys, unit = keys[own], unit[own]
    # Each n-gram once per unit.
    order = np.lexsort((unit, keys))
    keys, unit = keys[order], unit[order]
    once = np.r_[True, (keys[1:] != keys[:-1]) | (unit[1:] != unit[:-1])] if len(keys) else np.zeros(0, bool)
    keys, lang = keys[once], group[unit[once]]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    gram = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
    units = np.bincount(group[group >= 0], minlength=len(languages))
    counts = np.bincount(gram * len(languages) + lang, minlength=len(first) * len(languages)).reshape(len(first), -1) if len(first) else np.zeros((0, len(languages)), int)
    rate = counts / np.maximum(units, 1)
    has = (counts >= rare) & (rate >= share * rate.max(1, keepdims=True)) if len(first) else counts > 0
    out = Filters(languages, int(8 * has.sum() + 1))
    for k in range(len(languages)):
        out.add(keys[first][has[:, k]], k)
    return out.close()


#: Labelled texts per language on which the filter is fitted, and the longest of them in characters.
FIT_TEXTS, FIT_CHARS = 300, 4_000


def fit_sample(df: DataFrame, key: str, text: str, label: str, *, texts: int = FIT_TEXTS, chars: int = FIT_CHARS) -> DataFrame:
    """At most ``texts`` whole texts of up to ``chars`` characters per labelled language, picked by hash.

    The bound of what is collected for fitting is ``texts * chars`` characters a language.
    """
    lang = language_code(F.col(label))
    base = df.select(F.col(key).alias("k"), F.col(text).alias("t"), lang.alias("l"))
    base = base.where(F.col("l").isNotNull() & F.col("t").isNotNull() & F.length("t").between(20, chars))
    pick = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k")
    chosen = base.select("k", "l").withColumn("rank", F.row_number().over(pick)).where(F.col("rank") <= texts)
    return base.join(F.broadcast(chosen.select("k")), "k", "left_semi").select("k", "t", "l")


def fit_filters(df: DataFrame, key: str, text: str, label: str, *, texts: int = FIT_TEXTS, chars: int = FIT_CHARS) -> Filters:
    rows = sorted(fit_sample(df, key, text, label, texts=texts, chars=chars).collect(), key=lambda r: str(r["k"]))
    return fit([r["t"] for r in rows], [r["l"] for r in rows])


def identify(texts: list[str | None], filters: Filters, rules: Rules = Rules()) -> tuple[list, ...]:
    """Rows (text, line, language, confidence, mixed): line 0 for a text in one language, else one for each line with words.

    Every text with words has rows. Confidence is the lead over the second language as a
    share of the n-grams, less for lines and texts of fewer than ``least`` n-grams; a text
    none of whose n-grams is known has the language ``und`` and confidence 0.
    """
    parts = split_lines(texts)
    keys, line = ngrams(parts.chars, parts.line)
    lines, n = len(parts.text), len(texts)
    worded = np.bincount(line, minlength=lines) > 0
    total, hits = filters.scores(keys, line, lines)
    best, lead, sure = _best(total, hits, rules)
    # The text as a whole goes by its sure lines; without any, by all of them together.
    any_sure = np.bincount(parts.text[sure], minlength=n) > 0
    counted = sure | ~any_sure[parts.text]
    whole = np.zeros((n, hits.shape[1]))
    whole_total = np.bincount(parts.text[counted], weights=total[counted], minlength=n)
    for k in range(hits.shape[1]):
        whole[:, k] = np.bincount(parts.text[counted], weights=hits[counted, k], minlength=n)
    text_best, text_lead, _ = _best(whole_total, whole, rules)
    other = sure & (best != text_best[parts.text])
    mixed = np.bincount(parts.text[other], minlength=n) > 0
    names = [*filters.languages, "und"]
    out: list[tuple[int, int, str, float, bool]] = []
    known = whole.max(1) > 0
    for t in np.flatnonzero((np.bincount(parts.text[worded], minlength=n) > 0) & ~mixed):
        some = min(1.0, float(whole[t].max()) / rules.least)
        out.append((int(t), 0, names[text_best[t] if known[t] else -1], float(text_lead[t]) * some if known[t] else 0.0, False))
    of_mixed = np.flatnonzero(mixed[parts.text] & (parts.number > 0) & worded)
    for k in of_mixed[sure[of_mixed]]:
        out.append((int(parts.text[k]), int(parts.number[k]), names[best[k]], float(lead[k]), True))
    unsure = of_mixed[~sure[of_mixed]]
    if len(unsure):
        # Half of the prior is shared by the text's sure lines, half by the nearest sure line before and the one after.
        prior = whole[parts.text[unsure]]
        prior = prior / np.maximum(prior.sum(1, keepdims=True), 1e-9)
        at = np.flatnonzero(sure)
        for side in (-1, 0):
            near = np.clip(np.searchsorted(at, unsure) + side, 0, len(at) - 1)
            same = parts.text[at[near]] == parts.text[unsure]
            prior[same, best[at[near[same]]]] += 0.5
        some = hits[unsure] + rules.prior * prior / np.maximum(prior.sum(1, keepdims=True), 1e-9)
        best2, lead2, _ = _best(total[unsure] + rules.prior, some, rules)
        lead2 = lead2 * np.minimum(1, hits[unsure].max(1) / rules.least)
        for k, b, c in zip(unsure, best2, lead2):
            out.append((int(parts.text[k]), int(parts.number[k]), names[b], float(c), True))
    out.sort()
    return tuple(zip(*out)) if out else ((), (), (), (), ())


def identify_languages(df: DataFrame, key: str, text: str, filters: Filters, *, rules: Rules = Rules(), batch_chars: int = 1_000_000) -> DataFrame:
    """``key``, ``line_no``, ``language``, ``confidence`` and ``mixed``.

    A text in one language has one row with line_no 0; a mixed text one for each of its
    lines with words, however short. Confidence is the lead over the second language as a
    share of the n-grams (0 to 1). Texts are taken whole, in the tasks that read them; nothing
    is shuffled.

    Defined results: NULL and empty texts and texts without words have no row; texts with
    words of which no n-gram is known are ``und`` with confidence 0; repeated keys give rows each; other columns are ignored; an empty table gives
    no rows. Lines end with a line feed; those of blanks, tabs and carriage returns only
    are not counted.
    """
    shared = df.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            start = size = 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size >= batch_chars or k == len(texts) - 1:
                    at, number, lang, sure, mixed = identify(texts[start : k + 1], shared.value, rules)
                    keys = b.column(0).slice(start, k + 1 - start).take(pa.array(at, pa.int64()))
                    cols = [pa.array(number, pa.int32()), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(mixed, pa.bool_())]
                    yield pa.RecordBatch.from_arrays([keys, *cols], names=[key, "line_no", "language", "confidence", "mixed"])
                    start, size = k + 1, 0

    base = df.select(F.col(key), F.col(text).cast("string").alias("__text"))
    kind = base.schema[0].dataType.simpleString()
    return base.mapInArrow(run, f"`{key}` {kind}, line_no int, language string, confidence double, mixed boolean")
