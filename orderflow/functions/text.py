"""Column functions on French text: normal forms, slots, codes, name variants, controlled noise."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.scripts import has_other_script, in_latin

_LETTERS = [chr(c) for c in range(0xC0, 0x250)]


def _base(letter: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn")


#: Accented letters whose base is one letter, and the bases.
_ACCENTED = "".join(c for c in _LETTERS if _base(c) != c and len(_base(c)) == 1)
_BASES = "".join(_base(c) for c in _ACCENTED)
#: Lower-case letters and signs without a canonical base, in ASCII: those of one letter, and the others.
_SIGNS, _PLAIN = "øđłıð’‘–—", "odlid''--"
_LONGER = {"œ": "oe", "æ": "ae", "ß": "ss", "þ": "th", "°": "deg", "€": "eur"}

# Fixed values.
POLITE = r"aujourd|demain|ce\s+soir|svp|s'il\s+te\s+plait|s'il\s+vous\s+plait|merci"
ENDS = " ,;:.!?"
KEPT_FRENCH = "a-z0-9àâçéèêëîïôùûüÿñæœ"


def strip_accents(s: Column) -> Column:
    """Letters without their accents; ligatures stay."""
    return F.regexp_replace(F.translate(s, _ACCENTED, _BASES), r"\p{Mn}", "")


def stripped(s: Column) -> Column:
    """A text without the blanks of any kind at its ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def _squeezed(s: Column) -> Column:
    return F.btrim(F.regexp_replace(s, r"\s+", " "))


def _in_ascii(low: Column) -> Column:
    """Lower-case Latin letters in ASCII."""
    out = F.regexp_replace(F.translate(low, _ACCENTED + _SIGNS, _BASES + _PLAIN), r"\p{Mn}", "")
    for sign, plain in _LONGER.items():
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return out


def norm_ascii(s: Column) -> Column:
    """Lower-case ASCII letters, digits, hyphens and apostrophes, single blanks.

    Latin letters and those of the scripts of ``functions.scripts`` are transliterated; further scripts become blanks.
    """
    low = F.lower(s)
    low = F.when(has_other_script(low), in_latin(low)).otherwise(low)
    low = F.when(low.rlike(r"[^\x00-\x7F]"), _in_ascii(low)).otherwise(low)
    return F.btrim(F.regexp_replace(low, r"[^a-z0-9\-']+", " "))


def norm_french(s: Column) -> Column:
    """Lower-case letters with their French accents, digits and hyphens, single blanks; apostrophes become blanks."""
    low = F.translate(F.btrim(F.lower(s)), "’'", "  ")
    return _squeezed(F.regexp_replace(low, rf"[^{KEPT_FRENCH}\s\-]", " "))


def clean_slot(s: Column) -> Column:
    """A slot up to the first polite or time word, without blanks and punctuation at its ends."""
    head = F.split(s, rf"(?iUd)\b(?:{POLITE})\b", 2)[0]
    return F.btrim(F.btrim(head, F.lit(ENDS)))


def codes_in(field: Column) -> Column:
    """The 8-digit codes of a list field, in order, repeats kept."""
    return F.filter(F.split(field, r"[;,\s]+"), lambda x: x.rlike(r"^\d{8}$"))


def code_in_id(stop_id: Column) -> Column:
    """The first run of eight digits in an id, or null."""
    return F.nullif(F.regexp_extract(stop_id, r"(\d{8})", 1), F.lit(""))


def coordinates(pair: Column) -> Column:
    """``lat, lon`` as a struct; both null unless there are two numbers."""
    parts = F.split(pair, ",")
    lat, lon = (F.btrim(F.get(parts, F.lit(i))).try_cast("double") for i in (0, 1))
    both = (F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull()
    return F.struct(F.when(both, lat).alias("latitude"), F.when(both, lon).alias("longitude"))


def name_variants(name: Column) -> Column:
    """A name as written, with straight apostrophes, with blanks for hyphens, and with hyphens for blanks."""
    trimmed = stripped(name)
    straight = F.replace(trimmed, F.lit("’"), F.lit("'"))
    blanks = r"(?U)\s+"
    spaced = stripped(F.regexp_replace(F.replace(straight, F.lit("-"), F.lit(" ")), blanks, " "))
    forms = F.array(trimmed, straight, spaced, F.regexp_replace(straight, blanks, "-"))
    return F.filter(F.array_distinct(forms), lambda x: x != "")


_BLOCK = 256


def bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is named: in a lambda it would be computed for each element."""
    return F.transform(F.array(value), use)[0]


def running_total(numbers: Column) -> Column:
    """For each number of an array the sum up to it. Sums of blocks first, so that time grows little more than the array."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    upto = lambda a, n: total(F.slice(a, F.lit(1), n))
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / _BLOCK).cast("int")), lambda b: total(F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK))))
    starts = lambda bs: F.transform(bs, lambda x, b: upto(bs, b))
    each = lambda a, before: F.transform(a, lambda x, i: F.get(before, F.floor(i / _BLOCK).cast("int")) + total(F.slice(a, i - i % _BLOCK + 1, i % _BLOCK + 1)))
    return bound(numbers, lambda a: bound(blocks(a), lambda bs: bound(starts(bs), lambda before: each(a, before))))


def uniform(key: Column, salt: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key, the salt and the seed only, not on partitions or order: the first 32 bits
    of the MD5 of ``key|salt|seed``."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(salt), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def one_of(options: list[str], u: Column) -> Column:
    """The option that a number in [0, 1) falls on."""
    return F.get(F.array(*map(F.lit, options)), F.floor(u * len(options)).cast("int"))


def _place(u: Column, size: Column, inner: int) -> Column:
    """A 1-based place in a word that leaves out the first letter, and ``inner - 1`` at the end."""
    return (F.floor(u * F.greatest(size - inner, F.lit(1))) + 2).cast("int")


def _swapped(s: Column, i: Column) -> Column:
    return F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, 1), F.substring(s, i, 1), F.substring(s, i + 2, F.length(s)))


def _dropped(s: Column, i: Column) -> Column:
    return F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, F.length(s)))


def mild_typo(name: Column, key: Column, seed: int = 0) -> Column:
    """One letter dropped or two neighbours swapped, in ASCII; names of under four letters only lose accents."""
    s = strip_accents(name)
    n, u = F.length(s), uniform(key, "typo place", seed)
    drop = uniform(key, "typo kind", seed) < 0.5
    edited = F.when(drop, _dropped(s, _place(u, n, 2))).otherwise(_swapped(s, _place(u, n, 3)))
    return F.when(n < 4, s).otherwise(edited)


def controlled_typo(name: Column, key: Column, seed: int = 0) -> Column:
    """In 35 % of draws one letter is swapped, dropped, doubled or replaced by a vowel; names of under four letters stay."""
    n, i = F.length(name), _place(uniform(key, "slip place", seed), F.length(name), 2)
    kind, head, tail = uniform(key, "slip kind", seed), F.substring(name, 1, i - 1), F.substring(name, i + 1, n)
    edited = (
        F.when(kind < 0.25, _swapped(name, i))
        .when(kind < 0.5, _dropped(name, i))
        .when(kind < 0.75, F.concat(F.substring(name, 1, i), F.substring(name, i, n)))
        .otherwise(F.concat(head, one_of(list("aeiouy"), uniform(key, "slip vowel", seed)), tail))
    )
    return F.when((n < 4) | (uniform(key, "slip", seed) >= 0.35), name).otherwise(edited)


def _title(s: Column) -> Column:
    """Each run of letters with a capital first."""
    words = F.regexp_extract_all(s, F.lit(r"\p{L}+|\P{L}+"), 0)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def with_noise(rows: DataFrame, col: str, key: Column, seed: int = 0) -> DataFrame:
    """``rows`` with the sentences of a column disturbed in accents, case, apostrophes, blanks and end marks, each at its
    own rate. One projection per step, as each step names its input several times."""
    s, u = F.col(col), lambda salt: uniform(key, salt, seed)
    mixed = F.array_join(
        F.transform(F.split(s, ""), lambda c, i: F.when(uniform(F.concat(key.cast("string"), i.cast("string")), "mixed", seed) < 0.2, F.upper(c)).otherwise(F.lower(c))), ""
    )
    kind = u("case kind")
    blanks = lambda salt: F.repeat(F.lit(" "), F.floor(u(salt) * 3).cast("int"))
    steps = (
        ("accents", 0.25, strip_accents(s)),
        ("case", 0.30, F.when(kind < 0.25, F.lower(s)).when(kind < 0.5, F.upper(s)).when(kind < 0.75, _title(s)).otherwise(mixed)),
        ("apostrophes", 0.20, F.translate(s, "’'", "  ")),
        ("blanks", 0.20, F.concat(blanks("before"), _squeezed(s), blanks("after"))),
        ("end", 0.25, F.concat(s, one_of(["", ".", "!!", " ?", " ...", "!!!"], u("end kind")))),
    )
    for salt, rate, changed in steps:
        rows = rows.withColumn(col, F.when(u(salt) < rate, changed).otherwise(s))
    return rows
