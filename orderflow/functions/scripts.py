"""Other scripts in Latin letters: rules over letters, syllables and code point ranges, in array expressions.

A text is cut into units, the longest first (a kana with a small one behind it, else a single letter), and each unit is written by its rule.
Tables follow from the rows of the scripts: kana from consonants and vowels, Hangul by the arithmetic of its code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters in their alphabetical order, with their usual Latin spelling.
GREEK = "α a β b γ g δ d ε e ζ z η e θ th ι i κ k λ l μ m ν n ξ x ο o π p ρ r σ s ς s τ t υ u φ ph χ kh ψ ps ω o ά a έ e ή e ί i ό o ύ u ώ o ϊ i ϋ u ΐ i ΰ u"
CYRILLIC = (
    "а a б b в v г g д d е e ё io ж zh з z и i й i к k л l м m н n о o п p р r с s т t у u ф f х kh ц ts ч ch ш sh щ shch ъ ' ы y ь ' э e ю iu я ia"
    " є ie і i ї i ґ g ў u ђ dj ј j љ lj њ nj ћ c џ dz ѓ gj ќ kj ѕ dz"
)
GEORGIAN = "ა a ბ b გ g დ d ე e ვ v ზ z თ t ი i კ k ლ l მ m ნ n ო o პ p ჟ zh რ r ს s ტ t უ u ფ p ქ k ღ gh ყ q შ sh ჩ ch ც ts ძ dz წ ts ჭ ch ხ kh ჯ j ჰ h"
ARMENIAN = (
    "ա a բ b գ g դ d ե e զ z է e ը e թ t ժ zh ի i լ l խ kh ծ ts կ k հ h ձ dz ղ gh ճ ch մ m յ y ն n շ sh ո o չ ch պ p ջ j ռ r ս s վ v տ t ր r ց ts ւ w փ p ք k օ o ֆ f և ev"
)
#: Rows of kana: the consonant, and the signs for a, i, u, e and o (a dot where there is none).
KANA = "- あいうえお k かきくけこ s さしすせそ t たちつてと n なにぬねの h はひふへほ m まみむめも y や.ゆ.よ r らりるれろ w わゐ.ゑを g がぎぐげご z ざじずぜぞ d だぢづでど b ばびぶべぼ p ぱぴぷぺぽ"
KANA_ODD = "し shi ち chi つ tsu ふ fu じ ji ぢ ji づ zu を o ん n っ . ー ."
LEADS = "g kk n d tt r m b pp s ss . j jj ch k t p h".split()
VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
TAILS = ". k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split()

_ANY = "[Ͱ-ϿЀ-ԯԱ-֏Ⴀ-ჿ぀-ヿ가-힣！-～]"
_SMALL = "ゃゅょ"
_FIRST_HANGUL, _LAST_HANGUL = 0xAC00, 0xD7A3


def _pairs(row: str) -> dict[str, str]:
    words = row.split()
    return {k: v.replace(".", "") for k, v in zip(words[::2], words[1::2], strict=True)}


def _kana() -> dict[str, str]:
    """Hiragana by rows, with a small ``ya``, ``yu`` or ``yo`` behind those on i."""
    out = {}
    for consonant, signs in zip(KANA.split()[::2], KANA.split()[1::2], strict=True):
        out |= {sign: consonant.strip("-") + vowel for sign, vowel in zip(signs, "aiueo", strict=True) if sign != "."}
    out |= _pairs(KANA_ODD)
    for sign, said in list(out.items()):
        if said.endswith("i") and len(said) > 1:
            stem = said[:-1] if said in ("shi", "chi", "ji") else said[:-1] + "y"
            out |= {sign + small: stem + vowel for small, vowel in zip(_SMALL, "auo", strict=True)}
    return out


def rules() -> dict[str, str]:
    """All units with a spelling of their own."""
    out: dict[str, str] = {}
    for row in (GREEK, CYRILLIC, GEORGIAN, ARMENIAN):
        out |= _pairs(row)
    return out | _kana()


def has_other_script(text: Column) -> Column:
    return text.rlike(_ANY)


def in_latin(text: Column) -> Column:
    """A lower-case text with the letters of Greek, Cyrillic, Georgian, Armenian, kana, Hangul and full width in Latin ones; all else stays."""
    table = F.create_map(*(F.lit(x) for pair in rules().items() for x in pair))
    # katakana and full-width signs lie at a fixed distance from hiragana and ASCII
    shifts = (("".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097)))), ("".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))))
    for source, target in shifts:
        text = F.translate(text, source, target)
    units = F.regexp_extract_all(F.lower(text), F.lit(f"(?s).[{_SMALL}]|."), 0)
    part = lambda names, at: F.element_at(F.array(*(F.lit(n.replace(".", "")) for n in names)), at + 1)

    def unit(u: Column) -> Column:
        code = F.ascii(u) - _FIRST_HANGUL
        hangul = F.concat(part(LEADS, F.floor(code / 588).cast("int")), part(VOWELS, F.floor(code % 588 / 28).cast("int")), part(TAILS, (code % 28).cast("int")))
        letter = lambda at: F.coalesce(F.element_at(table, F.translate(F.substring(u, at, 1), _SMALL, "やゆよ")), F.substring(u, at, 1))
        alone = F.concat(letter(1), letter(2))
        return F.when(code.between(0, _LAST_HANGUL - _FIRST_HANGUL), hangul).otherwise(F.coalesce(F.element_at(table, u), alone))

    return F.array_join(F.transform(units, unit), "")
