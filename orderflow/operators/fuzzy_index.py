"""Names that may be near enough to a slot, by an index over pairs of letters; scores are computed for these only.

The score is ``functions.fuzzy.weighted_ratio``, the least score ``LEAST`` or more. A string's grams are the pairs of neighbouring letters of
its words, each word with a blank before and behind it; equal ones are numbered, so what two strings have in common is counted with repeats.
Proven bounds, for lengths ``a`` and ``b`` and a common subsequence of ``c`` letters: leaving a letter out changes two
grams at most and putting one in changes one, so with the outer blanks ``3 c - (a + b) + 1`` grams are common at least, in any order of
words. From that:

* *Near lengths* (the longer under 1.5 times the other). A score of 85 needs a ratio of 85 in percent of the whole strings, or of about 89.5 of their sorted
  or different words, so at least ``LEAST_SHARE`` of the grams of either string are common. In an order by rarity the
  others of one, and one more, must meet the like of the other string.
* *Stretches* (1.5 to 8 times as long). A score of 85 needs a stretch of the longer at a ratio of 94.4, so all but about a fifth of the inner
  grams of the shorter are grams of the longer; or a stretch of one letter, which is the shorter string; or a common word.
* *Common words* of strings of such lengths give 85.5 at least, whatever else they have, so the first name of each length
  with the word stands for all; those with a better score are found as above.

Where all names are alike these meet a part of all pairs. So names that differ from a slot by one or two letters left out or put in are looked for
first (``closest``), by what is left when letters are left out of either; a name found so is the best one if its ratio is above all that others can have:
stretches give 90 at most, several words in any order 95, and a ratio falls with the number of letters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from orderflow.functions.fuzzy import LEAVE_ONE, weighted_ratio
from orderflow.sources.scratch import stored

LEAST = 85.0
#: Of the grams of either string, the least share that is common at near lengths.
LEAST_SHARE = 0.41
#: Lengths up to which strings are near, and up to which stretches count.
NEAR, FAR = 1.5, 8
#: Most that stretches and that several words in any order can score.
MOST_STRETCH, MOST_WORDS = 90.0, 95.0
#: Longest strings of which two letters are left out to find close names.
LEAVE_TWO = 32


def _numbered(grams: Column) -> Column:
    """Grams with how many equal ones stand before each."""
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda x: x == g)).cast("string")))


def _pairs(text: Column) -> Column:
    """The pairs of neighbouring letters of a text."""
    return F.transform(F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: i < F.length(text)), lambda i: F.substring(text, i, F.lit(2)))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _grams(text: Column) -> Column:
    return _numbered(F.flatten(F.transform(_words(text), lambda w: _pairs(F.concat(F.lit(" "), w, F.lit(" "))))))


def _inner(text: Column) -> Column:
    """Grams of which a stretch may consist: those of the text, of its sorted and of its different words, without the outer blanks."""
    words = _words(text)
    forms = F.array_distinct(F.array(F.array_join(words, " "), F.array_join(F.array_sort(words), " "), F.array_join(F.array_sort(F.array_distinct(words)), " ")))
    return F.transform(forms, lambda f: _numbered(_pairs(f)))


def _rarest(grams: Column, rarity: Column, n: Column) -> Column:
    """The rarest ``n`` of some grams, by a map of how many names have each; unknown ones are the rarest."""
    ranked = F.array_sort(F.transform(grams, lambda g: F.struct(F.coalesce(F.element_at(rarity, g), F.lit(0)).alias("n"), g.alias("g"))))
    return F.transform(F.slice(ranked, F.lit(1), F.greatest(n, F.lit(0)).cast("int")), lambda x: x["g"])


def _posted(strings: DataFrame, column: str, rarity: DataFrame) -> DataFrame:
    """``column, n`` and the grams of a string for near lengths (``near``), as the shorter (``short``) and as the longer (``long``)."""
    text = F.col(column)
    own = strings.select(column, F.lit(1).alias("one"), F.length(column).alias("n"), _grams(text).alias("grams"), _inner(text).alias("inner"), _words(text).alias("words"))
    held = own.join(F.broadcast(rarity), "one")
    repeats = F.size(F.array_distinct("words")) < F.size("words")
    n, total = F.col("n"), F.size("grams")
    near = _rarest(F.col("grams"), F.col("rarity"), F.when(repeats, total).otherwise(total - F.floor(n * LEAST_SHARE)))
    # of the n - 1 inner grams 0.789 n - 1 are common, and one at least
    spare = lambda g: F.size(g) - F.greatest(F.lit(1), F.ceil((F.size(g) + 1) * 0.789 - 1 - 1e-9)) + 1
    short = F.flatten(F.transform("inner", lambda g: _rarest(g, F.col("rarity"), spare(g))))
    letters = F.when(n <= FAR, F.array_distinct(F.split(text, ""))).otherwise(F.array().cast("array<string>"))
    return held.select(
        column, "n", near.alias("near"), F.when(n == 1, F.array(text)).otherwise(F.array_distinct(short)).alias("short"), F.concat("grams", letters).alias("long"), F.array_distinct("words").alias("words")
    )


def _met(slots: DataFrame, names: DataFrame, own: str, other: str, test: Column, most_gap: int | None) -> DataFrame:
    x = slots.select("slot", F.col("n").alias("a"), F.explode(own).alias("gram"))
    y = names.select("city_norm", F.col("n").alias("b"), F.explode(other).alias("gram"))
    if most_gap is None:
        return x.join(y, "gram").where(test).select("slot", "city_norm")
    # the lengths that fit are part of the key
    x = x.withColumn("b", F.explode(F.sequence(F.greatest(F.lit(1), F.col("a") - most_gap), F.col("a") + most_gap))).where(test)
    return x.join(y, ["gram", "b"]).select("slot", "city_norm")


def candidates(slots: DataFrame, names: DataFrame, most_gap: int | None = None) -> DataFrame:
    """Different ``slot`` and ``city_norm`` values to pairs among which each slot's best name of score ``LEAST`` or more is; of the names whose
    lengths differ by ``most_gap`` at most, if that is given."""
    grams = names.select(F.explode(_grams(F.col("city_norm"))).alias("g")).groupBy("g").agg(F.count("*").alias("k"))
    # as many entries as there are pairs of letters, whatever the number of names
    rarity = grams.agg(F.map_from_entries(F.collect_list(F.struct("g", "k"))).alias("rarity")).withColumn("one", F.lit(1))
    x, y = _posted(slots, "slot", rarity), _posted(names, "city_norm", rarity)
    a, b = F.col("a"), F.col("b")
    apart = (F.greatest(a, b) >= NEAR * F.least(a, b)) & (F.greatest(a, b) <= FAR * F.least(a, b))
    near = _met(x, y, "near", "near", F.greatest(a, b) < NEAR * F.least(a, b), most_gap)
    stretch = _met(x, y, "short", "long", apart & (a < b), most_gap).unionByName(_met(x, y, "long", "short", apart & (a > b), most_gap))
    first = y.select(F.explode("words").alias("word"), F.col("n").alias("b"), "city_norm").groupBy("word", "b").agg(F.min("city_norm").alias("city_norm"))
    said = x.select("slot", F.col("n").alias("a"), F.explode("words").alias("word")).join(first, "word").where(apart & (F.abs(a - b) <= most_gap) if most_gap is not None else apart).select("slot", "city_norm")
    return near.unionByName(stretch).unionByName(said).distinct()


@F.pandas_udf(DoubleType())
def _score(slot: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(a, b) for a, b in zip(slot, name, strict=True)], dtype=float)


def _letters(strings: np.ndarray) -> np.ndarray:
    """How often each string has each letter, letters of the same last six bits taken for one."""
    out = np.zeros((len(strings), 64), np.int16)
    for row, s in zip(out, strings, strict=True):
        np.add.at(row, np.frombuffer(s.encode("utf-32-le"), np.uint32) & 63, 1)
    return out


@F.pandas_udf(DoubleType())
def _bound(slot: pd.Series, name: pd.Series) -> pd.Series:
    """A score that ``weighted_ratio`` cannot exceed: a common subsequence has common letters only, and only a word that both
    have, or that one repeats, may lift the score to 100."""
    (x, own), (y, other) = pd.factorize(slot), pd.factorize(name)
    own, other = np.asarray(own, object), np.asarray(other, object)
    a, b = (np.array([len(s) for s in v], np.int32)[k] for v, k in ((own, x), (other, y)))
    common = np.minimum(_letters(own)[x], _letters(other)[y]).sum(axis=1)
    short, long = np.minimum(a, b), np.maximum(a, b)
    gap = long / np.maximum(short, 1)
    out = 200 * common / np.maximum(a + b, 1)
    part = np.where(gap <= FAR, 0.9, 0.6) * 200 * common / np.maximum(short + common, 1)
    out = np.where(gap < NEAR, out, np.maximum(out, part))
    many = np.array([" " in s for s in own])[x] | np.array([" " in s for s in other])[y]
    for i in np.flatnonzero(many):
        v, w = own[x[i]].split(), other[y[i]].split()
        if not set(v).isdisjoint(w) or len(set(v)) < len(v) or len(set(w)) < len(w):
            out[i] = 100
    return pd.Series(out + 1e-9)


def near_cities(slots: DataFrame, names: DataFrame) -> DataFrame:
    """Different ``slot`` values and names ``city_norm, city`` to the best name ``slot, score, city_norm, city`` of those slots that have
    one of score ``LEAST`` or more; of equals the first by its normal form."""
    bound = stored(candidates(slots.select("slot"), names.select("city_norm")).withColumn("bound", _bound("slot", "city_norm")).where(F.col("bound") >= LEAST))
    # the name of the highest bound is scored first, and then only those that may be better
    first = bound.groupBy("slot").agg(F.max(F.struct("bound", "city_norm")).alias("f")).select("slot", F.col("f.city_norm").alias("city_norm"))
    first = stored(first.withColumn("score", _score("slot", "city_norm")))
    rest = bound.join(first.select("slot", F.col("city_norm").alias("tried"), F.col("score").alias("least")), "slot").where("bound >= least AND city_norm != tried")
    scored = first.unionByName(rest.select("slot", "city_norm", _score("slot", "city_norm").alias("score"))).where(F.col("score") >= LEAST)
    best = scored.groupBy("slot").agg(F.min(F.struct((-F.col("score")).alias("s"), "city_norm")).alias("b")).select("slot", (-F.col("b.s")).alias("score"), "b.city_norm")
    return best.join(names.select("city_norm", "city"), "city_norm").select("slot", "score", "city_norm", "city")


def with_near_lengths(slots: DataFrame, names: DataFrame, most_gap: int) -> DataFrame:
    """Of different ``slot`` values those that have a name ``city_norm`` of score ``LEAST`` or more among the names whose lengths differ by ``most_gap`` at most."""
    sizes = [r.n for r in names.select(F.length("city_norm").alias("n")).distinct().collect()]  # a few dozen numbers
    fit = F.exists(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: F.abs(n - F.length("slot")) <= most_gap)
    pairs = candidates(slots.select("slot").where(fit), names.select("city_norm"), most_gap)
    return pairs.where(_bound("slot", "city_norm") >= LEAST).where(_score("slot", "city_norm") >= LEAST).select("slot").distinct()


def _left_of(text: Column, n: int) -> Column:
    """What is left of a text when ``n`` of its letters are left out: 0, 1 or 2; nothing of a text that is too long for that, or too short."""
    size, first, rest = F.length(text), lambda i: F.substring(text, F.lit(1), i - 1), lambda i: F.substring(text, i + 1, size)
    if n == 0:
        return F.array(text)
    if n == 1:
        some = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(first(i), rest(i)))
        return F.when(size.between(2, LEAVE_ONE), F.array_distinct(some)).otherwise(F.array().cast("array<string>"))
    some = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.transform(F.sequence(i + 1, size), lambda j: F.concat(first(i), F.substring(text, i + 1, j - i - 1), rest(j)))))
    return F.when(size.between(3, LEAVE_TWO), F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def _dealt(strings: DataFrame, column: str, pairs: tuple[tuple[int, int], ...]) -> DataFrame:
    """``column`` and the ``key`` of what is left of it when ``own`` letters are left out, for a string that loses ``other`` letters."""
    keys = [F.transform(_left_of(F.col(column), own), lambda x: F.struct(F.xxhash64(F.lit(own), F.lit(other), x).alias("key"), F.lit(own + other).alias("d"))) for own, other in pairs]  # noqa: B023
    return strings.select(column, F.explode(F.concat(*keys)).alias("k")).select(column, "k.key", "k.d")


def closest(slots: DataFrame, names: DataFrame) -> DataFrame:
    """Different ``slot`` values and ``city_norm`` to ``slot, score, city_norm, whole`` for slots whose best name is proven by few letters left out or put in.

    It is the best of all names if ``whole``, else of the names of one word; of equals the first by its normal form. Letters that one string has more are
    counted in pairs: none or one of the slot, with one or two of the name, or one of the slot alone. Others have three at least, or two of the slot.
    """
    # a slot and a name meet by a key of the same numbers of letters, each from its own side
    met = ((0, 0), (0, 1), (0, 2), (1, 0), (1, 1))
    x = _dealt(slots.where("slot != ''"), "slot", met)
    y = names.select("city_norm", F.explode(F.concat(*(F.transform(_left_of(F.col("city_norm"), own), lambda v: F.xxhash64(F.lit(other), F.lit(own), v)) for other, own in met))).alias("key"))  # noqa: B023
    a, b = F.length("slot"), F.length("city_norm")
    ratio = 200.0 * ((a + b - F.col("d")) / 2) / (a + b)
    best = x.join(y.hint("merge"), "key").select("slot", F.struct((-ratio).alias("s"), "city_norm").alias("r")).groupBy("slot").agg(F.min("r").alias("r"))
    best = best.select("slot", (-F.col("r.s")).alias("score"), F.col("r.city_norm").alias("city_norm"))
    two = F.when(a + 2 <= LEAVE_TWO, 200.0 * a / (2 * a + 3)).otherwise(200.0 * a / (2 * a + 2))
    others = F.greatest(two, 200.0 * (a - 2) / F.greatest(2 * a - 2, F.lit(1)), F.lit(MOST_STRETCH))
    one_word = ~F.contains("slot", F.lit(" ")) & ~F.contains("city_norm", F.lit(" "))
    whole = F.col("score") > MOST_WORDS
    proven = best.where((F.length("slot") < LEAVE_ONE) & (F.col("score") > others) & (whole | one_word)).withColumn("whole", whole)
    # keys are hashes, so the score is computed for the one name
    return proven.where(F.abs(_score("slot", "city_norm") - F.col("score")) < 1e-9)
