"""Corpus scores of translations: character n-gram F and edits with block shifts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest gram of characters, and how much more recall weighs than precision.
ORDERS = 6
BETA = 2
#: Blocks that may be shifted: so many words at most, so far at most, and so many tries a sentence.
BLOCK = 10
DISTANCE = 50
TRIES = 1000


@F.pandas_udf(T.ArrayType(T.LongType()))
def gram_statistics(said: pd.Series, gold: pd.Series) -> pd.Series:
    """For each order: grams said (none where the reference has none of that order), grams of the reference, grams in common."""

    def one(a: str, b: str) -> list[int]:
        out = []
        for n in range(1, ORDERS + 1):
            x, y = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (a, b))
            out += [x.total() if y else 0, y.total(), (x & y).total()]
        return out

    return pd.Series([one(a or "", b or "") for a, b in zip(said, gold, strict=True)])


def chrf(rows: DataFrame, said: str, gold: str) -> DataFrame:
    """(chrf): 0 to 100 over all rows together. White space doesn't count; nulls are empty; orders that a side has none of are left out of the mean.

    Rows give 18 counts each, which Spark adds up; the score is made of the 18 sums.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\s\p{Z}]+", "")
    counts = rows.select(gram_statistics(bare(said), bare(gold)).alias("s"))
    sums = counts.agg(*[F.coalesce(F.sum(F.col("s")[i]), F.lit(0)).alias(f"s{i}") for i in range(3 * ORDERS)])
    each = [(F.col(f"s{3 * i}"), F.col(f"s{3 * i + 1}"), F.col(f"s{3 * i + 2}")) for i in range(ORDERS)]
    both = [F.when((p > 0) & (g > 0), 1).otherwise(0) for p, g, _ in each]
    used = sum(both[1:], both[0])
    mean = lambda side: sum((F.coalesce(F.try_divide(m, (p, g)[side]), F.lit(0.0)) * b for (p, g, m), b in zip(each, both, strict=True)), F.lit(0.0)) / F.greatest(used, F.lit(1))
    sums = sums.select(mean(0).alias("p"), mean(1).alias("r"))
    f = F.try_divide((1 + BETA**2) * F.col("p") * F.col("r"), BETA**2 * F.col("p") + F.col("r"))
    return sums.select((100 * F.coalesce(f, F.lit(0.0))).alias("chrf"))


def _table(said: list[int], gold: np.ndarray) -> np.ndarray:
    """Edit distances of all beginnings of ``said`` (rows) and ``gold`` (columns)."""
    steps = np.arange(len(gold) + 1)
    out = np.empty((len(said) + 1, len(gold) + 1), np.int64)
    out[0] = steps
    for i, word in enumerate(said):
        best = np.minimum(out[i] + 1, np.concatenate([[i + 1], out[i][:-1] + (gold != word)]))
        out[i + 1] = np.minimum.accumulate(best - steps) + steps  # insertions run along the row
    return out


def _alignment(table: np.ndarray, said: list[int], gold: np.ndarray) -> tuple[list[bool], list[bool], list[int]]:
    """Which words said and which of the reference are in error, and the place of the last word said before or at each of the reference's."""
    i, j = len(said), len(gold)
    wrong_said, wrong_gold, at = [False] * i, [False] * j, [-1] * j
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + (said[i - 1] != gold[j - 1]):
            i, j = i - 1, j - 1
            wrong_said[i] = wrong_gold[j] = bool(said[i] != gold[j])
            at[j] = i
        elif i and table[i, j] == table[i - 1, j] + 1:
            i -= 1
            wrong_said[i] = True
        else:
            j -= 1
            wrong_gold[j] = True
            at[j] = i - 1
    return wrong_said, wrong_gold, at


def _moved(words: list[int], start: int, n: int, to: int) -> list[int]:
    """The words with a block taken out and put before what stood at ``to``."""
    block, rest = words[start : start + n], words[:start] + words[start + n :]
    place = to if to <= start else max(to - n, start)
    return rest[:place] + block + rest[place:]


def edits(said: list[str], gold: list[str]) -> int:
    """Fewest edits found: insertions, deletions, substitutions, and shifts of blocks, each of which counts as one.

    As long as a shift lowers the other edits, the one that lowers them most is made: of equal ones the longer block, then the leftmost
    block, then the leftmost place. A block may move if its words stand together in the reference, if it holds an error where it is and
    the reference one where it would match, and if that isn't where it lies already; it goes beside what is aligned before or
    within its match.
    """
    number = {w: k for k, w in enumerate(dict.fromkeys([*said, *gold]))}
    words, aim = [number[w] for w in said], np.array([number[w] for w in gold], np.int64)
    shifts, tries = 0, 0
    while True:
        table = _table(words, aim)
        now = int(table[-1, -1])
        if not now or tries >= TRIES:
            return shifts + now
        wrong_said, wrong_gold, at = _alignment(table, words, aim)
        best = None
        for start in range(len(words)):
            for match in range(max(0, start - DISTANCE), min(len(aim), start + DISTANCE + 1)):
                for n in range(1, BLOCK + 1):
                    if start + n > len(words) or match + n > len(aim) or words[start + n - 1] != aim[match + n - 1]:
                        break
                    if not any(wrong_said[start : start + n]) or not any(wrong_gold[match : match + n]) or start <= at[match] < start + n:
                        continue
                    places = dict.fromkeys([at[match - 1] + 1 if match else 0, *(at[match + k] + 1 for k in range(n))])
                    for to in places:
                        if start <= to <= start + n or tries >= TRIES:
                            continue
                        tries += 1
                        moved = _moved(words, start, n, to)
                        found = (now - int(_table(moved, aim)[-1, -1]), n, -start, -to, moved)
                        best = found if best is None or found[:4] > best[:4] else best
        if best is None or best[0] <= 0:
            return shifts + now
        words, shifts = best[4], shifts + 1


def translation_edits(said: Column, gold: Column) -> Column:
    """(edits, words): the edits of a row, and the words of its reference."""

    @F.pandas_udf("edits long, words long")
    def count(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        pairs = [((x or "").lower().split(), (y or "").lower().split()) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"edits": [edits(x, y) for x, y in pairs], "words": [len(y) for _, y in pairs]})

    return count(said, gold)


def ter(rows: DataFrame, said: str, gold: str) -> DataFrame:
    """(edits, words, ter): all edits over all words of the references, in percent; case doesn't count, nulls are empty. Without a word in the references 100 if there are edits, else 0."""
    each = rows.select(translation_edits(F.col(said), F.col(gold)).alias("e"))
    sums = each.agg(F.coalesce(F.sum("e.edits"), F.lit(0)).alias("edits"), F.coalesce(F.sum("e.words"), F.lit(0)).alias("words"))
    share = F.when(F.col("words") > 0, 100 * F.col("edits") / F.col("words")).otherwise(F.when(F.col("edits") > 0, 100.0).otherwise(0.0))
    return sums.select("edits", "words", share.alias("ter"))
