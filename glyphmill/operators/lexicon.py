"""Dictionary operators over words (w): membership, confusions, fuzzy suggestions, tries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# What recognition confuses, as (read, meant).
CONFUSIONS = [
    ("iii", "m"),
    ("iii", "ni"),
    ("iii", "in"),
    ("in", "m"),
    ("ni", "m"),
    ("8", "e"),
    ("e", "8"),
    ("5", "s"),
    ("0", "o"),
    ("l", "i"),
]


def members(words: DataFrame, lexicon: DataFrame, column: str = "w", match_case: bool = False) -> DataFrame:
    """``words`` with known, the dictionary's spelling, or null. Case does not count unless ``match_case``; of spellings the least."""
    fold = (lambda c: F.col(c)) if match_case else F.lower
    known = lexicon.select(fold("w").alias("__l"), F.col("w").alias("known")).groupBy("__l").agg(F.min("known").alias("known"))
    return words.join(known, fold(column) == F.col("__l"), "left").drop("__l")


def spelt_as_known(words: DataFrame, lexicon: DataFrame, column: str = "w") -> DataFrame:
    """``words`` with known and same: whether the dictionary's spelling is the word's own, as a page's words are tested."""
    return members(words, lexicon, column).withColumn("same", F.coalesce(F.col("known") == F.col(column), F.lit(False)))


def missing(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    return words.join(lexicon.select(F.lower("w").alias("__l")).distinct(), F.lower("w") == F.col("__l"), "left_anti")


def confusions(words: DataFrame) -> DataFrame:
    """w, at, candidate: each confusion undone once, at each place of a word; a ``?`` in the word may be any letter. The table has ten fixed rows."""
    rules = F.explode(F.array(*[F.struct(F.lit(a).alias("read"), F.lit(b).alias("meant")) for a, b in CONFUSIONS]))
    each = words.select("w", rules.alias("r"), F.explode(F.sequence(F.lit(1), F.greatest(F.length("w"), F.lit(1)))).alias("at"))
    part = F.substring("w", F.col("at"), F.length("r.read"))
    fits = F.forall(F.sequence(F.lit(1), F.length("r.read")), lambda i: F.substring(part, i, F.lit(1)).isin("?") | (F.substring(part, i, F.lit(1)) == F.substring("r.read", i, F.lit(1))))
    each = each.where((F.length(part) == F.length("r.read")) & fits)
    return each.select("w", F.col("at").cast("long").alias("at"), F.concat(F.expr("substring(w, 1, at - 1)"), F.col("r.meant"), F.expr("substring(w, at + length(r.read))")).alias("candidate"))


def _deletions(w: Column) -> Column:
    one = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.when(F.length(w) > 0, one).otherwise(F.array().cast("array<string>"))


def neighbourhood(w: Column) -> Column:
    """The word and what is left of it without one or two letters.

    Words at an edit distance of at most 2 have an entry in common, so the fuzzy join is an equi join.
    """
    one = _deletions(w)
    return F.array_distinct(F.concat(F.array(w), one, F.flatten(F.transform(one, _deletions))))


def fuzzy(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """w, suggestion, distance: for words that no dictionary word equals, the nearest within 2; of equals the first."""
    q = missing(words, lexicon).select("w", F.explode(neighbourhood(F.col("w"))).alias("k"))
    d = lexicon.select(F.col("w").alias("word"), F.explode(neighbourhood(F.col("w"))).alias("k"))
    pairs = q.join(d, (q["k"] == d["k"]) & (F.abs(F.length("w") - F.length("word")) <= 2)).select("w", "word").distinct()  # a pair may meet on several keys
    near = pairs.withColumn("distance", F.levenshtein("w", "word", 2)).where("distance >= 0")
    best = near.groupBy("w").agg(F.min(F.struct("distance", "word")).alias("b"))
    return best.select("w", F.col("b.word").alias("suggestion"), F.col("b.distance").cast("long").alias("distance"))


def _prefixes(lexicon: DataFrame) -> DataFrame:
    return lexicon.select("w").distinct().select("w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("n"))


def trie_size(lexicon: DataFrame) -> DataFrame:
    """nodes: of the trie, with the start mark and an end mark for each word."""
    prefixes = _prefixes(lexicon).select(F.expr("substring(w, 1, n)").alias("p")).distinct().agg(F.count(F.lit(1)).alias("n"))
    ends = lexicon.select("w").distinct().agg(F.count(F.lit(1)).alias("m"))
    return prefixes.join(ends).select((F.col("n") + F.col("m") + 1).alias("nodes"))  # one row each


def dawg_size(lexicon: DataFrame) -> DataFrame:
    """nodes: of the smallest automaton whose nodes have letters: distinct pairs of a letter and what may follow it.

    What may follow is summed up as its size and hashes as rows arrive, never collected.
    """
    p = _prefixes(lexicon).select(F.expr("substring(w, 1, n)").alias("p"), F.expr("substring(w, n + 1)").alias("rest"))
    each = p.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rest")).alias("x"), F.sum(F.xxhash64(F.lit("#"), "rest").cast("decimal(38,0)")).alias("s"))
    return each.select(F.expr("right(p, 1)").alias("ch"), "n", "x", "s").distinct().agg((F.count(F.lit(1)) + 2).alias("nodes"))


def osa_distance(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, no part edited twice."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
    return row[-1]


def osa_distances(a: list[str], b: list[str]) -> np.ndarray:
    """The same for many pairs at once: one step for each cell of the longest pair's table, over all pairs."""
    longest = (max(map(len, a), default=0), max(map(len, b), default=0))
    codes = [np.zeros((len(a), longest[k]), dtype=np.int32) - 1 - k for k in (0, 1)]
    for k, words in enumerate((a, b)):
        for row, w in enumerate(words):
            codes[k][row, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<i4")
    table = np.zeros((longest[0] + 1, longest[1] + 1, len(a)), dtype=np.int32)
    table[:, 0], table[0] = np.arange(longest[0] + 1)[:, None], np.arange(longest[1] + 1)[:, None]
    x, y = codes[0].T, codes[1].T
    for i in range(1, longest[0] + 1):
        for j in range(1, longest[1] + 1):
            d = np.minimum(np.minimum(table[i - 1, j], table[i, j - 1]) + 1, table[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
            if i > 1 and j > 1:
                swapped = (x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1])
                d = np.where(swapped, np.minimum(d, table[i - 2, j - 2] + 1), d)
            table[i, j] = d
    return table[[len(w) for w in a], [len(w) for w in b], np.arange(len(a))]


@F.pandas_udf(IntegerType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(a), dtype="object")
    size = a.str.len().fillna(0).to_numpy() * (len(a) + 1) + b.str.len().fillna(0).to_numpy()
    order = [k for k in np.argsort(size, kind="stable") if a.iloc[k] is not None and b.iloc[k] is not None]
    for lo in range(0, len(order), 1000):  # pairs of like lengths together, so tables are no larger than they need be
        own = order[lo : lo + 1000]
        out.iloc[own] = osa_distances([a.iloc[k] for k in own], [b.iloc[k] for k in own]).tolist()
    return out


def trie_nodes(lexicon: DataFrame) -> DataFrame:
    """prefix, parent, letter, depth, children (the letters that follow, in order), ends (whether a word ends here) of each node but the root's."""
    each = lexicon.select("w").distinct().select("w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("n"))
    each = each.select(F.expr("substring(w, 1, n)").alias("prefix"), F.expr("substring(w, n + 1, 1)").alias("follows"), F.col("n").alias("depth"))
    nodes = each.groupBy("prefix", "depth").agg(F.sort_array(F.collect_set(F.when(F.col("follows") != "", F.col("follows")))).alias("children"), F.bool_or(F.col("follows") == "").alias("ends"))
    return nodes.select("prefix", F.expr("substring(prefix, 1, depth - 1)").alias("parent"), F.expr("right(prefix, 1)").alias("letter"), F.col("depth").cast("long").alias("depth"), "children", "ends")


def automaton(lexicon: DataFrame) -> DataFrame:
    """prefix, state: the node of the smallest automaton that a prefix ends in, named by the least prefix that ends there.

    Prefixes with the same last letter share a node where the same endings may follow; these are summed up as their number
    and hashes as rows arrive, never collected.
    """
    p = _prefixes(lexicon).select(F.expr("substring(w, 1, n)").alias("prefix"), F.expr("substring(w, n + 1)").alias("rest"))
    each = p.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rest")).alias("x"), F.sum(F.xxhash64(F.lit("#"), "rest").cast("decimal(38,0)")).alias("s"))
    same = ["letter", "n", "x", "s"]
    each = each.withColumn("letter", F.expr("right(prefix, 1)"))
    states = each.groupBy(*same).agg(F.min("prefix").alias("state"))
    return each.join(states, same).select("prefix", "state")


class Trie:
    """Words as nested dictionaries; the key ``""`` ends a word."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = {}

    def suggest(self, word: str, budget: int = 2, delete: bool = True) -> tuple[int, list[str]]:
        """The least cost within ``budget`` and the words at it, sorted.

        A letter matches itself and ``?`` matches any; another letter or one that the word lacks costs 1; letters left
        at the end cost 1 each; a confusion at the word's head is undone at no cost, never twice at one place. ``delete``:
        letters inside the word may be left out, too, at 1 each.
        """
        best, found = budget, {}
        seen: dict[tuple[int, str, bool], int] = {}

        def walk(node: dict, path: str, rest: str, cost: int, undone: bool) -> None:
            nonlocal best
            if cost > best:
                return
            key = (id(node), rest, undone)
            if seen.get(key, budget + 1) <= cost:
                return
            seen[key] = cost
            if "" in node:
                total = cost + (0 if rest == "?" else len(rest))
                if total <= best:
                    best = total
                    found[path] = min(total, found.get(path, total))
            if rest and not undone:
                for read, meant in CONFUSIONS:
                    if len(rest) >= len(read) and all(r in ("?", c) for r, c in zip(rest, read, strict=False)):
                        walk(node, path, meant + rest[len(read) :], cost, True)
            for c, child in node.items():
                if not c:
                    continue
                if rest:
                    walk(child, path + c, rest[1:], cost + (rest[0] not in (c, "?")), False)
                walk(child, path + c, rest, cost + 1, undone)
            if delete and rest:
                walk(node, path, rest[1:], cost + 1, False)

        walk(self.root, "", word, 0, False)
        return best, sorted(w for w, d in found.items() if d == best)


#: Variants of a word from which it is walked instead.
MOST_VARIANTS = 256


def variants(word: str, rules: list[tuple[str, str]], most: int = MOST_VARIANTS) -> list[str] | None:
    """The word with confusions undone at any places, never twice at one; None for over ``most``."""
    out, todo = set(), [("", word, False)]
    while todo:
        done, rest, undone = todo.pop()
        if not rest:
            out.add(done)
            if len(out) > most:
                return None
            continue
        todo.append((done + rest[0], rest[1:], False))
        if not undone:
            todo += [(done, meant + rest[len(read) :], True) for read, meant in rules if rest.startswith(read)]
    return sorted(out)


#: Dictionary words to a trie, and query words to a task, at most about.
TRIE_WORDS, TASK_WORDS = 100_000, 20_000


def trie_suggestions(words: DataFrame, lexicon: DataFrame, delete: bool = True, trie_words: int = TRIE_WORDS, task_words: int = TASK_WORDS, most: int = MOST_VARIANTS) -> DataFrame:
    """w, suggestion, distance: what the trie walk suggests, of the nearest words the first.

    What a walk that may leave out letters finds is the nearest dictionary word, within two edits, to any variant of the
    word; so variants meet the dictionary in the fuzzy join. Words with a ``?``, of over ``most`` variants, and all words
    where no letter may be left out, are walked (``walked``).
    """
    if not delete:
        return walked(words, lexicon, False, trie_words, task_words)
    # a rule that gives as many letters as it takes, and letters that no dictionary word has, can't help: bounded by the alphabet
    letters = {r[0] for r in lexicon.select(F.explode(F.split("w", ""))).distinct().collect()}
    rules = [(a, b) for a, b in CONFUSIONS if len(a) != len(b) or set(b) <= letters]

    @F.pandas_udf("array<string>")
    def rewritten(w: pd.Series) -> pd.Series:
        return pd.Series([None if "?" in x else variants(x, rules, most) for x in w], dtype=object)

    each = words.select("w").distinct().withColumn("v", rewritten("w"))
    q = each.where("v is not null").select("w", F.explode("v").alias("v")).select("w", "v", F.explode(neighbourhood(F.col("v"))).alias("k"))
    d = lexicon.select(F.col("w").alias("word")).distinct().select("word", F.explode(neighbourhood(F.col("word"))).alias("k"))
    pairs = q.join(d, (q["k"] == d["k"]) & (F.abs(F.length("v") - F.length("word")) <= 2)).select("w", "v", "word").distinct()
    near = pairs.select("w", "word", F.levenshtein("v", "word", 2).cast("long").alias("distance")).where("distance >= 0")
    best = near.groupBy("w").agg(F.min(F.struct("distance", "word")).alias("b")).select("w", F.col("b.word").alias("suggestion"), "b.distance")
    rest = each.where("v is null").select("w")
    return best if rest.isEmpty() else best.unionByName(walked(rest, lexicon, True, trie_words, task_words))


def walked(words: DataFrame, lexicon: DataFrame, delete: bool = True, trie_words: int = TRIE_WORDS, task_words: int = TASK_WORDS) -> DataFrame:
    """w, suggestion, distance by the trie walk over ``lexicon`` (w); of the nearest words the first.

    A dictionary of any size is cut into parts of ``trie_words``; each task has one part and some of the words, which meet
    all parts, and the nearest of the parts' suggestions is taken.
    """
    n_words, n_lexicon = words.count(), lexicon.count()
    parts, shares = max(1, -(-n_lexicon // trie_words)), max(1, -(-n_words // task_words), min(words.sparkSession.sparkContext.defaultParallelism, n_words))
    asked = words.select("w").withColumn("share", F.pmod(F.xxhash64("w"), F.lit(shares)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    known = lexicon.select("w").withColumn("part", F.pmod(F.xxhash64("w"), F.lit(parts)).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def walk(own: pd.DataFrame, dictionary: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(dictionary):
            return pd.DataFrame({"w": [], "suggestion": [], "distance": []}).astype({"distance": "int64"})
        trie = Trie(dictionary["w"].tolist())
        got = [(w, *trie.suggest(w, delete=delete)) for w in own["w"]]
        return pd.DataFrame([(w, s[0], d) for w, d, s in got if s], columns=["w", "suggestion", "distance"])

    keys = ["part", "share"]
    found = asked.repartition(parts * shares, *keys).groupBy(*keys).cogroup(known.repartition(parts * shares, *keys).groupBy(*keys)).applyInPandas(walk, "w string, suggestion string, distance long")
    best = found.groupBy("w").agg(F.min(F.struct("distance", "suggestion")).alias("b"))
    return best.select("w", "b.suggestion", "b.distance")
