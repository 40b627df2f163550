"""Generated names, eight ways to disturb them, and how often the right entry is found all the same.

Everything comes from a hash of the row's number, a seed and a place, so a row is the same however rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import ListConfig, Snapshot, search

# The letters of the syllables and the names of the categories.
CONSONANTS, VOWELS = "bdfghjklmnprstvz", "aeiou"
ALPHABET = CONSONANTS + VOWELS
CATEGORIES = ("EXACT", "TYPO_1", "TYPO_2", "TRANSPOSE_NONADJ", "SPACE_INSERT", "FUSED", "DOUBLE_TOKEN", "REMOVE_TOKEN")
SYLLABLES = [c + v + end for i, c in enumerate(CONSONANTS) for j, v in enumerate(VOWELS) for end in ("", CONSONANTS[(i + j + 1) % len(CONSONANTS)])]


def draw(n: int | Column, *place: str | int) -> Column:
    """A number from 0 to n - 1 for each row; place: columns by name, or numbers."""
    seen = [F.col(x) if isinstance(x, str) else F.lit(x) for x in place]
    return F.pmod(F.xxhash64(*seen), n if isinstance(n, Column) else F.lit(n)).cast("int")


def names(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(ord, id, keys): n entries of two or three tokens of two or three syllables."""
    syllable = lambda t, s: F.element_at(F.array(*(F.lit(x) for x in SYLLABLES)), draw(len(SYLLABLES), "ord", seed, t, s) + 1)
    token = lambda t: F.concat(syllable(t, 0), syllable(t, 1), F.when(draw(2, "ord", seed, t, 9) == 1, syllable(t, 2)).otherwise(""))
    name = F.concat_ws(" ", token(0), token(1), F.when(draw(2, "ord", seed, 9, 9) == 1, token(2)))
    return spark.range(n).select(F.col("id").alias("ord")).select("ord", F.concat(F.lit("e"), F.lpad(F.col("ord").cast("string"), 8, "0")).alias("id"), F.array(name).alias("keys"))


def put(s: Column, at: Column, letter: Column) -> Column:
    """s with another letter at `at`, from 0."""
    return F.concat(F.substring(s, F.lit(1), at), letter, F.substring(s, at + 2, F.char_length(s)))


def letters(s: Column) -> Column:
    """The places of a name's letters, from 0."""
    return F.filter(F.sequence(F.lit(0), F.char_length(s) - 1), lambda i: F.substring(s, i + 1, F.lit(1)) != " ")


def pick(places: Column, *place: str | int) -> Column:
    return F.try_element_at(places, draw(F.greatest(F.size(places), F.lit(1)), *place) + 1)


def other(letter: Column, *place: str | int) -> Column:
    """Another letter of the alphabet."""
    rest = F.replace(F.lit(ALPHABET), letter, F.lit(""))
    return F.substring(rest, draw(F.char_length(rest), *place) + 1, F.lit(1))


def disturbed(cases: DataFrame, seed: int) -> DataFrame:
    """cases (n, name) with a column for each category. A typo takes a place of its own and another letter that names have; a
    transposition takes two unlike letters that are not neighbours; a split is inside a token. Null: the name has no such place."""
    s, at = F.col("name"), lambda x, i: F.substring(x, i + 1, F.lit(1))
    out = cases.withColumn("i", pick(letters(s), "n", seed, 1))
    out = out.withColumn("typo", put(s, F.col("i"), other(at(s, F.col("i")), "n", seed, 2)))
    out = out.withColumn("j", pick(F.filter(letters(s), lambda x: x != F.col("i")), "n", seed, 3))
    out = out.withColumn("typos", put(F.col("typo"), F.col("j"), other(at(s, F.col("j")), "n", seed, 4)))
    far = F.filter(letters(s), lambda x: (F.abs(x - F.col("i")) > 1) & (at(s, x) != at(s, F.col("i"))))
    out = out.withColumn("k", pick(far, "n", seed, 5))
    swapped = put(put(s, F.col("i"), at(s, F.col("k"))), F.col("k"), at(s, F.col("i")))
    inner = F.filter(letters(s), lambda x: (x > 0) & (F.substring(s, x, F.lit(1)) != " "))
    out = out.withColumn("m", pick(inner, "n", seed, 6))
    split = F.concat(F.substring(s, F.lit(1), F.col("m")), F.lit(" "), F.substring(s, F.col("m") + 1, F.char_length(s)))
    tokens = F.split(s, " ")
    found = dict(zip(CATEGORIES, (s, F.col("typo"), F.col("typos"), swapped, split, F.replace(s, F.lit(" "), F.lit("")), F.concat(tokens[0], F.lit(" "), s), F.when(F.size(tokens) > 2, F.array_join(F.slice(tokens, F.lit(2), F.size(tokens)), " "))), strict=True))
    return out.select("n", "truth_id", *(x.alias(c) for c, x in found.items()))


def cases(entries: DataFrame, sample: int, seed: int = 42) -> DataFrame:
    """(query_id, q, truth_id, category): of the `sample` entries with the least hash a case in each category; those to lose a token
    are taken among entries of three. Sampling is the feature: a bench asks some of the entries it indexed."""
    named = entries.select(F.col("id").alias("truth_id"), F.col("keys")[0].alias("name"))
    own = named.withColumn("n", F.xxhash64("truth_id", F.lit(seed)))
    take = lambda df: df.orderBy("n", "truth_id").limit(sample)
    wide = lambda df, kinds: disturbed(df, seed).select("truth_id", F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("q")) for c in kinds))).alias("x")).select("truth_id", "x.*")
    all_ = wide(take(own), CATEGORIES[:-1]).unionByName(wide(take(own.where(F.size(F.split("name", " ")) > 2)), CATEGORIES[-1:]))
    return all_.where("q IS NOT NULL").select(F.concat_ws(":", "category", "truth_id").alias("query_id"), "q", "truth_id", "category")


def recall(asked: DataFrame, at: Snapshot, c: ListConfig) -> DataFrame:
    """(category, recall, cases) of cases: how many have their entry among the hits; and a row OVERALL."""
    hits = search(asked.select("query_id", "q"), at, c, with_keys=False).select("query_id", F.col("entry_id").alias("truth_id"), F.lit(1).alias("hit"))
    found = asked.join(hits, ["query_id", "truth_id"], "left").select(F.explode(F.array("category", F.lit("OVERALL"))).alias("category"), "hit")
    return found.groupBy("category").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count(F.lit(1)).alias("cases"))
