"""Quality rules: base counts of a text, and its distance from its language's character classes and common words.

For every text two histograms are made: of character classes and of the language's common words (each word its own bin,
all other words one more; capitals and marks around a word don't matter). A language's reference is the sum of the histograms of all its texts that pass the base
rules. A text is rejected if the Jensen-Shannon distance (base 2, from 0 to 1) of one histogram to the reference
exceeds its limit; texts with fewer characters or words than a guard are not judged by that histogram, as short texts
scatter. DataFrame functions only; the texts are read and split once, and only counts are kept.

Null and empty texts have no words; rows with a null lang, or one without a word list, share the reference "". doc_ids may be
null or repeat, and repeated rows are rows like any other, each with its share in the reference. A distance that equals its
limit passes. Whole texts are counted, however long. An empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import stored

#: Frequent function words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "was", "for", "it", "with", "as"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
}
#: Java patterns of runs of the character classes. The first two make one class; what is in none is the last class.
CLASSES = {
    "latin": r"[a-zß-öø-ÿ]+",
    "lower": r"\p{Ll}+",
    "space": r"[ \t-\r]+",
    "upper": r"\p{Lu}+",
    "digit": r"\p{N}+",
    "point": r"[.,;:!?'\"()-]+",
    "counted": r"[#*$%&|<>]+",
    "symbol": r"[=+_/\\^~`@\[\]{}]+",
}
#: Characters that don't belong to a word at its ends, however many there are.
MARKS = ".,;:!?'\"()-"


@dataclass(frozen=True)
class Limits:
    """Parameters of the rules."""

    least_words: int = 10
    repeat_percent: int = 20
    class_distance: float = 0.18
    #: Common words are under a fifth of usual text, so a text without any is only about 0.3 away from its reference.
    word_distance: float = 0.26
    class_least_chars: int = 200
    word_least_words: int = 50
    common: dict[str, list[str]] = field(default_factory=lambda: COMMON_WORDS)


def repeated_places(docs: DataFrame) -> DataFrame:
    """Add `_places`: sorted starts of the windows of 5 of `_words` found twice or more; null where there are none.

    Windows are compared by 64-bit hashes. Only if some hash repeats are they sorted with their places: n log n.
    """
    # windows of 1, 2, 4 and then 5 words; zip_with fills the last places with nulls, which the slice leaves out
    after = lambda name, k: F.slice(name, k + 1, F.size(name))
    joined = lambda name, other, k: F.zip_with(
        name, after(other, k), lambda a, b: a.bitwiseXOR(F.shiftleft(b, k))
    )
    docs = docs.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    docs = docs.withColumn("_h2", joined("_h1", "_h1", 1))
    docs = docs.withColumn("_h4", joined("_h2", "_h2", 2))
    docs = docs.withColumn("_h5", joined("_h4", "_h1", 4))
    docs = docs.withColumn("_hashes", F.slice("_h5", 1, F.greatest(F.lit(0), F.size("_words") - 4)))
    ordered = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))
    repeated = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    docs = docs.withColumn("_ordered", F.when(repeated, ordered))
    # neighbours in the order have the same hash; -1 and the size have no neighbour
    hash_at = lambda k: F.get("_ordered", k)["h"]
    hit = F.transform(
        "_ordered",
        lambda x, k: F.when(
            (F.coalesce(hash_at(k + 1), F.bitwise_not(x["h"])) == x["h"]) | (F.coalesce(hash_at(k - 1), F.bitwise_not(x["h"])) == x["h"]), x["i"]
        ),
    )
    return docs.withColumn("_places", F.array_sort(F.filter(hit, lambda x: x.isNotNull())))


def covered(places: Column) -> Column:
    """Words under windows of 5 that start at these sorted places."""
    # the last place is 5 wide, any other as far as to the next place
    widths = F.zip_with(
        places,
        F.slice(places, 2, F.size(places)),
        lambda a, b: F.when(b.isNull(), F.lit(5)).otherwise(F.least(F.lit(5), b - a)),
    )
    return F.aggregate(widths, F.lit(0), lambda s, x: s + x)


def text_counts(docs: DataFrame, limits: Limits, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """A row of counts for each row of docs: the base counts, `classes` and `common` histograms, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lang = F.when(F.col(lang_col).isin(*limits.common), F.col(lang_col)).otherwise(F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), text.alias("_text"))
    out = out.withColumn("_words", F.filter(F.split("_text", "[ \t-\r]+"), lambda w: w != ""))
    out = repeated_places(out)
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.regexp_like(x, F.lit("[^ \t-\r]"))))
    lists = F.create_map(*[x for k, v in limits.common.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    out = out.withColumn("_list", F.coalesce(F.try_element_at(lists, F.col("lang")), F.array().cast("array<string>")))
    # a common word may have capitals, and marks around it; longer words without marks at their ends are none
    longest = max([1, *(len(w.encode()) for ws in limits.common.values() for w in ws)])
    marked = lambda end: F.lit(MARKS).contains(end)
    short = F.filter(
        "_words", lambda w: (F.octet_length(w) <= longest) | marked(F.left(w, F.lit(1))) | marked(F.right(w, F.lit(1)))
    )
    plain = F.transform(short, lambda w: F.lower(F.btrim(w, F.lit(MARKS))))
    out = out.withColumn("_found", F.filter(plain, lambda w: F.array_contains("_list", w)))
    # each class is taken out of what the classes before it have left, so only the first sees the whole text
    out = out.withColumn("_left", F.col("_text"))
    for name, pattern in CLASSES.items():
        out = out.withColumn("_next", F.regexp_replace("_left", pattern, ""))
        out = out.withColumn(f"_{name}", (F.length("_left") - F.length("_next")).cast("long"))
        out = out.withColumn("_left", F.col("_next"))
    out = out.select(
        "doc_id",
        "lang",
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_text") - F.col("_space")).cast("long").alias("word_chars"),
        F.col("_counted").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered(F.col("_places")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length("_text").cast("long").alias("_chars"),
        F.array(F.col("_latin") + F.col("_lower"), *[F.col(f"_{name}") for name in list(CLASSES)[2:]]).alias("_classes"),
        F.transform(
            "_list", lambda c: F.size(F.filter(F.col("_found"), lambda w: w == c)).cast("long")
        ).alias("_common"),
    )
    failed = (F.col("n_words") < limits.least_words) | (
        100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words")
    )
    rest = lambda xs, total: F.concat(xs, F.array(total - F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)))
    return out.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rest(F.col("_classes"), F.col("_chars")).alias("classes"),
        rest(F.col("_common"), F.col("n_words")).alias("common"),
        F.col("_chars").alias("chars"),
        failed.alias("base_failed"),
    )


def references(counts: DataFrame, most: int) -> DataFrame:
    """A row for each language: the summed histograms of its texts. most: the longest word list."""
    total = lambda name, k: F.coalesce(F.sum(F.get(name, F.lit(k))), F.lit(0)).alias(f"{name}{k}")
    sums = counts.groupBy("lang").agg(
        *[total("classes", k) for k in range(len(CLASSES))], *[total("common", k) for k in range(most + 1)]
    )
    return sums.select(
        "lang",
        F.array(*[F.col(f"classes{k}") for k in range(len(CLASSES))]).alias("ref_classes"),
        F.array(*[F.col(f"common{k}") for k in range(most + 1)]).alias("ref_common"),
    )


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts; null if one of them is all zeros."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    na, nb = total(a), total(b)

    def term(x: Column, y: Column) -> Column:
        p, q = F.coalesce(x, F.lit(0)) / na, F.coalesce(y, F.lit(0)) / nb
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    js = F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x) / 2
    return F.when((na > 0) & (nb > 0), F.sqrt(F.greatest(F.lit(0.0), js)))


def distances(counts: DataFrame, references: DataFrame, limits: Limits) -> DataFrame:
    """Add class_distance and word_distance (null: too short to judge, or no reference) and _far."""
    # one row for each word list, and one more: far below any limit for a broadcast
    out = counts.join(F.broadcast(references), "lang", "left")
    judged = lambda ok, a, b: F.when(ok & F.col(b).isNotNull(), js_distance(F.col(a), F.col(b)))
    out = out.withColumn(
        "class_distance", judged(F.col("chars") >= limits.class_least_chars, "classes", "ref_classes")
    ).withColumn(
        "word_distance",
        judged((F.col("n_words") >= limits.word_least_words) & (F.col("lang") != ""), "common", "ref_common"),
    )
    far = (F.coalesce("class_distance", F.lit(0.0)) > limits.class_distance) | (
        F.coalesce("word_distance", F.lit(0.0)) > limits.word_distance
    )
    return out.withColumn("_far", far).drop("ref_classes", "ref_common")


def judge(
    docs: DataFrame,
    limits: Limits | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The base counts, base_failed, class_distance, word_distance (to nine places; null: not judged by it) and kept, for each row."""
    limits = limits or Limits()
    counts = stored(text_counts(docs, limits, id_col, text_col, lang_col), "text-counts")
    # A first reference of all texts that pass the base rules also has the unusual ones in it; a second one, of the
    # texts that are near the first, hasn't. Both have one row for each word list and one more.
    passed = counts.where(~F.col("base_failed"))
    most = max([0, *map(len, limits.common.values())])
    passed = distances(passed, references(passed, most), limits).where(~F.col("_far"))
    out = distances(counts, references(passed, most), limits)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round("class_distance", 9).alias("class_distance"), F.round("word_distance", 9).alias("word_distance"),
        (~F.col("base_failed") & ~F.col("_far")).alias("kept"),
    )
