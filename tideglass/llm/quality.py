"""Quality rules by distribution divergence, with DataFrame operations only.

Each text gives a histogram of character classes and one of common words.  Both are compared by
Jensen-Shannon distance with the reference of the text's language, which is the sum of the histograms of
all documents of that language; texts too short for a stable histogram are not judged by it.  Common words are
compared among themselves, and a text with far fewer of them than its language has fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written

#: Common words by language; a text in another language is compared with the sum over all documents.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "as", "was", "on", "be", "by", "are", "this", "at", "from", "an"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "est", "que", "dans", "pour", "sur", "par", "elle", "pas", "vous", "aux"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "für"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo"),
}
#: Character classes by Java regex; what is in none of them is the last class.
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()-]", r"[#*$%&|<>]")
SPACE_CLASS = 3
LEAST_CHARS, LEAST_WORDS = 200, 50
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.2, 0.75
#: Common words are compared among themselves from so many on; their share of all words must be over so much of the language's share.
LEAST_COMMON, LEAST_COMMON_SHARE = 20, 0.25
WINDOW, MOST_REPEATED_PERCENT, LEAST_TOTAL_WORDS = 5, 20, 10


def _count(column: str, pattern: str) -> Column:
    return F.regexp_count(column, F.lit(pattern)).cast("bigint")


def _next(hashes: str, more: str, places: int) -> Column:
    """Hashes of runs of words joined with those of the runs that begin `places` words on: longer runs by one hash each."""
    return F.zip_with(hashes, F.slice(more, places + 1, F.greatest(F.size(more) - places, F.lit(0))), lambda x, y: F.when(y.isNotNull(), x.bitwiseXOR(F.shiftleft(y, places))))


def _windows(d: DataFrame) -> DataFrame:
    """windows: 64-bit hashes of all windows of five words, null unless some window of four occurs twice; a hash is an exclusive or of shifted hashes of the words."""
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    d = d.withColumn("two", _next("hashes", "hashes", 1))
    d = d.withColumn("four", F.slice(_next("two", "two", 2), 1, F.greatest(F.size("words") - 3, F.lit(0))))
    again = F.size(F.array_distinct("four")) < F.size("four")
    return d.withColumn("windows", F.when(again, F.slice(_next("four", "hashes", WINDOW - 1), 1, F.greatest(F.size("words") - WINDOW + 1, F.lit(0)))))


def _repeated() -> tuple[Column, Column]:
    """Words in windows of five that occur twice or more; windows are compared by 64-bit hash."""
    # only texts with fewer distinct hashes than windows are looked at further
    order = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    covered = F.expr(
        f"""
        aggregate(
            array_sort(transform(filter(transform(sorted, (x, k) -> named_struct('i', x.i, 'twice',
                (k > 0 and x.h = sorted[k - 1].h) or (k < size(sorted) - 1 and x.h = sorted[k + 1].h))), x -> x.twice), x -> x.i)),
            named_struct('n', 0L, 'upto', -1),
            (a, i) -> named_struct('n', a.n + {WINDOW} - greatest(0, a.upto - i + 1), 'upto', i + {WINDOW} - 1),
            a -> a.n)
        """
    )
    return order, covered


def _classes(d: DataFrame) -> DataFrame:
    """classes: characters of each class.  The classes have no character in common, so what the most frequent one holds is taken out run by run before the others are counted."""
    d = d.withColumn("no_lower", F.regexp_replace("text", f"{CLASSES[0]}+", "")).withColumn("rest", F.regexp_replace("no_lower", f"{CLASSES[SPACE_CLASS]}+", ""))
    counts = [_count("rest", c) for c in CLASSES]
    counts[0] = (F.length("text") - F.length("no_lower")).cast("bigint")
    counts[SPACE_CLASS] = (F.length("no_lower") - F.length("rest")).cast("bigint")
    return d.withColumn("classes", F.array(*counts))


def base_columns(docs: DataFrame) -> DataFrame:
    """The counts of each text; words are runs of characters other than 0x20 and 0x09-0x0D."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    d = docs.select("doc_id", "lang", text.alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)).withColumn("lines", lines)
    d = _classes(_windows(d))
    order, covered = _repeated()
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("sorted", F.when(repeats, order)).withColumn("repeated", F.when(F.col("sorted").isNotNull(), covered).otherwise(F.lit(0)).cast("bigint"))
    every = sorted(set().union(*COMMON_WORDS.values()))
    common = F.transform(F.filter("words", lambda w: F.lower(w).isin(*every)), lambda w: F.lower(w))
    return d.select(
        "doc_id", F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise("").alias("lang"),
        F.size("words").cast("bigint").alias("n_words"),
        F.length("text").cast("bigint").alias("n_chars"),
        "classes",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.col("repeated").alias("n_repeat_words"),
        common.alias("common"),
    )


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays that sum to 1."""

    def part(a: Column, m: Column) -> Column:
        return F.when((a > 0) & (m > 0), a * F.log2(a / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def judge(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, the counts, base_failed, class_distance, word_distance, kept.

    Null and empty texts have no words and fail.  A null or unknown language is compared with all
    documents.  Distances are null under the minimum lengths and then do not count against a text.  word_distance is of
    the common words among themselves.
    Repeated rows and null ids each give a row; an empty table gives an empty result; extra columns
    are not read.
    """
    counts = written(_histograms(base_columns(docs)), "quality")
    size = max(map(len, COMMON_WORDS.values())) + 1
    sums = [F.sum(F.element_at("classes", i + 1)).alias(f"c{i}") for i in range(len(CLASSES) + 1)] + [F.sum(F.element_at("words", i + 1)).alias(f"w{i}") for i in range(size)]
    # one row for each language of COMMON_WORDS and one for the others: a fixed number of rows and columns
    rows = {r["lang"]: r for r in counts.groupBy("lang").agg(*sums).limit(len(COMMON_WORDS) + 1).collect()}

    def sums_of(lang: str, prefix: str, n: int) -> list[float]:
        use = [rows[lang]] if lang else list(rows.values())
        return [float(sum(r[f"{prefix}{i}"] or 0 for r in use)) for i in range(n)]

    def by_language(of) -> Column:
        out = of("")
        for lang in rows:
            if lang:
                out = F.when(F.col("lang") == lang, of(lang)).otherwise(out)
        return out

    def reference(prefix: str, n: int) -> Column:
        def of(lang: str) -> Column:
            v = sums_of(lang, prefix, n)
            return F.array(*(F.lit(x / (sum(v) or 1.0)) for x in v))

        return by_language(of)

    def common_share(lang: str) -> Column:
        v = sums_of(lang, "w", size)
        return F.lit(sum(v[:-1]) / (sum(v) or 1.0))

    def share(name: str) -> Column:
        total = F.aggregate(name, F.lit(0).cast("bigint"), lambda s, x: s + x)
        return F.transform(name, lambda x: x / F.greatest(total, F.lit(1)).cast("double"))

    d = counts.withColumn("class_distance", F.when(F.col("n_chars") >= LEAST_CHARS, _distance(share("classes"), reference("c", len(CLASSES) + 1))))
    # common words are compared only for languages that have a list
    long = (F.col("n_words") >= LEAST_WORDS) & (F.col("lang") != "")
    d = d.withColumn("common", F.slice("words", 1, size - 1)).withColumn("n_common", F.col("n_words") - F.element_at("words", -1))
    d = d.withColumn("word_distance", F.when(long & (F.col("n_common") >= LEAST_COMMON), _distance(share("common"), reference("w", size - 1))))
    few = long & (F.col("n_common") < LEAST_COMMON_SHARE * F.col("n_words") * by_language(common_share))
    failed = (F.col("n_words") < LEAST_TOTAL_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    odd = (F.coalesce("class_distance", F.lit(0.0)) > MOST_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD_DISTANCE) | few
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~odd).alias("kept"),
        F.round("class_distance", 9).alias("class_distance"), F.round("word_distance", 9).alias("word_distance"),
    )


def _histograms(d: DataFrame) -> DataFrame:
    """Counts of each class (the last: all other characters) and of each common word of the row's language (the last: all other words)."""
    size = max(map(len, COMMON_WORDS.values()))
    lists = F.create_map(*(x for lang, words in COMMON_WORDS.items() for x in (F.lit(lang), F.array(*map(F.lit, words)))))
    d = d.withColumn("own", F.coalesce(F.element_at(lists, F.when(F.col("lang") != "", F.col("lang")).otherwise("en")), F.array().cast("array<string>")))
    # each common word as one letter of a text, whose letters are then counted
    letters = "".join(chr(ord("A") + i) for i in range(size))
    spelled = F.array_join(F.transform("common", lambda w: F.substring(F.lit("@" + letters), F.array_position("own", w).cast("int") + 1, F.lit(1))), "")
    d = d.withColumn("spelled", spelled)
    words = F.slice(F.array(*((F.length("spelled") - F.length(F.replace("spelled", F.lit(x), F.lit("")))).cast("bigint") for x in letters)), 1, F.size("own"))
    known = F.aggregate("classes", F.lit(0).cast("bigint"), lambda s, x: s + x)
    d = d.withColumn("found", words)
    rest = F.col("n_words") - F.aggregate("found", F.lit(0).cast("bigint"), lambda s, x: s + x)
    pad = F.array_repeat(F.lit(0).cast("bigint"), size - F.size("found"))
    return d.select(
        "doc_id", "lang", "n_words", "n_chars", "n_dup_lines", "n_repeat_words",
        (F.col("n_chars") - F.element_at("classes", 4)).alias("word_chars"), F.element_at("classes", 6).alias("n_symbols"),
        F.concat("classes", F.array(F.col("n_chars") - known)).alias("classes"), F.concat("found", pad, F.array(rest)).alias("words"),
    )
