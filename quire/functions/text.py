"""Column expressions over text: counts, readability, previews, names. All native, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space that separates words (fixed values: the Unicode set that word splitting has to use).
SPACE = r"[\s\u00a0\u0085\u001c-\u001f\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u1680]"
#: Everything else, ASCII first: as ranges, a class is much faster than the negation of a set.
SOLID = r"[\x21-\x84\u0086-\u009f\u00a1-\u167f\u1681-\u1fff\u200b-\u2027\u202a-\u202e\u2030-\u205e\u2060-\u2fff\u3001-\uffff\x{10000}-\x{10ffff}\x00-\x08\x0e-\x1b]"
SENTENCE_MARKS = r"[.!?]+"
TRIM_MARKS = ".,!?;:"


def _c(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def let(value: Column, use) -> Column:
    """use(value) with value computed once: a CASE that names an expression three times would compute it three times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def round2(x: Column) -> Column:
    """Two places, from the binary value: F.round goes through the shortest decimal, so 4.725 (in binary a little less) would become 4.73."""
    return F.floor(x * 100 + 0.5) / 100


def strip(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), f"^{SPACE}+|{SPACE}+$", "")


def words(text: str | Column) -> Column:
    return F.filter(F.split(_c(text), f"{SPACE}+"), lambda w: w != "")


def word_count(text: str | Column) -> Column:
    return F.regexp_count(_c(text), F.lit(SOLID + "+")).cast("long")


def sentence_count(text: str | Column) -> Column:
    """Runs between sentence marks that hold more than white space; counted by one expression, without an array."""
    return F.regexp_count(_c(text), F.lit(f"[^.!?{SPACE[1:-1]}][^.!?]*")).cast("long")


def sentences(text: str | Column) -> Column:
    """Pieces after a sentence mark and white space, trimmed, none empty."""
    return F.filter(F.transform(F.split(_c(text), rf"(?<=[.!?]){SPACE}+"), strip), lambda s: s != "")


def paragraphs(text: str | Column) -> Column:
    return F.filter(F.transform(F.split(_c(text), "\n\n"), strip), lambda s: s != "")


def avg_word_length(text: str | Column) -> Column:
    """Characters of words without the marks at their ends, by the number of words."""
    bare = F.regexp_replace(_c(text), f"(?<!{SOLID})[{TRIM_MARKS}]+|[{TRIM_MARKS}]+(?!{SOLID})", "")
    return let(word_count(text), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(round2(F.length(F.regexp_replace(bare, f"{SPACE}+", "")) / n)))


def reading_time(text: str | Column, words_per_minute: int = 200) -> Column:
    show = lambda m: F.when(m < 1, F.concat(F.floor(m * 60).cast("string"), F.lit(" sec"))).otherwise(F.concat(F.floor(m).cast("string"), F.lit(" min")))
    return let(word_count(text) / F.lit(words_per_minute), show)


def plain_words(text: str | Column) -> Column:
    """The lower-case ASCII words, each between single spaces: tokens with other letters or digits are taken out."""
    apart = F.concat(F.lit(" "), F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}_]+", "  "), F.lit(" "))
    return F.regexp_replace(apart, r" [a-z]*[^a-z ][^ ]* ", " ")


def avg_syllables(text: str | Column) -> Column:
    """Mean vowel groups of the ASCII words (1 at least each), rounded to 2 places."""
    counts = lambda w: F.struct(F.regexp_count(w, F.lit("[a-z]+")).alias("n"), (F.regexp_count(w, F.lit("[aeiouy]+")) + F.regexp_count(w, F.lit("(?<= )[b-df-hj-np-tv-xz]+(?= )"))).alias("total"))
    return let(let(plain_words(text), counts), lambda c: F.when(c["n"] == 0, F.lit(1.0)).otherwise(round2(c["total"] / c["n"])))


def complexity_score(text: str | Column) -> Column:
    """Reading ease between 0 (hard) and 100; 50 without words or sentences."""
    parts = F.struct(word_count(text).alias("w"), sentence_count(text).alias("s"), avg_syllables(text).alias("y"))

    def score(p: Column) -> Column:
        ease = F.lit(206.835) - F.lit(1.015) * (p["w"] / p["s"]) - F.lit(84.6) * p["y"]
        return F.when((p["w"] == 0) | (p["s"] == 0), F.lit(50.0)).otherwise(round2(F.greatest(F.lit(0.0), F.least(F.lit(100.0), ease))))

    return let(parts, score)


def computed(text: str | Column) -> Column:
    """The struct of all measures of an enriched chunk."""
    return F.struct(
        word_count(text).alias("word_count"), F.length(_c(text)).cast("long").alias("char_count"), reading_time(text).alias("reading_time"),
        sentence_count(text).alias("sentence_count"), avg_word_length(text).alias("avg_word_length"), complexity_score(text).alias("complexity_score"),
    )


def preview(text: str | Column, n: int, tail: str = "...") -> Column:
    """The first n characters, marked if something follows."""
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(tail))).otherwise(t)


def title_case(text: str | Column) -> Column:
    """A capital after every non-letter, small letters elsewhere."""
    chars = F.split(F.lower(_c(text)), "")
    step = lambda a, c: F.concat(a, F.when((a == "") | ~F.substring(a, -1, 1).rlike(r"\p{L}"), F.upper(c)).otherwise(c))
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(""), step)


def section_header(text: str | Column) -> Column:
    """The header that a chunk's first line is, or null."""
    line = strip(F.substring_index(_c(text), "\n", 1))
    n = word_count(line)
    letters = line.rlike(r"\p{Lu}|\p{Lt}") & ~line.rlike(r"\p{Ll}")
    numbered = r"^(\d+\.)+\s+(.+)"
    bold, slanted = F.regexp_extract(line, r"^\*\*(.+?)\*\*", 1), F.regexp_extract(line, r"^_(.+?)_", 1)
    return (
        F.when((line == "") | (n > 15), F.lit(None).cast("string"))
        .when(letters & (n <= 10), title_case(line))
        .when(line.endswith(":") & (n <= 8), line.substr(F.lit(1), F.length(line) - 1))
        .when(line.rlike(numbered), F.regexp_extract(line, numbered, 2))
        .when((bold != "") & (word_count(bold) <= 10), bold)
        .when((slanted != "") & (word_count(slanted) <= 10), slanted)
    )


GENERIC = r"^(Section \d+$|Section_\d+$|Untitled|Part \d+$|Chapter \d+$)"


def first_sentence_title(text: str | Column, most: int = 80) -> Column:
    """A title from the first sentence, else the first line, without closing marks."""
    t = strip(text)
    sentence = strip(F.regexp_extract(t, r"([^.!?]+[.!?]+)", 1))
    line = strip(F.substring_index(t, "\n", 1))
    found = F.when(sentence != "", sentence).otherwise(line)
    title = F.regexp_replace(found, r"[.!?:;,]+$", "")
    return F.when(t == "", F.lit("Untitled Section")).otherwise(shorten(title, most))


def shorten(title: Column, most: int) -> Column:
    return F.when(F.length(title) > most, F.concat(F.substring(title, 1, most - 3), F.lit("..."))).otherwise(title)


def keyword_title(keywords: str | Column, text: str | Column, most: int = 80) -> Column:
    found = _c(keywords)
    title = F.concat(F.lit("Section: "), F.concat_ws(", ", F.transform(F.slice(found, 1, 3), title_case)))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, shorten(title, most)).otherwise(first_sentence_title(text, most))


def slug(text: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}_\s-]", ""), r"[-\s]+", "_")


def file_name(path: str | Column) -> Column:
    return F.substring_index(F.substring_index(_c(path), "/", -1), "\\", -1)


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def one_line(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(_c(text), f"{SPACE}+", " "))


def running_key(text: str | Column) -> Column:
    """Lines that differ in numbers or emphasis only have one key."""
    return F.lower(F.regexp_replace(one_line(F.regexp_replace(_c(text), r"[*_#`]+", "")), r"\d+", "#"))


def without_placeholders(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), r"\[Image:\s*\d+x\d+\]\s*", "")


def human_size(n: str | Column) -> Column:
    n = _c(n).cast("double")
    size = lambda x, unit: F.concat(F.format_string("%.1f", x), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" bytes"))).when(n < 1024**2, size(n / 1024, "KB")).when(n < 1024**3, size(n / 1024**2, "MB")).otherwise(size(n / 1024**3, "GB"))


def escape_field(text: str | Column) -> Column:
    return F.replace(F.replace(F.coalesce(_c(text), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def escape_value(text: str | Column) -> Column:
    t = F.replace(F.replace(_c(text), F.lit(","), F.lit("\\,")), F.lit("="), F.lit("\\="))
    return F.replace(t, F.lit("\n"), F.lit(" "))


def line_kind(line: str | Column) -> Column:
    """What a Markdown line is; the first rule that fits."""
    t = _c(line)
    return (
        F.when(strip(t).startswith("```"), "code_fence")
        .when(t.rlike(r"^\s*[-*+]\s+") | t.rlike(r"^\s*\d+\.\s+"), "list_item")
        .when(t.rlike(r"\[([^\]]+)\]\(([^)]+)\)"), "link")
        .when(t.rlike(r"!\[([^\]]*)\]\(([^)]+)\)"), "image")
        .when(strip(t).startswith(">"), "blockquote")
        .otherwise("text")
    )


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / norms)
